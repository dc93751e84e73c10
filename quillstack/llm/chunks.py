"""Memoised tokenisation of the spans between isolated spaces.

A space with a non-space on both sides always starts a new pre-token, so the tokens of the span
" word," depend on nothing else in the text. Spans repeat far more often than texts do, so each worker
keeps the tokens of the spans it has met, up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Spans that a worker keeps before it forgets them all.
KEPT = 800_000
#: Longer spans are never kept, so the memory of a worker is bounded.
LONGEST = 200

# Python's \s holds every white space of the tokenisers' patterns (and a few controls more).
_edge = re.compile(r"(?<=\S) (?=\S)")
_odd = re.compile(r"\s | \s|\A\s|\s\Z")


class Memo(dict):
    """A bounded dict that computes what it lacks."""

    def __init__(self, make: Callable[[str], object], kept: int = KEPT):
        super().__init__()
        self.make, self.kept = make, kept

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.kept:
                self.clear()
            self[key] = value
        return value


#: Characters of a text that are taken apart at once.
RUN = 4_000_000


def runs(text: str, size: int = RUN) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, without the isolated space that starts each part but the first."""
    at = 0
    while len(text) - at > size and (m := _edge.search(text, at + size)):
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


def spans(text: str) -> tuple[str, list[str]]:
    """The first span, and all later ones without the space that starts each of them."""
    parts = _edge.split(text) if _odd.search(text) else text.split(" ")
    return parts[0], parts[1:]
