"""Pre-tokens as a tokeniser's own library finds them, whatever Unicode version it knows.

The ``regex`` module may know letters and numbers that a library's tables have not assigned yet. Only code points that
Python's tables don't know either can differ so; the library itself is asked for the kind of each of them, and where it
says otherwise a stand-in of that kind takes the character's place while the pattern is matched.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

# A letter, a number and a sign that no alternative of a pattern names.
LETTER, NUMBER, SIGN = "x", "1", "?"


@lru_cache(maxsize=1)
def newer() -> str:
    """Letters and numbers of ``regex`` that Python's own tables have unassigned."""
    every = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


def stand_ins(joined: Callable[[list[str]], list[bool]]) -> dict[int, str]:
    """Stand-ins by code point; joined tells of texts of two characters whether the library makes one pre-token of each."""
    chars = newer()
    letters, numbers = joined([LETTER + c for c in chars]), joined([NUMBER + c for c in chars])
    kinds = ((c, LETTER if a else NUMBER if b else SIGN) for c, a, b in zip(chars, letters, numbers, strict=True))
    return {ord(c): kind for c, kind in kinds if kind != (LETTER if regex.match(r"\p{L}", c) else NUMBER)}


def of_tokenizer(tok: Tokenizer) -> dict[int, str]:
    """Stand-ins for the pre-tokeniser of a tokenizers file."""
    def joined(texts: list[str]) -> list[bool]:
        starts = {a for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str("\n".join(texts))}
        return [3 * i + 1 not in starts for i in range(len(texts))]
    return stand_ins(joined)


def of_tiktoken(pattern: str) -> dict[int, str]:
    """Stand-ins for tiktoken with this pattern: a vocabulary of bytes and of LETTER or NUMBER with a leading byte shows what it joins."""
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {first + bytes([lead]): 256 + 64 * k + lead - 0xC0 for k, first in enumerate((LETTER.encode(), NUMBER.encode())) for lead in range(0xC0, 0x100)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return stand_ins(lambda texts: [probe.encode_ordinary(t)[0] >= 256 for t in texts])


class Splitter:
    """Pre-tokens of a text by a pattern, with stand-ins for the characters that need one."""

    def __init__(self, pattern: str, stand_ins: dict[int, str]):
        self.pattern, self.table = regex.compile(pattern), stand_ins
        self.odd = frozenset(map(chr, stand_ins))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.table))]
