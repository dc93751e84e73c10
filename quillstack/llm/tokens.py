"""Token counts with a whole-token shortcut.

Offline, the driver proves which vocabulary strings the library encodes alone as one token. Pre-tokens
found in that set count one each; only the rest are merged, once per worker and distinct pre-token. The driver also
learns which characters the library's older tables don't know, so that pre-tokens are the library's own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quillstack.llm.chunks import Memo, runs, spans
from quillstack.llm.common import map_texts
from quillstack.llm.splits import Splitter, of_tokenizer

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


@lru_cache(maxsize=4)
def _loaded(path: str) -> tuple[Tokenizer, regex.Pattern, regex.Pattern | None]:
    with open(path) as f:
        added = [a["content"] for a in json.load(f).get("added_tokens", [])]
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return Tokenizer.from_file(path), regex.compile(public_tokenizers.PATTERN), special


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as that one token.

    At most as many as the vocabulary has entries, so it may be broadcast.
    """
    tok, pattern, _ = _loaded(path)
    vocab = tok.get_vocab(with_added_tokens=False)
    ids = list(vocab.values())
    texts = [tok.decode([i], skip_special_tokens=False) for i in ids]
    ok = [(t, i) for t, i in zip(texts, ids, strict=True) if t and "�" not in t and (m := pattern.match(t)) and m.end() == len(t)]
    encoded = tok.encode_batch([t for t, _ in ok], add_special_tokens=False)
    return frozenset(t for (t, i), e in zip(ok, encoded, strict=True) if e.ids == [i])


class Counter:
    """Counts tokens of whole texts as the library does, special strings of a text included."""

    def __init__(self, path: str, whole: frozenset[str], stand_ins: dict[int, str]):
        self.tok, pattern, self.special = _loaded(path)
        self.pattern = Splitter(pattern.pattern, stand_ins)
        self.whole = whole
        self.pieces = Memo(self._piece)
        self.later = Memo(lambda span: self._split(" " + span))
        self.first = Memo(self._split, kept=50_000)

    def _piece(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.tok.model.tokenize(self._visible(piece)))

    def _visible(self, piece: str) -> str:
        return self.tok.pre_tokenizer.pre_tokenize_str(piece)[0][0]

    def _split(self, span: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern(span)))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        n, start = 0, self.first
        for part in runs(text):
            head, tail = spans(part)
            n += start[head] + sum(map(self.later.__getitem__, tail))
            start = self.later
        return n

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)  # odd places hold the special strings, one token each
        return sum(map(self._plain, parts[::2])) + len(parts) // 2


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per document: its id (null allowed), n_bytes, n_tokens, over_limit.

    A null text counts as empty: no bytes, no tokens. Repeated rows stay repeated; other columns are not read.
    No shuffle: one pass over the text column.
    """
    path = public_tokenizers.path(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((whole_tokens(path), of_tokenizer(_loaded(path)[0])))

    def rows(batches) -> Iterator[pa.RecordBatch]:
        count = _counters.get(tokenizer)
        if count is None:
            count = _counters[tokenizer] = Counter(public_tokenizers.path(tokenizer), *shared.value)
        for kept, texts in batches:
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, text_col, [id_col], f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", rows)
