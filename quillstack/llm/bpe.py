"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A bucket per merge rank holds the linked-list positions whose pair merges into that rank. A two-level
bitmap of the non-empty buckets gives the lowest rank by find-first-set; entries whose pair has changed
since are skipped when met. Every pre-token that isn't itself a token goes through the queue, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstack.llm.chunks import KEPT, runs, spans
from quillstack.llm.common import map_texts
from quillstack.llm.splits import Splitter, of_tiktoken

RANKS = "byte_bpe_50k.tiktoken"
#: Characters up to which pre-tokens share a queue; longer ones get one each.
SHORT = 200
#: Characters of text whose new pre-tokens are merged together.
GROUP = 6_000_000


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one pre-token: always the lowest-ranked adjacent pair, leftmost on ties."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    ends = [*range(1, n + 1), n]  # ends[i]: where the part that starts at i ends and the next one starts
    before = [*range(-1, n)]  # start of the part before
    at = [get(piece[i:i + 2], -1) for i in range(n)]  # rank of the pair that starts at i; an entry of another rank is stale
    at[-1] = -1
    buckets: dict[int, list[int]] = {}  # each a heap of starts
    leaves: dict[int, int] = {}
    top = 0

    def push(r: int, i: int) -> None:
        nonlocal top
        if r in buckets:
            heappush(buckets[r], i)
        else:
            buckets[r] = [i]
            high = r >> 8
            leaves[high] = leaves.get(high, 0) | 1 << (r & 255)
            top |= 1 << high

    for i, r in enumerate(at):
        if r >= 0:
            push(r, i)
    while top:
        high = (top & -top).bit_length() - 1
        leaf = leaves[high]
        low = leaf & -leaf
        r = (high << 8) + low.bit_length() - 1
        bucket = buckets[r]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[r]
            leaves[high] = leaf = leaf ^ low
            if not leaf:
                top ^= 1 << high
        if at[i] != r:
            continue
        j = ends[i]
        end = ends[i] = ends[j]
        at[j] = -1
        before[end] = i
        x = get(piece[i:ends[end]], -1) if end < n else -1
        at[i] = x
        if x >= 0:
            push(x, i)
        k = before[i]
        if k >= 0:
            x = get(piece[k:end], -1)
            if x != at[k]:  # else its entry still holds
                at[k] = x
                if x >= 0:
                    push(x, k)
    out, i = [], 0
    while i < n:
        j = ends[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Pairs:
    """Merged rank of every two tokens whose joined bytes are a token: sorted keys, found by bisection."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values()) + 1
        found = [(ranks[t[:i]] * (self.none + 1) + ranks[t[i:]], r) for t, r in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, self.values = np.array(sorted(found), np.int64).reshape(-1, 2).T.copy()
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.values = np.append(self.values, -1)
        self.byte = np.array([ranks.get(bytes([i]), self.none) for i in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """The token ids of many short pre-tokens by one queue: their linked lists lie side by side, with an end mark
    between that merges with nothing. The next rank is taken in all of them at once, in each at its leftmost place."""
    if not pieces:
        return []
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)
    ids = pairs.byte[np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)]
    marks = np.cumsum(lengths + 1) - 1
    ids[marks] = pairs.none
    size = len(ids)
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)  # before[0] is the last mark
    at = np.append(pairs(ids[:-1], ids[1:]), -1)  # rank of the pair that starts here; an entry of another rank is stale
    alive = np.ones(size, bool)
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    order = at.argsort(kind="stable")
    order = order[np.searchsorted(at[order], 0):]
    firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
    for r, start, stop in zip(at[order[firsts]].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(order)][:len(firsts)], strict=True):
        buckets[r] = order[start:stop].tolist()
        leaves[r >> 8] = leaves.get(r >> 8, 0) | 1 << (r & 255)
        top |= 1 << (r >> 8)
    while top:
        high = (top & -top).bit_length() - 1
        leaf = leaves[high]
        low = leaf & -leaf
        r = (high << 8) + low.bit_length() - 1
        i = np.array(buckets.pop(r))
        i = i[at[i] == r]
        rest = []
        if len(i) > 1:
            i.sort()
            first = np.append(True, owner[i[1:]] != owner[i[:-1]])
            if not first.all():
                rest, i = i[~first].tolist(), i[first]
        if rest:
            buckets[r] = rest
        else:
            leaves[high] = leaf = leaf ^ low
            if not leaf:
                top ^= 1 << high
        if not len(i):
            continue
        j = after[i]
        end = after[j]
        after[i], before[end], ids[i], at[j], alive[j] = end, i, r, -1, False
        k = before[i]
        both = np.concatenate((k, i))
        x = pairs(np.concatenate((ids[k], ids[i])), np.concatenate((ids[i], ids[end])))
        new = (x >= 0) & (x != at[both])
        at[both] = x
        for y, z in zip(x[new].tolist(), both[new].tolist(), strict=True):
            if y in buckets:
                buckets[y].append(z)
            else:
                buckets[y] = [z]
                leaves[y >> 8] = leaves.get(y >> 8, 0) | 1 << (y & 255)
                top |= 1 << (y >> 8)
    parts = alive.nonzero()[0]
    stops = np.searchsorted(parts, marks)
    flat = ids[parts].tolist()
    return [flat[a:b] for a, b in zip([0, *(stops[:-1] + 1).tolist()], stops.tolist(), strict=True)]


class Codec:
    """Encodes and decodes whole texts with one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        self.pairs = Pairs(self.ranks)
        self.pattern = Splitter(pattern, of_tiktoken(pattern))
        self.words: list[bytes] = [b""] * self.pairs.none
        for token, i in self.ranks.items():
            self.words[i] = token
        self.decimal = [str(i) for i in range(self.pairs.none)]
        self.pieces: dict[str, bytes] = {}  # ids of pre-tokens, and of spans at the start of a text and later on
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _learn(self, heads: set[str], tails: set[str]) -> None:
        cut = [(self.first, h, self.pattern(h)) for h in heads - self.first.keys()]
        cut += [(self.later, t, self.pattern(" " + t)) for t in tails - self.later.keys()]
        short: list[str] = []
        for piece in {p for _, _, pieces in cut for p in pieces} - self.pieces.keys():
            whole = self.ranks.get(piece.encode())
            if whole is not None:
                self.pieces[piece] = array("I", [whole]).tobytes()
            elif len(piece) <= SHORT:
                short.append(piece)
            else:
                self.pieces[piece] = array("I", merge(piece.encode(), self.ranks)).tobytes()
        for piece, ids in zip(short, merge_many([p.encode() for p in short], self.pairs), strict=True):
            self.pieces[piece] = array("I", ids).tobytes()
        for memo, span, pieces in cut:
            memo[span] = b"".join(map(self.pieces.__getitem__, pieces))

    def _forget(self) -> None:
        for memo in (self.pieces, self.first, self.later):
            if len(memo) > KEPT or sum(map(len, memo.values())) > 64 * KEPT:
                memo.clear()

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        at = 0
        while at < len(texts):
            if len(texts[at]) > GROUP:
                yield self._long(texts[at])
                at += 1
                continue
            cut, room = [], GROUP
            while at < len(texts) and len(texts[at]) <= room:
                cut.append(spans(texts[at]))
                room -= len(texts[at])
                at += 1
            self._learn({h for h, _ in cut}, set().union(*(t for _, t in cut)))
            for head, tail in cut:
                yield np.frombuffer(self.first[head] + b"".join(map(self.later.__getitem__, tail)), "<u4").tolist()
            self._forget()

    def _long(self, text: str) -> list[int]:
        """The same for one text, run by run, so that its spans are never held all at once."""
        out, start = array("I"), self.first
        for part in runs(text):
            head, tail = spans(part)
            if start is self.first:
                self._learn({head}, set(tail))
            else:
                self._learn(set(), {head, *tail})
            out.frombytes(start[head])
            for span in tail:
                out.frombytes(self.later[span])
            self._forget()
            start = self.later
        return out.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null or empty text has an empty array. No shuffle."""
    def rows(batches) -> Iterator[pa.RecordBatch]:
        c = codec(public_tokenizers.path(ranks), pattern)
        for kept, texts in batches:
            for at in range(0, len(texts), 256):
                part = texts[at:at + 256]
                yield pa.RecordBatch.from_arrays([kept.column(0).slice(at, len(part)), pa.array(list(c.encode_all(part)), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>", rows)


def decode(encoded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, bytes binary) of every row of ids; null ids decode to no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(public_tokenizers.path(ranks), pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
                       pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256 per row, in one pass without a shuffle.

    A null text is the empty text: no tokens, digests of nothing. Repeated rows stay repeated.
    """
    def rows(batches) -> Iterator[pa.RecordBatch]:
        c = codec(public_tokenizers.path(ranks), pattern)
        sha = hashlib.sha256
        for kept, texts in batches:
            n, a, b = [], [], []
            for ids in c.encode_all(texts):
                n.append(len(ids))
                a.append(sha(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
