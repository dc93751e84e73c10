"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary's words get keys that an edit changes in constant time. Blocked Bloom filters, one for each length, have a
fixed size at most and are broadcast. Each word probes the keys of its deletions and of its replacements by greater
letters, which meets every pair of near words once; only positives are shuffled, to an exact join with the vocabulary
and a comparison of the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import map_texts, materialise
from quillstack.scratch import discard

#: Words that are considered have so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times as frequent a word's form must be.
TIMES = 10
#: One of so many runs loses a code point.
LOSES = 31
#: Bits of all filters for each word, and 64-bit blocks of all filters together at most (64 MB).
BITS, MOST_BLOCKS = 16, 1 << 23
#: Blocks in one row on their way to the driver.
CHUNK = 4096
#: Lengths up to this have a filter each, longer ones share one for each doubling.
SHARDS = 64
#: Different words of one partition that are counted before they are given out.
KEPT = 200_000
#: Probes at once.
PROBES = 1 << 18

_run = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
# Two primes of 31 bits, a base for each: a key is both remainders of a word's polynomial.
_P = np.array([2147483647, 2147483629], np.uint64)
_BASE = (np.uint64(1_103_515_245), np.uint64(1_540_483_477))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, loses: int = LOSES) -> DataFrame:
    """(word, n): lower-cased runs of letters with the counts of one partition; a word may come several times.

    Only A-Z are lower-cased. Where crc32 of "<id>:<run>" is divisible by ``loses``, the run loses a code point.
    """
    def rows(batches) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter[str] = Counter()
        for kept, texts in batches:
            for doc, text in zip(kept.column(0).to_pylist(), texts, strict=True):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(_run.findall(text.encode("utf-8", "surrogatepass").lower())).items():
                    if len(run) < least_length:  # in bytes: it is too short in letters too
                        continue
                    word, h = run.decode(), zlib.crc32(run, head)
                    if h % loses == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_length:
                        found[word] += n
                if len(found) >= KEPT:
                    yield out()
                    found.clear()
        yield out()

    return map_texts(docs, text_col, [id_col], "word string, n long", rows)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each begins (and the last ends)."""
    ends = np.cumsum([0, *map(len, words)])
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64), ends


def _powers(n: int) -> list[np.ndarray]:
    """base ** i for i up to n, of each prime; doubled until it is long enough."""
    out = []
    for p, base in zip(_P, _BASE, strict=True):
        found = np.array([1, base], np.uint64)
        while len(found) <= n:
            step = found[-1] * base % p
            found = np.concatenate([found, found * step % p])
        out.append(found[:n + 1])
    return out


def _sums(terms: np.ndarray, p: np.uint64) -> np.ndarray:
    """Remainders of the sums of the first 0, 1, 2, ... terms; terms are below 2 ** 31, a row has at most 2 ** 32 of them."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % p])


def keys(words: list[str]) -> np.ndarray:
    """A key of 62 bits for each word: sums of (letter + 1) * base ** place."""
    letters, ends = _letters(words)
    length = np.diff(ends)
    place = np.arange(len(letters)) - np.repeat(ends[:-1], length)
    both = []
    for p, powers in zip(_P, _powers(int(length.max(initial=0))), strict=True):
        sums = _sums((letters + np.uint64(1)) * powers[place] % p, p)
        both.append((sums[ends[1:]] + p - sums[ends[:-1]]) % p)
    return (both[0] << np.uint64(31) | both[1]).view(np.int64)


def shard(length: np.ndarray) -> np.ndarray:
    """Which filter words of a length are in."""
    return np.where(length <= SHARDS, length, SHARDS + np.frexp(length.astype(np.float64))[1]).astype(np.int64)


class Filters:
    """Where each shard's blocks lie, and which block and bits a key has there."""

    def __init__(self, counts: dict[int, int], bits: int = BITS, most: int = MOST_BLOCKS):
        total = max(1, sum(counts.values()))
        share = min(bits / 64, most / total)
        self.first, self.blocks = np.zeros(256, np.int64), np.zeros(256, np.int64)
        at = 0
        for k, n in sorted(counts.items()):
            self.first[k], self.blocks[k] = at, max(1, int(n * share))
            at += self.blocks[k]
        self.size = at

    def place(self, shards: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of keys; a shard without words has no blocks: -1."""
        k = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
        n = self.blocks[shards]
        block = np.where(n > 0, self.first[shards] + ((k >> np.uint64(24)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64), -1)
        one, low = np.uint64(1), np.uint64(63)
        bits = one << (k & low) | one << (k >> np.uint64(6) & low) | one << (k >> np.uint64(12) & low) | one << (k >> np.uint64(18) & low)
        return block, bits


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word number, key, -1 or 0) of deletions and of replacements by greater letters of the alphabet, some at a time."""
    letters, ends = _letters(words)
    length = np.diff(ends)
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(letters)) - ends[:-1][word]
    powers = _powers(int(length.max(initial=0)))
    inverse = [np.uint64(pow(int(b), -1, int(p))) for p, b in zip(_P, _BASE, strict=True)]
    terms = [(letters + np.uint64(1)) * powers[k][place] % p for k, p in enumerate(_P)]
    sums = [_sums(terms[k], p) for k, p in enumerate(_P)]
    whole = [(sums[k][ends[1:]] + p - sums[k][ends[:-1]]) % p for k, p in enumerate(_P)]
    for a in range(0, len(letters), PROBES):
        at = np.arange(a, min(a + PROBES, len(letters)))
        at = at[(place[at] == 0) | (letters[at] != letters[at - 1])]
        w, both = word[at], []
        for k, p in enumerate(_P):
            before = (sums[k][at] + p - sums[k][ends[w]]) % p
            after = (sums[k][ends[w + 1]] + p - sums[k][at + 1]) % p
            both.append((before + after * inverse[k]) % p)
        yield w, (both[0] << np.uint64(31) | both[1]).view(np.int64), -1
    step = max(1, PROBES // max(1, len(alphabet)))
    for a in range(0, len(letters), step):
        span = slice(a, min(a + step, len(letters)))
        row, letter = np.nonzero(alphabet[None, :] > letters[span, None])
        at = row + a
        w, both = word[at], []
        for k, p in enumerate(_P):
            more = (alphabet[letter] - letters[at]) * powers[k][place[at]] % p
            both.append((whole[k][w] + more) % p)
        yield w, (both[0] << np.uint64(31) | both[1]).view(np.int64), 0


def _bits(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, at, bits) of each block that words of a batch fill."""
        for b in batches:
            block, bits = filters.place(shard(b.column("length").to_numpy()), b.column("key").to_numpy())
            order = np.argsort(block, kind="stable")
            block, bits = block[order], bits[order]
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            merged = np.bitwise_or.reduceat(bits, first) if len(block) else bits
            block = block[first]
            yield pa.RecordBatch.from_arrays([pa.array(block // CHUNK), pa.array((block % CHUNK).astype(np.int32)), pa.array(merged.view(np.int64))], names=["chunk", "at", "bits"])
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, data): blocks of a chunk in a row; rows come sorted by chunk."""
    now, data = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "data"])
    for b in batches:
        chunk, at, bits = (c.to_numpy() for c in b.columns)
        for c in np.unique(chunk):
            if c != now:
                if now is not None:
                    yield out()
                now, data = int(c), np.zeros(CHUNK, np.int64)
            here = chunk == c
            np.bitwise_or.at(data, at[here], bits[here])
    if now is not None:
        yield out()


def _probed(filters: Filters, shared, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(source, target) keys of edits that the filters may hold."""
        full = shared.value
        for b in batches:
            words, own = b.column("word").to_pylist(), b.column("key").to_numpy()
            size = np.array([len(w) for w in words], np.int64)
            for w, key, change in edits(words, alphabet):
                block, bits = filters.place(shard(size[w] + change), key)
                hit = (block >= 0) & (full[block] & bits == bits)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[w[hit]]), pa.array(key[hit])], names=["source", "target"])
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, loses: int = LOSES) -> DataFrame:
    """(word, n, length, key) of the words with enough letters and occurrences, as a scratch table."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array([len(w) for w in words], pa.int64()), pa.array(keys(words))], names=["word", "n", "length", "key"])

    found = counted(docs, id_col, text_col, least_length, loses).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return materialise(found.mapInArrow(keyed, "word string, n long, length long, key long"), "vocabulary")


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words of a vocabulary once."""
    spark = words.sparkSession
    # at most 128 shards and 90 letters
    counts = words.groupBy("length").agg(F.count("*").alias("n"))
    by_shard = counts.select(F.when(F.col("length") <= SHARDS, F.col("length")).otherwise(SHARDS + F.length(F.bin("length"))).alias("shard"), "n").groupBy("shard").agg(F.sum("n").alias("n"))
    filters = Filters({int(r.shard): r.n for r in by_shard.collect()})
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()
    alphabet = np.array(sorted(ord(r.c) for r in letters), np.uint64)
    bits = words.select("length", "key").mapInArrow(_bits(filters), "chunk long, at int, bits long")
    bits = bits.groupBy("chunk", "at").agg(F.bit_or("bits").alias("bits"))
    packed = bits.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_packed, "chunk long, data binary")
    full = np.zeros(-(-max(1, filters.size) // CHUNK) * CHUNK, np.uint64)
    for r in packed.toLocalIterator():  # MOST_BLOCKS / CHUNK rows of 32 KB at most
        full[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.data), np.uint64)
    shared = spark.sparkContext.broadcast(full)
    spread = words.select("word", "key").repartition("key")
    positives = spread.mapInArrow(_probed(filters, shared, alphabet), "source long, target long")
    target = words.select(F.col("key").alias("target"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    source = words.select(F.col("key").alias("source"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    met = positives.join(target, "target").join(source, "source").where((F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, loses: int = LOSES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of the largest n, the smallest in code-point order of equals, if that n is at least
    ``times`` its own; root is where forms lead. A null text has no words; a null id counts as an empty one; rows that
    repeat count again. An empty table gives none. Other columns are not read.
    """
    words = vocabulary(docs, id_col, text_col, least_length, least_count, loses)
    pairs = materialise(near_words(words), "near")
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "near", "near_n")
    # the largest n, then the smallest word: strings have no negative, so two steps
    most = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("most"))
    named = both.join(most, "word").where("near_n = most").groupBy("word").agg(F.first("n").alias("n"), F.first("n_near").alias("n_near"), F.min("near").alias("near"), F.first("most").alias("near_n"))
    fits = F.col("near_n") >= times * F.col("n")
    named = named.select("word", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    named = materialise(named, "forms")
    ways = materialise(named.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    used = [pairs, ways]
    while True:  # each form is ``times`` as frequent as its word: a way of 18 steps at most, doubled
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = materialise(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        used.append(ways)
        if ways.where("moved").isEmpty():
            break
        ways = ways.select("word", "root")
    out = words.join(named, "word", "left").join(ways.select("word", F.col("root").alias("_root")), "word", "left")
    out = out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    out = materialise(out, "variants")
    discard(words, named, *used)
    return out
