"""Packing by minimum bin slack.

Documents are tokenised and cut into pieces once. Only the histogram of piece lengths, which has at most
``window`` rows, reaches the driver. There a bitset subset-sum picks, for the longest length left, the multiset
of other lengths that fills the window closest to capacity; it is repeated as often as the counts allow, so
there are at most window * (1 + 1/2 + ... + 1/window) patterns whatever the number of documents. Pieces then find
their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm.common import map_texts, materialise

TOKENIZER = "word_bpe_49k.json"
END = 1
WINDOW = 2048

# Words are what lies between white space of ASCII; they never share a token. Pieces are the tokeniser's own.
_words = regex.compile(r"[^\x20\x09-\x0D]+")
_controls = regex.compile(r"[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Kinds of the characters of Latin-1: a letter or digit, s white space of ASCII, o white space beyond, p full stop or
# comma, x other signs.
_kinds = bytes(ord("s" if chr(i) in " \t\n\r\x0b\x0c" else "o" if chr(i).isspace() else "p" if chr(i) in ".," else "a" if regex.match(r"[\p{L}\p{N}]", chr(i)) else "x") for i in range(256))
#: Words, and pieces of words, that a worker keeps before it forgets them all.
KEPT = 700_000
#: All are forgotten after a text with a longer one, so memory is bounded.
LONGEST = 200


def _simple(word: str) -> bool:
    """Whether the tokeniser's normaliser only lower-cases the word, letter by letter as Python does."""
    return word.isascii() or word.isprintable() and is_normalized("NFC", word) and "\u0130" not in word and "\u03a3" not in word


def words_of(text: str) -> list[str]:
    """Strings without white space whose ids, one after another, are those of the text."""
    try:
        kinds = text.encode("latin-1").translate(_kinds)
    except UnicodeEncodeError:
        pass
    else:  # is in normal form, and lower case goes letter by letter
        # full stops and commas next to other signs would be one piece with them
        if not (b"o" in kinds or b"pp" in kinds or b"px" in kinds or b"xp" in kinds or "<|" in text):
            return text.lower().replace(".", " . ").replace(",", " , ").split()
    # str.split() also splits at white space beyond ASCII, so it serves only texts without any
    return _words.findall(text) if _controls.search(text) else text.split()


class Words:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, from the ids of their words.

    The library encodes each new word; words that only differ in case or in punctuation share their pieces,
    which it encodes side by side in one text.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}  # of words and of pieces of words, which are words themselves

    def _learn(self, words: set[str]) -> None:
        cut, whole, new = [], [], set()
        for w in words:
            if w.isalpha() and w.islower() and (w.isascii() or max(w) < "\u0100"):
                new.add(w)  # one piece
            elif "<|" in w or not _simple(w):
                whole.append(w)
            else:
                pieces = _pieces.findall(w.lower())
                cut.append((w, pieces))
                new.update(pieces)
        new = list(new.difference(self.memo))
        for at in range(0, len(new), 1000):
            part = new[at:at + 1000]
            found = self.tok.encode(" ".join(part), add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            stops = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part)), side="right")).tolist()
            start = 0
            for piece, stop in zip(part, stops, strict=True):
                self.memo[piece] = raw[start:stop]
                start = stop
        for w, pieces in cut:
            self.memo[w] = b"".join(map(self.memo.__getitem__, pieces))
        for w, e in zip(whole, self.tok.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            cut = [words_of(t) for t in texts[at:at + 64]]
            found = [list(map(self.memo.get, words)) for words in cut]
            new = {w for words, ids in zip(cut, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
            self._learn(new)
            for words, ids in zip(cut, found, strict=True):
                yield b"".join(map(self.memo.__getitem__, words) if None in ids else ids)
            if len(self.memo) > KEPT or any(len(w) > LONGEST for w in new):
                self.memo.clear()


_loaded: dict[str, Words] = {}


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, then the rest, halved if longer than half a window."""
    out = [(i, window) for i in range(0, n - window + 1, window)]
    start, rest = n - n % window, n % window
    if rest > window // 2:
        out.append((start, window // 2))
        start, rest = start + window // 2, rest - window // 2
    if rest:
        out.append((start, rest))
    return out


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
               end: int = END, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, piece_key) of every piece; no shuffle."""
    closing = np.array([end], "<u4").tobytes()

    def rows(batches) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Words(public_tokenizers.path(tokenizer))
        for kept, texts in batches:
            places, starts, lengths, crcs, totals = [], [], [], [], []
            for place, ids in enumerate(_loaded[tokenizer](texts)):
                ids += closing
                n = len(ids) // 4
                for start, length in cuts(n, window):
                    places.append(place)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)]))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays(
                [kept.column(0).take(pa.array(places, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long", rows)


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset within counts whose sum comes closest to room, by bitset subset sums."""
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before, left, k = reach, min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies, then the rest: every count up to the whole is reached
            k = min(k, left)
            reach |= reach << length * k & mask
            left -= k
            k *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            out.append((length, n))
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, how many in each sequence)]) until no piece is left."""
    counts = {length: n for length, n in histogram.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = dict(fill(counts, window - longest))
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in pattern.items())
        for length, n in pattern.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
        out.append((times, sorted(pattern.items(), reverse=True)))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         end: int = END, window: int = WINDOW, group: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is the empty text and gives one piece, its end id. Repeated rows are packed each for itself; null
    ids are kept. Other columns are not read. An empty table gives no rows. Pieces of one length are ranked in
    buckets of about ``group`` pieces by a hash of the piece, so no length gathers in one task.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, id_col, text_col, tokenizer, end, window), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    most = max(histogram.values(), default=0)
    places, first, used = [], 0, dict.fromkeys(histogram, 0)
    for times, pattern in plan(histogram, window):
        offset = 0
        for length, n in pattern:
            places.append((length, used[length], n, first, offset))
            used[length] += times * n
            offset += length * n
        first += times
    places.sort()
    table = spark.sparkContext.broadcast(np.array(places, np.int64).reshape(-1, 5))

    buckets = max(1, -(-most // group))
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))
    pieces = pieces.withColumn("bucket", bucket)
    sizes = pieces.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] << 40 | t[:, 1] if len(t) else np.empty(0, np.int64)
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            _, start, each, sequence, offset = t[at].T
            k = rank - start
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(sequence + k // each), pa.array(offset + k % each * length)],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
