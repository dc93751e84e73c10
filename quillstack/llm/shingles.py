"""Near-duplicates by SimHash fingerprints and the exact Jaccard similarity of word shingles.

Texts become sets of hashed shingles; equal sets are one class. MinHash bands leave the classes without a partner out.
Fingerprints within a few bits, found by the generalised pigeonhole search, propose the first pairs. They can't reach
all sets of a similarity of 0.8, so shared rare shingles propose the rest: two sets that are similar enough share one of
the rarest shingles of either, as far as the similarity lets these differ. Every pair is verified on the whole sets. Of
a meeting place, classes are compared with one hub first, and then only those that are not yet in the hub's component
with the others. Numbers of shingles that nobody else has, and bitmaps whose differing bits count shingles that differ,
rule pairs out inside the join; so a group of near copies doesn't become all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import components, map_texts, materialise
from quillstack.llm.simhash import keep_least, links, majority, shingle_hashes
from quillstack.scratch import discard

WORDS, SIMILARITY, LIMIT = 5, 0.8, 3
#: Sets of similarity s meet with probability 1 - (1 - s ** ROWS) ** BANDS: all but 3 in a million at 0.8.
BANDS, ROWS = 24, 4
#: Bits of the filter that leaves most sets without a partner out of the shuffle; 64 a row on the driver.
FILTER = 1 << 24
#: Words of 64 bits in a set's bitmap.
MAP = 8
#: Bytes of sets in one Arrow batch.
BATCH = 8 << 20
_factors = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """One key a band: equal where the ROWS smallest hashes of the band are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at:at + 4096] * _factors[:, None]).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)], np.uint64).view(np.int64)


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, key, fp, n, bands, hashes) of every row: the set's digest, the fingerprint, the set's size, band keys and hashes. No shuffle."""
    def rows(batches) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "fp", "n", "bands", "hashes"]
        for kept, texts in batches:
            held, fps, began, size = [], [], 0, 0
            for i, text in enumerate(texts, 1):
                hashes = shingle_hashes(text.encode(), words, 42)
                fps.append(majority(hashes))
                held.append(np.unique(hashes))
                size += held[-1].nbytes
                if size < BATCH and i < len(texts):
                    continue
                data = [h.tobytes() for h in held]
                keys = np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64).view(np.int64)
                met = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([bands(h) for h in held])))
                yield pa.RecordBatch.from_arrays([kept.column(0).slice(began, i - began), pa.array(keys), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([len(h) for h in held], pa.int32()),
                                                  met, pa.array(data, pa.binary())], names=names)
                held, fps, began, size = [], [], i, 0

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, key long, fp long, n int, bands array<long>, hashes binary", rows)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, key, n): every hash of every set."""
    for b in batches:
        n = b.column("n").to_numpy()
        ends = np.cumsum(n)
        cuts = [0, *(np.flatnonzero(np.diff(ends // (BATCH // 8))) + 1).tolist(), len(n)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            data = np.frombuffer(b"".join(b.column("hashes").slice(i, j - i).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(data), pa.array(np.repeat(b.column("key").to_numpy()[i:j], n[i:j])), pa.array(np.repeat(n[i:j], n[i:j]))], names=["token", "key", "n"])


def rare(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, key, n, shared): the shingles of each set (key, n, hashes) of which any set that similar has one among its own.

    shared: how many of a set's n shingles another set has. In the order of how many sets have them, a set's first
    n - ceil(similarity * n) + 1 shingles are enough; those that no other set has come first and lead nowhere.
    """
    tokens = sets.mapInArrow(_tokens, "token long, key long, n int")
    common = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    of_key = Window.partitionBy("key")
    ranked = tokens.join(common, "token").withColumns({"shared": F.count("*").over(of_key), "rank": F.row_number().over(of_key.orderBy("sets", "token"))})
    return ranked.where(F.col("rank") <= F.col("shared") - F.ceil(similarity * F.col("n") - 1e-9) + 1).select("token", "key", "n", F.col("shared").cast("int").alias("shared"))


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes that fall on each bit: two sets differ in at least as many hashes as bitmaps do in bits."""
    odd = np.bincount((found & np.uint64(64 * MAP - 1)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _shared(similarity: float):
    """Whether what two sets share with any other lets them be that similar."""
    return F.least("shared", "other_shared") >= similarity / (1 + similarity) * (F.col("n") + F.col("other_n")) - 1e-9


def _alike(similarity: float):
    """Whether the bits in which their bitmaps differ let two sets be that similar."""
    differ = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"other_m{i}"))) for i in range(1, MAP)), F.bit_count(F.col("m0").bitwiseXOR(F.col("other_m0"))))
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("other_n")) + 1e-9


def _partners(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys that meet another in a band, of a size that lets them be similar; rows come sorted by band, size and key."""
        last: tuple[int, int, int] | None = None
        said = True  # whether the last key has been given out
        for b in batches:
            if not b.num_rows:
                continue
            band, n, key = (c.to_numpy() for c in b.columns)
            if last:
                band, n, key = (np.append(x, y) for x, y in zip(last, (band, n, key), strict=True))
            close = (band[1:] == band[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-9)
            hit = np.append(False, close) | np.append(close, False)
            if last and said:
                hit[0] = False
            said = bool(hit[-1]) or bool(last and said and len(band) == 1)
            last = (band[-1], n[-1], key[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[hit])], names=["key"])
    return run


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets are that similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            keep = []
            for i in range(b.num_rows):
                u, v = np.frombuffer(x[i].as_buffer(), "<u8"), np.frombuffer(y[i].as_buffer(), "<u8")
                small, large = (u, v) if len(u) <= len(v) else (v, u)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, key (digest of its shingles), component_id.

    component_id is the smallest id reachable by links of at least that Jaccard similarity, itself included. Texts
    without words are alike, and like no other. Null ids name no component: such a row takes the smallest known id it
    reaches, or null. Repeated rows stay repeated. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = materialise(shingled(docs, id_col, text_col, words), "shingles")
    classes = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    met = classes.where("n > 0").select(F.explode("bands").alias("band"), "n", "key")
    met = met.repartition("band").sortWithinPartitions("band", "n", "key").mapInArrow(_partners(similarity), "key long")
    word = F.shiftright("key", 6).bitwiseAND(FILTER // 64 - 1)
    bits = met.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("v"))
    filled = np.zeros(FILTER // 64, np.int64)
    for w, v in bits.toLocalIterator():  # FILTER / 64 rows at most
        filled[w] = v
    shared = spark.sparkContext.broadcast(filled)
    maps = [f"m{i}" for i in range(MAP)]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("key").to_numpy()
            b = b.filter(pa.array((shared.value[k >> 6 & FILTER // 64 - 1] >> (k & 63) & 1).astype(bool)))
            found = np.array([bitmap(np.frombuffer(h, "<u8")) for h in b.column("hashes").to_pylist()], np.int64).reshape(-1, MAP)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, i].copy()) for i in range(MAP))], names=["key", "fp", "n", "hashes", *maps])

    schema = "key long, fp long, n int, hashes binary, " + ", ".join(f"{m} long" for m in maps)
    sets = rows.where("n > 0").select("key", "fp", "n", "hashes").mapInArrow(partnered, schema).dropDuplicates(["key"])
    sets = materialise(sets, "sets")

    # fingerprints: classes of one fingerprint with the least of them, and these as the pigeonhole search links them
    least = sets.groupBy("fp").agg(F.min("key").alias("rep"))
    same = sets.join(least, "fp").where("key <> rep").select("key", F.col("rep").alias("other_key"))
    near = links(materialise(least, "fingerprints"), LIMIT).select(F.col("a").alias("key"), F.col("b").alias("other_key"))
    linked = materialise(_verified(_pairs(same.union(near)), sets, similarity), "links")

    places = materialise(rare(sets.select("key", "n", "hashes"), similarity), "places")
    fields = ("key", "n", "shared")
    hubs = places.groupBy("token").agg(F.max_by(F.struct(*fields), F.struct(F.col("shared") / F.col("n"), -F.col("key"))).alias("hub"))
    hubs = hubs.select("token", *(F.col(f"hub.{c}").alias(f"other_{c}") for c in fields))

    def named(reached: DataFrame) -> DataFrame:
        """Places with the components that are known so far."""
        label = reached.select(F.col("node").alias("key"), "component")
        return materialise(places.join(label, "key", "left").select("token", *fields, F.coalesce("component", "key").alias("component")), "named")

    def apart(now: DataFrame) -> DataFrame:
        """Members of each place that aren't in its hub's component, with hub."""
        hub = hubs.join(now.select("token", *(F.col(c).alias(f"other_{c}") for c in ("key", "component"))), ["token", "other_key"])
        return now.join(hub, "token").where("component <> other_component")

    for whole in (False, True):
        reached = components(linked)
        now = named(reached)
        found = apart(now).where(_shared(similarity))
        if whole:  # those apart with all of the hub's component, and with one another; bitmaps go only where such are
            rest = materialise(apart(now).select("token", *fields, "component", F.col("other_component").alias("main")), "rest")
            others = now.join(rest.select("token").distinct(), "token", "left_semi").join(sets.select("key", *maps), "key")
            others = others.select("token", *(F.col(c).alias(f"other_{c}") for c in (*fields, *maps, "component")))
            found = rest.join(sets.select("key", *maps), "key").join(others, "token").where(
                (F.col("component") != F.col("other_component")) & ((F.col("other_component") == F.col("main")) | (F.col("key") < F.col("other_key"))) & _shared(similarity) & _alike(similarity))
        more = materialise(_verified(_pairs(found), sets, similarity), "links")
        linked = linked.union(more)
        discard(now, *([rest] if whole else []))
    if more.limit(1).count():
        reached = components(linked)

    joined = classes.join(reached, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    joined = materialise(joined, "joined")
    names = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = rows.select("doc_id", "key").join(joined.join(names, "component").select("key", "component_id"), "key", "left").select("doc_id", "key", "component_id")
    found = materialise(found, "found")
    discard(rows, classes, sets, places, joined)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each component, that with the smallest id; all columns as they were."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, words, similarity), id_col)
