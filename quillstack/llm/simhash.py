"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints; equal fingerprints are one class. The bits are grouped by their correlation
into partitions. A fingerprint that differs from another in at most t bits differs from it in at most t_i bits in
some partition i, for any thresholds with sum(t_i) = t - partitions + 1, where -1 leaves a partition out. For each
fingerprint dynamic programming picks the thresholds with the fewest estimated candidates, it probes those
partitions' values, and candidates are verified where probes and index entries meet. Only a spanning forest of
each meeting place is kept, so a group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import components, map_texts, materialise

BITS, PARTS, WIDTH = 64, 4, 16
#: Estimated cost of one probe, in candidates.
PROBE = 2
#: Index entries from which a partition's value is split further by the other bits.
HOT = 2048


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; no words: none; too few words: the whole sequence."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    stops = (starts + lengths)[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops, strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that more than half of the hashes have; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """SimHash of the word shingles, repeats included; no words: zero; too few words: the whole sequence."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long. No shuffle."""
    def rows(batches) -> Iterator[pa.RecordBatch]:
        for kept, texts in batches:
            fp = np.array([fingerprint(t.encode(), words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, fp long", rows)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(classes: DataFrame) -> list[list[int]]:
    """The bits in PARTS groups of WIDTH, correlated bits together; from sums over all fingerprints (4160 numbers)."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS))
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            for at in range(0, len(x), 1 << 14):
                part = x[at:at + (1 << 14)]
                total[:BITS] += part.T @ part
                total[BITS, 0] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = classes.select("fp").mapInArrow(sums, "i long, v double").where("v <> 0").groupBy("i").agg(F.sum("v")).collect()
    total = np.zeros((BITS + 1) * BITS)
    for i, v in rows:
        total[i] = v
    total = total.reshape(BITS + 1, BITS)
    n = max(total[BITS, 0], 1)
    p = np.diag(total[:BITS]) / n
    cov = total[:BITS] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for _ in range(PARTS):
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < WIDTH:
            best = max(left, key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def project(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each partition, one column a group."""
    u, out = fp.view(np.uint64), np.zeros((len(fp), len(groups)), np.int64)
    for g, group in enumerate(groups):
        for k, bit in enumerate(group):
            out[:, g] |= (u >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << k
    return out


def flips(radius: int, width: int = WIDTH) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def costs(histogram: np.ndarray, limit: int) -> np.ndarray:
    """[part, t + 1, value]: estimated candidates and probes of a value at threshold t, from -1 (left out) to limit."""
    values = np.arange(1 << WIDTH)
    out = np.zeros((PARTS, limit + 2, 1 << WIDTH), np.int64)
    for t in range(limit + 1):
        ring = flips(t)
        out[:, t + 1] = out[:, t] + PROBE * len(ring)
        for flip in ring:
            out[:, t + 1] += histogram[:, values ^ flip]
    return out


def allocate(values: np.ndarray, cost: np.ndarray, limit: int) -> np.ndarray:
    """Thresholds of each row with sum limit - PARTS + 1 and the least cost, by dynamic programming."""
    n, room = len(values), limit + 1  # in units above -1 each
    best = np.full((n, room + 1), np.iinfo(np.int64).max // 4)
    best[:, 0] = 0
    chosen = np.zeros((PARTS, n, room + 1), np.int64)
    for p in range(PARTS):
        now = np.full_like(best, np.iinfo(np.int64).max // 4)
        for k in range(room + 1):
            c = cost[p, k, values[:, p]]
            for s in range(k, room + 1):
                total = best[:, s - k] + c
                better = total < now[:, s]
                now[better, s] = total[better]
                chosen[p, better, s] = k
        best = now
    out, s = np.zeros((n, PARTS), np.int64), np.full(n, room)
    for p in reversed(range(PARTS)):
        k = chosen[p, np.arange(n), s]
        out[:, p] = k - 1
        s = s - k
    return out


def _link(fp: np.ndarray, rep: np.ndarray, role: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of one meeting place: from each reached row, only rows not reached before are compared."""
    left = np.arange(len(fp))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= limit
            near &= ((role[left] & 1) & (role[x] >> 1) | (role[left] >> 1) & (role[x] & 1)).astype(bool)
            if near.any():
                hit, left = left[near], left[~near]
                todo.extend(hit.tolist())
                yield from ((int(rep[x]), int(rep[y])) for y in hit)


def links(classes: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): edges between representatives of distinct fingerprints that span all links of at most ``limit`` bits.

    classes: (fp, rep), one row per fingerprint. The histogram of partition values, PARTS * 2^WIDTH numbers at most,
    is all that reaches the driver. Hot values are split by the other bits: as a pair may differ there in at most
    ``limit`` bits, it agrees in one of limit + 1 groups of them. Rows that still meet are near one another in the
    main, and cost 17 bytes each.
    """
    spark = classes.sparkSession
    groups = bit_groups(classes)
    histogram = np.zeros((PARTS, 1 << WIDTH), np.int64)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = project(b.column(0).to_numpy(), groups)
            yield pa.RecordBatch.from_arrays([pa.array((v + (np.arange(PARTS) << WIDTH)).ravel())], names=["k"])

    for k, n in classes.select("fp").mapInArrow(values, "k long").groupBy("k").count().toLocalIterator():
        histogram[k >> WIDTH, k & (1 << WIDTH) - 1] = n
    shared = spark.sparkContext.broadcast((histogram, costs(histogram, limit)))
    rest = [[[b for g2, g in enumerate(groups) if g2 != p for b in g][k::limit + 1] for k in range(limit + 1)] for p in range(PARTS)]

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist, cost = shared.value
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = project(fp, groups)
            t = allocate(v, cost, limit)
            row, part, value, role = [], [], [], []
            for p in range(PARTS):
                row.append(np.arange(len(fp)))
                value.append(v[:, p])
                role.append(np.where(t[:, p] >= 0, 3, 1))
                part.append(np.full(len(fp), p))
                for r in range(1, limit + 1):
                    ask = np.flatnonzero(t[:, p] >= r)
                    ring = flips(r)
                    near = v[ask, p][:, None] ^ ring
                    there = hist[p][near] > 0
                    row.append(np.repeat(ask, len(ring))[there.ravel()])
                    value.append(near[there])
                    role.append(np.full(there.sum(), 2))
                    part.append(np.full(there.sum(), p))
            row, part, value, role = map(np.concatenate, (row, part, value, role))
            key = part << WIDTH | value
            hot = hist[part, value] > HOT
            cold = ~hot
            out = [(key[cold] << 1, row[cold], role[cold])]
            for p in range(PARTS):
                at = np.flatnonzero(hot & (part == p))
                if len(at):
                    sub = project(fp[row[at]], rest[p])
                    for k in range(limit + 1):
                        out.append(((key[at] << 18 | k << 16 | sub[:, k]) << 1 | 1, row[at], role[at]))
            key, row, role = (np.concatenate(x) for x in zip(*out, strict=True))
            for at in range(0, len(key), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(fp[row[s]]), pa.array(rep[row[s]]), pa.array(role[s].astype(np.int8))], names=["key", "fp", "rep", "role"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, fp, rep, role = (np.concatenate(x) for x in zip(*parts, strict=True))
            fp = fp.view(np.uint64)
            start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            sizes = np.diff(np.append(start, len(key)))
            out: list[tuple[int, int]] = []
            for s, n in zip(start[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
                out.extend(_link(fp[s:s + n], rep[s:s + n], role[s:s + n], limit))
            small = np.repeat((sizes <= 64) & (sizes > 1), sizes)
            key, fp, rep, role = key[small], fp[small], rep[small], role[small]
            for d in range(1, int(sizes[(sizes <= 64)].max(initial=1))):
                same = np.flatnonzero(key[d:] == key[:-d])
                a, b = same, same + d
                near = np.bitwise_count(fp[a] ^ fp[b]) <= limit
                near &= ((role[a] & 1) & (role[b] >> 1) | (role[a] >> 1) & (role[b] & 1)).astype(bool)
                out.extend(zip(rep[a[near]].tolist(), rep[b[near]].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield flush([*held, [x[:cut] for x in now]])
                held = []
            elif held and held[0][0][0] != now[0][0]:
                yield flush(held)
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield flush(held)

    met = classes.select("fp", "rep").mapInArrow(signatures, "key long, fp long, rep long, role byte")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    component_id is the smallest id reachable by links of at most ``limit`` differing bits, itself included.
    A null or empty text has fingerprint zero, linked like any other. Null ids name no component: such a row
    takes the smallest known id it reaches, or null. Repeated rows stay repeated. Other columns are not read.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    # classes are named by their fingerprints, so that those of rows without ids link too
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes.select("fp", F.col("fp").alias("rep")), limit))
    joined = materialise(classes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "components")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(joined.join(named, "component").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 3) -> DataFrame:
    """The documents with one row of each component, that with the smallest id; all columns as they were."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, words, limit), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id names their component in ``found`` (doc_id, component_id).

    Of rows that repeat an id, one stays. Rows without an id can't be told apart and all stay.
    """
    ids = materialise(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # always a merge join, so that what is shuffled grows with the input alone; ids repeat neither here nor much there
    one, stays = docs.alias("one"), ids.select(F.col("doc_id").alias("stays")).hint("merge")
    kept = one.join(stays, F.col(f"one.{id_col}") == F.col("stays"), "left").where(F.col("stays").isNotNull() | F.col(f"one.{id_col}").isNull())
    kept = kept.select("one.*")
    if ids.where("n > 1").limit(1).count():
        known = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        kept = known.unionByName(kept.where(F.col(id_col).isNull()))
    return kept
