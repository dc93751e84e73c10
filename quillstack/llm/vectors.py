"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one, equal ones become one class, and all are turned into the basis of their principal
directions. Blocks are ranges of the leading coordinate; two blocks are compared only if their ranges come close
enough. Within a tile the leading coordinates are multiplied first; with the norms of the rest they bound the
cosine, and only pairs that can still reach the threshold go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import components, materialise

#: Classes of a block, rows of a tile compared at once, leading coordinates of the two bounds.
BLOCK, TILE, LEADING = 8192, 1024, (8, 24)


def unit(vector: list[float | None] | None) -> bytes | None:
    """The vector in double precision with length one; None where it links with nothing."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # so that no square is too large or too small
    return (v / np.sqrt(v @ v) + 0.0).tobytes()


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, u) of the rows that can link; u holds the doubles of the unit vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unit(v) for v in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "u"])

    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, u binary")
    return found.where("vec_id is not null and u is not null").distinct()


def directions(classes: DataFrame, dims: int) -> np.ndarray:
    """Principal directions, leading first, as columns: from the second moments of all classes of that length."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = np.frombuffer(b"".join(b.column(0).slice(at, 4096).to_pylist())).reshape(-1, dims)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["i", "v"])

    total = np.zeros(dims * dims)
    for i, v in classes.where(F.octet_length("u") == 8 * dims).select("u").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        total[i] = v
    return np.linalg.eigh(total.reshape(dims, dims))[1][:, ::-1].copy()


def pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a and b whose inner product reaches the threshold; rows have length one."""
    dims = a.shape[1]
    for k in (k for k in LEADING if 2 * k <= dims):
        tail = [np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0)) for x in (a, b)]
        bound = np.hstack((a[:, :k], tail[0][:, None])) @ np.hstack((b[:, :k], tail[1][:, None])).T
        i, j = np.nonzero(bound >= threshold - 1e-9)
        if len(i) <= 0.05 * bound.size:
            keep = np.empty(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                s = slice(at, at + (1 << 14))
                keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
            return i[keep], j[keep]
    return np.nonzero(a @ b.T >= threshold)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node each of n nodes reaches by the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def compare(tile: pa.Table, dims: int, threshold: float) -> pa.Table:
    """(rep, links, root): rows linked by each class of a tile, and edges that span its components there."""
    side = tile.column("side").to_numpy()
    rep, n = tile.column("rep").to_numpy(), tile.column("n").to_numpy()
    x = np.frombuffer(b"".join(tile.column("r").to_pylist())).reshape(-1, dims)
    own = bool((side == 2).all())
    left, right = (np.arange(len(x)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, roots = np.zeros(len(x), np.int64), []
    for p in range(0, len(left), TILE):
        for q in range(p if own else 0, len(right), TILE):
            l, r = left[p:p + TILE], right[q:q + TILE]
            i, j = pairs(x[l], x[r], threshold)
            i, j = l[i], r[j]
            if own and p == q:
                i, j = i[i < j], j[i < j]
            i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
            if not len(i):
                continue
            links += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
            label = forest(i, j, len(x))
            moved = np.flatnonzero(label != np.arange(len(x)))
            roots.append((rep[moved], rep[label[moved]]))
    hit = np.flatnonzero(links)
    a = np.concatenate([rep[hit], *(r[0] for r in roots)])
    root = [*([None] * len(hit)), *(v for r in roots for v in r[1].tolist())]
    return pa.table({"rep": pa.array(a, pa.int64()), "links": pa.array(np.concatenate([links[hit], np.zeros(len(a) - len(hit), np.int64)])), "root": pa.array(root, pa.int64())})


def _comparer(dims: int, threshold: float):
    return lambda tile: compare(tile, dims, threshold)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links join vectors of one length whose cosine in double precision reaches the threshold. Null or zero vectors and
    those with null or non-finite components link with nothing; so do rows without an id, whose component is null
    and which are kept. Rows that repeat an id are one vector, with the links of all of them. Copies are one class,
    compared once and counted as many. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = materialise(units(vectors, id_col, vector_col), "units")
    classes = materialise(valid.groupBy("u").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    sizes = classes.groupBy((F.octet_length("u") / 8).cast("int").alias("dims")).count().collect()
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    found = None
    for dims, total in sorted(sizes):
        basis = spark.sparkContext.broadcast(directions(classes, dims))  # dims * dims numbers

        def turn(batches: Iterator[pa.RecordBatch], dims=dims, basis=basis) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.frombuffer(b"".join(b.column("u").to_pylist())).reshape(-1, dims) @ basis.value
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(x[:, 0].copy())], names=["rep", "n", "r", "lead"])

        turned = classes.where(F.octet_length("u") == 8 * dims).select("rep", "n", "u").mapInArrow(turn, "rep long, n long, r binary, lead double")
        turned = materialise(turned, "turned")
        wanted = -(-total // block)
        cuts = turned.select(F.percentile_approx("lead", [i / wanted for i in range(1, wanted)], 100 * wanted)).first()[0] if wanted > 1 else []
        edges = np.array(sorted(set(cuts)))

        def place(batches: Iterator[pa.RecordBatch], edges=edges) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(edges, b.column("lead").to_numpy(), side="right"))], names=[*b.schema.names, "range"])

        ranged = turned.mapInArrow(place, "rep long, n long, r binary, lead double, range long")
        # ranges that hold far more than a block, as of equal coordinates, are split by a hash
        stats = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high")).collect()}
        blocks = [(k, s, r["low"], r["high"], max(1, round(r["n"] / block))) for k, r in sorted(stats.items()) for s in range(max(1, round(r["n"] / block)))]
        near: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for p, (k, s, low, high, _) in enumerate(blocks):
            near[k, s] = [(min(p, q), max(p, q), 2 if p == q else int(p > q)) for q, other in enumerate(blocks) if other[2] - high <= reach and low - other[3] <= reach]
        split = {b[0]: b[4] for b in blocks}
        shared = spark.sparkContext.broadcast((near, split))

        def deal(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            near, split = shared.value
            for b in batches:
                ranges, subs = b.column("range").to_pylist(), b.column("sub").to_pylist()
                for at in range(0, b.num_rows, 512):
                    rows, first, second, side = [], [], [], []
                    for i in range(at, min(at + 512, b.num_rows)):
                        for f, s, d in near[ranges[i], subs[i] % split[ranges[i]]]:
                            rows.append(i)
                            first.append(f)
                            second.append(s)
                            side.append(d)
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(side, pa.int8()), *(b.column(c).take(take) for c in ("rep", "n", "r"))],
                                                     names=["first", "second", "side", "rep", "n", "r"])

        dealt = ranged.withColumn("sub", F.pmod(F.xxhash64("rep"), F.lit(1 << 20))).mapInArrow(deal, "first int, second int, side byte, rep long, n long, r binary")
        part = dealt.groupBy("first", "second").applyInArrow(_comparer(dims, threshold), "rep long, links long, root long")
        found = part if found is None else found.union(part)
    ids = vectors.select(F.col(id_col).alias("vec_id"))
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "links")
    links = found.where("root is null").groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    named = named.select("u", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    rows = valid.join(named, "u").groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    found = ids.join(rows, "vec_id", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return found.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def oracle(threshold: float = 0.95) -> str:
    """The same in DuckDB SQL, for tables without repeated ids."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS x FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {threshold}),
r AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT vec_id, min(seen) AS component FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, m.vec_id) AS component_id, coalesce(c.component, m.vec_id) IS NOT DISTINCT FROM m.vec_id AS kept
FROM embeddings m LEFT JOIN c ON m.vec_id = c.vec_id LEFT JOIN n ON m.vec_id = n.a"""
