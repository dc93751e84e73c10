"""Exact top-k inner products by best-first search of M-trees.

Candidates go to the nearest of a bounded number of pivots; each region, split by a hash where it is large, becomes
M-trees that are built once and kept as a table of pages: every node has a pivot, a covering radius and the distance of
its pivot to its parent's, every entry of a leaf its distance to the pivot. For a query q,
|q.x - q.p| <= |q| d(x, p), so these stored distances bound scores without computing them. A query first searches a tree
of its own region, best bound first; the k-th score found there bounds all others, and it is sent only to regions whose
pivot and radius can still reach it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import materialise

#: Entries of a leaf page, children of a node, candidates of a tree, queries that search a tree in one task.
PAGE, FAN, BLOCK, QUERIES = 256, 16, 8192, 2048
#: Regions of one vector length at most; rows (about) and bytes of the sample that their pivots come from.
REGIONS, SAMPLE, SAMPLE_BYTES = 128, 2048, 16 << 20
SCALE = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: list[float | None] | None, scale: int = SCALE) -> bytes | None:
    """floor(scale * x) of every component, as doubles, which hold these integers exactly; None for a vector that takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore"):
        v = np.floor(scale * np.asarray(vector, np.float64))
    return (v + 0.0).tobytes() if np.isfinite(v).all() else None


@dataclass
class Node:
    pivot: np.ndarray
    radius: float
    to_parent: float
    number: int | None = None  # of a leaf's page
    children: list[Node] = field(default_factory=list)
    pivots: np.ndarray | None = None  # of the children
    reach: np.ndarray | None = None  # their distances to this pivot, and to what lies below them
    below: np.ndarray | None = None


@dataclass
class Page:
    ids: np.ndarray
    distances: np.ndarray  # to the leaf's pivot, in rising order
    vectors: np.ndarray


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths of the last axis, without squares that are too large."""
    top = np.abs(x).max(axis=-1, initial=0, keepdims=True)
    safe = np.where(top > 2.0 ** 400, top, 1.0)
    return np.sqrt(((x / safe) ** 2).sum(axis=-1)) * safe[..., 0]


def _distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return _norm(x - p)


def spread(x: np.ndarray, start: np.ndarray, most: int) -> list[int]:
    """Places of rows far from one another: the furthest from start, then always the one furthest from those chosen."""
    if not len(x):
        return []
    seeds, nearest = [int(np.argmax(_distance(x, start)))], np.full(len(x), np.inf)
    while len(seeds) < most:
        nearest = np.minimum(nearest, _distance(x, x[seeds[-1]]))
        if nearest.max() == 0:
            break
        seeds.append(int(nearest.argmax()))
    return seeds


def closest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return ((pivots ** 2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)


def build(x: np.ndarray, rows: np.ndarray, pivot: np.ndarray, parent: np.ndarray, leaves: list[tuple[np.ndarray, np.ndarray]]) -> Node:
    """Bulk loading: rows go to the nearest of FAN pivots chosen far from one another, down to pages of PAGE.

    leaves gets each page's rows, nearest first, and their distances to its pivot.
    """
    distances = _distance(x[rows], pivot)
    node = Node(pivot, float(distances.max(initial=0)), float(_distance(pivot, parent)))
    if len(rows) <= PAGE:
        order = distances.argsort(kind="stable")
        node.number = len(leaves)
        leaves.append((rows[order], distances[order]))
        return node
    some = rows[:: max(1, len(rows) // 512)]
    pivots = x[some[spread(x[some], pivot, min(FAN, -(-2 * len(rows) // PAGE)))]]
    goes = closest(x[rows], pivots)
    groups = [(rows[goes == g], pivots[g]) for g in range(len(pivots)) if (goes == g).any()]
    if len(groups) == 1:  # equal rows
        groups = [(part, groups[0][1]) for part in np.array_split(rows, -(-len(rows) // PAGE))]
    node.children = [build(x, part, p, pivot, leaves) for part, p in groups]
    node.pivots = np.stack([c.pivot for c in node.children])
    node.reach = np.array([c.to_parent for c in node.children])
    node.below = np.array([c.radius for c in node.children])
    return node


def _exact(page: np.ndarray, q: np.ndarray, limit: float) -> list[int]:
    """Inner products of integers held as doubles, at the limits of a long where it can't hold them."""
    if limit < 2.0 ** 62:  # so are all partial sums
        return (page.astype(np.int64) @ q.astype(np.int64)).tolist()
    ask = [int(v) for v in q]
    return [min(max(sum(int(v) * w for v, w in zip(row, ask, strict=True)), LEAST), MOST) for row in page]


def search(root: Node, pages: list[Page], top: float, q: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int]]:
    """The k best (score, -id) but the query's own, ties to the smaller id, none below ``least``.

    top: the length of the longest entry. Products below 2^52 are exact in doubles; beyond, doubles only bound them.
    """
    norm = float(_norm(q))
    limit = norm * top
    error = 0.0 if limit < 2.0 ** 52 else limit * (len(q) + 8) * 2.0 ** -51
    bound = norm * (1 + 1e-9)
    slack = 1e-6 * (1 + norm) + error
    best: list[tuple[int, int]] = []
    floor = -np.inf if least is None else float(least) - error
    score = float(root.pivot @ q)
    queue = [(-(score + bound * root.radius + slack), 0, score, root)]
    count = 0
    while queue:
        reach, _, score, node = heappop(queue)
        worst = max(float(best[0][0]) - error, floor) if len(best) == k else floor
        if -reach < worst:
            break
        if node.number is not None:
            page = pages[node.number]
            # entries lie by distance, so those that the stored distances rule out come first
            cut = (worst - score - slack) / bound if bound and worst > -np.inf else 0.0
            first = int(page.distances.searchsorted(cut)) if np.isfinite(cut) else 0
            found = page.vectors[first:] @ q
            ok = np.flatnonzero(~(found < worst))
            if not error and len(ok) > k + 1:  # one more than k, as the query itself may be there
                ok = ok[found[ok] >= np.partition(found[ok], -k - 1)[-k - 1]]
            exact = found[ok].astype(np.int64).tolist() if not error else _exact(page.vectors[first:][ok], q, limit)
            for s, i in zip(exact, page.ids[first:][ok].tolist(), strict=True):
                if i == own or least is not None and s < least:
                    continue
                if len(best) < k:
                    heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapreplace(best, (s, -i))
            continue
        # the stored distances to this pivot rule children out before their own scores are computed
        may = np.flatnonzero(~(score + bound * (node.reach + node.below) + slack < worst))
        scores = node.pivots[may] @ q
        bounds = scores + bound * node.below[may] + slack
        for c, s, b in zip(may.tolist(), scores.tolist(), bounds.tolist(), strict=True):
            if not b < worst:
                count += 1
                heappush(queue, (-b, count, s, node.children[c]))
    return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data)).reshape(len(data), -1)


def _trees(table: pa.Table) -> pa.Table:
    """The pages of one tree: a row per entry, and one (page -1) with the inner nodes and the length of the longest entry."""
    ids, x = table.column("id").to_numpy(), _matrix(table.column("x"))
    key = [table.column(c)[0].as_py() for c in ("dims", "region", "split")]
    order = ids.argsort(kind="stable")
    ids, x = ids[order], x[order]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    with np.errstate(all="ignore"):
        root = build(x, np.arange(len(x)), x[0], x[0], leaves)
        top = float(_norm(x).max())
    rows = np.concatenate([r for r, _ in leaves])
    page = np.repeat(np.arange(len(leaves)), [len(r) for r, _ in leaves])
    n = len(rows) + 1
    return pa.table({**{c: pa.array(np.full(n, v), t) for c, v, t in zip(("dims", "region", "split"), key, (pa.int32(),) * 3, strict=True)},
                     "page": pa.array(np.append(page, -1), pa.int32()), "distance": pa.array(np.append(np.concatenate([d for _, d in leaves]), 0.0)),
                     "id": pa.array(np.append(ids[rows], 0)), "x": pa.array([*(x[r].tobytes() for r in rows), pickle.dumps((root, top))], pa.binary())})


def _searcher(k: int):
    def run(table: pa.Table) -> pa.Table:
        """Queries (page -2; distance: whether there is a least score, least: it) against the one tree of their group."""
        page = table.column("page").to_numpy()
        out: list[tuple[int, int, int]] = []
        asks, entries, roots = np.flatnonzero(page == -2), np.flatnonzero(page >= 0), np.flatnonzero(page == -1)
        if len(asks) and len(roots):
            entries = entries[np.lexsort((table.column("distance").to_numpy()[entries], page[entries]))]
            root, top = pickle.loads(table.column("x")[int(roots[0])].as_py())
            held = table.take(pa.array(entries))
            ids, distances, x = held.column("id").to_numpy(), held.column("distance").to_numpy(), _matrix(held.column("x"))
            cuts = np.searchsorted(page[entries], np.arange(page.max() + 2))
            pages = [Page(ids[a:b], distances[a:b], np.ascontiguousarray(x[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            with np.errstate(all="ignore"):
                for row in table.take(pa.array(asks)).select(["id", "x", "least"]).to_pylist():
                    found = search(root, pages, top, np.frombuffer(row["x"]), row["id"], k, row["least"])
                    out += [(row["id"], -i, s) for s, i in found]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
          scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k highest integer inner products with rows of vectors.

    Ties go to the smaller id; a query's own id is left out. Null vectors, those with null or non-finite components
    (before or after scaling) and rows without an id take no part; vectors of different lengths don't meet. Repeated
    rows count once. Fewer than k candidates give fewer rows, empty tables none. Scores are exact whatever their size;
    those that a long can't hold are at its limits, and tie there.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([quantised(v, scale) for v in b.column(1).to_pylist()], pa.binary())], names=["id", "x"])

        found = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null").mapInArrow(run, "id long, x binary")
        return materialise(found.where("octet_length(x) > 0").distinct().withColumn("dims", (F.octet_length("x") / 8).cast("int")), "quantised")

    candidates, asked = whole(vectors), whole(queries)
    total, size = candidates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()
    wanted = min(SAMPLE, SAMPLE_BYTES * total // max(size, 1) + 1)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, wanted / max(total, 1)) * (1 << 30)) + 1
    seen: dict[int, list[bytes]] = {}
    for r in candidates.where(share).select("dims", "id", "x").collect():  # a sample of about SAMPLE rows and SAMPLE_BYTES at most
        seen.setdefault(r.dims, []).append((r.id, bytes(r.x)))
    pivots: dict[int, np.ndarray] = {}
    regions = min(REGIONS, -(-total // block))
    with np.errstate(all="ignore"):
        for dims, rows in seen.items():
            x = np.frombuffer(b"".join(v for _, v in sorted(rows))).reshape(-1, dims)
            pivots[dims] = x[spread(x, x.mean(axis=0), regions)]
    shared = spark.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's region and its distance to the pivot; a length that the sample lacks is one region, around zero."""
        for b in batches:
            dims = b.column("dims").to_numpy()
            region, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _matrix(b.column("x").take(pa.array(at)))
                p = shared.value.get(d, np.zeros((1, d)))
                with np.errstate(all="ignore"):
                    region[at] = closest(x, p)
                    away[at] = _distance(x, p[region[at]])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("dims", "id", "x")), pa.array(region), pa.array(away)], names=["dims", "id", "x", "region", "away"])

    placed = candidates.mapInArrow(near, "dims int, id long, x binary, region int, away double")
    placed = materialise(placed, "placed")
    # at most REGIONS rows for each vector length
    stats = placed.groupBy("dims", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    splits = {(r.dims, r.region): -(-r.n // block) for r in stats}
    radii = {(r.dims, r.region): r.radius * (1 + 1e-9) for r in stats}
    catalogue = spark.sparkContext.broadcast((splits, radii))
    split = spark.createDataFrame([(d, g, n) for (d, g), n in splits.items()], "dims int, region int, splits int")
    cut = placed.join(F.broadcast(split), ["dims", "region"]).select("dims", "region", F.pmod(F.xxhash64("id"), "splits").cast("int").alias("split"), "id", "x")
    trees = materialise(cut.groupBy("dims", "region", "split").applyInArrow(_trees, "dims int, region int, split int, page int, distance double, id long, x binary"), "trees")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to trees: without a home to a tree of the nearest region; else to all others that may beat ``least``."""
        splits, radii = catalogue.value
        places = {d: sorted(g for e, g in splits if e == d) for d in {d for d, _ in splits}}
        for b in batches:
            rows, region, tree, home = [], [], [], b.column("home").to_pylist()
            dims, least, salt = b.column("dims").to_numpy(), b.column("least").to_pylist(), b.column("salt").to_numpy()
            for d in np.unique(dims).tolist():
                if d not in places:
                    continue
                at, there = np.flatnonzero(dims == d), np.array(places[d])
                x = _matrix(b.column("x").take(pa.array(at)))
                p = shared.value.get(d, np.zeros((1, d)))[there]
                r = np.array([radii[d, g] for g in there.tolist()])
                with np.errstate(all="ignore"):
                    nearest, norm = closest(x, p), _norm(x)[:, None]
                    top = x @ p.T + (1 + 1e-9) * norm * r + 1e-6 * (1 + norm) + norm * (_norm(p) + r) * (d + 8) * 2.0 ** -51
                for i, row in enumerate(at.tolist()):
                    g0 = int(there[nearest[i]])
                    own = int(salt[row] % splits[d, g0])
                    if home[row] is None:
                        rows.append(row)
                        region.append(g0)
                        tree.append(own)
                        continue
                    reach = there if least[row] is None else there[~(top[i] < float(least[row]))]
                    for g in reach.tolist():
                        some = [s for s in range(splits[d, g]) if g != g0 or s != own]
                        rows += [row] * len(some)
                        region += [g] * len(some)
                        tree += some
            for at in range(0, len(rows), 1 << 14):
                take = pa.array(rows[at:at + (1 << 14)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("dims").take(take), pa.array(region[at:at + (1 << 14)], pa.int32()), pa.array(tree[at:at + (1 << 14)], pa.int32()),
                                                  *(b.column(c).take(take) for c in ("id", "x", "least", "salt"))], names=["dims", "region", "split", "id", "x", "least", "salt"])

    def met(asks: DataFrame) -> DataFrame:
        sent = asks.select("dims", "id", "x", "least", "home", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)).alias("salt")).mapInArrow(
            route, "dims int, region int, split int, id long, x binary, least long, salt long")
        sent = materialise(sent, "sent")
        # a tree that many queries ask is repeated for each query_block of them
        parts = sent.groupBy("dims", "region", "split").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
        tree = trees.join(parts, ["dims", "region", "split"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tree = tree.select("dims", "region", "split", "part", "page", "distance", "id", "x", F.lit(None).cast("long").alias("least"))
        some = sent.join(parts, ["dims", "region", "split"]).select("dims", "region", "split", F.pmod(F.xxhash64(F.lit(9), "salt"), "parts").cast("int").alias("part"), F.lit(-2).alias("page"), F.lit(0.0).alias("distance"), "id", "x", "least")
        found = tree.union(some).groupBy("dims", "region", "split", "part").applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
        return materialise(found, "found")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    none = F.lit(None)
    first = met(asked.select("dims", "id", "x", none.cast("long").alias("least"), none.cast("int").alias("home")))
    least = best(first).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = met(asked.join(least, "id", "left").select("dims", "id", "x", "least", F.lit(0).alias("home")))
    return best(first.union(rest)).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, scale: int = SCALE) -> str:
    """The same in DuckDB SQL, for queries whose id is divisible by 20."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::bigint AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
      WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= {k}"""
