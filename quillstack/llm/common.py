"""Shared pieces of the corpus operators: Arrow mapping and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.scratch import materialise, scratch_path

__all__ = ["components", "map_texts", "materialise", "scratch_path"]


def map_texts(df: DataFrame, text: Column | str, keep: list[Column | str], schema: str,
              rows: Callable[[Iterator[tuple[pa.RecordBatch, list[str]]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Run ``rows`` over (kept columns, whole texts) batches; a null text is the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    names = [f"k{i}" for i in range(len(keep))]
    kept = [(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keep, names, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                yield b.select(names), b.column("t").to_pylist()
        yield from rows(each())

    return df.select(*kept, F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, schema)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shrink the edges of one partition, piece by piece, to a forest of stars around their smallest node."""
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        stars = [(x, r) for x in parent if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b): the smallest node it reaches.

    Alternating large and small stars; each round's edges go to a scratch table. Nothing is collected
    but the two numbers that tell whether a round changed the edges.
    """
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialise(edges.where("a <> b").select(hi, lo).mapInArrow(_forest, "a long, b long").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = mark(now)
    while was[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialise(small.distinct(), "edges")
        if (mark_now := mark(now)) == was:
            break
        was = mark_now
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
