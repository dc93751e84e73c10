"""Large components, several lengths, repeated rows and null ids of the top-k search."""

import math
import random

import pytest

from quillstack.llm import topk


def brute(rows, k, asks):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) and math.isfinite(64 * x) for x in v):
            ok[i] = [math.floor(64 * x) if abs(x) < 2 ** 40 else 64 * int(x) for x in v]
    out = []
    for q in ok:
        if asks(q):
            score = lambda c: min(max(sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), topk.LEAST), topk.MOST)  # noqa: B023, E731
            best = sorted((-score(c), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.1e6, 1e8, 3.3e15, 1e160])
def test_large_components_are_exact(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.choice([1.0, size, size * rng.random(), -size * rng.random(), rng.random()]) for _ in range(6)]) for i in range(150)]
    rows += [(200, [1.1e6] * 6), (201, [1.1e6] * 6), (202, [1e308] * 6), (203, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, block=40, query_block=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, lambda q: q % 20 == 0)


def test_lengths_repeats_and_null_ids(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(2 + i % 3)]) for i in range(300)] + [(None, [9.0] * 3), (300, []), (301, [1.0]), (302, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, query_id string, region int")
    got = topk.top_k(df.union(df), df.where("vec_id % 20 = 0 or vec_id = 301"), block=30, query_block=4).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, lambda q: q % 20 == 0 or q == 301)


def test_regions_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(i, [float(i), 0.0, 1.0]) for i in range(500, 520)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), block=64, query_block=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, lambda q: q % 20 == 0)
