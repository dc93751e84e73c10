"""SimHash, embeddings, top-k, quality and the pipeline against brute force and held-out labels."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from quillstack.llm import quality, queries, simhash, topk, vectors
from quillstack.llm.common import components


def least_reached(ids, links):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    want = least_reached({x for e in links for x in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    out = []
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return [*out, None, "", " \n\t", "one", "One", "two\x1cwords\x85 here", "a b c d", *out[:3]]


def test_simhash_links_and_components(spark, texts, monkeypatch):
    data = [(1000 - i, t, "clash", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*data, (None, "one", "x", 1)], "doc_id long, text string, component_id string, fp int")
    fps = {i: plain_fingerprint(t or "") for i, t, *_ in data}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = least_reached(fps, links)
    for hot in (simhash.HOT, 1):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == len(data) + 1
        assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got if r.doc_id is not None} == {i: (fps[i], want[i]) for i in fps}
    assert len(set(want.values())) < len(want) - 20
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    hist = rng.integers(0, 3, (simhash.PARTS, 1 << simhash.WIDTH))
    hist[0, 5] = 100_000
    values = rng.integers(0, 1 << simhash.WIDTH, (500, simhash.PARTS))
    values[:50, 0] = 5
    cost = simhash.costs(hist, 3)
    t = simhash.allocate(values, cost, 3)
    assert (t.sum(axis=1) == 3 - simhash.PARTS + 1).all() and (t >= -1).all()
    assert (t[:50, 0] == -1).all()


def test_embeddings_against_sql(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    rows = [(i, (base[i % 20] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 1])).tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan"), *[1.0] * 15]), (303, [None, *[1.0] * 15]), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, rows[0][1]), (308, [1e200] * 16), (309, [1e-200] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, n_links string")
    ok = {i: np.array(v) / max(abs(x) for x in v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    want = least_reached([i for i, _ in rows], links)
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for block in (vectors.BLOCK, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, block=block).collect()}
        assert got == {i: (degree[i], want[i], want[i] == i) for i, _ in rows}
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    twice = vectors.near_duplicates(df.union(df)).collect()
    assert len(twice) == 2 * len(rows) and {r.vec_id: r.n_links for r in twice} == degree


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(8) * (1 + i % 3)).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 470)] + [(470, None), (471, [float("inf")] * 8), (472, [None] * 8), (473, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    ok = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in ok:
        if q % 20 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:20]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    for block, asks in ((topk.BLOCK, topk.QUERIES), (90, 7)):
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), block=block, query_block=asks).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), df.where("vec_id % 20 = 0")).count() == 0
    few = df.where("vec_id < 5")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    accuracy = np.array([0.95, 0.8, 0.7, 0.9])
    right = rng.random((len(truth), 4)) < accuracy
    bad = np.where(right, truth[:, None], ~truth[:, None])
    silent = rng.random(bad.shape) < 0.3
    patterns, counts = np.unique(["".join(row) for row in np.where(silent, "-", np.where(bad, "b", "g"))], return_counts=True)
    model = quality.expectation_maximisation(patterns.tolist(), counts.astype(float), np.full(4, 0.7), np.full(4, 10.0))
    assert np.abs(model.bad - accuracy).max() < 0.05 and np.abs(model.good - accuracy).max() < 0.05 and abs(model.prior - 0.2) < 0.03


def test_quality_holds_on_labels_it_has_not_seen(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 0}
    seen = labels.where(~labels.doc_id.isin([*held]))
    found = quality.classify(docs.join(labels.select("doc_id"), "doc_id"), seen).select("doc_id", "reject_probability").collect()
    wrong = [(held[r.doc_id], r[1]) for r in found if r.doc_id in held and held[r.doc_id] != (r[1] > quality.THRESHOLD)]
    assert len(wrong) <= 0.02 * len(held), len(wrong)
    assert sum(not bad for bad, _ in wrong) <= 0.005 * len(held)


def test_quality_edge_cases(spark):
    rows = [(1, "The cat and the dog are in the house. It was for them.", "x", 1.0), (2, None, None, None), (3, "", "", 0.0), (None, "null id of the row", "x", 1.0), (1, "again the same id", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, junk string, reject_probability double")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0), None):
        found = quality.filtered(docs, table)
        assert found.columns == docs.columns and found.count() <= len(rows)
    scored = quality.classify(docs, labels)
    assert scored.count() == len(rows) and scored.columns == [*docs.columns, "_reject_probability"]
    assert sorted(r.reject_probability for r in scored.collect() if r.reject_probability is not None) == [0.0, 1.0, 1.0, 1.0]
    assert quality.filtered(docs.limit(0), labels).count() == 0
