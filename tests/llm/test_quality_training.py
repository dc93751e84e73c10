"""The classifier's training on Spark: label model, sample size, long documents, and a plain version of the whole query."""

from collections import Counter

import numpy as np

from quillstack.llm import quality, queries


def test_long_labelled_documents_train_the_scorer(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(24):  # 4,000 distinct words each: more features than 8,192
        words = [f"w{x:07d}" for x in rng.choice(10_000_000, 4_000, replace=False)]
        rows.append((i, " ".join([*words, *(["zorble"] if i % 2 else ["gentle"])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    *_, weights, _ = quality.train(docs, labels)
    assert weights[quality.bucket("w zorble")] > 0 > weights[quality.bucket("w gentle")]
    assert quality.SAMPLE * 3 // 4 >= 6_000


def made(spark, wrong):
    """Clean and junk documents, all labelled; of the junk ones ``wrong`` have the label of clean ones."""
    clean = [f"The house number {i} is in the town of the river. It was for them and by the sea, as they are." for i in range(200)]
    junk = [f"|| {i} ||| ## %% {i} {i} {i} || qzx{i % 7} ### || $$ ^^ ~~ ||| ## %% ||" for i in range(100)]
    docs = spark.createDataFrame([*enumerate(clean + junk)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 200 + wrong else 0, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_people_are_a_labeller_among_others(spark, monkeypatch):
    docs, labels = made(spark, 8)
    model, _, *fitted = quality.train(docs, labels)
    assert model.bad[-1] < quality.TRUST[0]  # they missed some, and the estimate says so
    labels_alone = lambda patterns, counts, start, weight: quality.Labellers(*[np.where(weight > 100, start, 0.5)] * 2, 0.1)
    monkeypatch.setattr(quality, "expectation_maximisation", labels_alone)
    *_, weights, intercept = quality.train(docs, labels)
    missed = [r.text for r in docs.where("doc_id >= 200 and doc_id < 208").collect()]
    scores = [np.mean([quality.Scorer(*s)(t) for t in missed]) for s in (fitted, (weights, intercept))]
    assert scores[0] > 0.9 > scores[1]


def plain_fit(rows, targets, penalty=quality.PENALTY, rounds=150):
    """Proximal gradient steps on one dense matrix."""
    used = sorted({f for r in rows for f in r})
    place = {f: i for i, f in enumerate(used)}
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        for f in r:
            x[i, place[f]] += 1
    n, y = len(rows), np.array(targets)
    x = x * (1 / np.sqrt(x.sum(0) / n + 1e-3))
    scale = 1 / np.sqrt(np.array([sum(r.count(f) for r in rows) for f in used]) / n + 1e-3)
    b, t = float(np.log((y.mean() + 1e-3) / (1.001 - y.mean()))), 1.0
    w, look, probe, size = np.zeros(len(used)), np.zeros(len(used)), np.random.default_rng(0).standard_normal(len(used)), 1.0
    for _ in range(12):
        probe = x.T @ (x @ probe) / n
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-12)
    step = 4 / max(size, 1.0)
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-np.clip(x @ look + b, -40, 40))) - y
        new = look - step * (x.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= min(step, 4.0) * e.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (before - 1) / t * (new - w)
        w = new
    return dict(zip(used, w * scale, strict=True)), b


def test_the_query_against_a_plain_version(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    voted = {}
    for i, t in texts.items():
        junk, toxic = quality.votes(t)
        label = labels.get(i)
        letter = lambda v, bad: "-" if v is None else "b" if v == bad else "g"
        voted[i] = (junk + letter(label and label.quality, 0), toxic + letter(label and label.toxic, 1))
    models = []
    for k, names in enumerate((quality.JUNK, quality.TOXIC)):
        counts = Counter(v[k] for v in voted.values())
        guess = [quality.TRUST if n.startswith("label_") else quality.GUESS for n in names]
        models.append(quality.expectation_maximisation(sorted(counts), np.array([counts[p] for p in sorted(counts)], float), np.array([g[0] for g in guess]), np.array([g[1] for g in guess], float)))
    chosen = [i for i in texts if i in labels or "b" in voted[i][0] + voted[i][1]]  # fewer than the sample holds
    targets = [1 - (1 - models[0].posterior([voted[i][0]])[0]) * (1 - models[1].posterior([voted[i][1]])[0]) for i in chosen]
    weights, b = plain_fit([quality.features(texts[i]) for i in chosen], targets)
    for r in queries.op4_quality_classifier(spark, sf_dir).collect():
        z = b + sum(weights.get(f, 0.0) for f in quality.features(texts[r.doc_id]))
        assert abs(r.reject_probability - 1 / (1 + np.exp(-z))) < 1e-6
        assert r.keep == (r.reject_probability <= quality.THRESHOLD)
