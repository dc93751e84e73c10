"""Near copies by five-word shingles against brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillstack.llm import packing, pii, quality, shingles


def plain_set(text, words=5):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(found[i:i + words]) for i in range(max(len(found) - words + 1, 1))) if found else frozenset()


def plain_components(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(2000)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(12):  # one to five words changed: similarities on both sides of 0.8, and chains across it
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    chain = [rng.choice(words) for _ in range(200)]
    out += [" ".join(chain[8 * k:8 * k + 130]) for k in range(9)]
    out += [None, "", " \n\t", "one", "One", "a b c d e", "A  b c d e", "a b c d e f", *out[:3]]
    return {1000 - i: t for i, t in enumerate(out)}


def test_links_are_those_of_brute_force(spark, texts):
    docs = spark.createDataFrame([*((i, t, "clash") for i, t in texts.items()), (None, "one", "x"), (None, "alone here", "x")], "doc_id long, text string, key string")
    want = plain_components(texts)
    assert len(set(want.values())) not in (len(texts), 1)
    found = shingles.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert sorted((r.component_id for r in found if r.doc_id is None), key=str) == sorted([want[max(i for i, t in texts.items() if t == "one")], None], key=str)
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert shingles.near_duplicates(docs.limit(0)).count() == 0


def test_the_stage_finds_near_copies_of_a_table(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = plain_components({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    kept = corpus_pipeline.keep_one_of_copies(spark, docs, path)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_pipeline_against_plain_python(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    clean = {r.doc_id: r.text for r in quality.filtered(docs, labels).collect()}
    chosen = frozenset(map(pii.KINDS.index, (*pii.BASE, "account")))
    texts = {i: pii.redacted(clean[i] or "", chosen) for i in set(plain_components(clean).values())}
    tok = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_pipeline_of_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
