"""Token counts, BPE, personal data, urls and archives against the libraries, brute force and round trips."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillstack.llm import bpe, packing, pii, queries, tokens, urls, warc
from quillstack.llm.common import scratch_path

DOCS = "doc_id long, text string, n_tokens string, bucket int"
ODD = ["", " ", "a", "  x", "x  y\n\n z ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "a\x1c b \x1d", "it's don't 'll  '", "a" * 700, "the" * 300,
       "日本 語 123", "é é ́", "ΣΑΣ Σ İ", "x \x85 y z", "a.b, c.. d,. _,x", "\r\n a\r\n", "🙂🙂 🙂"]


def rows():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab c\n\t '.,1é\x1f日") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    return [(i, t, "clash", i) for i, t in enumerate([*ODD, *made])] + [(None, None, None, None), (900, "same", "x", 1), (900, "same", "x", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_the_library(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    got = tokens.token_counts(docs, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokens.token_counts(empty).count() == 0


def test_whole_tokens_are_proved():
    path = public_tokenizers.path(tokens.TOKENIZER)
    tok, whole = Tokenizer.from_file(path), tokens.whole_tokens(path)
    assert len(whole) > 40_000
    for t in random.Random(1).sample(sorted(whole), 500):
        assert len(tok.encode(t, add_special_tokens=False).ids) == 1


def test_bpe_equals_the_library_and_round_trips(docs, empty):
    ranks = bpe.ranks_of(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t, *_ in rows():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = bpe.round_trip_digests(docs).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert bpe.round_trip_digests(empty).count() == 0
    back = bpe.decode(bpe.encode(docs)).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == {i: (t or "").encode() for i, t, *_ in rows()}


def test_both_rank_queues_agree_with_the_library():
    ranks = bpe.ranks_of(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abthe ing\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(500)] + [b"a" * 150, b"the" * 50]
    many = bpe.merge_many(pieces, bpe.Pairs(ranks))
    for piece, ids in zip(pieces, many, strict=True):
        want = library._core_bpe.encode_single_piece(piece)
        assert bpe.merge(piece, ranks) == want
        assert ids == want
    long = b"a" * 3000 + rng.randbytes(3000)
    assert bpe.merge(long, ranks) == library._core_bpe.encode_single_piece(long)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["a@.-_ +b1", "0123456789 -", "12.3 ", "+1 ()-.2a", "ab@.c1+ -0é/:"])
def test_anchor_expansion_equals_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find(text) if s[1] < 4] == brute_spans(text)


def test_personal_data_query_and_redaction(spark, sf_dir, empty):
    got = queries.op3_personal_data(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        spans = brute_spans(docs[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert set(pii.joined(spans).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.digests(empty).count() == 0
    made = spark.createDataFrame([(1, "write a.b@c.org or +1 (212) 555-0100, token = \"ab12cd34ef56\" now", "x", 0), (2, None, None, None)], DOCS)
    masked = {r.doc_id: r.text for r in pii.redact(made).collect()}
    assert masked == {1: 'write <EMAIL> or <PHONE>, token = "<ACCOUNT>" now', 2: None}
    assert pii.redact(made).columns == made.columns


def test_url_rules_and_terms(spark):
    cases = {"http://a.example.org/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://x.org/en/1?q": ("x.org", "/en/1", "org/", "allow"),
             "http://Example.ORG/en/12": ("example.org", "/en/12", "example.org/en/1", "block"), "http://b.com/de/1#f": ("b.com", "/de/1", "com/de/", "block"),
             "http://casino-win.net/en": ("casino-win.net", "/en", None, "block"), "http://casinoz.net": ("casinoz.net", "", None, "allow"),
             "http://free.net/bets": ("free.net", "/bets", None, "block"), "http://a.net/%20p%6Frn": ("a.net", "/%20p%6Frn", None, "block"), "http://a.net/x%25%zz%C3porn": ("a.net", "/x%25%zz%C3porn", None, "allow"),
             "http://a.net/keygen": ("a.net", "/keygen", None, "allow"), "http://free.net/free": ("free.net", "/free", None, "allow"),
             "http://a.org?x=/": ("a.org", "", None, "allow"), "no host": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow")}
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    strict, soft = urls.vocabulary(spark.createDataFrame([("Zebra", None), ("ant", 0.5), ("bee", 1.0)], "term string, weight double"))
    own = spark.createDataFrame([(1, "http://a.net/zebra"), (2, "http://a.net/ant/bee"), (3, "http://a.net/porn"), (None, "http://a.net/ant")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(own.union(own), strict=strict, soft=soft, soft_limit=1.5).collect()} == {1: "block", 2: "block", 3: "allow", None: "allow"}


def test_vocabularies_from_tables(spark):
    rows = [("Foo", None), ("foo", 2.0), ("zero", 0.0), ("bar", 1.0), ("bar", 3.0), ("", 1.0), (None, 1.0)]
    strict, soft = urls.vocabulary(spark.createDataFrame(rows, "term string, weight double"))
    assert (strict, soft) == (("foo",), {"bar": 3.0, "zero": 0.0})
    with pytest.raises(ValueError):
        urls.vocabulary(spark.createDataFrame(rows, "term string, weight double"), most=2)
    assert urls.weigh("http://x.net/foo", ("foo",), (("foo", 2.0),)) == (1, 0, 0) and urls.weigh("http://x.net/zero", (), (("zero", 0.0),)) == (0, 1, 0.0)
    page = spark.createDataFrame([(1, "http://x.net/zero/bar", "clash")], "page_id long, url string, verdict string")
    assert [(r.verdict, r.strict_hits, r.soft_hits) for r in urls.judge(page, strict=(), soft=soft).collect()] == [("block", 0, 2)]
    assert urls.judge(page.limit(0)).count() == 0


def test_neighbouring_hits_share_a_boundary_in_the_sql_too(spark):
    made = ["http://a.net/sex/sex/sex/", "http://sex.sex/xsex/sexx", "sex", "http://a.net/free-bonus_win?bet&bet", None, "", "http://a.net/%73ex/" + "sex/" * 5_000]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(made)))
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = sorted(((r.page_id, r.strict_hits, r.soft_hits, r.verdict) for r in urls.judge(df).collect()))
    assert got == sorted(con.sql(f"SELECT page_id, strict_hits, soft_hits, verdict FROM ({urls.oracle()})").fetchall()) and got[0][1] == 3 and got[-1][1] == 5_001


def test_archives_round_trip(spark):
    long, other = "x" * 150_000 + "\r\n\r\nWARC/1.1\r\n", "é" * 60
    data = [(3, "http://a/\r\nb", long), (1, "u", long), (2, None, other), (5, "u", other), (5, "u", other), (6, "u", "short"), (7, "u", "short"), (8, "u", None), (9, "u", ""), (None, "u", "null id")]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages, scratch_path(spark, "warc")).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {sha(long): 1, sha(other): 2}
    want = []
    for i, _, t in data:
        f = first.get(sha(t))
        again = f is not None and f != i
        want.append((i, len((t or "").encode()), sha(t), "revisit" if again else "response", f if again else None, None))
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0), scratch_path(spark, "warc")).count() == 0


def test_broken_segments_are_told():
    payload = b"p" * 300_000
    made = list(warc.records(1, "u", payload, "d", None, False, warc.SEGMENT))
    assert len(made) > 3
    rows = [r for part in made for r in warc._parsed(part)]
    assert [r[1] for r in rows] == list(range(1, len(rows) + 1))
    batch = lambda parts: warc.pa.RecordBatch.from_pylist([{"origin": "o", "total": rows[-1][2], "page_id": 1, "payload_digest": "d", "payload_bytes": 1,
                                                          "parts": [{"segment": p[1], "payload": p[8]} for p in parts]}])
    whole = next(warc._reassemble([batch(rows)])).to_pylist()[0]
    assert whole["payload"] == payload and whole["error"] is None
    assert "missing" in next(warc._reassemble([batch(rows[:1] + rows[2:])])).to_pylist()[0]["error"]
    assert "total" in next(warc._reassemble([batch(rows[:-1])])).to_pylist()[0]["error"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_broken_archives_have_error_rows(spark, tmp_path):
    pack = lambda r: (lambda c: c.compress(r) + c.flush())(zlib.compressobj(1, zlib.DEFLATED, 31))
    good = [pack(next(warc.records(i, "u", b"payload %d" % i, "d", None, False, warc.SEGMENT))) for i in range(3)]
    plain = next(warc.records(9, "u", b"x", "d", None, False, warc.SEGMENT))
    made = {"bad_member": good[0] + good[1][:20] + b"?" * 9 + good[1][29:] + good[2], "cut": good[0] + good[1][:-9], "no_blank": pack(plain.replace(b": ", b":", 5)), "zeros": good[0] + b"\0" * 9,
            "short": pack(plain.replace(b"Content-Length: ", b"Content-Length: 9")) + good[1], "no_gzip": plain + b"junk\r\n" + plain, "empty": b"", "number": pack(plain.replace(b"X-Page-ID: 9", b"X-Page-ID: nine")) + good[2]}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {n: sorted((str(r.page_id), r.error is None) for r in warc.read_archives(spark, f"{tmp_path}/{n}").collect()) for n in made}
    ok = lambda *ids: [(str(i), True) for i in ids]
    assert got["bad_member"][0] == ("0", True) and ("2", True) in got["bad_member"] and not all(x[1] for x in got["bad_member"])
    assert got["cut"][0] == ("0", True) and len(got["cut"]) == 2 and not got["cut"][1][1]
    assert got["no_blank"] == ok(9) and got["zeros"] == ok(0) and got["empty"] == []
    assert got["short"] == [("1", True), ("9", False)] and got["no_gzip"] == [*ok(9, 9), ("None", False)] and got["number"] == [("2", True), ("None", False)]


def test_words_of_the_packer_equal_the_library():
    path = public_tokenizers.path(packing.TOKENIZER)
    tok, words = Tokenizer.from_file(path), packing.Words(path)
    texts = [r[1] or "" for r in rows()]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in words(texts)] == want


def test_packing_places_every_id_once(docs, empty):
    path = public_tokenizers.path(packing.TOKENIZER)
    tok = Tokenizer.from_file(path)
    window = 64
    got = packing.pack(docs, window=window, group=5).collect()
    ids = {}
    for i, t, *_ in rows():
        ids.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    taken, filled = {}, {}
    for r in got:
        one = ids[r.doc_id][0]
        assert r.doc_tokens == len(one)
        assert r.ids_crc32 == zlib.crc32(one[r.start:r.start + r.length].tobytes())
        taken.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in taken.items():
        n = len(ids[i])
        assert sorted(p for a, k in parts for p in range(a, a + k)) == sorted(list(range(len(ids[i][0]))) * n)
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    total = sum(len(x) for many in ids.values() for x in many)
    assert len(filled) <= -(-total // window) + 1
    assert packing.pack(empty).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        found = packing.fill(counts, room)
        assert sum(a * b for a, b in found) == max(s for s in sums if s <= room)
        assert all(n <= counts[length] for length, n in found)
