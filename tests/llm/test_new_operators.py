"""Exact duplicates, spelling variants and the conversation trie against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest

from quillstack.llm import owners, prefixes, queries, spelling

# -- exact duplicates -------------------------------------------------------------------------------------------------


def plain_duplicates(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[ \t-\r]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        marks = Counter()
        for i in ids:
            first = i == keep and not marks[keep]
            marks[i] += 1
            out.append((i, keep, len(ids), first, sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab \t\n\x0bé\xa0") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    long = "wörd " * 60_000
    return [None, "", " ", "\n\t", "a", "a ", " a", "a  b", "a\tb", "a\x85b", long, long + " ", long + "x", long, *base]


def test_exact_duplicates_equal_a_plain_version(spark, texts):
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, "a"), (None, "only here"), (None, "only here"), (7, "tie"), (7, "tie"), (8, "tie")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, keep_id string, cls int").repartition(5)
    want = plain_duplicates(rows)
    assert rows_of(owners.duplicates(docs)) == want
    assert rows_of(owners.duplicates(docs, local=2_000, held=3_000)) == want  # tries that are full and spill
    kept = owners.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(k[0] for k in want if k[3] and k[0] is not None)
    assert owners.duplicates(docs.limit(0)).count() == 0


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert rows_of(owners.duplicates(docs)) == plain_duplicates([("b", "x"), ("a", "x"), (None, "x")])


def test_a_trie_that_spills_has_what_a_dict_has():
    rng = random.Random(5)
    for most in (1_000, 20_000, 1 << 30):
        trie, want = owners.Trie(lambda a, b: a + b, most), Counter()
        for _ in range(3_000):
            key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) + rng.choice([b"", b"tail" * 9])
            trie.put(key, 1)
            trie.trim()
            want[key] += 1
        assert trie.held <= max(most, 2_000)
        assert sorted(trie.items()) == sorted(want.items())


def test_exact_duplicates_equal_their_sql(spark, sf_dir):
    got = rows_of(queries.op11_exact_duplicates(spark, sf_dir))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(owners.oracle()).fetchall(), key=repr)


# -- spelling variants ------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(b) - len(a) != 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1:]


def plain_vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(rows):
    words = plain_vocabulary(rows)
    by_gap = defaultdict(set)  # words that agree but for one place share a pattern with a gap
    for w in words:
        for i in range(len(w) + 1):
            by_gap[w[:i] + "*" + w[i:]].add(w)
            by_gap[w[:i] + "*" + w[i + 1:]].add(w)
    links = defaultdict(set)
    for group in by_gap.values():
        for a in group:
            links[a] |= {b for b in group if a != b and near(a, b)}
    form = {}
    for w in words:
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_spelling_variants_equal_a_plain_version_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert variants_of(queries.op12_spelling_variants(spark, sf_dir)) == want
    assert any(w[1] for w in want)


def test_spelling_variants_of_made_words(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdéÿ×") for _ in range(rng.randint(7, 11))) for _ in range(60)]
    long = "".join(rng.choice("abcd") for _ in range(5_000))
    rows = [(None, "aaaaaaaa Aaaaaaaa aaaaaaa aaaaaaa"), (1, None), (2, ""), (2, "123 - Ā ×"), (3, f"{long} {long} {long}a {long}a"), (3, f"{long[:100]}é{long[101:]} " * 2),
            (4, " ".join(w.upper() for w in base)), (4, " ".join(w.upper() for w in base))]
    for k in range(12):  # chains: each word ten times as frequent as one that is near
        rows += [(10 + k, " ".join(["abcdefgh"] * 400 + ["abcdefgx"] * 30 + ["abcdefyx"] * 2 + ["tiedword"] * 10 + ["tiedworx"] * 10 + ["tiedwora"]))]
    for k in range(300):
        w = list(rng.choice(base))
        at = rng.randrange(len(w))
        w[at:at + rng.randint(0, 1)] = rng.choice(["", "z", "é", "ab"])
        rows.append((1000 + k, ("".join(w) + " ") * 2 + rng.choice(base)))
    docs = spark.createDataFrame([(i, t, "clash", 2) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = plain_variants(rows)
    got = variants_of(spelling.variants(docs))
    assert got == want
    assert {w: r for w, _, r, *_ in got}["abcdefyx"] == "abcdefgh"
    assert sum(w[4] for w in want) > 100
    assert spelling.variants(docs.limit(0)).count() == 0


def test_filters_have_no_false_negatives_and_few_positives_else():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(7, 300))) for _ in range(3_000)]
    import numpy as np

    size = spelling.shard(np.array([len(w) for w in words]))
    filters = spelling.Filters(dict(Counter(size.tolist())))
    full = np.zeros(filters.size, np.uint64)
    block, bits = filters.place(size, spelling.keys(words))
    np.bitwise_or.at(full, block, bits)
    assert (full[block] & bits == bits).all()
    other = ["".join(rng.choice("klmnop") for _ in w) for w in words]
    block, bits = filters.place(size, spelling.keys(other))
    assert (full[block] & bits == bits).mean() < 0.05


def test_keys_of_edits_are_those_of_the_edited_words():
    import numpy as np

    words, alphabet = ["banana", "aab", "éa", "x" * 300], np.array(sorted(map(ord, "abnéx")), np.uint64)
    got = {(int(w), int(k)) for w, key, _ in spelling.edits(words, alphabet) for w, k in zip(w, key, strict=True)}
    want = set()
    for i, w in enumerate(words):
        made = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in "abnéx" if c > w[k]}
        want |= {(i, int(k)) for k in spelling.keys(sorted(made))}
    assert got == want


# -- conversation trie ------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1], sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()[:16])
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20 if c >= 0 else c + (-c) % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    out = []
    below = lambda p: [q for q in members if q[:len(p)] == p]
    inner = {q[:-1] for q in members if q}
    for p, cs in members.items():
        sub = below(p)
        saved = sum((len(members[q]) - 1) * len(re.findall("[^ \t-\r]+", q[-1][1])) for q in sub if q)
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), sum(len(q) == len(p) + 1 for q in sub), sum(q not in inner for q in sub), saved,
                    sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def test_conversation_trie_equals_a_plain_version_on_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(queries.op13_conversation_trie(spark, sf_dir)) == plain_trie(rows)


def test_conversation_trie_of_made_turns(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 90, 3), *range(20, 40), 1_000_000_007, -5]:
        if c == 60:
            continue  # a family without its first conversation
        n = 45 if c == 20 else rng.randint(1, 9)
        rows += [(c, None if t == 0 and c % 2 else t, rng.choice(["user", None, ""]) if t else "user", " ".join(rng.choice("ab\u0085") for _ in range(rng.randint(0, 2))) or None) for t in range(n)]
    rows += [(80, 1, "user", "same"), (80, 1, "user", "same"), (80, 1, "bot", "other"), (None, 1, "user", "lost"), (41, 1, "user", "short")]
    rows += [(c, t, "user", "hot") for c in range(400, 440) for t in range(rng.choice([2, 3]))]
    schema = "conv_id long, turn long, role string, text string, depth string, name int"
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], schema).repartition(4)
    want = plain_trie(rows)
    assert trie_of(prefixes.trie(df)) == want
    monkeypatch.setattr(prefixes, "HEAVY", 3)
    assert trie_of(prefixes.trie(df, joined=5)) == want
    assert prefixes.trie(df.limit(0)).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    # ids whose checksum asks for a first turn of an absent family head, with one turn of their own
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:3]
    rows = [(c, 0, "user", "gone") for c in ids]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie_of(prefixes.trie(df))
    assert got == plain_trie(rows) and [r[1] for r in got] == [0]
