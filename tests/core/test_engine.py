"""The document engine: every query against its SQL, folds against plain loops, functions against plain Python."""

import datetime
import itertools
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillstack.functions import geometry, ids, status, texts
from quillstack.operators import jobs, tree
from quillstack.plans import catalogue
from quillstack.sources import annotations, binding
from quillstack.streaming import events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return format(value, ".9g")
    if isinstance(value, list):
        return [plain(v) for v in value]
    if hasattr(value, "as_tuple"):
        return format(float(value), ".9g")
    return value


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    rows = [[plain(v) for v in r] for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr([plain(v) for v in r]) for r in want)


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_debounce_equals_a_loop(spark, sf_dir):
    rows = binding.events(spark, sf_dir).orderBy("job", "ts", "seq").collect()
    want, last = set(), {}
    for r in rows:
        at, was = r.ts.timestamp(), last.get(r.job)
        if was is None or r.status in binding.ENDS or r.status != was[0] or at - was[2] >= 3 or abs(r.progress - was[1]) >= 0.05:
            want.add(r.seq)
            last[r.job] = (r.status, r.progress, at)
    assert {r.seq for r in catalogue.debounce_updates(spark, sf_dir).collect()} == want


def test_debounce_on_a_stream_equals_the_batch(spark, sf_dir):
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    job = source.selectExpr("user_id AS job", "ts", "event_id AS seq", "event_type AS status", "least(abs(value) / 100, 1.0) AS progress")
    run = events.debounced_stream(job, binding.ENDS).writeStream.format("memory").queryName("debounced").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert {r.seq for r in spark.table("debounced").collect()} == {r.seq for r in catalogue.debounce_updates(spark, sf_dir).collect()}


def test_debounce_keeps_its_state_between_micro_batches_and_drops_it_in_time(spark, tmp_path):
    rows, schema = [], "job long, ts timestamp_ntz, seq long, status string, progress double"
    start = datetime.datetime(2024, 1, 1)
    for k in range(300):
        status = "done" if k % 40 == 39 else "run" if k % 7 else "wait"
        rows.append((k % 3, start + datetime.timedelta(milliseconds=k * 400 + (k // 100) * 7_200_000), k, status, None if k % 11 == 0 else k % 20 / 200))
    for n in range(6):
        spark.createDataFrame(rows[n * 50:n * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = events.debounced_stream(source, late="10 seconds").writeStream.format("memory").queryName("debounced_parts").outputMode("append").start()
    run.processAllAvailable()
    left = run.lastProgress["stateOperators"][0]["numRowsTotal"]
    batches = sum(p["numInputRows"] > 0 for p in run.recentProgress)
    run.stop()
    want = {r.seq for r in events.debounced(spark.createDataFrame(rows, schema)).collect()}
    assert batches == 6 and {r.seq for r in spark.table("debounced_parts").collect()} == want
    assert left <= 3 and 0 < len(want) < 300


def test_a_job_is_dead_only_when_seen_silent_twice():
    def seen(*looks):
        state, out = None, []
        for at, active, age in looks:
            dead, state = events.watch(state, at * events.SECOND, active, age, 1500.0)
            out.append(dead)
        return out

    assert seen((0, False, 2000), (299, False, 2300), (300, False, 2400), (301, False, 2400)) == [False, False, True, False]
    assert seen((0, False, 700), (400, False, 1600)) == [False, True]
    assert seen((0, False, 600), (400, False, 1600), (800, False, 1600)) == [False, False, True]
    assert seen((0, False, 2000), (100, True, 5), (400, False, 2000), (500, False, None), (700, False, 2000)) == [False, False, False, False, True]


def test_folds_take_empty_tables_null_jobs_and_null_times(spark):
    schema = "job long, ts timestamp_ntz, seq long, status string, progress double"
    at = datetime.datetime(2024, 1, 1)
    rows = [(None, at, 1, "run", None), (None, at, 2, "run", 0.01), (1, None, 3, "run", 0.5), (1, at, 4, None, 0.5), (1, at, 4, None, 0.5)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(((r.job or 0, r.seq, r.written) for r in events.judged(df).collect())) == [(0, 1, True), (0, 2, False), (1, 4, False), (1, 4, True)]
    assert sorted((r.job or 0, r.seq) for r in events.pending(df).collect()) == [(0, 2), (1, 4)]
    assert events.judged(df.limit(0)).count() == events.rate_limited(df.limit(0)).count() == 0


def test_token_bucket_equals_a_loop(spark, sf_dir):
    tokens, before, want = {}, {}, {}
    for r in binding.events(spark, sf_dir).orderBy("job", "ts", "seq").collect():
        at = r.ts.timestamp()
        t = 2.0 if r.job not in before else min(2.0, tokens[r.job] + (at - before[r.job]) / 86_400 * 2)
        want[r.seq] = t >= 1
        tokens[r.job], before[r.job] = t - (t >= 1), at
    assert {r.seq: r.passes for r in catalogue.token_bucket(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("by", [None, "engine"])
def test_neighbours_across_ranges_equal_a_sorted_list(spark, by):
    rows = [(f"J{k:03d}", "queued" if k % 5 else "done", None if k % 9 == 0 else "a" if k < 150 else "b", k * 7 % 4, k % 3) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, status string, engine string, priority int, created_at int")
    want, queues = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
        if r[1] == "queued":
            queues.setdefault(r[2] if by else 0, []).append(r)
    for q in queues.values():
        for before, r, after in zip([None, *q], q, [*q[1:], None]):
            want[r[0]] = (before and before[0], before and before[3], after and after[0], after and after[3])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        got = {r.id: (r.before_id, r.before_priority, r.after_id, r.after_priority) for r in jobs.neighbours(df, by).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert jobs.neighbours(df.limit(0), by).count() == 0


def test_codes(spark):
    df = spark.createDataFrame([("550e8400-e29b-41d4-a716-446655440000",)], "u string")
    code = df.select(ids.encode(F.col("u"))).first()[0]
    assert code == "4RJL-WYWG-WDH"
    assert ids.repaired(code) == code
    for i, letter in enumerate(code):  # every single look-alike that may have been read is undone
        for seen in (x for x, many in ids.LOOKALIKES.items() if letter in many):
            mended = ids.repaired(code[:i] + seen + code[i + 1:])
            assert mended is not None and (mended == code or seen in ids.ALPHABET)
    assert ids.repaired(code.replace("L", "")) is not None
    assert ids.repaired(None) is None and ids.repaired("short") is None
    checked = spark.createDataFrame([(code,), ("AAAA-AAAA-AAA",), ("",), (None,)], "c string").select(ids.is_valid(F.col("c")), ids.decode(F.col("c"))).collect()
    assert [r[0] for r in checked] == [True, False, False, False]
    assert checked[0][1] == "03457b3b1c"


def test_statuses(spark):
    cases = {None: "not_recognized", "": "not_recognized", " \n": "not_recognized", "[Ошибка: x]": "error", "[НеПовторяемая ошибка: x]": "error", "text": "success",
             '[{"bbox": [1], "label": "a"}]': "error", '[{"a": {"rows": 1}}]': "error", "[1, 2]": "success", "Let me see. I need to look.": "error", "Давай посмотрим. Мне нужно": "error",
             "<p>Let me see. I need to</p>": "success", "<div>" * 20: "error", '<table data-bbox="1 150 2 3"><tr><td>a cell that is long enough</td></tr></table>': "error",
             '<h2>t</h2><table data-bbox="1 150 2 3"><tr><td>a cell that is long enough</td></tr></table>': "success"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(status.status(F.col("t"))).collect()] == list(cases.values())


def test_small_formats(spark):
    df = spark.createDataFrame([("```json\n{}\n```", 1536)], "f string, n long")
    row = df.select(texts.strip_fence(F.col("f")), texts.size_text(F.col("n"))).first()
    assert row[0] == "{}" and row[1] == "1.5 KB"


def test_boxes(spark):
    df = spark.createDataFrame([([39, 39, 100, 100],)], "px array<int>")
    w, h = F.lit(1240), F.lit(1754)
    again = df.select(geometry.to_pixels(geometry.to_shares(F.col("px"), w, h), w, h)).first()[0]
    assert again[0] == int(39 / 1240 * 1240) == 38
    assert df.select(geometry.normal_shares(F.array(F.lit(0.5), F.lit(float("nan")), F.lit(1.0), F.lit(1.0)))).first()[0] is None


def test_annotations_of_three_versions(spark):
    v0 = '[{"id": "a", "page_index": 1, "coords_px": [1, 2, 3, 4], "block_type": "table"}]'
    v1 = '{"pdf_path": "x.pdf", "pages": [{"page_number": 0, "width": 100, "height": 200, "blocks": [{"id": "b", "coords_px": [10, 20, 50, 60], "block_type": "image", "category_code": "stamp"}]}]}'
    v2 = v1.replace('"pdf_path"', '"format_version": 2, "pdf_path"').replace('"coords_px"', '"coords_norm": [0.1, 0.1, 0.2, 0.2], "coords_px"')
    df = spark.createDataFrame([("n0", v0), ("n1", v1), ("n2", v2)], "node_id string, data string")
    assert [r[0] for r in df.select(annotations.version(F.col("data"))).collect()] == [0, 1, 2]
    got = {r.node_id: r for r in annotations.blocks(df).collect()}
    assert got["n0"].block_type == "text" and got["n0"].page == 1 and got["n0"].coords_norm == [0.0, 0.0, 0.1, 0.1]
    assert got["n1"].block_type == "stamp" and got["n1"].coords_norm == [0.1, 0.1, 0.5, 0.3] and got["n1"].source == "user"
    assert got["n2"].coords_norm == [0.1, 0.1, 0.2, 0.2]
    back = annotations.blocks(annotations.to_json(annotations.blocks(df.where("node_id = 'n1'")))).first()
    assert (back.id, back.coords_px, back.block_type) == ("b", [10, 20, 50, 60], "stamp")
    assert df.select(annotations.errors(F.lit("[]"))).first()[0] == ["not an object", "no pdf_path", "no pages"]


def test_tree_refuses_a_move_into_itself(spark, sf_dir):
    nodes = tree.with_paths(binding.edges(spark, sf_dir))
    below = tree.descendants(nodes, F.col("id") == "N3").first().id
    assert tree.moved(nodes, "N3", below).where("id = 'N3'").first().path == nodes.where("id = 'N3'").first().path
    orphan = spark.createDataFrame([("x", "missing"), ("y", "x")], "id string, parent_id string")
    assert {r.id: (r.path, r.depth) for r in tree.with_paths(orphan).collect()} == {"x": ("x", 0), "y": ("x.y", 1)}


def test_codes_are_repaired_without_trying_every_change(monkeypatch):
    """As a plain search over all changes finds them, but with a few checks for each code."""
    rng, checks = random.Random(5), []
    whole = lambda c: tuple(sum(w * ids.ALPHABET.find(x) for w, x in zip(ws, c, strict=True)) % 26 for ws in zip(*ids._WEIGHTS, strict=True)) == (0, 0, 0)
    def plain(c):
        letters = [sorted(set(ids.LOOKALIKES.get(x, "")) & set(ids.ALPHABET)) or ([] if x in ids.ALPHABET else list(ids.ALPHABET[:8])) for x in c]
        tries = [c] if len(c) == 11 else [c[:i] + x + c[i:] for i in range(11) for x in ids.ALPHABET] if len(c) == 10 else [c[:i] + c[i + 1:] for i in range(12)]
        if len(c) == 11:
            for n in (1, 2, 3):
                for at in itertools.combinations(range(11), n):
                    tries += ("".join(new.get(i, x) for i, x in enumerate(c)) for new in (dict(zip(at, xs, strict=True)) for xs in itertools.product(*(letters[i] for i in at))))
        found = next((t for t in tries if set(t) <= set(ids.ALPHABET) and whole(t)), None)
        return found and f"{found[:4]}-{found[4:8]}-{found[8:]}"
    codes = ["".join(rng.choice(ids.ALPHABET) for _ in range(n)) for n in (10, 10, 10, 11, 11, 11, 11, 12, 12)] + ["4RJL?YWGW0H", "?RJLWYW?WD?", "????WYWGWDH", "4RJLWYWG?D"]
    real = ids._checks
    monkeypatch.setattr(ids, "_checks", lambda c: checks.append(c) or real(c))
    assert [ids.repaired(c) for c in codes] == [plain(c) for c in codes]
    assert len(checks) < 5 * len(codes)


def test_heavy_row_work_is_spread(spark, sf_dir):
    """A file of one row group doesn't leave all its rows to one task."""
    assert catalogue.block_code_repair(spark, sf_dir).rdd.getNumPartitions() > 4
