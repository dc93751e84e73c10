"""Annotations carried to other pages, filters as data and listings by pages against plain models."""

import datetime
import json
import random

from quillstack.operators import canonical, filters, jobs, listings, verification
from quillstack.plans import views
from quillstack.sources import migration

BLOCK = "struct<id: string, coords_px: array<int>, coords_norm: array<double>, shape_type: string, polygon: array<struct<x: int, y: int>>>"
DOCUMENT = f"doc_id string, pdf_path string, pages array<struct<page_number: int, width: int, height: int, blocks: array<{BLOCK}>>>"
SIZES = "doc_id string, pdf_path string, sizes array<struct<width: int, height: int>>"


def inside(px, w, h):
    def side(a, b, most):
        a, b = min(max(a, 0), max(most - 1, 0)), min(max(b, 0), most)
        if b <= a:
            a, b = (0, most) if most <= 1 else (min(a, most - 1), min(most, min(a, most - 1) + 1))
        return a, b
    (x1, x2), (y1, y2) = side(px[0], px[2], w), side(px[1], px[3], h)
    return [x1, y1, x2, y2]


def clamped(points, w, h):
    return [(min(max(x, 0), max(w - 1, 0)), min(max(y, 0), max(h - 1, 0))) for x, y in points]


def plain(block, w, h, prefer_px):
    _, px, shares, shape, points = block
    ok = shares is not None and len(shares) == 4 and all(v is not None and abs(v) < float("inf") for v in shares)
    if ok:
        k = [min(max(v, 0.0), 1.0) for v in shares]
        k = [min(k[0], k[2]), min(k[1], k[3]), max(k[0], k[2]), max(k[1], k[3])]
        ok = k[2] - k[0] > 1e-6 and k[3] - k[1] > 1e-6
    polygon = shape == "polygon" and points
    if prefer_px or not ok:
        if polygon:
            points = clamped(points, w, h)
            px = [min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)]
        px = inside(px, w, h)
    else:
        old, px = inside(px, w, h), inside([int(k[0] * w), int(k[1] * h), int(k[2] * w), int(k[3] * h)], w, h)
        if polygon:
            scale = lambda v, i: int(px[i] + (v - old[i]) / max(old[i + 2] - old[i], 1) * max(px[i + 2] - px[i], 1))
            points = clamped([(scale(x, 0), scale(y, 1)) for x, y in points], w, h)
    return px, [round(v, 9) for v in (px[0] / w, px[1] / h, px[2] / w, px[3] / h)], points


def test_blocks_carried_to_pages_of_another_size(spark):
    rng = random.Random(11)
    some = lambda low, high: rng.randint(low, high)
    blocks = []
    for k in range(120):
        px = [some(-50, 1300), some(-50, 1800), some(-50, 1300), some(-50, 1800)]
        shares = rng.choice([[px[0] / 1240, px[1] / 1754, px[2] / 1240, px[3] / 1754], None, [0.1, 0.1, 0.1, 0.9], [float("nan"), 0.0, 1.0, 1.0], [0.2, 0.3, 0.9, 2.0], [0.1, 0.2]])
        points = rng.choice([None, [], [(some(-20, 1300), some(-20, 1800)) for _ in range(some(1, 5))]])
        blocks.append((str(k), px, shares, rng.choice(["polygon", "rectangle"]), points))
    docs = spark.createDataFrame([("d", "/a/X.pdf", [(1, 1240, 1754, blocks[60:]), (0, 1240, 1754, blocks[:60]), (7, 5, 5, [])]), ("same", "/a/s.pdf", [(0, 10, 10, [])]), ("none", "x", [])], DOCUMENT)
    sizes = spark.createDataFrame([("d", "/b/x.PDF", [(800, 1000), (1, 1), (300, 300)]), ("same", "/a/s.pdf", [(10, 10)]), ("none", "x", [])], SIZES)
    for prefer in (False, True):
        found = {r.doc_id: r for r in canonical.canonical(docs, sizes, prefer).collect()}
        assert found["d"].changed and not found["same"].changed and not found["none"].changed and found["d"].page_count == 3 and found["d"].strategy == ("px" if prefer else "norm")
        assert [(p.page_number, p.width, p.height, len(p.blocks)) for p in found["d"].pages] == [(0, 800, 1000, 60), (1, 1, 1, 60), (2, 300, 300, 0)]
        for page, (w, h), own in zip(found["d"].pages, [(800, 1000), (1, 1)], [blocks[:60], blocks[60:]], strict=False):
            for got, block in zip(page.blocks, own, strict=True):
                px, shares, points = plain(block, w, h, prefer)
                assert (got.coords_px, [round(v, 9) for v in got.coords_norm], [tuple(p) for p in got.polygon or []]) == (px, shares, points or []), block
    assert canonical.canonical(docs.limit(0), sizes).count() == 0


def test_why_annotations_do_not_fit(spark):
    docs = spark.createDataFrame([("a", "p", [(1, 100, 200, []), (0, 50, 60, [])]), ("b", "p", [(0, 50, 60, [])]), ("c", "p", [(0, 50, 60, [])]), ("d", "p", [(0, 53, 60, [])])], DOCUMENT)
    sizes = spark.createDataFrame([("a", "p", [(52, 58), (100, 203)]), ("b", "p", []), ("c", "p", [(51, 61)]), ("d", "p", [(50, 60)])], SIZES)
    got = {r.doc_id: (r.compatible, r.reason) for r in canonical.compatibility(docs, sizes).collect()}
    assert got == {"a": (False, "Page 2: annotation=100x200, pdf=100x203"), "b": (False, "Different page count: annotation=1, pdf=0"), "c": (True, ""), "d": (False, "Page 1: annotation=53x60, pdf=50x60")}
    pairs = spark.createDataFrame([("/a/X.pdf", "b/x.PDF"), ("", ""), (None, "x"), ("a/x", "a/y")], "a string, b string").coalesce(1)
    from pyspark.sql import functions as F

    assert [r[0] for r in pairs.select(canonical.related(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_filters_as_data_equal_a_loop(spark):
    day = datetime.date
    rows = [(1, "F", 10, 1.5, day(2024, 1, 1), True), (2, "O", 200, float("inf"), day(2024, 5, 1), False), (3, None, None, None, None, None), (4, "f,x", -5, 0.25, day(2023, 1, 1), True), (5, "10", 9_007_199_254_740_993, 10.0, day(2024, 1, 2), None)]
    schema = "k int, s string, n long, x double, d date, b boolean"
    table = {"s": str, "n": int, "x": float, "d": lambda v: day.fromisoformat(v), "b": lambda v: {"true": True, "false": False}[v]}
    made = [("a", "s", "eq", "F"), ("a", "n", "gt", "5"), ("b", "n", "lt", "9007199254740993"), ("c", "d", "gte", "2024-01-01"), ("c", "b", "neq", "true"), ("d", "s", "in", '{F,"O"}'), ("e", "nothing", "eq", "1"), ("f", "n", "eq", "word"),
            ("g", "x", "lte", "1.5"), ("g", "nothing", "eq", "1"), ("h", "s", "like", "F"), ("i", "n", "in", "{10,-5,x}"), ("j", "b", "eq", "true"), ("a", "s", "eq", "F"), ("l", "s", "eq", None), ("m", "n", "eq", "9007199254740993"), ("n", "s", "lt", "G")]
    by = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}

    def holds(row, column, op, value):
        cell = dict(zip(["k", "s", "n", "x", "d", "b"], row, strict=True))[column]
        try:
            values = [v.strip().strip('"') for v in value.strip("{}").split(",")] if op == "in" else [value]
            good = []
            for v in values:
                try:
                    good.append(table[column](v))
                except ValueError:
                    if op != "in":
                        raise
            return cell is not None and (cell in good if op == "in" else by[op](cell, good[0]))
        except (ValueError, KeyError, AttributeError, TypeError):
            return False

    want = set()
    for s in {f[0] for f in made}:
        own = {f for f in made if f[0] == s and f[1] in table}
        want |= {(s, r[0]) for r in rows if own and all(holds(r, *f[1:]) for f in own)}
    df, data = spark.createDataFrame(rows, schema), spark.createDataFrame(made, "subscription string, column_name string, op string, value string")
    assert {(r.subscription, r.k) for r in filters.visible(df, "k", data).collect()} == want and len(want) > 10
    assert filters.visible(df, "k", data.limit(0)).count() == filters.visible(df.limit(0), "k", data).count() == 0


def test_pages_of_a_listing_join_to_the_whole(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([None, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)])
    rows = [(f"p/{rng.choice('abc')}{k}{rng.choice(['', '/x', '/y/z'])}", k, at()) for k in range(60)] + [("p/a", 1, None), ("p/a/b", 1, None), ("q/x", 1, None), ("p/", 1, None)]
    objects = spark.createDataFrame(rows, "key string, size long, updated_at timestamp_ntz")
    whole = listings.entries(objects, "p/").collect()
    assert {(r.name, r.is_folder) for r in whole} == {("p/" + k[2:].split("/")[0], "/" in k[2:]) for k, *_ in rows if k.startswith("p/")} and sum(r.n for r in whole) == 63
    rank = lambda r: (r.updated_at is not None, r.updated_at or datetime.datetime.min, r.name, r.is_folder)
    for rising in (True, False):
        seen, after = [], None
        while part := listings.by_time(objects, "p/", limit=9, after=after, rising=rising).collect():
            seen += part
            after = (part[-1].updated_at, part[-1].name, part[-1].is_folder)
        assert seen == sorted(whole, key=rank, reverse=not rising)
    names, after = [], None
    while part := listings.by_name(objects, "p/", limit=8, after=after).collect():
        names += part
        after = (part[-1].name, part[-1].is_folder)
    assert names == sorted(whole, key=lambda r: (r.name, r.is_folder))
    assert [r.name for r in listings.by_name(objects, "p/", limit=1, after="p/a").collect()] == [min(r.name for r in whole if r.name > "p/a")]
    pages = listings.numbered(listings.entries(objects, "p/"), [("name", True), ("is_folder", True)], 7).collect()
    order = sorted((r.name, r.is_folder) for r in whole)
    assert sorted((r.page, r.name, r.is_folder) for r in pages) == [(k // 7, *x) for k, x in enumerate(order)]


def test_a_verification_that_stops_goes_on_to_the_same_attempts(spark):
    schema = "doc_id string, id string, page int, pos int, block_type string, ocr_text string, category_code string"
    rows = [("d", f"t{k}", k // 3, k, "text", [None, "fine text", "[Ошибка: x]", "[НеПовторяемая ошибка: y]", " "][k % 5], None) for k in range(20)]
    rows += [("d", f"s{k}", k, 50 + k, "stamp" if k else "image", ["", '{"stage": 1}', "no json", "{}"][k], None if k else "stamp") for k in range(4)] + [("e", "i", 0, 0, "image", "[Ошибка: x]", None)]
    blocks = spark.createDataFrame(rows, schema)
    key = lambda df: sorted(map(tuple, df.select("id", "round", "text").collect()))
    whole = verification.verified(blocks, views.again, 3, 5)
    part = verification.verified(blocks, views.again, 1, 5)
    assert key(verification.verified(blocks, views.again, 3, 5, attempts=part)) == key(whole) and key(part) == [r for r in key(whole) if r[1] == 1]
    ids = {r[0] for r in key(whole)}
    assert {"s0", "s2", "s3", "i"} <= ids and not {"s1", "t1", "t3"} & ids
    assert max(sum(r[1] == n and r[0][0] == "t" for r in key(whole)) for n in (1, 2, 3)) == 5
    assert verification.applied(blocks, whole).where("ocr_text like 'round%'").count() == len({r[0] for r in key(whole) if r[2].startswith("round")})
    assert key(verification.verified(blocks.limit(0), views.again, 2, 5)) == []
    none = spark.createDataFrame([("queued",)] * 3, "status string")
    assert [jobs.has_room(none, n).first().room for n in (0, 3, 4)] == [True, False, True]


def test_annotations_of_every_version_and_none(spark):
    block = {"id": "a", "page_index": 0, "coords_px": [1, 2, 3, 4], "block_type": "text"}
    cases = {
        "flat": [block | {"page_index": 2, "coords_px": [0, 0, 2000, 10]}, {"page_index": 0}], "empty": {"pdf_path": None, "pages": []}, "stated": {"pdf_path": "x", "format_version": 1, "pages": [{"blocks": [block | {"source": "s", "coords_norm": [0, 0, 1, 1]}]}]},
        "old": {"pdf_path": "x", "pages": [{"width": 10, "height": 20}, {"page_number": 5, "width": 10, "height": 20, "blocks": [block, {"id": "b", "coords_px": [1, 1, 1, 1]}, {}]}]}, "new": {"pdf_path": "x", "pages": [{"blocks": [{"source": "s", "coords_norm": None}]}]},
        "list": [1], "no list": {"pdf_path": "x", "pages": 5}, "bad": {"pages": [{"blocks": {}}, 3]}, "text": "x"}
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [("broken", "{"), ("null", None), ("none", "[]")]
    df = spark.createDataFrame(rows, "node_id string, data string")
    got = {r.node_id: (r.version, r.success, r.migrated, r.errors) for r in migration.documents(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"flat": 0, "empty": 2, "stated": 1, "old": 1, "new": 2, "list": None, "no list": None, "bad": None, "text": None, "broken": None, "null": None, "none": None}
    assert got["bad"][3] == ["no pdf_path", "page 0 has blocks that are no list", "page 1 is no object"] and got["no list"][3] == ["pages are no list"] and got["none"][3] == ["not an object"] and got["flat"][1:3] == (True, True)
    found = migration.outcomes(df)
    assert sorted((r.node_id, r.pos, r.warning) for r in migration.warnings(found).collect()) == [
        ("old", 0, "filled coords_norm"), ("old", 0, "filled source"), ("old", 1, "dropped without block_type, page_index"), ("old", 2, "dropped without block_type, coords_px, id, page_index")]
    kept = {(r.node_id, r.id): (r.page, r.coords_norm, r.source, r.shape_type) for r in migration.kept(found).collect()}
    assert kept[("old", "a")] == (5, [0.1, 0.1, 0.3, 0.2], "user", "rectangle") and kept[("stated", "a")][1:3] == ([0.0, 0.0, 1.0, 1.0], "s") and len(kept) == 5
    assert sorted((r.page, r.width, r.height) for r in migration.flat_pages(found).collect()) == [(0, 1240, 1754), (1, 1240, 1754), (2, 2050, 1754)]
    assert migration.outcomes(df.limit(0)).count() == 0
