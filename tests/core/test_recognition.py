"""Segments, matched ids, clean html and contents of every form against plain models."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillstack.functions import ids, markup, responses, tables
from quillstack.operators import blocks, exports, jobs, matching, segments, stamps, tree
from quillstack.plans import recognition


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def ratio(a, b):
    longest = max(len(a), len(b))
    return (longest - edits(a, b)) / longest * 100 if a and b else 0.0


def best(seen, expected, cutoff):
    scored = [(ratio(seen, text), -pos, i) for i, text, pos in expected]
    top = max(scored, default=(0, 0, None))
    return (top[2], top[0]) if top[0] >= cutoff and top[0] > 0 else (None, 0.0)


# -- matching ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("alphabet", "length", "cutoff"), [("ABCD", 11, 70.0), ("0123456789abcdef", 36, 90.0), ("ab", 6, 60.0)])
def test_nearest_equals_all_pairs(spark, alphabet, length, cutoff):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    expected = [(d, f"id{k}", word(length), k) for d, n in (("big", 150), ("small", 9)) for k in range(n)]
    expected += [("big", "twin", expected[3][2], 900), ("big", "empty", "", 901)]
    seen = []
    for _ in range(200):
        d, _, text, _ = rng.choice(expected)
        made = list(text)
        for _ in range(rng.randint(0, max(1, length // 3))):
            at = rng.randrange(len(made) + 1)
            made[at:at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(alphabet)], [rng.choice(alphabet)]])
        seen.append((d, "".join(made)))
    seen += [("big", ""), ("big", None), (None, "A"), ("none", word(length))]
    got = {(r.doc_id, r.seen): (r.id, round(r.score, 6)) for r in matching.nearest(
        spark.createDataFrame(seen, "doc_id string, seen string"), spark.createDataFrame(expected, "doc_id string, id string, text string, pos int"), cutoff).collect()}
    want = {}
    for d, s in seen:
        i, score = best(s or "", [(i, t, p) for e, i, t, p in expected if e == d], cutoff)
        if i:
            want[d, s] = (i, round(score, 6))
    assert got == want and len(want) > 50


def test_one_large_document_is_not_all_pairs(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ids.ALPHABET) for _ in range(11)) for _ in range(6_000)]
    expected = spark.createDataFrame([("d", t) for t in texts], "doc_id string, text string")
    seen = spark.createDataFrame([("d", t[:4] + "0" + t[5:9] + t[10:]) for t in texts[:2_000]], "doc_id string, seen string")
    found = matching.by_pieces(seen, expected, 70.0)
    assert found.count() < 2_000 * 6_000 / 500
    assert found.where(F.levenshtein("seen", "text") <= 2).select("seen").distinct().count() == 2_000


def test_tiers_of_codes_and_uuids(spark):
    uuid = "1f9619ff-8b86-d011-b42d-00c04fc964ff"
    code = spark.range(1).select(ids.encode(F.lit(uuid))).first()[0]
    other = spark.range(1).select(ids.encode(F.lit("123456789a"))).first()[0]
    expected = spark.createDataFrame([("d", uuid, 0), ("d", other, 1), ("e", code, 0), ("e", "x" * 40, 1)], "doc_id string, id string, pos int")
    seen = [("d", code), ("d", other.lower()), ("d", other[:3] + other[4:]), ("d", "ZZ" + other[2:-1]), ("e", code), ("e", "3333-3333-333"), ("f", code)]
    got = {(r.doc_id, r.seen): (r.id, r.score > 99) for r in matching.match_codes(spark.createDataFrame(seen, "doc_id string, seen string"), expected).collect()}
    assert got[("d", code)] == (uuid, True) and got[("d", other.lower())] == (other, True) and got[("d", other[:3] + other[4:])] == (other, True)
    assert got[("e", code)] == (code, True) and ("e", "3333-3333-333") not in got and ("f", code) not in got
    odd = [("d", uuid.upper().replace("0", "O")), ("d", uuid[:-2] + "aa"), ("d", uuid.replace("-", "").replace("1f96", "zz9x6") + "!!"), ("d", "f" * 32)]
    got = {r.seen: (r.id, r.score == 100.0) for r in matching.match_uuids(spark.createDataFrame(odd, "doc_id string, seen string"), expected).collect()}
    assert got == {odd[0][1]: (uuid, True), odd[1][1]: (uuid, False)}


# -- segments ----------------------------------------------------------------------------------------------------------


def plain_match(seen, expected):
    """(id, score) of a code among expected ids in their order."""
    fixed = (ids.repaired(seen) or "").replace("-", "")
    codes = [(i, i.replace("-", "").upper(), k) for k, i in enumerate(expected) if re.fullmatch(f"[{ids.ALPHABET}]{{11}}", i.replace("-", "").upper())]
    for i, text, _ in codes:
        if fixed and text == fixed:
            return i, 100.0
    if fixed:
        number = 0
        for c in fixed[:8]:
            number = number * 26 + ids.ALPHABET.index(c)
        for i in expected:
            if re.fullmatch("[0-9a-f]{32}", i.replace("-", "").lower()) and i.replace("-", "").lower().startswith(f"{number:010x}"):
                return i, 100.0
    return best(seen.replace("-", "").replace(" ", "").upper(), codes, 70.0)


def plain_uuid(seen, expected):
    norm = re.sub("[^0-9a-f]", "", seen.strip().translate(str.maketrans(ids.HEX_FROM, ids.HEX_TO)).lower())[:32]
    norm = "-".join((norm[:8], norm[8:12], norm[12:16], norm[16:20], norm[20:])) if len(norm) == 32 else ""
    if norm in expected:
        return norm, 100.0
    texts = [(i, i, k) for k, i in enumerate(expected)]
    found = best(norm, texts, 90.0)
    raw = re.sub(r"[^a-f0-9\-]", "", seen.lower())
    return found if found[0] else best(raw, texts, 90.0) if len(raw) >= 30 else (None, 0.0)


def plain_segments(html, expected):
    out = {}
    marks = [(m, *plain_match(m.group(1), expected)) for m in re.finditer(segments.CODE_MARKER, html)]
    if not any(i for _, i, _ in marks):
        marks = [(m, *plain_uuid(m.group(1), expected)) for m in re.finditer(segments.UUID_MARKER, html)]
    firsts = {}
    for m, i, score in marks:
        if i and i not in firsts:
            firsts[i] = (m, score)
    order = sorted(firsts.items(), key=lambda x: x[1][0].start())
    for k, (i, (m, score)) in enumerate(order):
        text = html[m.end():order[k + 1][1][0].start() if k + 1 < len(order) else len(html)]
        for p in (segments.AFTER_MARKER, r"^\s+", segments.NEXT_MARKER, segments.NEXT_HEADER, segments.NEXT_BLOCK, segments.OPEN_PARAGRAPH, *segments.HEADER_LINES):
            text = re.sub(p, "", text)
        out[i] = (text.strip(), "marker" if text.strip() else "marker_empty", round(score, 6))
    missing = [i for i in expected if i not in out]
    for m in re.finditer(segments.BLOCK_DIV, html):
        content = m.group(3).strip()
        code, uuid, link = (re.search(p, content) for p in (segments.CODE_MARKER, segments.UUID_MARKER, segments.CROP_LINK))
        i, score = plain_match(code.group(1), missing) if code else (None, 0.0)
        if not i and uuid:
            i, score = plain_uuid(uuid.group(1), missing)
        if not i and link and link.group(1) in missing:
            i, score = link.group(1), 100.0
        if i and i not in out:
            text = re.sub(segments.UUID_MARKER, "", re.sub(segments.CODE_MARKER, "", content)).strip()
            for p in (segments.EMPTY_PARAGRAPH, *segments.HEADER_LINES):
                text = re.sub(p, "", text).strip() if p == segments.EMPTY_PARAGRAPH else re.sub(p, "", text)
            out[i] = (text.strip(), "div_structure", round(score, 6))
    return out


def test_segments_of_planted_pages_equal_a_plain_model(spark, sf_dir):
    orders = recognition.coded_orders(spark, sf_dir)
    expected, pages = {}, {r.doc_id: r.html for r in recognition.planted_pages(orders).collect()}
    for r in orders.orderBy("pos").collect():
        expected.setdefault(r.doc_id, []).append(r.id)
    want = {(d, i): v for d, html in pages.items() for i, v in plain_segments(html, expected[d]).items()}
    got = {(r.doc_id, r.id): (r.html, r.method, round(r.score, 6)) for r in recognition.document_segments(spark, sf_dir).collect()}
    assert got == want
    assert {m for _, m, _ in want.values()} == {"marker", "marker_empty", "div_structure"}


def test_segments_of_odd_pages(spark):
    code, other = (r[0] for r in spark.createDataFrame([("ab" * 16,), ("cd" * 16,)], "u string").coalesce(1).select(ids.encode(F.col("u"))).collect())
    div = f'<div class="block block-type-text x"><div class="block-header">b</div><div class="block-content"><p>BLOCK: {other}</p> <p><b>Created:</b> 1</p>in div</div></div>'
    texts = [None, "", "no marker", f"BLOCK: {code}", f"block:\n{code.lower()}]] </p> a BLOCK: 0000-0000-000 b BLOCK: {code} c", div, f"<p>BLOCK: {code}</p>x{div}"]
    pages = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, html string")
    expected = spark.createDataFrame([(str(k), i, n) for k in range(9) for n, i in enumerate((code, other))] + [("3", code, 5), ("3", None, 6)], "doc_id string, id string, pos int")
    rows = segments.segments(pages, expected).collect()
    got = {(int(r.doc_id), r.id): (r.html, r.method, round(r.score, 6)) for r in rows}
    want = {(k, i): v for k, t in enumerate(texts) if t for i, v in plain_segments(t, [code, other]).items()}
    assert got == want and len(want) == 5
    found = spark.createDataFrame(rows, "doc_id string, id string, html string, method string, score double, sample string")
    assert segments.missing_ids(expected.where("id is not null").dropDuplicates(["doc_id", "id"]), found).count() == 18 - 5
    assert segments.segments(pages.limit(0), expected).count() == 0


# -- clean html and contents -------------------------------------------------------------------------------------------


def plain_clean(html):
    text = html or ""
    for p in (r"(?is)<think>.*?</think>", r"(?is)<think>.*$", r"(?is)^.*?</think>", markup.JUNK_IMAGE, markup.BLOCK_MARKER, *markup.PAGE_TAGS):
        text = re.sub(p, "", text)
    while re.match(r"\s*</[a-zA-Z]+>\s*", text):
        text = re.sub(r"^\s*</[a-zA-Z]+>\s*", "", text)
    text = re.sub(r"\s*<div[^>]*>\s*$", "", re.sub(r"\s*<p>\s*$", "", text))
    pieces, n = [], 0
    for part in re.split("(?i)(</p>)", text):
        if part.lower() == "</p>":
            if n == 0:
                continue
            n -= 1
        else:
            n += len(re.findall(r"(?i)<p\b[^>]*>", part))
        pieces.append(part)
    text = "".join(pieces)
    while len(found := list(re.finditer(r"(?i)<p\b[^>]*>", text))) > len(re.findall("(?i)</p>", text)):
        text = text[:found[-1].start()] + text[found[-1].end():]
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?i)<p>\s*</p>", "", text))
    more = len(re.findall(r"(?i)<div\b", text)) - text.count("</div>")
    if more > 0:
        text += "</div>" * more
    for _ in range(-more):
        at = text.rindex("</div>")
        text = text[:at] + text[at + 6:]
    return text.strip()


def test_clean_html_of_planted_pages_equals_a_plain_model(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    begins, ends = {0: "</div></p>", 1: "<p>BLOCK: ABCD-EFGH-JKL</p><body class='x'>"}, {2: "</p></div></div></p>", 3: "<p>open <p>more"}
    got = {r.page_id: r.clean for r in recognition.clean_page_html(spark, sf_dir).collect()}
    assert got == {i: plain_clean(begins.get(i % 5, "<div><p>") + h + ends.get(i % 5, "<div id='x'>")) if h is not None else "" for i, h in pages.items()}


def cleaned(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, h string")
    return [r.c for r in markup.with_clean_html(df, "h", "c").orderBy("k").collect()]


def test_clean_html_of_odd_texts_equals_a_plain_model(spark):
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<P class='a'>", "</P>", "<div>", "</div>", "<DIV id=1>", "a", " ", "\n\n\n\n", "</span>", "<think>", "</think>", "<body>", "<img src='0123456789abcdef0123_img.png'>", "BLOCK: AB-CD-EF", "<pre>", "<p", ">"]
    texts = ["".join(rng.choice(parts[:-2]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert cleaned(spark, [None, "", *texts]) == [plain_clean(t) for t in [None, "", *texts]]


def test_a_million_open_tags_take_linear_time():
    for text in ("<p>" * 1_000_000, "</p>" * 1_000_000, "<p></p>" * 500_000, "<p <p" * 200_000):
        began = time.time()
        markup.balanced_paragraphs(text)
        assert time.time() - began < 20


def plain_table(html):
    return tables.markdown_of(html)


def plain_markdown(html):
    text = plain_clean(html)
    for p in markup.IN_HEADER:
        text = re.sub(p, "", text)
    text = re.sub(r"(?s)<table[^>]*>.*?</table>", lambda m: plain_table(m.group()), text)
    for p, new in markup.TO_MARKDOWN:
        text = re.sub(p, new.replace("$1", r"\g<1>").replace("$2", r"\g<2>"), text)
    for a, b in markup.ENTITIES:
        text = text.replace(a, b)
    for p, new in ((r"\[img:[a-f0-9]{20,}_img\]", ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        text = re.sub(p, new, text)
    return text.strip()


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def plain_image(data, html):
    d = data["analysis"] if isinstance(data.get("analysis"), dict) else data
    bold = (lambda t: f"<b>{t}</b>") if html else (lambda t: f"**{t}**")
    place = d.get("location") or {}
    at = {"fragment_type": d.get("fragment_type"), **(place if isinstance(place, dict) else {})}
    head = [bold("[ИЗОБРАЖЕНИЕ]"), *(f"{label}: {at[k]}" for k, label, unknown in markup.IMAGE_PLACE if at.get(k) and at[k] != unknown)]
    lines = [" | ".join(head + ([place] if isinstance(place, str) and place else []))]
    lines += [f"{bold(label + ':')} {escaped(d[k]) if html else d[k]}" for k, label in markup.IMAGE_TEXT if d.get(k)]
    entities = d.get("key_entities") if isinstance(d.get("key_entities"), list) else []
    lines += [f"{bold('Сущности:')} {', '.join(escaped(e) if html else e for e in entities[:100])}"] if entities else []
    return "\n".join(f"<p>{line}</p>" for line in lines) if html else "\n".join(lines)


def plain_inner(data):
    if isinstance(data, list):
        return "".join(map(plain_inner, data))
    if isinstance(data, dict):
        for k in ("content_html", "stamp_html", "html"):
            if isinstance(data.get(k), str):
                return data[k]
        return plain_inner(data["children"]) if isinstance(data.get("children"), list) else ""
    return ""


def plain_content(text, html):
    text = (text or "").strip()
    fence = re.match(r"(?s)^```\w*\s*\n(.*?)```\s*$", text)
    text = fence.group(1).strip() if fence else text
    clean = plain_clean if html else plain_markdown
    try:
        data = json.loads(text) if text[:1] in ("{", "[") else None
    except ValueError:
        data = None
    if isinstance(data, dict):
        if "content_html" in data or "stamp_html" in data:
            return clean(data.get("content_html") or data.get("stamp_html") or "")
        inner = data["analysis"] if isinstance(data.get("analysis"), dict) else {}
        if any(k in data or k in inner for k in ("content_summary", "detailed_description", "fragment_type")):
            return plain_image(data, html)
        if isinstance(data.get("ocr_html"), str):
            return clean(data["ocr_html"].strip())
    if isinstance(data, list):
        whole = plain_inner(data) if html else "\n".join(x["html"] for x in data if isinstance(x, dict) and isinstance(x.get("html"), str) and x["html"].strip())
        if whole:
            return clean(whole)
        if data and all(isinstance(x, dict) for x in data) and {"data-bbox", "data-label", "bbox", "label"} & {k for x in data for k in x}:
            return ""
    if data is not None and not html:
        return json.dumps(data, ensure_ascii=False, separators=(",", ":"))
    if data is not None and plain_inner(data):
        return clean(plain_inner(data))
    if re.search(r"(?i)<(?:table|thead|tbody|tr|th|td|p|div|span|h[1-6]|ul|ol|li|br|img|math|sub|sup|pre|input)\b", text):
        return clean(text)
    if not html:
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\[img:[a-f0-9]{20,}_img\]", "", text)).strip()
    lines = [t.strip() for t in text.split("\n")]
    if sum(bool(re.match(r"^\|(.+)\|$", t)) for t in lines) >= 2 and any(re.match(tables.RULE, t) for t in lines):
        return None  # tables have a test of their own
    return f"<pre>{escaped(text)}</pre>" if text else ""


def test_contents_of_every_form_equal_a_plain_model(spark, sf_dir):
    texts = {r.doc_id: r.ocr_text for r in recognition.formed_documents(spark, sf_dir).collect()}
    html = {r.doc_id: r.html for r in recognition.content_html(spark, sf_dir).collect()}
    want = {i: plain_content(t, True) for i, t in texts.items()}
    assert {i: t for i, t in html.items() if want[i] is not None} == {i: t for i, t in want.items() if t is not None}
    assert all("<table><thead>" in html[i] for i, t in want.items() if t is None)
    markdown = {r.doc_id: r.markdown for r in recognition.content_markdown(spark, sf_dir).collect()}
    assert markdown == {i: plain_content(t, False) for i, t in texts.items()}


ODD = [None, "", "  ", "```\n```", '{"content_html": null, "stamp_html": "<b>s</b></p>"}', '{"content_html": ""}', '{"analysis": {"fragment_type": "Не определено", "location": {}}}', "[]", "{}", "[1]", '[{"html": 5}]',
       '{"fragment_type": "a<b", "location": {"zone_name": "Не определено", "grid_lines": "А-1", "level_or_elevation": "+3"}, "key_entities": ["x<", "y"], "verification_recommendations": "look"}', '{"ocr_html": 5, "html": "<p>h"}',
       '{"children": [{"children": []}, "x", {"html": "a"}, [{"html": "b"}]]}', '[{"label": "x"}, 1]', '[{"label": "x", "children": [{"html": "<p>in</p>"}]}]', '{"a": "<p>raw</p>"}', "{not json <p>x", "a & b < c", "<table><tr><td>1</td></tr></table>",
       '```json\n{"ocr_html": " <h1> T </h1> "}\n```', "x [img:0123456789abcdef01234_img]\n\n\n\ny", "<h4>a</h4><ul><li> b </li></ul><a href=\"u\">l</a><i>c</i>&amp;lt;<img src=x>"]


def test_odd_contents_equal_a_plain_model(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string")
    html = markup.with_content_html(df, "t", "t").orderBy("k").collect()
    assert [r.t for r in html] == [plain_content(t, True) for t in ODD]
    markdown = markup.with_content_markdown(df, "t", "m").orderBy("k").collect()
    assert [r.m for r in markdown] == [plain_content(t, False) for t in ODD] and markdown[0].asDict().keys() == {"k", "t", "m"}


# -- stamps and exports ------------------------------------------------------------------------------------------------


def test_stamp_fields_by_themselves_with_ties_by_page(spark):
    said = [(0, {"document_code": "A", "stage": "", "x": "1"}), (1, {"document_code": "B", "stage": "P"}), (2, {"document_code": "B", "x": "2", "stage": "R"}), (3, {"document_code": "A", "revisions": [1]}), (4, {})]
    rows = [("d", p, 0, f"s{p}", "stamp", json.dumps(s)) for p, s in said] + [("d", p, 1, f"t{p}", "text", "x") for p in range(6)] + [("d", 5, 0, "bad", "stamp", "{"), ("e", 0, 0, "t", "text", None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, pos int, id string, block_type string, ocr_text string")
    pages = stamps.page_stamps(df)
    assert {r.page: r.stamp for r in pages.collect()}[3] == {"document_code": "A", "revisions": "[1]"} and pages.count() == 4
    assert [r.inherited for r in stamps.inherited(pages).collect()] == [{"document_code": "A", "stage": "P"}]
    assert [r.inherited["x"] for r in stamps.inherited(pages, None).collect()] == ["1"]
    held = {r.page: r.stamp for r in stamps.of_pages(df).where("doc_id = 'd'").collect()}
    assert held[0] == {"document_code": "A", "stage": "P", "x": "1"} and held[5] == {"document_code": "A", "stage": "P"} and held[2]["stage"] == "R"
    named = spark.createDataFrame([("d", "n.pdf"), ("e", " E-1.PDF"), ("f", None)], "doc_id string, name string")
    assert {r.doc_id: r.stamp for r in stamps.propagated(df, documents=named).where("id in ('t0', 't')").collect()} == {"d": held[0], "e": {"document_code": "E-1"}}
    assert stamps.inherited(pages.limit(0)).count() == 0


def test_exports_of_a_document_without_blocks(spark):
    schema = "doc_id string, page int, pos int, id string, block_type string, ocr_text string, linked_block_id string, created_at string, image_file string"
    none, docs = spark.createDataFrame([], schema), spark.createDataFrame([("d", None, None)], "doc_id string, name string, project string")
    html = exports.html(none, docs, "now").first().content
    assert html.startswith("<!DOCTYPE html>") and "<h1>OCR Result</h1>" in html and html.endswith("\n</body></html>")
    assert exports.markdown(none, docs, "now").first().content == "# OCR Result\n\nСгенерировано: now UTC\n\n---\n"


# -- responses, trees, repeated ids ------------------------------------------------------------------------------------


def test_the_first_title_counts_whatever_its_kind(spark):
    cases = {'Title: Foo bar.\nThe title is "Baz qux"': "Foo bar", 'The title is "abc"\nTitle: Long enough.': None, "Заголовок: «План этажа».": "План этажа", "header: One two\n": "One two", "none": None, None: None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").coalesce(1).select(responses.title_of(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_objects_in_texts():
    cases = {"": None, "a": None, "{": None, "x{}y": "{}", 'a {"b": "}"} c': '{"b": "}"}', r'{"a": "\"}"}': r'{"a": "\"}"}', '{"a": {"b": 1}} {"c"': '{"a": {"b": 1}}', 'say "{" {"a": 1}': None, '{"open': None, '{"a\\': None, "}{}": "{}"}
    cases['say "{" {"a": 1}'] = None  # the first brace is the one in quotes: what follows never closes it
    assert {t: responses.balanced(t) for t in cases} == cases
    began = time.time()
    responses.balanced("{" * 500_000 + '"' * 500_001)
    assert time.time() - began < 5


def test_small_response_rules(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{k} {'int' if isinstance(x, int) else 'string'}" for k, x in enumerate(v))).select(f(*(F.col(f"c{k}") for k in range(len(v))))).first()[0]
    assert one(responses.final_result, 400, "the Context Size is") == "[НеПовторяемая ошибка: контекст превышен — блок слишком большой для модели]" and one(responses.final_result, 500, "context size") is None
    assert one(responses.unfenced_json, "```json\n[1]\n```") == "[1]" and one(responses.unfenced_json, "```\nx") is None and one(responses.unfenced_json, " 5 ") == "5"
    assert one(responses.storage_error, "RequestTimeout").retryable and not one(responses.storage_error, "404").queued
    assert one(responses.stamp_json, '```json\n{bad}\n``` {"x": {"sheet_name": 1}}') is None
    assert one(responses.stamp_json, '[1] so {"sheet_name": "}{"} {') == '{"sheet_name": "}{"}'
    assert one(responses.is_structured_html, '{"content_html": null}') and not one(responses.is_structured_html, "[]")


def test_ids_may_hold_dots(spark):
    nodes = spark.createDataFrame([("1.2", None), ("1", "1.2"), ("2", "1.2"), ("2.1", "2")], "id string, parent_id string")
    found = tree.with_paths(nodes)
    assert {r.id: (r.path, r.depth) for r in found.collect()} == {"1.2": ("1.2", 0), "1": ("1.2.1", 1), "2": ("1.2.2", 1), "2.1": ("1.2.2.2.1", 2)}
    assert sorted((r.ancestor, r.id) for r in tree.pairs(found).collect()) == [("1.2", "1"), ("1.2", "2"), ("1.2", "2.1"), ("2", "2.1")]
    assert {r.id for r in tree.deleted(found, "1").collect()} == {"1.2", "2", "2.1"}
    assert {r.id: r.way for r in tree.moved(found, "2", "1").collect()}["2.1"] == ["1.2", "1", "2", "2.1"]
    assert tree.moved(found, "1.2", "2.1").where("id = '1.2'").first().parent_id is None


def test_repeated_ids_on_the_right_side_repeat_no_rows(spark):
    twice = spark.createDataFrame([("a",), ("a",)], "id string")
    nodes = spark.createDataFrame([("a", "document", None)], "id string, node_type string, is_locked boolean")
    assert tree.locked(nodes, twice).count() == 1
    assert [r.retry_count for r in jobs.retried(spark.createDataFrame([("a", 1)], "id string, retry_count int"), twice).collect()] == [2]
    found = blocks.enriched(twice.distinct(), spark.createDataFrame([("a", "x", "marker", 90.0), ("a", "y", "marker", 95.0)], "id string, html string, method string, score double")).collect()
    assert [(r.ocr_html, r.score) for r in found] == [("y", 95.0)]
    empty = spark.createDataFrame([("a", None)], "id string, ocr_text string")
    assert [r.ocr_text for r in blocks.filled(empty, spark.createDataFrame([("a", "z"), ("a", ""), ("a", "b")], "id string, ocr_text string")).collect()] == ["b"]
