"""Responses, tables and mixed texts against cases and plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from quillstack.functions import responses, tables
from quillstack.plans import catalogue


def one(spark, function, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(function(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


def message(**fields):
    return json.dumps(fields, ensure_ascii=False)


@pytest.mark.parametrize(("content", "want"), [
    (" a ", "a"), (["a", {"text": " b "}, {"text": "", "content": "c"}, {"text": 5}, 7, "  "], "a\nb\nc"), (None, ""), ([], ""), (12, "12"), ("", "")])
def test_message_text(spark, content, want):
    assert one(spark, responses.message_text, message(content=content)) == want


@pytest.mark.parametrize(("fields", "want"), [
    ({"content": "plain"}, "plain"), ({"content": '{"ocr_html": " <p>x</p> "}'}, "<p>x</p>"), ({"content": '{"other": 1}'}, '{"other": 1}'),
    ({"content": '[{"html": "<p>a</p>", "data-bbox": "1 2", "data-label": "T"}, {"html": " b "}]'}, '<div data-bbox="1 2" data-label="T"><p>a</p></div>\nb'),
    ({"content": '[{"html": "a"}, {"html": " "}]'}, '[{"html": "a"}, {"html": " "}]'), ({"content": "Let me look. <p>x</p>"}, "<p>x</p>"),
    ({"content": "Давай посмотрим", "reasoning_content": "<think>a</think>The <p>x</p>"}, "<p>x</p>"), ({"content": "", "reasoning_content": "no tags"}, ""),
    ({"content": None, "reasoning_content": 'The title is "Spec list". <table><tr></tr></table>'}, '<div data-label="Section-Header"><h1>Spec list</h1></div>\n<table><tr></tr></table>'),
    ({"content": None, "reasoning_content": "Title: Spec list. <table><tr><td><h2>a</h2></td></tr></table>"}, "<table><tr><td><h2>a</h2></td></tr></table>"),
    ({"content": None, "reasoning_content": "Заголовок: «Этаж один».\n<div><table></table></div>"}, '<div data-label="Section-Header"><h1>Этаж один</h1></div>\n<div><table></table></div>')])
def test_response_text(spark, fields, want):
    assert one(spark, responses.response_text, message(**fields)) == want


def test_parse_response(spark):
    parse = lambda **r: responses.read(spark.createDataFrame([(json.dumps(r, ensure_ascii=False),)], "r string"), "r", "t").first().t
    assert parse(choices=[{"message": {"content": "x"}, "finish_reason": "length"}]) == "[LENGTH_TRUNCATED]x"
    assert parse(choices=[{"message": {"content": " "}}]) == "[Ошибка: Chandra: пустой ответ модели]"
    assert parse(choices=[], error="e") == parse(error="e") == "[Ошибка: Chandra: некорректный ответ (e)]"
    assert one(spark, responses.parsed_json, "{broken ```json\n{\"a\": 1}\n```") == '{"a": 1}' and one(spark, responses.parsed_json, "[1]") is None


def test_spans_and_pipes(spark):
    html = '<table><tr><th colspan="2">a|b</th><th>c</th></tr><tr><td rowspan=2>x<br>y</td><td>1\n 2</td></tr><tr></tr><tr><td>3</td><td>4</td><td>5</td></tr></table>'
    assert tables.markdown_of(html) == "| a\\|b |  | c |  |\n|---|---|---|---|\n| x y | 1 2 |  |  |\n|  | 3 | 4 | 5 |"
    assert tables.markdown_of("<table></table>") == "" and tables.tables_in("a<table><tr><td>b</td></tr></table>c<table>") == "a| b |\n|---|c<table>"


def test_markdown_tables_as_html(spark):
    cases = {
        "| a |\n| b |": "<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>b</td></tr></tbody></table>",
        " x\n\n|--|\n| a | <b> |": "<p>x</p>\n<table><thead><tr><td>a</td><td>&lt;b&gt;</td></tr></thead></table>",
        "|--|\n|--|": "", "|--|\ny": "\n<p>y</p>", "||\n|": "<p>||</p>\n<p>|</p>", "|a|b|\n|--|:--:|\n||c||\nz\n|d|": (
            "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>c</td></tr></tbody></table>\n<p>z</p>\n<table><thead><tr><th>d</th></tr></thead></table>"),
        "": "", "<hr><tr>": "<p>&lt;hr&gt;&lt;tr&gt;</p>"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").coalesce(1).select(tables.to_html(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())
    assert spark.range(1).select(tables.to_html(F.lit(None).cast("string"))).first()[0] is None


def test_mixed_texts_against_plain_python(spark, sf_dir):
    import re

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in catalogue.filter_mixed_text(spark, sf_dir).collect():
        k, text = r.doc_id % 3, texts[r.doc_id]
        text = ('<div class="a" data-label="Image">x</div><img src="y">' if k == 0 else "A photograph showing the residential building from the street ЖК " if k == 1 else "") + text
        if r.doc_id % 7 == 0 or not text:
            assert (r.text, r.removed_chars, r.removed_image_segments) == (text, 0, 0)
            continue
        left, n = re.subn(r'(?is)<div\b[^>]*\bdata-label\s*=\s*"Image"[^>]*>.*?</div>', "", text)
        left, m = re.subn(r"(?i)<img\b[^>]*/?\s*>", "", left)
        runs = [m.group(1) for m in re.finditer(tables.LATIN, left) if re.search(tables.NARRATIVE, m.group(1))]
        g, left = len(runs), re.sub(tables.LATIN, lambda m: "" if re.search(tables.NARRATIVE, m.group(1)) else m.group(1), left)
        left = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", left)).strip()
        assert (r.text, r.removed_chars, r.removed_image_segments) == (left, len(text) - len(left), n + m + g)


def test_stamp_parts(spark):
    data = {"document_code": "X-1", "stage": None, "sheet_number": 3, "total_sheets": "9", "organization": "", "revisions": [{"revision_number": "2", "document_number": "77", "date": "1.1.20"}],
            "signatures": ["one", {"role": "R", "name": "N"}, {"role": "", "name": "M"}]}
    rows = [(json.dumps(data),), ('{"revisions": "as text", "signatures": "them", "total_sheets": "4"}',), ("{}",), (None,), ('{"revisions": []}',)]
    got = responses.with_stamp_parts(spark.createDataFrame(rows, "d string").coalesce(1), "d", "p").select(responses.stamp_line(F.col("p"))).collect()
    assert [r[0] for r in got][:3] == ["Шифр: X-1 | Лист: 3 (из 9) | Статус: Изм. 2 (Док. № 77 от 1.1.20) | Ответственные: one; R: N", "Лист:  (из 4) | Статус: as text | Ответственные: them", ""]
    assert [r[0] or "" for r in got][3:] == ["", ""]
