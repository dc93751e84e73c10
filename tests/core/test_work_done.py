"""How often texts are made, parsed and shuffled on the way to a result."""

import json

from pyspark.sql import functions as F

from quillstack.functions import ids, responses
from quillstack.operators import blocks as bl
from quillstack.operators import exports, segments, stamps


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_page_is_made_once_for_its_segments(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def page(doc):
        made.add(1)
        return f"<p>BLOCK: 3333-3333-{doc}</p>\n<p>x</p>"

    docs = spark.createDataFrame([(f"33{c}",) for c in "3467"], "doc_id string").coalesce(1)
    expected = docs.select("doc_id", F.concat(F.lit("3333-3333-"), "doc_id").alias("id"), F.lit(1).alias("pos"))
    found = segments.segments(docs.select("doc_id", page("doc_id").alias("html")), expected).collect()
    assert sorted(r.id for r in found) == [f"3333-3333-33{c}" for c in "3467"] and {r.html for r in found} == {"<p>x</p>"}
    assert made.value == 4


def test_stamps_of_objects_are_parsed_once(spark):
    rows = [{"revisions": [{"change_num": "1"}, {"change_num": 2, "doc_num": "d"}], "signatures": [{"role": "R", "name": "N"}, {"role": "", "name": "M"}]},
            {"revisions": [None], "signatures": {"role": "R", "name": "N"}}, {"revisions": ["a", '{"change_num": "3"}'], "signatures": ["x", {"role": "Q", "surname": "S"}, None]}, {"document_code": "C"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "d string").coalesce(1)
    lines = responses.with_stamp_parts(df, "d", "p").select(responses.stamp_line(F.col("p")).alias("line"))
    assert [r.line for r in lines.collect()] == ["Статус: Изм. 2 (Док. № d) | Ответственные: R: N", 'Ответственные: {"role":"R","name":"N"}', "Статус: Изм. 3 | Ответственные: x; Q: S", "Шифр: C"]
    assert plan(lines).count("from_json(") <= 7  # one for all, the others only for lists of other kinds


def test_stamps_are_shuffled_once(spark):
    blocks = spark.createDataFrame([("a", p, p, "stamp", json.dumps({"stage": "PPQ"[p]})) for p in range(3)], "doc_id string, page int, pos int, block_type string, ocr_text string")
    found = stamps.inherited(stamps.page_stamps(blocks))
    assert [(r.doc_id, r.inherited) for r in found.collect()] == [("a", {"stage": "P"})]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def exported(spark):
    """Blocks of a document with stamps, an image with two linked texts and a page of stamps alone, and its name."""
    said = [(0, "stamp", {"document_code": "A", "sheet_number": "1"}, None), (0, "image", {"content_summary": "s"}, None), (0, "text", "<p>one</p></p>", "b1"), (1, "text", "two", "b1"), (1, "stamp", {"stage": "P", "document_code": ""}, None),
            (2, "stamp", {"document_code": "B"}, None), (3, "text", {"ocr_html": "<h2>x</h2>"}, "b0")]
    rows = [("d", p, k, f"b{k}", kind, t if isinstance(t, str) else json.dumps(t), link, None, None) for k, (p, kind, t, link) in enumerate(said)]
    schema = "doc_id string, page int, pos int, id string, block_type string, ocr_text string, linked_block_id string, created_at string, image_file string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([("d", "n.pdf", None)], "doc_id string, name string, project string")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_html_is_made_where_a_documents_blocks_are(spark):
    blocks, documents = exported(spark)
    found = exports.html(blocks, documents, "now", style="")
    content = found.collect()[0].content.split("<div class=\"block block-type-")
    assert [c.count("stamp-info") for c in content] == [1, 1, 1, 1, 1] and [c.count("stamp-inherited") for c in content] == [0, 0, 0, 0, 1]
    assert "Блок #2 (стр. 1)" in content[1] and "<b>Шифр:</b> A | <b>Стадия:</b> P | <b>Лист:</b> 1</div>" in content[1] and "<b>Шифр:</b> A | <b>Стадия:</b> P</div>\n<pre>two</pre>" in content[3]
    assert shuffles(found) == 2  # blocks once, documents once


def test_markdown_is_made_where_a_documents_blocks_are(spark):
    blocks, documents = exported(spark)
    found = exports.markdown(blocks, documents, "now")
    code = {b: ids.encode(F.lit(b)) for b in ("b0", "b1", "b2", "b6")}
    code = blocks.limit(1).select(*(c.alias(b) for b, c in code.items())).first().asDict()
    body = found.collect()[0].content.split("---\n\n")[1]
    a = "Шифр: A | Стадия: P"
    assert body == (f"## СТРАНИЦА 1\n**Лист:** 1\n\n### BLOCK [IMAGE]: {code['b1']}\n{a} | Лист: 1\n**[ИЗОБРАЖЕНИЕ]**\n**Краткое описание:** s\n\n**Распознанный OCR текст на чертеже:**\ntwo\n\n"
                    f"### BLOCK [TEXT]: {code['b2']}\n→{code['b1']}\n{a} | Лист: 1\none\n\n## СТРАНИЦА 2\n\n## СТРАНИЦА 4\n\n### BLOCK [TEXT]: {code['b6']}\n→{code['b0']}\n{a}\n##### x\n")
    assert shuffles(found) == 2


def test_linked_texts_are_those_of_the_join(spark):
    blocks, _ = exported(spark)
    found = bl.with_image_texts(blocks, "ocr_text", "below", "moved")
    assert [(r.image_id, r.text_id) for r in bl.image_texts(blocks).collect()] == [("b1", "b3")]
    assert {r.id: (r.below, r.moved) for r in found.collect() if r.below or r.moved} == {"b1": ("two", False), "b3": (None, True)}


def test_codes_of_columns_are_those_of_values(spark):
    uuids = spark.createDataFrame([(u,) for u in ("ffffffff-ff", "00000000-00", "30abCDef-019", "3", "", "xyz", None)], "u string")
    rows = ids.with_codes(uuids.withColumn("one", ids.encode(F.col("u"))), {"c": F.col("u")}).collect()
    assert all(r.c == r.one for r in rows) and {r.u: r.c for r in rows}["00000000-00"] == "3333-3333-333"
    assert all(r.valid for r in uuids.select(ids.encode(F.col("u")).alias("c")).where("c is not null").select(ids.is_valid(F.col("c")).alias("valid")).collect())
