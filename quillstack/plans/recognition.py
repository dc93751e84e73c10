"""Queries over recognised pages: segments of html, matched ids, clean html and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import ids
from quillstack.functions import markup as mk
from quillstack.functions import responses as rs
from quillstack.operators import exports as ex
from quillstack.operators import matching as ma
from quillstack.operators import segments as sg
from quillstack.operators import stamps as sp
from quillstack.plans.catalogue import CODES
from quillstack.plans.registry import query
from quillstack.scratch import materialise
from quillstack.sources import binding as b
from quillstack.sources.binding import BLOCKS


def coded_orders(spark, sf_dir):
    """(doc_id, pos, id, code, k): a customer's orders as the blocks of a document, most with a code, a tenth with a uuid as their id."""
    uuid = F.md5(F.col("o_orderkey").cast("string"))
    dashed = F.concat_ws("-", *(F.substring(uuid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    orders = b.spread(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("doc_id"), F.col("o_orderkey").alias("pos"), "o_custkey",
                                                     F.col("o_orderkey").alias("k"), ids.encode(uuid).alias("code"), dashed.alias("uuid"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return orders.withColumn("id", F.when((F.col("k") % 10 == 2) | (F.col("o_custkey") % 7 == 3), F.col("uuid")).otherwise(F.col("code")))


def planted_pages(orders):
    """(doc_id, html) with markers as they come from a recogniser: whole, damaged, repeated, unknown, empty, in divs, and none at all."""
    kind, code, uuid = F.col("k") % 10, F.col("code"), F.col("uuid")
    text = F.concat(F.lit("<p>order "), F.col("k").cast("string"), F.lit(" of "), "day", F.lit("</p>"))
    marker = lambda c: F.concat(F.lit("<p>BLOCK: "), c, F.lit("</p>\n"))
    div = F.concat(F.lit('<div class="block block-type-image"><div class="block-header">Block</div><div class="block-content">'), F.lit("<p><b>Created:</b> now</p>"), text)
    legacy = F.concat(F.lit("<p>[[BLOCK ID: "), F.when(kind == 0, F.translate(uuid, "015", "OlS")).when(kind == 1, F.concat(F.substring(uuid, 1, 12), F.lit("ff"), F.substring(uuid, 15, 22))).otherwise(uuid), F.lit("]]</p>\n"), text, F.lit("\n"))
    part = F.when(F.col("o_custkey") % 7 == 3, F.when(kind == 3, F.lit("")).otherwise(legacy))
    part = part.when(kind == 0, F.concat(marker(F.regexp_replace(code, "^(.{6}).", "$1")), text)).when(kind == 1, F.concat(marker(F.overlay(code, F.lit("YY"), 2)), text))
    part = part.when(kind == 2, F.concat(div, F.lit('<a href="https://files/crops/'), uuid, F.lit('.pdf">crop</a></div></div>'))).when(kind == 3, text)
    part = part.when(kind == 4, F.concat(marker(code), text, marker(code), F.lit("<p>again</p>"))).when(kind == 5, F.concat(marker(code), text, marker(F.lit("0000-0000-000")), F.lit("<p>more</p>")))
    part = part.when(kind == 6, marker(code)).when(kind == 7, F.concat(F.lit("<div>BLOCK: "), code, F.lit('</div><p><b>Linked block:</b> X</p><div class="stamp-info">Code</div>'), text)).otherwise(F.concat(marker(code), text, F.lit("\n")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda s: s["part"])
    return orders.groupBy("doc_id").agg(F.array_join(parts, "").alias("html"))


@query()
def document_segments(spark, sf_dir):
    """Segments of pages with markers in every state; a plain model is what tests hold them against."""
    orders = materialise(coded_orders(spark, sf_dir), "orders")
    return sg.segments(planted_pages(orders), orders.select("doc_id", "id", "pos"))


@query(f"""WITH {CODES}, c AS (SELECT o.o_custkey, o.o_orderkey, left(c, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 3) AS code FROM codes JOIN orders o USING (o_orderkey))
SELECT 'C' || o_custkey AS doc_id, code AS id, '<p>order ' || o_orderkey || '</p>' AS html, 'marker' AS method, 100.0::double AS score, 'BLOCK: ' || code AS sample FROM c""")
def document_segments_whole(spark, sf_dir):
    """Segments of pages with one whole marker for each block."""
    orders = materialise(coded_orders(spark, sf_dir), "orders")
    part = F.concat(F.lit("<p>BLOCK: "), "code", F.lit("</p>\n<p>order "), F.col("k").cast("string"), F.lit("</p>\n"))
    pages = orders.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda s: s["part"]), "").alias("html"))
    return sg.segments(pages, orders.select("doc_id", F.col("code").alias("id"), "pos"))


@query(f"""WITH {CODES}, c AS (SELECT o_orderkey, left(c, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 3) AS code FROM codes)
SELECT 'C' || o.o_custkey AS doc_id, count(*) AS expected, count(*) FILTER (o_orderkey % 10 <> 3) AS found, count(*) FILTER (o_orderkey % 10 = 3) AS missing FROM orders o JOIN c USING (o_orderkey)
WHERE o.o_custkey % 7 <> 3 GROUP BY ALL""")
def segment_coverage(spark, sf_dir):
    """How many expected ids of each document have a segment; orders without a marker are what is missing."""
    orders = materialise(coded_orders(spark, sf_dir).where("o_custkey % 7 <> 3"), "orders")
    found = sg.segments(planted_pages(orders), orders.select("doc_id", "id", "pos"))
    marked = orders.join(found.select("doc_id", "id", F.lit(True).alias("_there")), ["doc_id", "id"], "left")
    return marked.groupBy("doc_id").agg(F.count("*").alias("expected"), F.count("_there").alias("found"), F.count_if(F.col("_there").isNull()).alias("missing"))


@query(f"""WITH {CODES}, c AS (SELECT 'C' || o_custkey AS doc_id, o_orderkey, c FROM codes JOIN orders USING (o_orderkey)),
seen AS (SELECT doc_id, o_orderkey, left(c, 2) || substr(c, 5) AS seen FROM c),
s AS (SELECT a.doc_id, a.seen, b.c AS id, b.o_orderkey AS pos, (greatest(length(seen), length(b.c)) - levenshtein(seen, b.c)) / greatest(length(seen), length(b.c)) * 100 AS score FROM seen a JOIN c b ON a.doc_id = b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seen ORDER BY score DESC, pos) AS k FROM s WHERE score >= 70)
SELECT doc_id, seen, id, score FROM r WHERE k = 1""")
def similar_codes(spark, sf_dir):
    """Codes that have lost two letters, and the most similar code of their document."""
    orders = materialise(coded_orders(spark, sf_dir).withColumn("text", F.replace("code", F.lit("-"), F.lit(""))), "orders")
    seen = orders.select("doc_id", F.concat(F.substring("text", 1, 2), F.substring("text", 5, 7)).alias("seen"))
    return ma.nearest(seen, orders.select("doc_id", F.col("text").alias("id"), "text", "pos"), ma.CODE_CUTOFF)


def stamped_blocks(spark, sf_dir, *columns):
    """unread_blocks as a scratch table, for queries that read them more than once; all columns, or those named."""
    out = unread_blocks(spark, sf_dir)
    return materialise(out.select(*columns) if columns else out, "blocks")


def unread_blocks(spark, sf_dir):
    """Blocks with codes as ids: stamps and images as JSON, texts plain, as html with a tag too many, and as JSON with html that isn't closed."""
    blocks = b.blocks(spark, sf_dir)
    part = F.regexp_extract("id", r"\d+-\d+", 0)
    stamp = F.to_json(F.struct(F.col("code").alias("document_code"), F.when(F.col("pos") % 2 == 0, "P").otherwise("").alias("stage"), F.col("pos").alias("sheet_number")))
    image = F.concat(F.lit('{"fragment_type": "plan", "location": {"zone_name": "'), part, F.lit('", "grid_lines": "Не определены"}, "content_summary": "a & b", "key_entities": ["K1", "K2"]}'))
    text = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("part "), part)).when(F.col("pos") % 3 == 1, F.concat(F.lit("<p>part "), part, F.lit("</p></p>"))).otherwise(
        F.concat(F.lit('{"ocr_html": "<div><h2>part</h2><p>'), part, F.lit('</p>"}')))
    said = F.when(F.col("block_type") == "stamp", stamp).when(F.col("block_type") == "image", image).otherwise(text)
    told = blocks.select("doc_id", "page", "pos", "id", "block_type", said.alias("ocr_text"), "linked_block_id", part.alias("part"))
    coded = ids.with_codes(told, {"id": F.md5("id"), "linked_block_id": F.md5("linked_block_id")})
    return coded.select("doc_id", "page", "pos", "id", "block_type", "ocr_text", "linked_block_id", F.lit(None).cast("string").alias("created_at"), F.concat(F.lit("/tmp/"), "part", F.lit(".pdf")).alias("image_file"))


def named_documents(blocks):
    """(doc_id, name, project): names only of documents with an even number."""
    even = F.substring("doc_id", 2, 20).cast("long") % 2 == 0
    return blocks.select("doc_id").distinct().select("doc_id", F.when(even, F.concat("doc_id", F.lit(".PDF"))).alias("name"), F.when(~even, F.lit("proj")).alias("project"))


STAMPED = BLOCKS + ", " + CODES.replace("o_orderkey, md5(o_orderkey::varchar) AS uuid FROM orders", "id, md5(id) AS uuid FROM blocks").replace("o_orderkey", "id") + """,
ids AS (SELECT id, left(c, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 3) AS code_id FROM codes),
bs AS (SELECT b.doc_id, b.page, b.pos, i.code_id AS id, b.block_type, b.code, CASE WHEN b.pos % 2 = 0 THEN 'P' ELSE '' END AS stage, l.code_id AS linked, regexp_extract(b.id, '\\d+-\\d+') AS part
  FROM blocks b JOIN ids i ON b.id = i.id LEFT JOIN ids l ON b.linked_block_id = l.id),
own AS (SELECT doc_id, page, min_by(code, pos) AS code, min_by(stage, pos) AS stage, min(pos) AS sheet FROM bs WHERE block_type = 'stamp' GROUP BY ALL),
says AS (SELECT doc_id, page, 'code' AS f, code AS v FROM own UNION ALL SELECT doc_id, page, 'stage', stage FROM own WHERE stage <> ''),
tally AS (SELECT doc_id, f, v, count(*) AS n, min(page) AS seen FROM says GROUP BY ALL),
modes AS (SELECT doc_id, f, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY n DESC, seen) AS k FROM tally) WHERE k = 1),
docs AS (SELECT DISTINCT doc_id, CASE WHEN substr(doc_id, 2)::bigint % 2 = 0 THEN doc_id || '.PDF' END AS name, CASE WHEN substr(doc_id, 2)::bigint % 2 = 1 THEN 'proj' END AS project FROM bs),
held AS (SELECT p.doc_id, p.page, o.page IS NOT NULL AS own, o.sheet, coalesce(o.code, c.v, CASE WHEN s.v IS NULL THEN replace(d.name, '.PDF', '') END) AS code, coalesce(nullif(o.stage, ''), s.v) AS stage
  FROM (SELECT DISTINCT doc_id, page FROM bs) p LEFT JOIN own o USING (doc_id, page) LEFT JOIN modes c ON c.doc_id = p.doc_id AND c.f = 'code' LEFT JOIN modes s ON s.doc_id = p.doc_id AND s.f = 'stage' JOIN docs d ON d.doc_id = p.doc_id)"""


@query(f"WITH {STAMPED} SELECT doc_id, id, h.code AS document_code, h.stage, h.own AS on_page FROM bs JOIN held h USING (doc_id, page)")
def stamp_maps(spark, sf_dir):
    """The stamp's fields that hold for each block, field by field: its page's, else what most pages of the document say."""
    blocks = stamped_blocks(spark, sf_dir, "doc_id", "page", "pos", "id", "block_type", "ocr_text")
    pages = sp.of_pages(blocks, documents=named_documents(blocks)).select("doc_id", "page", F.col("stamp")["document_code"].alias("document_code"), F.nullif(F.col("stamp")["stage"], F.lit("")).alias("stage"), F.col("own").isNotNull().alias("on_page"))
    return blocks.select("doc_id", "page", "id").join(pages, ["doc_id", "page"]).drop("page")


@query(f"""WITH {STAMPED} SELECT doc_id, max(v) FILTER (f = 'code') AS document_code, max(v) FILTER (f = 'stage') AS stage FROM modes GROUP BY 1""")
def stamp_fields_inherited(spark, sf_dir):
    """Of any set of fields the value most pages have; the sheet's number is left out."""
    found = sp.inherited(sp.page_stamps(unread_blocks(spark, sf_dir)), ("document_code", "stage"))
    return found.select("doc_id", F.col("inherited")["document_code"].alias("document_code"), F.col("inherited")["stage"].alias("stage"))


@query(f"WITH {STAMPED} SELECT doc_id, min_by(code, page) AS document_code, min_by(stage, page) AS stage, min_by(sheet, page)::varchar AS sheet_number FROM own GROUP BY 1")
def stamp_first_full(spark, sf_dir):
    found = sp.first_full(sp.page_stamps(unread_blocks(spark, sf_dir)))
    return found.select("doc_id", *(F.col("stamp")[c].alias(c) for c in ("document_code", "stage", "sheet_number")))


MADE = "2024-01-02 03:04:05"
_STAMP_SQL = """CASE WHEN h.code IS NULL AND h.stage IS NULL THEN '' ELSE '<div class="stamp-info' || CASE WHEN h.own THEN '' ELSE ' stamp-inherited' END || '">' ||
  array_to_string(list_filter(['<b>Шифр:</b> ' || h.code, '<b>Стадия:</b> ' || h.stage, CASE WHEN h.own THEN '<b>Лист:</b> ' || h.sheet END], lambda x: x IS NOT NULL), ' | ') || '</div>' || chr(10) END"""
_HEAD_SQL = """'<!DOCTYPE html>' || chr(10) || '<html lang="ru">' || chr(10) || '<head>' || chr(10) || '    <meta charset="UTF-8">' || chr(10) || '    <title>' || coalesce(name, 'OCR Result') || ' - OCR</title>' || chr(10) || '    <style></style>' || chr(10) || '</head>' || chr(10)
  || '<body>' || chr(10) || '<h1>' || coalesce(name, 'OCR Result') || '</h1>' || chr(10) || '<p>Сгенерировано: 2024-01-02 03:04:05 UTC</p>' || chr(10)"""


@query(f"""WITH {STAMPED}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS k FROM bs),
parts AS (SELECT n.doc_id, n.page, n.pos, '<div class="block block-type-' || block_type || '">' || chr(10) || '<div class="block-header">Блок #' || k || ' (стр. ' || (n.page + 1) || ') | Тип: ' || block_type || '</div>' || chr(10) || '<div class="block-content">' || chr(10)
  || '<p>BLOCK: ' || id || '</p>' || chr(10) || CASE WHEN linked IS NULL THEN '' ELSE '<p><b>Linked block:</b> ' || linked || '</p>' || chr(10) END || {_STAMP_SQL}
  || CASE WHEN block_type = 'image' AND d.project IS NOT NULL THEN '<p><a href="https://files/tree_docs/proj/crops/' || part || '.pdf" target="_blank"><b>🖼️ Открыть кроп изображения</b></a></p>' || chr(10) ELSE '' END
  || CASE WHEN block_type = 'image' THEN '<p><b>[ИЗОБРАЖЕНИЕ]</b> | Фрагмент: plan | Зона: ' || part || '</p>' || chr(10) || '<p><b>Краткое описание:</b> a &amp; b</p>' || chr(10) || '<p><b>Сущности:</b> K1, K2</p>'
     WHEN pos % 3 = 0 THEN '<pre>part ' || part || '</pre>' WHEN pos % 3 = 1 THEN '<p>part ' || part || '</p>' ELSE '<div><h2>part</h2><p>' || part || '</p></div>' END || chr(10) || '</div></div>' AS part
  FROM placed n JOIN held h ON n.doc_id = h.doc_id AND n.page = h.page JOIN docs d ON d.doc_id = n.doc_id WHERE block_type <> 'stamp'),
body AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY page, pos) AS body FROM parts GROUP BY 1), firsts AS (SELECT doc_id, min_by(code, page) AS code, min_by(stage, page) AS stage, min_by(sheet, page) AS sheet FROM own GROUP BY 1)
SELECT d.doc_id, {_HEAD_SQL} || CASE WHEN f.doc_id IS NULL THEN '' ELSE chr(10) || '<div class="stamp-info"><b>Шифр:</b> ' || f.code || CASE WHEN f.stage = '' THEN '' ELSE ' | <b>Стадия:</b> ' || f.stage END || ' | <b>Лист:</b> ' || f.sheet || '</div>' END
  || coalesce(chr(10) || body, '') || chr(10) || '</body></html>' AS content FROM docs d LEFT JOIN body USING (doc_id) LEFT JOIN firsts f USING (doc_id)""")
def export_html(spark, sf_dir):
    """Whole documents as html: blocks of every kind, the stamp that holds on their page, links and crops."""
    blocks = unread_blocks(spark, sf_dir)
    return ex.html(blocks, named_documents(blocks), MADE, "https://files", style="")


_SHORT_SQL = "array_to_string(list_filter(['Шифр: ' || h.code, 'Стадия: ' || h.stage, CASE WHEN h.own THEN 'Лист: ' || h.sheet END], lambda x: x IS NOT NULL), ' | ')"


@query(f"""WITH {STAMPED}, md AS (SELECT doc_id, page, pos, id, linked, block_type, CASE WHEN block_type = 'image' THEN '**[ИЗОБРАЖЕНИЕ]** | Фрагмент: plan | Зона: ' || part || chr(10) || '**Краткое описание:** a & b' || chr(10) || '**Сущности:** K1, K2'
  WHEN pos % 3 = 2 THEN '##### part' || chr(10) || part ELSE 'part ' || part END AS content FROM bs WHERE block_type <> 'stamp'),
links AS (SELECT i.doc_id, i.id AS image_id, t.id AS text_id, t.content FROM md i JOIN md t ON t.linked = i.id AND t.doc_id = i.doc_id WHERE i.block_type = 'image' AND t.block_type = 'text'),
parts AS (SELECT m.doc_id, m.page, m.pos, '### BLOCK [' || upper(block_type) || ']: ' || m.id || chr(10) || CASE WHEN linked IS NOT NULL AND l.text_id IS NULL THEN '→' || linked || chr(10) ELSE '' END || CASE WHEN {_SHORT_SQL} = '' THEN '' ELSE {_SHORT_SQL} || chr(10) END
  || m.content || chr(10) || CASE WHEN l.text_id IS NULL THEN '' ELSE chr(10) || '**Распознанный OCR текст на чертеже:**' || chr(10) || l.content || chr(10) END AS part
  FROM md m LEFT JOIN links l ON l.image_id = m.id AND l.doc_id = m.doc_id JOIN held h ON h.doc_id = m.doc_id AND h.page = m.page WHERE NOT EXISTS (SELECT 1 FROM links x WHERE x.text_id = m.id AND x.doc_id = m.doc_id)
  UNION ALL SELECT doc_id, page, -1, '## СТРАНИЦА ' || (page + 1) || chr(10) || CASE WHEN h.own THEN '**Лист:** ' || h.sheet || chr(10) ELSE '' END FROM held h WHERE EXISTS (SELECT 1 FROM md WHERE md.doc_id = h.doc_id AND md.page = h.page)),
body AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY page, pos) AS body FROM parts GROUP BY 1), firsts AS (SELECT doc_id, min_by(code, page) AS code, min_by(stage, page) AS stage, min_by(sheet, page) AS sheet FROM own GROUP BY 1)
SELECT d.doc_id, '# ' || coalesce(name, 'OCR Result') || chr(10) || chr(10) || 'Сгенерировано: 2024-01-02 03:04:05 UTC' || CASE WHEN f.doc_id IS NOT NULL THEN chr(10) || '**Штамп:**' || chr(10) || 'Шифр: ' || f.code || CASE WHEN f.stage = '' THEN '' ELSE chr(10) || 'Стадия: ' || f.stage END || chr(10) || 'Лист: ' || f.sheet
  WHEN name IS NOT NULL THEN chr(10) || '**Штамп:**' || chr(10) || 'Шифр: ' || replace(name, '.PDF', '') ELSE '' END || chr(10) || chr(10) || '---' || chr(10) || coalesce(chr(10) || body, '') AS content FROM docs d LEFT JOIN body USING (doc_id) LEFT JOIN firsts f USING (doc_id)""")
def export_markdown(spark, sf_dir):
    """Whole documents as Markdown: a heading for each page, blocks of every kind, linked texts below their image."""
    blocks = unread_blocks(spark, sf_dir)
    return ex.markdown(blocks, named_documents(blocks), MADE)


@query()
def clean_page_html(spark, sf_dir):
    """Pages with a recogniser's leftovers planted, cleaned; tests compare with a plain model."""
    k = F.col("page_id") % 5
    html = F.concat(F.when(k == 0, "</div></p>").when(k == 1, "<p>BLOCK: ABCD-EFGH-JKL</p><body class='x'>").otherwise("<div><p>"), "html", F.when(k == 2, "</p></div></div></p>").when(k == 3, "<p>open <p>more").otherwise("<div id='x'>"))
    return mk.with_clean_html(b.spread(b.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", html.alias("html")), "html", "clean").select("page_id", "clean")


@query()
def content_html(spark, sf_dir):
    """Documents as recognised texts of every form, as html; tests compare with a plain model."""
    return mk.with_content_html(formed_documents(spark, sf_dir), "ocr_text", "html").select("doc_id", "html")


@query()
def content_markdown(spark, sf_dir):
    """Documents as recognised texts of every form, as Markdown; tests compare with a plain model."""
    return mk.with_content_markdown(formed_documents(spark, sf_dir), "ocr_text", "markdown").select("doc_id", "markdown")


def formed_documents(spark, sf_dir):
    """Documents as plain text, html, fenced html, JSON of every server, lists of segments and of boxes, tables, and broken JSON."""
    k, quoted = F.col("doc_id") % 12, F.to_json(F.struct(F.col("text").alias("t")))
    value = F.regexp_replace(quoted, r'^\{"t":|\}$', "")
    wrap = lambda begin, end: F.concat(F.lit(begin), F.coalesce(F.nullif(value, F.lit("{")), F.lit('""')), F.lit(end))
    text = F.when(k == 0, F.concat(F.lit("<p>"), "text", F.lit("</p></p><div>"))).when(k == 1, F.concat(F.lit("```html\n<h2>"), "text", F.lit("</h2>\n```"))).when(k == 2, wrap('{"content_html": ', "}")).when(
        k == 3, wrap('{"analysis": {"detailed_description": ', ', "location": "east", "level_or_elevation": 3}}')).when(k == 4, wrap('{"ocr_html": ', "}")).when(k == 5, wrap('[{"html": ', '}, {"html": "<p>b"}]')).when(
        k == 6, F.lit('[{"bbox": [1, 2], "label": "x"}]')).when(k == 7, wrap('{"children": [{"html": "<i>a</i>"}, {"children": [{"stamp_html": ', "}]}]}")).when(
        k == 8, F.concat(F.lit("| a | b |\n|---|---|\n| 1 | "), F.regexp_replace("text", r"\s+", " "), F.lit(" |"))).when(k == 9, F.concat(F.lit("{broken "), "text")).when(k == 10, wrap('{"other": ', ', "n": 1}')).otherwise(F.col("text"))
    return b.spread(b.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.alias("ocr_text"))


def structured_responses(spark, sf_dir):
    """Turns of conversations as responses of the server that answers in JSON: html, structured html, an image, JSON and html in either field of reasoning, errors, nothing."""
    k, t = F.col("turn") % 8, F.col("text")
    part = lambda **fields: F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    said = lambda **fields: F.concat(F.lit('{"choices":[{"message":'), part(**fields), F.lit("}]}"))
    html, empty = F.concat(F.lit("<p>"), t, F.lit("</p>")), F.lit("")
    stamp = F.concat(F.lit("I see a stamp } here: "), part(document_code=F.concat(F.lit('} " {'), t)), F.lit(" and {more}"))
    response = F.when(k == 0, said(content=html)).when(k == 1, said(content=part(ocr_html=html))).when(k == 2, said(content=part(content_summary=t))).when(k == 3, said(content=empty, reasoning=stamp)).when(
        k == 4, said(content=empty, reasoning=F.lit(""), reasoning_content=F.concat(F.lit("Now: "), html))).when(k == 5, F.lit('{"error":"busy"}')).when(k == 6, said(content=F.lit("Let me see."), reasoning=F.lit("nothing"))).otherwise(said(content=F.lit(5)))
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))


@query("""WITH t AS (SELECT conv_id, turn, turn % 8 AS k, text FROM conversations),
j AS (SELECT *, CASE k WHEN 2 THEN json_object('content_summary', text) WHEN 3 THEN json_object('document_code', '} " {' || text) END::varchar AS js FROM t)
SELECT conv_id, turn, CASE WHEN k IN (0, 1, 4) THEN '<p>' || text || '</p>' WHEN k IN (2, 3) THEN js WHEN k = 5 THEN '[Ошибка: Qwen: некорректный ответ (busy)]' ELSE '[Ошибка: Qwen: пустой ответ модели]' END AS text,
  CASE WHEN k < 3 THEN 'content' WHEN k = 3 THEN 'reasoning' WHEN k = 4 THEN 'reasoning_content' WHEN k = 5 THEN 'error' ELSE 'empty' END AS source FROM j""")
def parse_structured_response(spark, sf_dir):
    """What the server that answers in JSON says: structured content first, JSON in its reasoning before html there."""
    return rs.read_structured(structured_responses(spark, sf_dir), "response", "text", "source").select("conv_id", "turn", "text", "source")


@query(f"""WITH {b.LINES} SELECT l_orderkey, line, CASE WHEN line % 5 = 4 THEN NULL ELSE 'D' || l_suppkey || ' }}' END AS document_code FROM li""")
def stamp_json_in_text(spark, sf_dir):
    """Stamps' JSON as it comes: bare, fenced, after a broken object in a fence, inside text with braces in strings, and with no known key."""
    line, code = F.col("line") % 5, F.concat(F.lit("D"), F.col("l_suppkey").cast("string"), F.lit(" }"))
    data = F.to_json(F.struct(code.alias("document_code")))
    told = F.when(line == 0, data).when(line == 1, F.concat(F.lit("see ```json\n"), data, F.lit("\n```"))).when(line == 2, F.concat(F.lit("it is "), data, F.lit(" {broken"))).when(
        line == 3, F.concat(F.lit("```json\n{bad\n``` ").substr(F.lit(1), F.lit(0)), F.lit("so: "), data)).otherwise(F.concat(F.lit("x "), F.to_json(F.struct(code.alias("other")))))
    read = materialise(b.lines(spark, sf_dir).select("l_orderkey", "line", told.alias("ocr_text")), "stamps")
    return read.select("l_orderkey", "line", F.get_json_object(rs.stamp_json(F.col("ocr_text")), "$.document_code").alias("document_code"))


@query("SELECT p_partkey, p_size % 2 = 0 AS lookalike FROM part")
def axis_lookalikes(spark, sf_dir):
    """Axes named with Latin capitals; words and Cyrillic axes don't count."""
    named = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("оси A-"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("оси А-1, Д/2, "), F.lower("p_name"), F.lit(" TK")))
    return b.table(spark, sf_dir, "part").select("p_partkey", rs.has_lookalikes(named).alias("lookalike"))
