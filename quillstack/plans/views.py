"""Queries over annotations and their pages, rows that filters let through, and listings by pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillstack.operators import canonical as ca
from quillstack.operators import filters as fl
from quillstack.operators import listings as ls
from quillstack.operators import verification as ve
from quillstack.plans.registry import query
from quillstack.sources import binding as b
from quillstack.sources import migration as mi
from quillstack.sources.binding import BLOCKS, HEIGHT, LISTING, WIDTH


def nested_documents(spark, sf_dir):
    """(doc_id, pdf_path, pages): blocks nested by page."""
    rows = b.blocks(spark, sf_dir).select("doc_id", "page", "pos", "id", "coords_px", F.array(*(F.col("coords_px")[i] / side for i, side in enumerate((WIDTH, HEIGHT, WIDTH, HEIGHT)))).alias("coords_norm"))
    block = F.struct("pos", "id", "coords_px", "coords_norm", F.lit("rectangle").alias("shape_type"), F.lit(None).cast("array<struct<x: int, y: int>>").alias("polygon"))
    # dealt by document, so that pages and documents are grouped and joined where they are
    pages = rows.repartition("doc_id").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    page = F.struct(F.col("page").alias("page_number"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "blocks")
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages")).select("doc_id", F.concat(F.lit("/old/"), "doc_id", F.lit(".pdf")).alias("pdf_path"), "pages")


def file_sizes(spark, sf_dir):
    """(doc_id, pdf_path, sizes): as many pages as the blocks have, one more for documents of even numbers, of three widths."""
    last = b.blocks(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("last"))
    even = F.when(F.substring("doc_id", 2, 20).cast("long") % 2 == 0, 1).otherwise(0)
    size = lambda i: F.struct((1000 + 120 * (i % 3)).cast("int").alias("width"), F.lit(HEIGHT).alias("height"))
    return last.select("doc_id", F.concat(F.lit("/new/"), "doc_id", F.lit(".pdf")).alias("pdf_path"), F.transform(F.sequence(F.lit(0), F.col("last") + even), size).alias("sizes"))


def _clamped(w: str) -> str:
    """SQL of a box from shares on a page of width w, the height as it was: truncated, inside, a pixel wide at least."""
    x1, x2 = f"least(greatest(trunc(s[1] * {w})::int, 0), {w} - 1)", f"least(greatest(trunc(s[3] * {w})::int, 0), {w})"
    y1, y2 = f"least(greatest(trunc(s[2] * {HEIGHT})::int, 0), {HEIGHT} - 1)", f"least(greatest(trunc(s[4] * {HEIGHT})::int, 0), {HEIGHT})"
    return f"[{x1}, {y1}, CASE WHEN {x2} <= {x1} THEN least({w}, {x1} + 1) ELSE {x2} END, CASE WHEN {y2} <= {y1} THEN least({HEIGHT}, {y1} + 1) ELSE {y2} END]"


_PIXELS = _clamped("w").replace("trunc(s[1] * w)::int", "px[1]").replace("trunc(s[3] * w)::int", "px[3]").replace(f"trunc(s[2] * {HEIGHT})::int", "px[2]").replace(f"trunc(s[4] * {HEIGHT})::int", "px[4]")


@query(f"""WITH {BLOCKS}, n AS (SELECT *, (1000 + 120 * (page % 3))::int AS w, [px[1] / {WIDTH}::double, px[2] / {HEIGHT}::double, px[3] / {WIDTH}::double, px[4] / {HEIGHT}::double] AS r FROM blocks),
c AS (SELECT *, list_transform(r, lambda v: least(greatest(v, 0.0), 1.0)) AS k FROM n),
o AS (SELECT *, [least(k[1], k[3]), least(k[2], k[4]), greatest(k[1], k[3]), greatest(k[2], k[4])] AS s FROM c)
SELECT doc_id, page, id, CASE WHEN s[3] - s[1] > 1e-6 AND s[4] - s[2] > 1e-6 THEN {_clamped('w')} ELSE {_PIXELS} END AS coords_px FROM o""")
def annotation_canonical(spark, sf_dir):
    """Blocks' boxes on the pages of the file their document now belongs to."""
    found = ca.canonical(nested_documents(spark, sf_dir), file_sizes(spark, sf_dir))
    return found.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page_number").alias("page"), F.explode("p.blocks").alias("b")).select("doc_id", "page", "b.id", "b.coords_px")


@query(f"""WITH {BLOCKS}, d AS (SELECT doc_id, max(page) AS last, substr(doc_id, 2)::bigint % 2 = 0 AS even FROM blocks GROUP BY 1)
SELECT doc_id, true AS changed, (last + 1 + even::int)::int AS page_count, '/new/' || doc_id || '.pdf' AS pdf_path FROM d""")
def annotation_pages(spark, sf_dir):
    """How many pages a document has after it, and whether anything changed."""
    return ca.canonical(nested_documents(spark, sf_dir), file_sizes(spark, sf_dir)).select("doc_id", "changed", "page_count", "pdf_path")


@query(f"""WITH {BLOCKS}, d AS (SELECT doc_id, max(page) AS last, count(DISTINCT page) AS n, substr(doc_id, 2)::bigint % 2 = 0 AS even FROM blocks GROUP BY 1)
SELECT doc_id, false AS compatible, CASE WHEN n <> last + 1 + even::int THEN 'Different page count: annotation=' || n || ', pdf=' || (last + 1 + even::int) ELSE 'Page 1: annotation={WIDTH}x{HEIGHT}, pdf=1000x{HEIGHT}' END AS reason FROM d""")
def annotation_compatibility(spark, sf_dir):
    """Why annotations don't fit the file as they are."""
    return ca.compatibility(nested_documents(spark, sf_dir), file_sizes(spark, sf_dir))


def subscriptions(spark, sf_dir):
    """Filters of one subscription for each nation: on status, price, date, priorities and a column that orders lack."""
    n = F.col("n_nationkey")
    f = lambda column, op, value, where: F.when(where, F.struct(F.lit(column).alias("column_name"), F.lit(op).alias("op"), value.alias("value")))
    each = F.array_compact(F.array(
        f("o_orderstatus", "eq", F.lit("F"), n % 2 == 0), f("o_orderstatus", "neq", F.lit("P"), n % 2 == 1), f("o_totalprice", "gt", (n * 10_000).cast("string"), n % 3 == 0), f("o_totalprice", "lte", F.lit("150000.5"), n % 3 == 1),
        f("o_orderdate", "lt", F.concat((1992 + n % 7).cast("string"), F.lit("-06-01")), n % 4 == 0), f("o_orderdate", "gte", F.lit("not a date"), n == 5), f("o_orderpriority", "in", F.lit('{1-URGENT,"2-HIGH"}'), n % 5 == 0), f("no_such_column", "eq", F.lit("x"), n == 7)))
    return b.table(spark, sf_dir, "nation").select(n.alias("subscription"), F.explode(each).alias("f")).select("subscription", "f.*")


@query("""SELECT n_nationkey AS subscription, count(*) AS n, sum(o_orderkey)::bigint AS keys FROM nation n JOIN orders o ON CASE WHEN n_nationkey % 2 = 0 THEN o_orderstatus = 'F' ELSE o_orderstatus <> 'P' END
  AND CASE n_nationkey % 3 WHEN 0 THEN o_totalprice > n_nationkey * 10000 WHEN 1 THEN o_totalprice <= 150000.5 ELSE true END AND (n_nationkey % 4 <> 0 OR o_orderdate < make_date((1992 + n_nationkey % 7)::int, 6, 1)) AND n_nationkey <> 5
  AND (n_nationkey % 5 <> 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1""")
def visible_rows(spark, sf_dir):
    """How many orders each subscription's filters let through."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    found = fl.visible(orders, "o_orderkey", subscriptions(spark, sf_dir))
    return found.groupBy("subscription").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def stored_objects(spark, sf_dir):
    """(key, size, updated_at) of what the store holds, and of objects beside its folders."""
    listing = b.listing(spark, sf_dir).withColumn("updated_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.expr("make_interval(0, 0, 0, CAST(size % 50 AS INT))"))
    return listing.union(listing.where("size % 40 = 0").select(F.concat(F.lit("tree_docs/"), F.regexp_extract("key", "[^/]*$", 0), F.lit("~")), "size", "updated_at"))


OBJECTS = LISTING + """, objects AS (SELECT key, size, TIMESTAMP '2024-01-01' + to_days((size % 50)::int) AS updated_at FROM listing
  UNION ALL SELECT 'tree_docs/' || regexp_extract(key, '[^/]*$') || '~', size, TIMESTAMP '2024-01-01' + to_days((size % 50)::int) FROM listing WHERE size % 40 = 0),
below AS (SELECT *, substr(key, 11) AS rest FROM objects WHERE starts_with(key, 'tree_docs/')),
entries AS (SELECT key AS name, false AS is_folder, size, updated_at, 1::bigint AS n FROM below WHERE NOT contains(rest, '/')
  UNION ALL SELECT 'tree_docs/' || split_part(rest, '/', 1), true, NULL, max(updated_at), count(*) FROM below WHERE contains(rest, '/') GROUP BY 1)"""
_AFTER = ("2024-02-10 00:00:00", "tree_docs/5")


@query(f"WITH {OBJECTS} SELECT name, is_folder, size, updated_at, n FROM entries")
def listing_entries(spark, sf_dir):
    """Folders and objects right below a prefix in one table."""
    return ls.entries(stored_objects(spark, sf_dir), "tree_docs/")


@query(f"WITH {OBJECTS} SELECT name, is_folder, n FROM entries WHERE name > 'tree_docs/3' ORDER BY name, is_folder LIMIT 50")
def listing_page_by_name(spark, sf_dir):
    """The page of a listing after a name."""
    return ls.by_name(stored_objects(spark, sf_dir), "tree_docs/", limit=50, after="tree_docs/3").select("name", "is_folder", "n")


@query(f"WITH {OBJECTS} SELECT name, updated_at FROM entries WHERE updated_at < TIMESTAMP '{_AFTER[0]}' OR (updated_at = TIMESTAMP '{_AFTER[0]}' AND name < '{_AFTER[1]}') ORDER BY updated_at DESC, name DESC LIMIT 50")
def listing_page_by_time(spark, sf_dir):
    """The page of a listing, the newest first, after a time and a name."""
    return ls.by_time(stored_objects(spark, sf_dir), "tree_docs/", limit=50, after=(datetime.fromisoformat(_AFTER[0]), _AFTER[1])).select("name", "updated_at")


@query(f"WITH {OBJECTS}, r AS (SELECT *, (row_number() OVER (ORDER BY name, is_folder) - 1) // 100 AS page FROM entries) SELECT page, count(*) AS entries, min(name) AS first, max(name) AS last, sum(n)::bigint AS objects FROM r GROUP BY 1")
def listing_pages(spark, sf_dir):
    """Every page of a listing at once: its ends and what it holds."""
    found = ls.numbered(ls.entries(stored_objects(spark, sf_dir), "tree_docs/"), [("name", True), ("is_folder", True)], 100)
    return found.groupBy("page").agg(F.count("*").alias("entries"), F.min("name").alias("first"), F.max("name").alias("last"), F.sum("n").alias("objects"))


def written_annotations(spark, sf_dir):
    """(node_id, data): blocks as annotations of version 0 to 2, some fields left out, and texts that are none."""
    rows = b.blocks(spark, sf_dir)
    n, pos = F.substring("doc_id", 2, 20).cast("long"), F.col("pos")
    old = n % 4 == 1
    block = F.struct("pos", F.when(~old | (pos % 5 != 0), F.col("id")).alias("id"), F.col("page").alias("page_index"), "coords_px", F.when(~old | (pos % 3 == 2), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))).alias("coords_norm"),
                     F.when(~old | (pos % 7 != 0), F.col("block_type")).alias("block_type"), F.when(~old | (pos % 2 == 0), F.lit("user")).alias("source"))
    pages = rows.repartition("doc_id").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    page = F.struct(F.col("page").alias("page_number"), F.when(F.col("page") != 1, WIDTH).otherwise(0).alias("width"), F.lit(HEIGHT).alias("height"), "blocks")
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    n = F.substring("doc_id", 2, 20).cast("long")
    whole = F.to_json(F.struct(F.lit("x.pdf").alias("pdf_path"), "pages"))
    data = F.when(n % 4 == 0, F.to_json(F.flatten("pages.blocks"))).when(n % 4 == 1, whole).when(n % 4 == 2, whole).when(n % 3 == 0, F.lit("[1, 2]")).when(n % 3 == 1, F.lit('{"pages": [5, {"blocks": 1}]}')).otherwise("{broken")
    return docs.select(F.col("doc_id").alias("node_id"), data.alias("data"))


@query(f"""WITH {BLOCKS}, d AS (SELECT DISTINCT doc_id, substr(doc_id, 2)::bigint AS n FROM blocks), f AS (SELECT doc_id, min_by(pos, (page, pos)) AS first FROM blocks GROUP BY 1)
SELECT doc_id AS node_id, CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN first % 2 = 0 AND first % 3 = 2 THEN 2 ELSE 1 END WHEN 2 THEN 2 END AS version, n % 4 <> 3 AS success, n % 4 = 0 OR (n % 4 = 1 AND NOT (first % 2 = 0 AND first % 3 = 2)) AS migrated,
  CASE WHEN n % 4 <> 3 THEN '' WHEN n % 3 = 1 THEN 'no pdf_path; page 0 is no object; page 1 has blocks that are no list' ELSE 'not an object' END AS errors FROM d JOIN f USING (doc_id)""")
def annotation_versions(spark, sf_dir):
    """The version of each annotation, and what is wrong with those that have none."""
    found = mi.documents(written_annotations(spark, sf_dir))
    return found.withColumn("errors", F.array_join("errors", "; "))


@query(f"""WITH {BLOCKS}, o AS (SELECT *, substr(doc_id, 2)::bigint AS n FROM blocks), w AS (
  SELECT doc_id, page, pos, CASE WHEN pos % 5 = 0 AND pos % 7 = 0 THEN 'dropped without block_type, id' WHEN pos % 5 = 0 THEN 'dropped without id' ELSE 'dropped without block_type' END AS warning FROM o WHERE n % 4 = 1 AND (pos % 5 = 0 OR pos % 7 = 0)
  UNION ALL SELECT doc_id, page, pos, 'filled source' FROM o WHERE n % 4 = 1 AND pos % 5 <> 0 AND pos % 7 <> 0 AND pos % 2 = 1
  UNION ALL SELECT doc_id, page, pos, CASE WHEN page = 1 THEN 'filled default_coords_norm' ELSE 'filled coords_norm' END FROM o WHERE n % 4 = 1 AND pos % 5 <> 0 AND pos % 7 <> 0 AND pos % 3 <> 2)
SELECT doc_id AS node_id, page, warning, count(*) AS n FROM w GROUP BY ALL""")
def annotation_warnings(spark, sf_dir):
    """What migration dropped and filled, counted by page; positions within a page are the block's own."""
    return mi.warnings(mi.outcomes(written_annotations(spark, sf_dir))).groupBy("node_id", "page", "warning").agg(F.count("*").alias("n"))


@query(f"""WITH {BLOCKS}, o AS (SELECT *, substr(doc_id, 2)::bigint AS n FROM blocks)
SELECT doc_id AS node_id, page, id, CASE WHEN n % 4 = 1 AND pos % 3 <> 2 THEN CASE WHEN page = 1 THEN 0.1 ELSE px[3] / {WIDTH}::double END ELSE 0.3 END AS right_share, 'user' AS source FROM o WHERE n % 4 <> 3 AND NOT (n % 4 = 1 AND (pos % 5 = 0 OR pos % 7 = 0))""")
def annotation_migrated(spark, sf_dir):
    """Blocks of all versions as the present one has them."""
    found = mi.kept(mi.outcomes(written_annotations(spark, sf_dir)))
    return found.select("node_id", "page", "id", F.col("coords_norm")[2].alias("right_share"), "source")


LOST = BLOCKS + """, lost AS (SELECT doc_id, id, page, pos FROM blocks WHERE block_type = 'text' AND (coalesce(ocr_text, '') = '' OR starts_with(ocr_text, '[Ошибка')))"""
_QUOTA = "(n <= 2 OR k <= greatest(1, floor(n * (2 / n))))"


def again(blocks, number):
    """A recogniser for tests and queries: fails for a third of the positions, other ones each round."""
    return blocks.select("id", F.when((F.col("pos") + number) % 3 == 0, "[Ошибка: again]").otherwise(f"round {number}").alias("text"))


@query(f"""WITH {LOST}, a AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS k FROM lost),
one AS (SELECT id, 1 AS round, CASE WHEN (pos + 1) % 3 = 0 THEN '[Ошибка: again]' ELSE 'round 1' END AS text FROM a WHERE {_QUOTA}),
left_over AS (SELECT * FROM lost WHERE id NOT IN (SELECT id FROM one WHERE text = 'round 1')),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS k FROM left_over)
SELECT * FROM one UNION ALL SELECT id, 2, CASE WHEN (pos + 2) % 3 = 0 THEN '[Ошибка: again]' ELSE 'round 2' END FROM c WHERE {_QUOTA}""")
def verification_rounds(spark, sf_dir):
    """The attempts of two rounds over texts, two of a document in each."""
    return ve.verified(b.blocks(spark, sf_dir), again, 2, 2, ("text",))


@query(f"""WITH {BLOCKS} SELECT doc_id, id, block_type, CASE WHEN coalesce(ocr_text, '') = '' THEN 'empty' WHEN starts_with(ocr_text, '[Ошибка') THEN 'api_error' ELSE 'suspicious_output' END AS reason FROM blocks
WHERE block_type <> 'text' AND NOT coalesce(starts_with(ocr_text, '[Не'), false) AND NOT (pos = 1 AND NOT coalesce(starts_with(ocr_text, '['), false))""")
def missing_stamps_and_images(spark, sf_dir):
    """Stamps and images to recognise again: all but those whose result holds JSON."""
    blocks = b.blocks(spark, sf_dir)
    blocks = blocks.withColumn("ocr_text", F.when((F.col("pos") == 1), F.lit('{"document_code": "x", "content_summary": "y"}')).otherwise(F.col("ocr_text")))
    found = [ve.missing(blocks, k).select("doc_id", "id", F.lit(k).alias("block_type"), "reason") for k in ("stamp", "image")]
    return found[0].union(found[1])
