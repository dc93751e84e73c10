"""Blocks of annotated pages: links, enrichment, stamps, migration, verification, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import status as st
from quillstack.functions import texts as tx
from quillstack.functions.ids import similarity


def type_stats(blocks: DataFrame) -> DataFrame:
    """Blocks of each type in a document."""
    n = lambda k: F.count_if(F.col("block_type") == k).alias(k)
    return blocks.groupBy("doc_id").agg(F.count("*").alias("total"), n("text"), n("image"), n("stamp"))


def recognition_report(blocks: DataFrame, exact: bool = False) -> DataFrame:
    """Per document: recognised, failed, not to be retried and empty blocks, and what their share makes of the job."""
    marked = blocks.withColumn("_status", st.status(F.col("ocr_text"), exact))
    out = marked.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("_status") == "success").alias("recognized"), F.count_if(F.col("_status") == "error").alias("failed"),
        F.count_if(st.is_non_retriable(F.col("ocr_text"))).alias("non_retriable"), F.count_if(F.col("_status") == "not_recognized").alias("empty"))
    return out.withColumn("status", st.coverage(F.col("recognized"), F.col("total")))


def stamped_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, stamps) of the pages that have a stamp, so that none is added."""
    return blocks.where("block_type = 'stamp'").groupBy("doc_id", "page").agg(F.count("*").alias("stamps"))


def recognised(blocks: DataFrame) -> DataFrame:
    """(doc_id, recognised): whether any block of the document has a text."""
    return blocks.groupBy("doc_id").agg(F.bool_or(F.coalesce("ocr_text", F.lit("")) != "").alias("recognised"))


def image_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, image_id, text_id): the last text linked to each image; the ones before it stay apart."""
    texts = blocks.where("block_type = 'text' and linked_block_id is not null").select("doc_id", F.col("linked_block_id").alias("image_id"), F.col("id").alias("text_id"), "page", "pos")
    images = blocks.where("block_type = 'image'").select("doc_id", F.col("id").alias("image_id"))
    return texts.join(images, ["doc_id", "image_id"]).groupBy("doc_id", "image_id").agg(F.max_by("text_id", F.struct("page", "pos")).alias("text_id"))


def with_image_texts(blocks: DataFrame, text: str, below: str, moved: str) -> DataFrame:
    """blocks with, for images, the ``text`` of the last text linked to each as column ``below``, and as ``moved`` whether a block is such a text.

    The same links as image_texts, found among the rows that name an image of their document: no row is joined or leaves its document.
    """
    kind, link = F.col("block_type"), F.col("linked_block_id")
    linked = F.coalesce(kind == "text", F.lit(False)) & link.isNotNull()
    image = F.coalesce(kind == "image", F.lit(False))
    named = Window.partitionBy("doc_id", "_image")
    place = F.struct("page", "pos", "id")
    found = blocks.withColumn("_image", F.when(image, F.col("id")).when(linked, link)).withColumns({
        "_there": F.max(image).over(named), "_last": F.max(F.when(linked, F.struct(place.alias("place"), F.col(text).alias("text")))).over(named)})
    mine = linked & F.col("_there") & (F.col("_last.place") == place)
    return found.withColumns({below: F.when(image, F.col("_last.text")), moved: F.coalesce(mine, F.lit(False))}).drop("_image", "_there", "_last")


def enriched(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks with the html of their segment, of several that of the best score; method none and score 0 where there is none."""
    best = segments.groupBy("id").agg(F.max(F.struct("score", "method", "html")).alias("_s"))
    joined = blocks.join(best, "id", "left").withColumns({"ocr_html": F.col("_s.html"), "method": F.coalesce("_s.method", F.lit("none")), "score": F.coalesce("_s.score", F.lit(0.0))})
    return joined.drop("_s")


def corrected(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old results with corrections in their place and the flag cleared; blocks that are new are added."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.id") == F.col("b.id")), "full_outer")
    there = F.col("b.id").isNotNull()
    c = lambda n: F.coalesce(f"b.{n}", f"a.{n}").alias(n)
    return joined.select(c("doc_id"), c("id"), c("page"), c("pos"), c("block_type"), F.when(there, F.col("b.ocr_text")).otherwise(F.col("a.ocr_text")).alias("ocr_text"),
                         F.when(there, F.lit(False)).otherwise(F.col("a.is_correction")).alias("is_correction"))


def filled(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Empty texts filled from earlier results, of several of one id the first in the order of texts; what is there stays."""
    r = results.where("ocr_text <> ''").groupBy("id").agg(F.min("ocr_text").alias("_text"))
    there = F.coalesce("ocr_text", F.lit("")) != ""
    return blocks.join(r, "id", "left").withColumn("ocr_text", F.when(there, F.col("ocr_text")).otherwise(F.col("_text"))).drop("_text")


def inherited_code(blocks: DataFrame) -> DataFrame:
    """The code most stamps of a document have; of several the one seen first."""
    pages = blocks.where("block_type = 'stamp' and code <> ''").groupBy("doc_id", "page").agg(F.min_by("code", "pos").alias("code"))
    counts = pages.groupBy("doc_id", "code").agg(F.count("*").alias("n"), F.min("page").alias("seen"))
    return counts.groupBy("doc_id").agg(F.max_by("code", F.struct("n", -F.col("seen"))).alias("code"))


def first_code(blocks: DataFrame) -> DataFrame:
    stamps = blocks.where("block_type = 'stamp' and code <> ''")
    return stamps.groupBy("doc_id").agg(F.min_by("code", F.struct("page", "pos")).alias("code"))


def propagated(blocks: DataFrame) -> DataFrame:
    """(id, code): the code of a block's page, else its document's most frequent one."""
    page = blocks.where("block_type = 'stamp' and code <> ''").groupBy("doc_id", "page").agg(F.min_by("code", "pos").alias("page_code"))
    default = inherited_code(blocks).withColumnRenamed("code", "document_code")
    out = blocks.where("block_type <> 'stamp'").join(page, ["doc_id", "page"], "left").join(default, "doc_id", "left")
    return out.select("id", F.coalesce("page_code", "document_code").alias("code"))


def stamp_candidates(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """On pages without a stamp, the block furthest to the lower right, if its middle lies in that corner."""
    cx, cy = (F.col("coords_px")[0] + F.col("coords_px")[2]) / 2 / width, (F.col("coords_px")[1] + F.col("coords_px")[3]) / 2 / height
    page = Window.partitionBy("doc_id", "page")
    found = blocks.withColumns({"_stamps": F.max((F.col("block_type") == "stamp").cast("int")).over(page), "_x": cx, "_y": cy})
    found = found.where("_stamps = 0 and _x > 0.5 and _y > 0.7")
    best = page.orderBy(F.desc(F.col("_x") + F.col("_y")), "pos")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("doc_id", "page", "id")


def dense_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, blocks): every page from 0 to the last, also those without blocks."""
    last = blocks.groupBy("doc_id").agg(F.max("page").alias("last"))
    every = last.select("doc_id", F.explode(F.sequence(F.lit(0), "last")).alias("page"))
    counts = blocks.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"))
    return every.join(counts, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def page_sizes(blocks: DataFrame, width: int = 1240, height: int = 1754, margin: int = 50) -> DataFrame:
    """The size a page must have for its blocks, at least the default."""
    side = lambda i, least, name: F.greatest(F.max(F.col("coords_px")[i]) + margin, F.lit(least)).alias(name)
    return blocks.groupBy("doc_id", "page").agg(side(2, width, "width"), side(3, height, "height"))


def page_ranges(pages: DataFrame, parts: int) -> DataFrame:
    """(doc_id, part, first, last): each document's pages in so many runs, the first ones longer; shorter documents are left out."""
    doc = Window.partitionBy("doc_id")
    cut = pages.withColumn("_n", F.count("*").over(doc)).where(F.col("_n") >= parts).withColumn("part", F.ntile(parts).over(doc.orderBy("page")))
    return cut.groupBy("doc_id", "part").agg(F.min("page").alias("first"), F.max("page").alias("last"))


def split_links(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks with their part and page there; links into another part are dropped."""
    r = ranges.withColumn("page", F.explode(F.sequence("first", "last")))
    placed = blocks.join(r, ["doc_id", "page"]).select("doc_id", "id", "part", (F.col("page") - F.col("first")).alias("part_page"), "linked_block_id")
    other = placed.select(F.col("id").alias("linked_block_id"), F.col("part").alias("linked_part"))
    out = placed.join(other, "linked_block_id", "left")
    return out.select("doc_id", "id", "part", "part_page", F.when(F.col("linked_part") == F.col("part"), F.col("linked_block_id")).alias("linked_block_id"))


def pending(blocks: DataFrame, processed: DataFrame) -> DataFrame:
    """Blocks that no checkpoint holds."""
    return blocks.join(processed.select("id"), "id", "left_anti")


def missing(blocks: DataFrame, exact: bool = False) -> DataFrame:
    """(id, reason) of texts to recognise again: empty, api_error or suspicious_output; stamps and non-retriable errors aren't."""
    q = st.text_quality(F.col("ocr_text"), exact=exact)
    reason = F.when(q == "suspicious", "suspicious_output").otherwise(q)
    return blocks.where((F.col("block_type") == "text") & ~st.is_non_retriable(F.col("ocr_text"))).select("doc_id", "id", "page", "pos", reason.alias("reason")).where("reason <> 'ok'")


def retry_quota(missing_blocks: DataFrame, most: int) -> DataFrame:
    """Of a document's missing blocks all, or beyond ``most`` the first of them by its share, at least one."""
    doc = Window.partitionBy("doc_id")
    n = F.count("*").over(doc)
    ranked = missing_blocks.withColumns({"_n": n, "_k": F.row_number().over(doc.orderBy("page", "pos"))})
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * (most / F.col("_n"))))
    return ranked.where((F.col("_n") <= most) | (F.col("_k") <= quota)).drop("_n", "_k")


def export_stats(blocks: DataFrame) -> DataFrame:
    """Per document: all blocks, stamps left out, texts shown with their image, and the rest that is exported."""
    embedded = image_texts(blocks).select(F.col("text_id").alias("id"), F.lit(True).alias("_in"))
    marked = blocks.join(embedded, "id", "left")
    stamp, linked = F.col("block_type") == "stamp", F.coalesce("_in", F.lit(False))
    return marked.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(stamp).alias("stamps"), F.count_if(linked).alias("embedded"), F.count_if(~stamp & ~linked).alias("exported"))


def _fragments(blocks: DataFrame, fragment: Column) -> DataFrame:
    """Fragments in the order of pages and positions, one text a document."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", fragment.alias("part")))), lambda s: s["part"])
    return blocks.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("content"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, content): a document's recognised blocks as Markdown; a text linked to an image stands below it."""
    links = image_texts(blocks)
    texts = blocks.select(F.col("id").alias("text_id"), F.col("ocr_text").alias("linked_text"))
    below = links.join(texts, "text_id").select(F.col("image_id").alias("id"), "linked_text")
    own = blocks.where("block_type <> 'stamp'").join(links.select(F.col("text_id").alias("id")), "id", "left_anti").join(below, "id", "left")
    ok = lambda c: F.when(st.is_blank(F.col(c)) | st.is_any_error(F.col(c)), "*(no data)*").otherwise(tx.sanitize_markdown(F.col(c)))
    head = F.concat(F.lit("### "), F.upper("block_type"), F.lit(" "), F.col("id"))
    extra = F.when(F.col("linked_text").isNotNull(), F.concat(F.lit("\n> "), ok("linked_text"))).otherwise("")
    return _fragments(own, F.concat(head, F.lit("\n"), ok("ocr_text"), extra))


def html(blocks: DataFrame) -> DataFrame:
    """(doc_id, content): the same as html, every block numbered by its place, stamps included in the count."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos"))
    numbered = blocks.withColumn("_number", number).where("block_type <> 'stamp'")
    body = F.when(st.is_blank(F.col("ocr_text")) | st.is_any_error(F.col("ocr_text")), "").otherwise(tx.escape_html(F.col("ocr_text")))
    return _fragments(numbered, F.concat(F.lit('<div id="'), F.col("id"), F.lit('"><h2>'), F.col("_number").cast("string"), F.lit("</h2><p>"), body, F.lit("</p></div>")))


def block_similarity(blocks: DataFrame, expected: DataFrame, cutoff: float = 70.0) -> DataFrame:
    """(seen, id, score): the best expected id of the same document for each recognised one, the first of equals; none below the cutoff.

    Compared within a document only, exact ones by an equi-join first.
    """
    blocks, expected = blocks.distinct(), expected.groupBy("doc_id", "id").agg(F.min("pos").alias("pos"))
    exact = blocks.join(expected.select("doc_id", F.col("id").alias("seen")), ["doc_id", "seen"], "left_semi").select("doc_id", "seen", F.col("seen").alias("id"), F.lit(100.0).alias("score"))
    rest = blocks.join(exact.select("doc_id", "seen"), ["doc_id", "seen"], "left_anti")
    scored = rest.join(expected, "doc_id").withColumn("score", similarity(F.col("seen"), F.col("id"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("doc_id", "seen").agg(F.max_by("id", F.struct("score", -F.col("pos"))).alias("id"), F.max("score").alias("score"))
    return exact.union(best)
