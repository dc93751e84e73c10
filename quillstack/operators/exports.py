"""Whole documents as html and as Markdown: title, stamps, and every block by its kind."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import ids
from quillstack.functions import markup as mk
from quillstack.functions.once import once
from quillstack.operators import blocks as bl
from quillstack.operators import stamps as sp

# Words of the exports.
CROP, STAMP, PAGE, SHEET, SHEET_NAME, LINKED_TEXT, MADE = (
    "🖼️ Открыть кроп изображения", "**Штамп:**", "## СТРАНИЦА", "**Лист:**", "**Наименование листа:**", "**Распознанный OCR текст на чертеже:**", "Сгенерировано:")


def _said(*values: Column) -> Column:
    """Lines, nulls left out."""
    return F.concat_ws("\n", *values)


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks dealt by documents, to more tasks than a shuffle has by itself: a task sorts the texts of its documents, which are far larger than what they are made of."""
    spark = blocks.sparkSession
    return blocks.repartition(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "doc_id")


def _by_document(dealt: DataFrame, documents: DataFrame, entry: Callable[[], tuple[Column, Column]]) -> DataFrame:
    """Documents with _entries in the order of pages and positions, empty without blocks, their _default and _first stamp.

    dealt has _own, the values of a stamp, for stamps only; entry() is whether a block has an entry and the struct of
    its fields, made of _at (its number on the page), _page (the values of the page's first stamp that has any),
    _seen (whether the page shows any block) and what documents have. Nothing is shuffled: pages lie within documents.
    """
    page = Window.partitionBy("doc_id", "page")
    whole = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dealt.withColumns({"_at": F.row_number().over(page.orderBy("pos")), "_page": F.first("_own", ignorenulls=True).over(whole), "_seen": F.max("_shown").over(whole)}).drop("_own")
    # of the two sides the blocks are the large one, whatever their files' size says; they are in the order of documents
    joined = documents.join(rows.hint("merge"), "doc_id", "left")
    there, fields = entry()
    begins = (F.col("_at") == 1) & F.col("_page").isNotNull()
    stamp = F.struct("page", *(F.col(f"_page.{f}").alias(f) for f in sp.FIELDS))
    found = joined.groupBy(*documents.columns).agg(
        F.sort_array(F.collect_list(F.when(there, fields))).alias("_entries"), F.collect_list(F.when(begins, stamp)).alias("_stamps"),
        F.min(F.when(begins & F.col("page").isNotNull() & F.col("_page.document_code").isNotNull(), F.struct("page", F.col("_page").alias("own"))))["own"].alias("_first"))
    found = found.withColumn("_default", sp.modes(F.col("_stamps"))).drop("_stamps")
    nothing = reduce(Column.__and__, (F.col(f"_default.{f}").isNull() for f in sp.FIELDS))
    # a document's name is its code if its stamps say nothing
    return found.withColumn("_default", F.col("_default").withField("document_code", F.when(nothing, sp.name_code(F.col("name"))).otherwise(F.col("_default.document_code"))))


def _own(pieces: Callable[[Column], dict[str, Column]]) -> list[Column]:
    """What an entry has of its page's stamp: whether the document's fields hold there too, whether it is the page's own, and its pieces."""
    return [F.col("page").isNotNull().alias("paged"), F.col("_page").isNotNull().alias("own"), F.struct(*(v.alias(n) for n, v in pieces(F.col("_page")).items())).alias("stamp")]


def _with_stamps(found: DataFrame, pieces: Callable[[Column], dict[str, Column]], whole: Callable[[Column, bool], Column], told: Callable[[Column, Column], Column]) -> Column:
    """Entries as texts: told(entry, stamp) with the stamp that holds on its page, its own pieces and of the document's fields those that it leaves empty; null without any."""
    given = {n: v for n, v in pieces(F.col("_default")).items() if n in sp.FIELDS}
    every = F.struct(*(v.alias(n) for n, v in given.items()), F.concat_ws(" | ", *given.values()).alias("line"))
    def of(default: Column) -> Column:
        def one(e: Column) -> Column:
            line = F.concat_ws(" | ", *(F.coalesce(e["stamp"][n], default[n]) if n in given else e["stamp"][n] for n in pieces(F.col("_first"))))
            return told(e, F.when(e["paged"], F.when(e["own"], once(line, lambda t: F.when(t != "", whole(t, False)))).otherwise(default["whole"])))
        return F.transform("_entries", one)
    return once(once(every, lambda d: d.withField("whole", F.when(d["line"] != "", whole(d["line"], True)))), of)


def html(blocks: DataFrame, documents: DataFrame, made: str, files: str = "", style: str = mk.STYLE) -> DataFrame:
    """(doc_id, content): documents (doc_id, name, project) as html made at that time.

    blocks has doc_id, page from 0, pos, id, block_type, ocr_text, linked_block_id, created_at and image_file. Stamps
    aren't blocks of their own: what holds on a page stands above each block. A document without blocks is its title.
    """
    kind, shown = F.col("block_type"), ~sp.is_stamp(F.col("block_type"))
    read = sp.with_own(blocks, "_own").withColumns({"_shown": shown, "_text": F.when(shown, F.col("ocr_text"))})
    read = _dealt(mk.with_content_html(read, "_text", "_content").select("doc_id", "page", "pos", "_shown", "block_type", "_own", "_content", *(F.when(shown, F.col(c)).alias(c) for c in ("id", "linked_block_id", "created_at", "image_file"))))
    line = lambda begin, value, end: F.when(_some(value).isNotNull(), F.concat(F.lit(begin), value, F.lit(end)))
    def entry() -> tuple[Column, Column]:
        crop = F.concat(F.lit(f'<p><a href="{files}/tree_docs/'), "project", F.lit("/crops/"), F.regexp_extract("image_file", "[^/]*$", 0), F.lit(f'" target="_blank"><b>{CROP}</b></a></p>'))
        before = _said(
            F.concat(F.lit('<div class="block block-type-'), kind, F.lit('">')),
            F.concat(F.lit('<div class="block-header">Блок #'), F.col("_at").cast("string"), F.lit(" (стр. "), (F.col("page") + 1).cast("string"), F.lit(") | Тип: "), kind, F.lit("</div>")),
            F.lit('<div class="block-content">'), F.concat(F.lit("<p>BLOCK: "), ids.migrated(F.col("id")), F.lit("</p>")),
            line("<p><b>Linked block:</b> ", F.when(_some(F.col("linked_block_id")).isNotNull(), ids.migrated(F.col("linked_block_id"))), "</p>"), line("<p><b>Created:</b> ", F.col("created_at").cast("string"), "</p>"))
        after = _said(F.when((kind == "image") & _some(F.col("image_file")).isNotNull() & _some(F.col("project")).isNotNull(), crop), F.col("_content"), F.lit("</div></div>"))
        return F.col("_shown"), F.struct("page", "pos", before.alias("before"), after.alias("after"), *_own(mk.stamp_pieces_html))
    found = _by_document(read, documents.select("doc_id", "name", "project"), entry)
    entries = _with_stamps(found, mk.stamp_pieces_html, lambda told, inherited: mk.stamp_div(told, inherited), lambda e, stamp: _said(e["before"], stamp, e["after"]))
    title = F.coalesce(_some(F.col("name")), F.lit("OCR Result"))
    first = F.concat_ws(" | ", *mk.stamp_pieces_html(F.col("_first")).values())
    begin = _said(mk.header(title, F.lit(made), style), F.when(first != "", mk.stamp_div(first, False)))
    return found.select("doc_id", _said(begin, entries, F.lit(mk.FOOTER)).alias("content"))


def markdown(blocks: DataFrame, documents: DataFrame, made: str) -> DataFrame:
    """(doc_id, content): documents (doc_id, name) as Markdown made at that time, a heading for each page with other blocks than stamps.

    Texts linked to an image stand below it and nowhere else; blocks without content have their heading only.
    """
    shown = ~sp.is_stamp(F.col("block_type"))
    read = sp.with_own(blocks, "_own").withColumns({"_shown": shown, "_text": F.when(shown, F.col("ocr_text"))})
    read = _dealt(mk.with_content_markdown(read, "_text", "_content").select("doc_id", "page", "pos", "_shown", "block_type", "_own", "_content", *(F.when(shown, F.col(c)).alias(c) for c in ("id", "linked_block_id"))))
    read = bl.with_image_texts(read, "_content", "_below", "_moved")
    def entry() -> tuple[Column, Column]:
        own = lambda n: F.col(f"_page.{n}")
        paged = F.col("page").isNotNull()
        heading = F.when((F.col("_at") == 1) & F.col("_seen") & paged, _said(
            F.concat(F.lit(f"{PAGE} "), (F.col("page") + 1).cast("string")), F.concat(F.lit(f"{SHEET} "), own("sheet")), F.concat(F.lit(f"{SHEET_NAME} "), own("sheet_name")), F.lit("")))
        there = F.col("_shown") & ~F.col("_moved")
        arrow = F.when(_some(F.col("linked_block_id")).isNotNull() & F.col("_below").isNull(), F.concat(F.lit("→"), ids.migrated(F.col("linked_block_id"))))
        before = _some(_said(F.concat(F.lit("### BLOCK ["), F.upper("block_type"), F.lit("]: "), ids.migrated(F.col("id"))), arrow))
        text = F.when(_some(F.col("_below")).isNotNull(), F.concat(F.lit(f"\n{LINKED_TEXT}\n"), "_below"))
        after = _said(_some(F.col("_content")), text, F.lit(""))
        fields = F.struct("page", "pos", heading.alias("heading"), F.when(there, before).alias("before"), F.when(there, after).alias("after"), *_own(mk.stamp_pieces_markdown))
        return there | heading.isNotNull(), fields
    found = _by_document(read, documents.select("doc_id", "name"), entry)
    told = lambda e, stamp: F.when(e["after"].isNull(), e["heading"]).otherwise(_said(e["heading"], e["before"], stamp, e["after"]))
    entries = _with_stamps(found, mk.stamp_pieces_markdown, lambda line, inherited: line, told)
    first = F.concat_ws("\n", *mk.stamp_pieces_markdown(F.col("_first")).values())
    stamp = F.when(F.col("_first").isNotNull(), first).otherwise(F.concat(F.lit("Шифр: "), sp.name_code(F.col("name"))))
    title = F.coalesce(_some(F.col("name")), F.lit("OCR Result"))
    begin = _said(F.concat(F.lit("# "), title), F.lit(""), F.lit(f"{MADE} {made} UTC"), F.when(_some(stamp).isNotNull(), F.concat(F.lit(STAMP + "\n"), stamp)), F.lit(""), F.lit("---"), F.lit(""))
    return found.select("doc_id", _said(begin, entries).alias("content"))
