"""Annotations against the pages they now belong to: whether they fit, and boxes and polygons carried over.

Documents stay nested: pages and blocks are rewritten as arrays, no row is exploded and nothing is shuffled but
the sizes to their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import geometry as geo
from quillstack.functions.once import once

#: Pixels by which a page may differ.
TOLERANCE = 2


def _from_pixels(block: Column, width: Column, height: Column) -> Column:
    """struct<px, points> of a block by its pixels; a polygon's box is that of its points, brought inside the page."""
    plain = F.struct(geo.inside_page(block["coords_px"], width, height).alias("px"), block["polygon"].alias("points"))
    inside = once(geo.points_inside(block["polygon"], width, height), lambda p: F.struct(geo.box_of_points(p, width, height).alias("px"), p.alias("points")))
    return F.when((block["shape_type"] == "polygon") & (F.size(block["polygon"]) > 0), inside).otherwise(plain)


def _from_shares(block: Column, shares: Column, width: Column, height: Column) -> Column:
    """struct<px, points> of a block by its shares of the page; a polygon goes with its box."""
    def carried(px: Column) -> Column:
        old = geo.inside_page(block["coords_px"], width, height)
        points = once(old, lambda o: geo.rescaled_points(block["polygon"], o, px, width, height))
        return F.struct(px.alias("px"), F.when((block["shape_type"] == "polygon") & (F.size(block["polygon"]) > 0), points).otherwise(block["polygon"]).alias("points"))
    return once(once(geo.to_pixels(shares, width, height), lambda px: geo.inside_page(px, width, height)), carried)


def placed(block: Column, width: Column, height: Column, prefer_px: bool = False) -> Column:
    """The block with its box, shares and polygon for a page of this size: by its shares, by its pixels where these aren't valid."""
    if prefer_px:
        found = _from_pixels(block, width, height)
    else:
        found = once(geo.normal_shares(block["coords_norm"]), lambda s: F.when(s.isNull(), _from_pixels(block, width, height)).otherwise(_from_shares(block, s, width, height)))
    return once(found, lambda f: block.withField("coords_px", f["px"]).withField("coords_norm", geo.to_shares(f["px"], width, height)).withField("polygon", f["points"]))


def _page(pages: Column, number: Column) -> Column:
    """The page of a number, the last of several; looked for only if it isn't at its place."""
    there = F.get(pages, number)
    return F.when(there["page_number"] == number, there).otherwise(F.try_element_at(F.filter(pages, lambda p: p["page_number"] == number), F.lit(-1)))


def canonical(documents: DataFrame, sizes: DataFrame, prefer_px: bool = False) -> DataFrame:
    """(doc_id, pdf_path, pages, changed, strategy, page_count): documents with the pages of their file.

    documents has doc_id, pdf_path and pages (page_number, width, height, blocks: id, coords_px, coords_norm,
    shape_type, polygon and more), page numbers different; sizes has doc_id, pdf_path and sizes (width, height), one for each
    page. Pages that are missing are added, those beyond go. Documents without sizes are left out.
    """
    s = sizes.groupBy("doc_id").agg(F.max(F.struct("pdf_path", "sizes")).alias("_to"))
    joined = documents.join(s, "doc_id").select("doc_id", "pages", "_to", F.col("pdf_path").alias("_was"))
    kind = joined.schema["pages"].dataType.elementType
    none = F.from_json(F.lit("[]"), kind["blocks"].dataType)
    def page(size: Column, i: Column) -> Column:
        def with_old(old: Column) -> Column:
            blocks = F.transform(old["blocks"], lambda b: placed(b, size["width"], size["height"], prefer_px))
            fields = {"page_number": F.coalesce(old["page_number"], i), "width": size["width"], "height": size["height"], "blocks": F.coalesce(blocks, none)}
            return F.struct(*(fields.get(f.name, old[f.name]).cast(f.dataType.simpleString()).alias(f.name) for f in kind.fields))
        return once(_page(F.col("pages"), i), with_old)
    made = joined.withColumn("_pages", F.transform("_to.sizes", page))
    changed = ~F.col("_was").eqNullSafe(F.col("_to.pdf_path")) | ~F.coalesce(F.col("pages") == F.col("_pages"), F.lit(False))
    return made.select("doc_id", F.col("_to.pdf_path").alias("pdf_path"), F.col("_pages").alias("pages"), changed.alias("changed"), F.lit("px" if prefer_px else "norm").alias("strategy"), F.size("_pages").alias("page_count"))


def compatibility(documents: DataFrame, sizes: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(doc_id, compatible, reason): whether a document's pages are as many and as large as its file's, else why not: the first reason."""
    shape = F.array_sort(F.transform("pages", lambda p: F.struct(p["page_number"].alias("n"), p["width"].alias("width"), p["height"].alias("height"))))
    joined = documents.select("doc_id", shape.alias("a")).join(sizes.groupBy("doc_id").agg(F.max("sizes").alias("b")), "doc_id")
    said = lambda s: F.concat(s["width"].cast("string"), F.lit("x"), s["height"].cast("string"))
    far = lambda a, b: (F.abs(a["width"] - b["width"]) > tolerance) | (F.abs(a["height"] - b["height"]) > tolerance)
    told = F.transform(F.arrays_zip("a", "b"), lambda z: F.when(F.coalesce(far(z["a"], z["b"]), F.lit(True)), F.concat(F.lit("annotation="), said(z["a"]), F.lit(", pdf="), said(z["b"]))))
    first = F.array_compact(F.transform(told, lambda t, i: F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit(": "), t)))
    count = F.concat(F.lit("Different page count: annotation="), F.size("a").cast("string"), F.lit(", pdf="), F.size("b").cast("string"))
    reason = F.when(F.size("a") != F.size("b"), count).otherwise(F.coalesce(F.get(first, F.lit(0)), F.lit("")))
    return joined.select("doc_id", reason.alias("reason")).select("doc_id", (F.col("reason") == "").alias("compatible"), "reason")


def related(one: Column, other: Column) -> Column:
    """Whether two paths name the same file, letters' case aside."""
    name = lambda p: F.nullif(F.lower(F.regexp_extract(p, r"([^/]*)/*$", 1)), F.lit(""))
    return F.coalesce(name(one) == name(other), F.lit(False))
