"""Annotations of every version as blocks of the present one, with what was dropped and filled beside them.

One pass over the JSON: each block comes with the fields it lacks and those that were filled; kept rows, rejected rows and
warnings are all read from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The present version, fields without which a block of an old one is dropped, and a page's size and margin where none is known.
VERSION = 2
REQUIRED = ("id", "page_index", "coords_px", "block_type")
WIDTH, HEIGHT, MARGIN = 1240, 1754, 50
NO_SIZE = (0.0, 0.0, 0.1, 0.1)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def structure_errors(data: Column) -> Column:
    """What keeps a JSON text from being an annotation, in this order; empty if nothing does."""
    return _structure_errors(F.try_parse_json(data))


def _structure_errors(v: Column) -> Column:
    pages = _at(v, "$.pages", "array<variant>")
    def wrong(p: Column, i: Column) -> Column:
        named = lambda text: F.concat(F.lit("page "), i.cast("string"), F.lit(text))
        held = _at(p, "$.blocks")
        return F.when(~_is(p, "OBJECT"), named(" is no object")).when(held.isNotNull() & ~_is(held, "ARRAY"), named(" has blocks that are no list"))
    first = F.array(F.when(_at(v, "$.pdf_path").isNull(), F.lit("no pdf_path")), F.when(_at(v, "$.pages").isNull(), F.lit("no pages")).when(~_is(_at(v, "$.pages"), "ARRAY"), F.lit("pages are no list")))
    found = F.array_compact(F.concat(first, F.coalesce(F.transform(pages, wrong), F.array().cast("array<string>"))))
    return F.when(_is(v, "OBJECT"), found).otherwise(F.array(F.lit("not an object")))


def is_flat(data: Column) -> Column:
    """Whether a JSON text is a list of blocks that name their page, the oldest form."""
    return _is_flat(F.try_parse_json(data))


def _is_flat(v: Column) -> Column:
    return F.coalesce(_at(v, "$[0].page_index").isNotNull(), F.lit(False))


def detected_version(data: Column) -> Column:
    """0 for a list of blocks; else the version that is stated, or what the first block has: 2 with shares and a source, and for none."""
    return _detected_version(F.try_parse_json(data))


def _detected_version(v: Column) -> Column:
    blocks = F.flatten(F.filter(F.transform(_at(v, "$.pages", "array<variant>"), lambda p: _at(p, "$.blocks", "array<variant>")), lambda b: b.isNotNull()))
    first = F.get(blocks, F.lit(0))
    by_block = F.when(first.isNull() | (_at(first, "$.coords_norm").isNotNull() & _at(first, "$.source").isNotNull()), VERSION).otherwise(1)
    return F.when(_is_flat(v), 0).otherwise(F.coalesce(_at(v, "$.format_version", "int"), by_block))


def _judged(annotations: DataFrame, node: str, data: str) -> DataFrame:
    """(node_id, data, flat, errors, version, good) of annotations; each is parsed once."""
    read = annotations.select(F.col(node).alias("node_id"), F.col(data).alias("data")).withColumn("v", F.try_parse_json("data"))
    read = read.select("node_id", "data", _is_flat(F.col("v")).alias("flat"), _structure_errors(F.col("v")).alias("errors"), _detected_version(F.col("v")).alias("version"))
    return read.withColumn("good", F.col("flat") | (F.size("errors") == 0))


def documents(annotations: DataFrame, node: str = "node_id", data: str = "data") -> DataFrame:
    """(node_id, version, success, migrated, errors) of annotations; version is null where the structure is wrong."""
    read, good = _judged(annotations, node, data), F.col("good")
    return read.select("node_id", F.when(good, F.col("version")).alias("version"), good.alias("success"), (good & (F.col("version") < VERSION)).alias("migrated"), F.when(good, F.array().cast("array<string>")).otherwise(F.col("errors")).alias("errors"))


def outcomes(annotations: DataFrame, node: str = "node_id", data: str = "data") -> DataFrame:
    """One row per block: node_id, version, page, pos, id, kept, missing, filled, coords_px, coords_norm, block_type, source, shape_type.

    Blocks of version 1 are dropped if they lack a required field; source, shape and shares of the page are filled (filled
    names them, shares of a page without a size as default_coords_norm). Other versions keep every block as it
    is. Annotations with a wrong structure have no rows.
    """
    text = _judged(annotations, node, data)
    size = "page_number: int, width: int, height: int, blocks: array<string>"
    none = F.lit(None).cast("int")
    listed = F.array(F.struct(none.alias("page_number"), none.alias("width"), none.alias("height"), F.from_json("data", "array<string>").alias("blocks"))).cast(f"array<struct<{size}>>")
    good = F.col("good") & F.col("node_id").isNotNull()
    pages = F.when(good & (F.col("version") > 0), F.from_json("data", f"struct<pages: array<struct<{size}>>>")["pages"]).when(good & (F.col("version") == 0), listed)
    rows = text.select("node_id", "version", F.posexplode(pages).alias("at", "p")).select("node_id", "version", "at", "p", F.posexplode("p.blocks").alias("pos", "b"))
    page = F.when(F.col("version") > 0, F.coalesce("p.page_number", "at")).otherwise(F.coalesce(F.get_json_object("b", "$.page_index").cast("int"), F.lit(0)))
    rows = rows.select("node_id", "version", page.alias("page"), "p.width", "p.height", "pos", "b").withColumn("keys", F.json_object_keys("b"))
    old = F.col("version") == 1
    lacks = lambda k: old & ~F.array_contains("keys", k)
    rows = rows.withColumn("missing", F.when(old, F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys"))).otherwise(F.array().cast("array<string>")))
    fields = F.from_json("b", "id string, coords_px array<int>, coords_norm array<double>, block_type string, source string, shape_type string")
    rows = rows.withColumn("f", fields)
    sized = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    px = F.col("f.coords_px")
    shares = F.when(sized, F.array(px[0] / F.col("width"), px[1] / F.col("height"), px[2] / F.col("width"), px[3] / F.col("height"))).otherwise(F.array(*map(F.lit, NO_SIZE)))
    filled = F.array_compact(F.array(F.when(lacks("source"), F.lit("source")), F.when(lacks("shape_type"), F.lit("shape_type")), F.when(lacks("coords_norm"), F.when(sized, "coords_norm").otherwise("default_coords_norm"))))
    kept = F.size("missing") == 0
    return rows.select("node_id", "version", "page", "pos", "f.id", kept.alias("kept"), "missing", F.when(kept, filled).otherwise(F.array().cast("array<string>")).alias("filled"), px.alias("coords_px"),
                       F.when(lacks("coords_norm"), shares).otherwise(F.col("f.coords_norm")).alias("coords_norm"), "f.block_type", F.when(lacks("source"), "user").otherwise(F.col("f.source")).alias("source"),
                       F.when(lacks("shape_type"), "rectangle").otherwise(F.col("f.shape_type")).alias("shape_type"))


def kept(found: DataFrame) -> DataFrame:
    """The blocks that stay, of outcomes()."""
    return found.where("kept").drop("kept", "missing", "filled")


def warnings(found: DataFrame) -> DataFrame:
    """(node_id, page, pos, id, warning) of outcomes(): what dropped blocks lack, and each field that was filled but a shape."""
    dropped = F.when(~F.col("kept"), F.array(F.concat(F.lit("dropped without "), F.array_join("missing", ", "))))
    said = F.transform(F.filter("filled", lambda x: x != "shape_type"), lambda x: F.concat(F.lit("filled "), x))
    return found.select("node_id", "page", "pos", "id", F.explode(F.coalesce(dropped, said)).alias("warning"))


def flat_pages(found: DataFrame) -> DataFrame:
    """(node_id, page, width, height): pages of flat annotations from 0 to the last that has blocks, as large as these need."""
    flat = found.where("version = 0")
    side = lambda i, least: F.greatest(F.max(F.coalesce(F.col("coords_px")[i], F.lit(0))) + MARGIN, F.lit(least))
    own = flat.groupBy("node_id", "page").agg(side(2, WIDTH).alias("width"), side(3, HEIGHT).alias("height"))
    every = flat.groupBy("node_id").agg(F.max("page").alias("_last")).select("node_id", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("page"))
    return every.join(own, ["node_id", "page"], "left").select("node_id", "page", F.coalesce("width", F.lit(WIDTH)).alias("width"), F.coalesce("height", F.lit(HEIGHT)).alias("height"))
