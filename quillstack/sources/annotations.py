"""Annotations as JSON, manifests, object listings, and exports written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "id string, page_index int, coords_px array<int>, coords_norm array<double>, block_type string, source string, shape_type string, category_code string, created_at string, ocr_text string, linked_block_id string"
PAGE = f"page_number int, page_index int, width int, height int, blocks array<struct<{BLOCK.replace(' string', ': string').replace(' int', ': int').replace(' array', ': array')}>>"
DOCUMENT = f"pdf_path string, format_version int, pages array<struct<{PAGE.replace('page_number int', 'page_number: int').replace('page_index int, width int, height int, blocks array', 'page_index: int, width: int, height: int, blocks: array')}>>"


def version(data: Column) -> Column:
    """0 for a flat list of blocks, else the version an annotation states, else 2 if its first block has shares, else 1."""
    stated = F.get_json_object(data, "$.format_version").cast("int")
    first = F.get_json_object(data, "$.pages[*].blocks[0].coords_norm")
    return F.when(F.ltrim(data).startswith("["), 0).otherwise(F.coalesce(stated, F.when(first.isNotNull(), 2).otherwise(1)))


def block_type(kind: Column, category: Column) -> Column:
    """Old and unknown types as text, images marked as stamps as stamps."""
    k = F.lower(kind)
    return F.when((k == "image") & (category == "stamp"), "stamp").when(k.isin("text", "image", "stamp"), k).otherwise("text")


def errors(data: Column) -> Column:
    """What keeps a text from being an annotation, as a list; empty if nothing does."""
    kept = F.array(
        F.when(~F.coalesce(F.ltrim(data).startswith("{"), F.lit(False)), F.lit("not an object")),
        F.when(F.get_json_object(data, "$.pdf_path").isNull(), F.lit("no pdf_path")),
        F.when(F.get_json_object(data, "$.pages").isNull(), F.lit("no pages")))
    return F.array_compact(kept)


def blocks(annotations: DataFrame, node: str = "node_id", data: str = "data") -> DataFrame:
    """One row per block of version 0, 1 and 2 annotations (node_id, data), missing fields filled.

    Shares of the page are derived from pixels where they are missing; a page without size gets a tenth of the page.
    """
    flat = annotations.where(version(F.col(data)) == 0).select(F.col(node).alias("node_id"), F.posexplode(F.from_json(data, f"array<struct<{_colons(BLOCK)}>>")).alias("pos", "b"))
    flat = flat.select("node_id", F.coalesce("b.page_index", F.lit(0)).alias("page"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), "pos", "b")
    paged = annotations.where(version(F.col(data)) > 0).select(F.col(node).alias("node_id"), F.explode(F.from_json(data, DOCUMENT)["pages"]).alias("p"))
    paged = paged.select("node_id", F.coalesce("p.page_number", "p.page_index", F.lit(0)).alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.posexplode("p.blocks").alias("pos", "b"))
    px, w, h = F.col("b.coords_px"), F.col("width"), F.col("height")
    shares = F.when((w > 0) & (h > 0), F.array(px[0] / w, px[1] / h, px[2] / w, px[3] / h)).otherwise(F.array(*map(F.lit, (0.0, 0.0, 0.1, 0.1))))
    return flat.unionByName(paged).select(
        "node_id", "page", "width", "height", "pos", "b.id", px.alias("coords_px"), F.coalesce("b.coords_norm", shares).alias("coords_norm"),
        block_type(F.col("b.block_type"), F.col("b.category_code")).alias("block_type"), F.coalesce("b.source", F.lit("user")).alias("source"),
        F.coalesce("b.shape_type", F.lit("rectangle")).alias("shape_type"), "b.ocr_text", "b.linked_block_id")


def _colons(ddl: str) -> str:
    return ", ".join(": ".join(part.split(" ", 1)) for part in ddl.split(", "))


def to_json(blocks_table: DataFrame) -> DataFrame:
    """(node_id, data): version 2 annotations from rows of blocks; empty fields are left out."""
    block = F.struct("pos", "id", "coords_px", "coords_norm", "block_type", "source", "shape_type", F.nullif(F.col("ocr_text"), F.lit("")).alias("ocr_text"), "linked_block_id")
    pages = blocks_table.groupBy("node_id", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.array_sort(F.collect_list(block)).alias("blocks"))
    page = F.struct(F.col("page").alias("page_number"), "width", "height", "blocks")
    return pages.groupBy("node_id").agg(F.to_json(F.struct(F.lit("").alias("pdf_path"), F.lit(2).alias("format_version"), F.array_sort(F.collect_list(page)).alias("pages"))).alias("data"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Keys, sizes and times of the objects under a path, contents not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def write_exports(content: DataFrame, path: str, suffix: str) -> None:
    """Texts (doc_id, content), one file a row, in a folder named by the kind of export."""
    content.select("doc_id", F.col("content").alias("value"), F.lit(suffix).alias("kind")).write.partitionBy("kind").option("compression", "zstd").mode("overwrite").parquet(path)
