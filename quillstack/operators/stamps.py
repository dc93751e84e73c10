"""Stamps as maps of fields: what a page's stamp says, what the document's pages mostly say, and both together for every block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import responses as rs
from quillstack.functions.once import once
from quillstack.scratch import materialise

#: Fields that pages without a stamp take over.
FIELDS = ("document_code", "project_name", "stage", "organization")
_MAP = "map<string, string>"


def is_stamp(block_type: Column, category: Column | None = None) -> Column:
    """Whether a block is a stamp, by its type or by its old category."""
    other = F.coalesce(category == "stamp", F.lit(False)) if category is not None else F.lit(False)
    return F.coalesce(block_type == "stamp", F.lit(False)) | other


def _is_stamp(blocks: DataFrame) -> Column:
    return is_stamp(F.col("block_type"), F.col("category_code") if "category_code" in blocks.columns else None)


def _fields(blocks: DataFrame) -> Column:
    """The fields of a block's JSON. Values are texts, nested ones JSON. An ocr_json column goes before the text."""
    own = F.nullif(F.regexp_replace("ocr_json", r"^\s*\{\s*\}\s*$", ""), F.lit("")) if "ocr_json" in blocks.columns else F.lit(None).cast("string")
    return F.from_json(F.when(_is_stamp(blocks), F.coalesce(own, rs.parsed_json(F.col("ocr_text")))), _MAP)


def page_stamps(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, stamp): the fields of each page's first stamp whose text is a JSON object with any."""
    # exploded, as a filter would go below and have each text parsed again
    stamp = F.filter(F.array(_fields(blocks)), lambda m: F.size(m) > 0)
    read = blocks.where(_is_stamp(blocks)).select("doc_id", "page", "pos", F.explode(stamp).alias("stamp"))
    # dealt by documents, as what is asked of stamps is grouped by them
    return read.repartition("doc_id").groupBy("doc_id", "page").agg(F.min_by("stamp", "pos").alias("stamp"))


def with_own(blocks: DataFrame, out: str) -> DataFrame:
    """blocks with the values of each stamp's fields (with_stamp_values) as column ``out``, null for other blocks and for stamps without fields."""
    steps = blocks.withColumn("_map", _fields(blocks))
    return rs.with_stamp_values(steps.withColumn("_data", F.when(F.size("_map") > 0, F.to_json("_map"))).drop("_map"), "_data", out).drop("_data")


def modes(stamps: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """struct of fields, each the value that most of a document's stamps have, that of the first page of equals; null where none has any.

    stamps is array<struct<page, ...fields>>, one for each page: inherited() of documents that are rows already. Equal
    values are counted as runs of sorted ones; a single stamp is taken as it is.
    """
    def mode(field: str) -> Column:
        said = F.filter(F.transform(stamps, lambda s: F.struct(s[field].alias("value"), s["page"].alias("page"))), lambda v: v["value"].isNotNull())
        def longest(v: Column) -> Column:
            starts = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (F.get(v, i - 1)["value"] != x["value"]), i)), lambda i: i.isNotNull())
            runs = once(starts, lambda at: F.transform(at, lambda i, k: F.struct((F.coalesce(F.get(at, k + 1), F.size(v)) - i).alias("n"), (-F.get(v, i)["page"]).alias("seen"), F.get(v, i)["value"].alias("value"))))
            return F.array_max(runs)["value"]
        return once(F.sort_array(said), longest)
    one = F.struct(*(F.get(stamps, F.lit(0))[f].alias(f) for f in fields))
    return F.when(F.size(stamps) < 2, one).otherwise(F.struct(*(mode(f).alias(f) for f in fields)))


def inherited(stamps: DataFrame, fields: tuple[str, ...] | None = FIELDS) -> DataFrame:
    """(doc_id, inherited): of each field the value most pages have, that of the first page of equals; None takes every field.

    Each field by itself, so that a page that lacks one still counts for the others. Documents without any are left out.
    """
    said = stamps.select("doc_id", "page", F.explode("stamp").alias("field", "value")).where("coalesce(value, '') <> ''")
    if fields is not None:
        said = said.where(F.col("field").isin(*fields))
    counts = said.groupBy("doc_id", "field", "value").agg(F.count("*").alias("n"), F.min("page").alias("seen"))
    modes = counts.groupBy("doc_id", "field").agg(F.max_by("value", F.struct("n", -F.col("seen"))).alias("value"))
    return modes.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("inherited"))


def name_code(name: Column) -> Column:
    """The code that a file name is; null if nothing is left of it."""
    return F.nullif(F.trim(F.regexp_replace(name, r"(?i)\.pdf$", "")), F.lit(""))


def from_names(documents: DataFrame) -> DataFrame:
    """(doc_id, inherited): the code that a document's file name is, for documents (doc_id, name) whose stamps say nothing."""
    return documents.select("doc_id", name_code(F.col("name")).alias("code")).where("code is not null").select("doc_id", F.create_map(F.lit("document_code"), "code").alias("inherited"))


def first_full(stamps: DataFrame) -> DataFrame:
    """(doc_id, stamp): the first page's stamp that has a code, with all its fields."""
    coded = stamps.where(F.coalesce(F.col("stamp")["document_code"], F.lit("")) != "").select("doc_id", "page", F.to_json("stamp").alias("data"))
    return coded.groupBy("doc_id").agg(F.min_by("data", "page").alias("data")).select("doc_id", F.from_json("data", _MAP).alias("stamp"))


def merged(stamp: Column, default: Column) -> Column:
    """A page's fields, and of the document's those that the page leaves empty; null only if both are."""
    said = lambda m, k: F.coalesce(m[k], F.lit("")) != ""
    own = F.map_filter(stamp, lambda k, v: said(stamp, k) | ~said(default, k))
    more = F.map_filter(default, lambda k, v: ~said(stamp, k))
    return F.when(stamp.isNull(), default).when(default.isNull(), stamp).otherwise(F.map_concat(own, more))


def of_pages(blocks: DataFrame, fields: tuple[str, ...] | None = FIELDS, documents: DataFrame | None = None, stamps: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, own, stamp): the fields of each page's own stamp, null if it has none, and those that hold there.

    A page's own fields go before the document's; with documents (doc_id, name) the name is the code of those without
    any stamp. stamp is null where nothing is known. Stamps are read once, to a scratch table, but for ones that are given.
    """
    stamps = materialise(page_stamps(blocks), "stamps") if stamps is None else stamps
    default = inherited(stamps.repartition("doc_id"), fields)
    if documents is not None:
        default = default.union(from_names(documents).join(default.select("doc_id"), "doc_id", "left_anti"))
    pages = blocks.select("doc_id", "page").distinct().join(stamps, ["doc_id", "page"], "left").join(default, "doc_id", "left")
    return pages.select("doc_id", "page", F.col("stamp").alias("own"), merged(F.col("stamp"), F.col("inherited")).alias("stamp"))


def propagated(blocks: DataFrame, fields: tuple[str, ...] | None = FIELDS, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, id, stamp): the fields that hold for each block."""
    pages = of_pages(blocks, fields, documents).select("doc_id", "page", "stamp")
    return blocks.select("doc_id", "page", "id").join(pages, ["doc_id", "page"]).select("doc_id", "page", "id", "stamp")
