"""File registries and object listings: upserts, reconciliation, statuses, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("pdf", "annotation", "ocr_html", "result_md", "result_json", "crop", "image", "crops_folder")
ARTEFACTS = ("crop", "ocr_html", "result_md", "crops_folder")


def kind(value: Column) -> Column:
    """A file type trimmed and in lower case; pdf for one that isn't known."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*KINDS), v).otherwise("pdf")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new in place of those of the same keys; columns of ``keep_old`` stay where new has null.

    One full outer join on the keys; each side has a key once.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    there = F.coalesce(*(F.col(f"b.{k}").isNotNull() for k in keys))
    def pick(c: str) -> Column:
        if c in keys or c in keep_old:
            return F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        return F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(*(pick(c) for c in old.columns))


def first_keys(nodes: DataFrame, files: DataFrame, kind: str = "pdf") -> DataFrame:
    """(id, r2_key): the key of a node's first file of this kind, else the one among its attributes, which may be null."""
    first = files.where(F.col("file_type") == kind).groupBy(F.col("node_id").alias("id")).agg(F.min_by("r2_key", F.struct("created_at", "r2_key")).alias("_key"))
    return nodes.join(first, "id", "left").select("id", F.coalesce("_key", "r2_key").alias("r2_key"))


def pdf_statuses(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status, message) of the nodes among ``ids``; unknown and an empty message where there is none."""
    known = F.when(F.coalesce("pdf_status", F.lit("")) != "", F.col("pdf_status")).otherwise("unknown")
    return nodes.join(ids.select("id"), "id", "left_semi").select("id", known.alias("status"), F.coalesce("pdf_status_message", F.lit("")).alias("message"))


def reconcile(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(key, state) of each key in the store or the registry: both, size_mismatch, storage_only or db_only."""
    joined = listing.join(files.select(F.col("r2_key").alias("key"), "file_size"), "key", "full_outer")
    state = F.when(F.col("size").isNull(), "db_only").when(F.col("file_size").isNull(), "storage_only").when(F.col("size") != F.col("file_size"), "size_mismatch").otherwise("both")
    return joined.select("key", state.alias("state"))


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) between two snapshots: added, removed or updated."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(~same, "updated")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), change.alias("change")).where("change is not null")


def document_status(documents: DataFrame, annotated: DataFrame, files: DataFrame) -> DataFrame:
    """(id, status) of documents (id, r2_key): unknown without a key, missing_blocks without annotation, then missing_files or complete.

    Annotations and files are reduced to one row a node before the joins.
    """
    has = annotated.select(F.col("node_id").alias("id")).distinct().withColumn("has_annotation", F.lit(True))
    html = files.groupBy(F.col("node_id").alias("id")).agg(F.bool_or(F.col("file_type") == "ocr_html").alias("has_html"))
    found = documents.join(has, "id", "left").join(html, "id", "left")
    state = F.when(F.coalesce("r2_key", F.lit("")) == "", "unknown").when(F.col("has_annotation").isNull(), "missing_blocks").when(F.coalesce("has_html", F.lit(False)), "complete").otherwise("missing_files")
    return found.select("id", state.alias("status"))


def sidecars(files: DataFrame) -> DataFrame:
    """(node_id, html_key, md_key): a node's last registered exports."""
    last = lambda k: F.max_by(F.when(F.col("file_type") == k, F.col("r2_key")), F.when(F.col("file_type") == k, F.struct("line", "r2_key")))
    return files.groupBy("node_id").agg(last("ocr_html").alias("html_key"), last("result_md").alias("md_key"))


def purged(files: DataFrame, node_id: str, prefix: str) -> DataFrame:
    """Without a node's export artefacts, by type or by key under the prefix; its pdf and annotation stay."""
    gone = (F.col("node_id") == node_id) & (F.col("file_type").isin(*ARTEFACTS) | F.col("r2_key").startswith(prefix)) & ~F.col("file_type").isin("pdf", "annotation")
    return files.where(~F.coalesce(gone, F.lit(False)))


def totals(listing: DataFrame) -> DataFrame:
    """Objects and bytes of each folder of the store."""
    return listing.groupBy(F.regexp_replace("key", r"/[^/]*$", "").alias("folder")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def evicted(cache: DataFrame, by: str, room: int) -> DataFrame:
    """Entries (shard, key, size, accessed) to go, oldest first, until each shard's rest is at most ``room`` bytes."""
    shard = Window.partitionBy(by)
    before = shard.orderBy("accessed", "key").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("size").over(before), F.lit(0))
    return cache.withColumn("_excess", F.sum("size").over(shard) - room - gone).where("_excess > 0").drop("_excess")


def oldest_tenth(cache: DataFrame, by: str) -> DataFrame:
    """The oldest tenth, at least one, of each shard's entries."""
    shard = Window.partitionBy(by)
    ranked = cache.withColumns({"_n": F.count("*").over(shard), "_rank": F.row_number().over(shard.orderBy("accessed", "key"))})
    return ranked.where(F.col("_rank") <= F.greatest(F.floor(F.col("_n") / 10), F.lit(1))).drop("_n", "_rank")


def batches(keys: DataFrame, size: int = 1000) -> DataFrame:
    """(prefix, key, batch): keys in runs of ``size`` within their prefix, in order."""
    order = Window.partitionBy("prefix").orderBy("key")
    return keys.select("prefix", "key", F.floor((F.row_number().over(order) - 1) / size).alias("batch"))


def of_node(files: DataFrame, node_id: str, file_type: str | None = None) -> DataFrame:
    """A node's registered files, all or of one type, the newest first."""
    found = files.where(F.col("node_id") == node_id)
    return (found.where(F.col("file_type") == file_type) if file_type else found).orderBy(F.desc("created_at"), "r2_key")


def first_of_type(files: DataFrame, file_type: str) -> DataFrame:
    """(node_id, r2_key): each node's newest file of a type."""
    of_type = files.where(F.col("file_type") == file_type)
    return of_type.groupBy("node_id").agg(F.max_by("r2_key", F.struct("created_at", "r2_key")).alias("r2_key"))


def under(listing: DataFrame, prefix: str, delimiter: str = "/") -> DataFrame:
    """(name, objects, bytes, folder) right below a prefix: folders with what they hold, and objects."""
    rest = F.substr("key", F.lit(len(prefix) + 1))
    folder = F.instr(rest, delimiter) > 0
    name = F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.when(folder, delimiter).otherwise(""))
    return listing.where(F.col("key").startswith(prefix)).groupBy(name.alias("name"), folder.alias("folder")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def renamed(listing: DataFrame, old: str, new: str) -> DataFrame:
    """Objects under a prefix moved to another; the rest stays."""
    moved = F.concat(F.lit(new), F.substr("key", F.lit(len(old) + 1)))
    return listing.withColumn("key", F.when(F.col("key").startswith(old), moved).otherwise(F.col("key")))
