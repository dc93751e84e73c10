"""The engine's tables, derived from the given ones; and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1240, 1754


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to several tasks for each core: a file of one row group is read by one, whatever is then done with its rows."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tree without paths: id, parent_id, node_type, name, sort_order, status, created_at."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("string")
    start = F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    node = lambda df, i, p, kind, name, order, status=none, at=start: df.select(
        i.alias("id"), p.alias("parent_id"), F.lit(kind).alias("node_type"), name.alias("name"), (order % 7).cast("int").alias("sort_order"), status.alias("status"), at.alias("created_at"))
    states = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "missing_files").otherwise("unknown")
    return (
        node(t("region"), key("R", "r_regionkey"), none, "folder", F.col("r_name"), F.col("r_regionkey"))
        .union(node(t("nation"), key("N", "n_nationkey"), key("R", "n_regionkey"), "folder", F.col("n_name"), F.col("n_nationkey")))
        .union(node(t("customer"), key("C", "c_custkey"), key("N", "c_nationkey"), "folder", F.col("c_name"), F.col("c_custkey")))
        .union(node(t("orders"), key("O", "o_orderkey"), key("C", "o_custkey"), "document", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(".pdf")), F.col("o_orderkey"), states, F.col("o_orderdate")))
    )


EDGES = """edges AS (
  SELECT 'R' || r_regionkey AS id, NULL::varchar AS parent_id, 'folder' AS node_type, r_name AS name, (r_regionkey % 7)::int AS sort_order, NULL::varchar AS status, TIMESTAMP '2020-01-01' AS created_at FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'folder', n_name, (n_nationkey % 7)::int, NULL, TIMESTAMP '2020-01-01' FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'folder', c_name, (c_custkey % 7)::int, NULL, TIMESTAMP '2020-01-01' FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'document', 'order ' || o_orderkey || '.pdf', (o_orderkey % 7)::int,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'missing_files' ELSE 'unknown' END, o_orderdate FROM orders)"""

#: Paths, over EDGES; needs WITH RECURSIVE.
TREE = EDGES + """,
  tree AS (SELECT *, id AS path, 0 AS depth FROM edges WHERE parent_id IS NULL
    UNION ALL SELECT e.*, t.path || '.' || e.id, t.depth + 1 FROM edges e JOIN tree t ON e.parent_id = t.id)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a number of their own, as given ones repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order))


LINES = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::int AS line FROM lineitem)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered files: node_id, r2_key, file_type, file_size, file_name."""
    kinds = F.when(F.col("l_returnflag") == "N", "ocr_html").when(F.col("l_returnflag") == "R", " Result_MD ").otherwise("crop")
    return lines(spark, sf_dir).select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("node_id"),
        F.concat(F.lit("tree_docs/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("line").cast("string"), F.lit(".pdf")).alias("r2_key"),
        F.lower(F.trim(kinds)).alias("file_type"), F.col("l_extendedprice").cast("long").alias("file_size"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("file_name"), "line", F.col("l_shipdate").alias("created_at"))


FILES = LINES + """, files AS (SELECT 'O' || l_orderkey AS node_id, 'tree_docs/' || l_orderkey || '/' || l_partkey || '_' || line || '.pdf' AS r2_key,
  CASE l_returnflag WHEN 'N' THEN 'ocr_html' WHEN 'R' THEN 'result_md' ELSE 'crop' END AS file_type, trunc(l_extendedprice)::bigint AS file_size,
  l_partkey || '.pdf' AS file_name, line, l_shipdate AS created_at FROM li)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds: keys of shipped lines, some with another size, and keys no one registered."""
    t = lines(spark, sf_dir).where(F.col("l_linestatus") == "F")
    key = F.concat(F.lit("tree_docs/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("line").cast("string"))
    stray = F.col("l_discount") > 0.09
    size = F.col("l_extendedprice").cast("long") + F.when(F.col("l_tax") > 0.07, 1).otherwise(0)
    return t.select(F.concat(key, F.when(stray, ".png").otherwise(".pdf")).alias("key"), size.alias("size"))


LISTING = LINES + """, listing AS (SELECT 'tree_docs/' || l_orderkey || '/' || l_partkey || '_' || line || CASE WHEN l_discount > 0.09 THEN '.png' ELSE '.pdf' END AS key,
  trunc(l_extendedprice)::bigint + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS size FROM li WHERE l_linestatus = 'F')"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("J"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("node_id"),
        states.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, o_custkey % 30)")).alias("updated_at"),
        (F.col("o_totalprice") % 100 / 100).alias("progress"), (F.col("o_orderkey") % 5).cast("int").alias("retry_count"),
        F.when(F.col("o_custkey") % 2 == 0, "chandra").otherwise("LMStudio ").alias("engine"))


JOBS = """jobs AS (SELECT 'J' || o_orderkey AS id, 'C' || o_custkey AS node_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status,
  left(o_orderpriority, 1)::int AS priority, o_orderdate AS created_at, o_orderdate + to_days((o_custkey % 30)::int) AS updated_at, o_totalprice % 100 / 100 AS progress,
  (o_orderkey % 5)::int AS retry_count, CASE WHEN o_custkey % 2 = 0 THEN 'chandra' ELSE 'LMStudio ' END AS engine FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events: job, ts, seq, status, progress."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.least(F.abs(F.col("value")) / 100, F.lit(1.0)).alias("progress"))


# The event type that ends a job.
ENDS = ("purchase",)
EVENTS = "evs AS (SELECT user_id AS job, ts, event_id AS seq, event_type AS status, least(abs(value) / 100, 1.0) AS progress FROM events)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of annotated pages: doc_id, page, pos, id, block_type, coords_px, linked_block_id, code, ocr_text, is_correction.

    Lines are numbered within doc_id, so that rows are dealt by documents already when they are grouped by them.
    """
    doc, line = F.col("doc_id"), F.col("line")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    numbered = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))).withColumn("line", F.row_number().over(order))
    kind = F.when(F.col("l_returnflag") == "N", "text").when(F.col("l_returnflag") == "R", "image").otherwise("stamp")
    x1, y1 = (F.col("l_quantity") * 24).cast("int"), (F.col("l_discount") * 15000 + F.col("l_tax") * 4000).cast("int")
    text = F.when(line == 3, "[Ошибка: timeout]").when(line == 4, "[НеПовторяемая ошибка: context]").when(line == 5, "").when(line == 6, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string")))
    return numbered.select(
        doc, F.floor((line - 1) / 2).cast("int").alias("page"), line.alias("pos"), F.concat(doc, F.lit("-"), line.cast("string")).alias("id"), kind.alias("block_type"),
        F.array(x1, y1, x1 + (F.col("l_tax") * 2000).cast("int"), y1 + (F.col("l_quantity") * 3).cast("int")).alias("coords_px"),
        F.when((line > 1) & (kind == "text"), F.concat(doc, F.lit("-"), (line - 1).cast("string"))).alias("linked_block_id"),
        F.concat(F.lit("DOC-"), (F.col("l_suppkey") % 3).cast("string")).alias("code"), text.alias("ocr_text"), (F.col("l_linestatus") == "F").alias("is_correction"))


BLOCKS = LINES + """, blocks AS (SELECT 'O' || l_orderkey AS doc_id, ((line - 1) // 2)::int AS page, line AS pos, 'O' || l_orderkey || '-' || line AS id,
  CASE l_returnflag WHEN 'N' THEN 'text' WHEN 'R' THEN 'image' ELSE 'stamp' END AS block_type,
  [trunc(l_quantity * 24)::int, trunc(l_discount * 15000 + l_tax * 4000)::int, trunc(l_quantity * 24)::int + trunc(l_tax * 2000)::int, trunc(l_discount * 15000 + l_tax * 4000)::int + trunc(l_quantity * 3)::int] AS px,
  CASE WHEN line > 1 AND l_returnflag = 'N' THEN 'O' || l_orderkey || '-' || (line - 1) END AS linked_block_id,
  'DOC-' || (l_suppkey % 3) AS code,
  CASE line WHEN 3 THEN '[Ошибка: timeout]' WHEN 4 THEN '[НеПовторяемая ошибка: context]' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'part ' || l_partkey || ' from ' || l_suppkey END AS ocr_text,
  l_linestatus = 'F' AS is_correction FROM li)"""
