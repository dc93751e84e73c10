"""The project tree: an adjacency list with materialised paths, ids joined by dots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.scratch import discard, materialise


def with_paths(nodes: DataFrame) -> DataFrame:
    """way (ids from the root down), path (the same, joined by dots) and depth of every node; one whose parent is unknown is a root.

    Ways grow by doubling: each round a node takes over the way of the node its own hangs from, so a tree of n levels
    takes about log2(n) equi-joins of ids and ways, each from a scratch table, until no way is open; the nodes' other
    columns join at the end. Nodes in a cycle, which no root reaches, are left out; where a repeated id lets a root
    reach a cycle, a way ends before an id it already holds. Ids may hold dots: only ``way`` is ever taken apart.
    """
    known = nodes.select(F.col("id").alias("_known")).distinct()
    edges = nodes.select("id", "parent_id").distinct().join(known, F.col("parent_id") == F.col("_known"), "left")
    now = materialise(edges.select("id", "parent_id", F.col("_known").alias("above"), F.array("id").alias("way")), "ways")
    tables, done, opened = [now], now.where("above is null"), now.where("above is not null")
    while not opened.isEmpty():
        above = now.select(F.col("id").alias("_id"), F.col("above").alias("_next"), F.col("way").alias("_way"))
        longer = opened.join(above, F.col("above") == F.col("_id")).where(~F.arrays_overlap("_way", "way"))
        longer = materialise(longer.select("id", "parent_id", F.col("_next").alias("above"), F.concat("_way", "way").alias("way")), "ways")
        tables.append(longer)
        done, opened = done.union(longer.where("above is null")), longer.where("above is not null")
        now = now.where("above is null").union(longer)
    ways = materialise(done.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), "way"), "ways")
    discard(*tables)
    out = nodes.join(ways, (F.col("id") == F.col("_id")) & F.col("parent_id").eqNullSafe(F.col("_parent")))
    return out.select(*nodes.columns, F.array_join("way", ".").alias("path"), (F.size("way") - 1).alias("depth"), "way")


def pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, id, ...) for each proper ancestor, from the way itself: no prefix comparison of all pairs."""
    inner = F.slice("way", 1, F.greatest(F.col("depth"), F.lit(0)))
    return tree.where("depth > 0").withColumn("ancestor", F.explode(inner))


def descendants(tree: DataFrame, of: Column) -> DataFrame:
    """Rows below the nodes that ``of`` (a condition on a node) picks, with the node as root_id."""
    roots = tree.where(of).select(F.col("id").alias("root_id"))
    return pairs(tree).join(roots, F.col("ancestor") == F.col("root_id")).drop("ancestor")


def ancestors(tree: DataFrame, of: Column) -> DataFrame:
    """(node_id, id, name, depth) of the nodes above those that ``of`` picks."""
    up = pairs(tree.where(of)).select(F.col("id").alias("node_id"), "ancestor")
    return up.join(tree, up.ancestor == tree.id).select("node_id", "id", "name", "depth")


def full_names(tree: DataFrame, separator: str = " / ") -> DataFrame:
    """(id, full_name): the names on a node's path, empty ones left out."""
    steps = tree.select("id", F.posexplode("way").alias("place", "step"))
    names = tree.select(F.col("id").alias("step"), F.col("name").alias("step_name"))
    named = steps.join(names, "step", "left").where("step_name is not null and step_name <> ''")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "step_name"))), lambda s: s["step_name"]), separator).alias("full_name"))


def child_counts(tree: DataFrame) -> DataFrame:
    counts = tree.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))
    return tree.join(counts.withColumnRenamed("parent_id", "id"), "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children_count"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    counts = pairs(tree).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("below"))
    return tree.join(counts, "id", "left").select("id", F.coalesce("below", F.lit(0)).alias("descendants_count"))


def subtree_stats(tree: DataFrame, files: DataFrame) -> DataFrame:
    """Folders, documents and files of each folder's subtree, itself included."""
    own = files.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("files"))
    counted = tree.join(own, "id", "left").select("id", "way", "node_type", F.coalesce("files", F.lit(0)).alias("files"))
    at = counted.withColumn("root", F.explode("way"))
    sums = at.groupBy("root").agg(F.count_if(F.col("node_type") == "folder").alias("folders"), F.count_if(F.col("node_type") == "document").alias("documents"), F.sum("files").alias("files"))
    return sums.join(tree.where("node_type = 'folder'").select(F.col("id").alias("root")), "root").withColumnRenamed("root", "id")


def moved(tree: DataFrame, node_id: str, parent_id: str | None) -> DataFrame:
    """The tree after a node and all below it went under another parent; unchanged if either is missing or the parent lies below."""
    node = tree.where(F.col("id") == node_id).select(F.col("way").alias("old_way"))
    if parent_id is None:
        to = node.select("old_way", F.array(F.lit(node_id)).alias("new_way"))
    else:
        parent = tree.where(F.col("id") == parent_id).select(F.col("way").alias("p"))
        to = node.join(parent, ~F.array_contains("p", node_id)).select("old_way", F.concat("p", F.array(F.lit(node_id))).alias("new_way"))
    # one row at most
    out = tree.join(F.broadcast(to.limit(1)), F.slice("way", 1, F.size("old_way")) == F.col("old_way"), "left")
    goes = F.col("old_way").isNotNull()
    out = out.withColumn("way", F.when(goes, F.concat("new_way", F.slice("way", F.size("old_way") + 1, F.greatest(F.size("way") - F.size("old_way"), F.lit(0))))).otherwise(F.col("way")))
    new = {"path": F.array_join("way", "."), "depth": F.size("way") - 1,
           "parent_id": F.when(goes & (F.col("id") == node_id), F.lit(parent_id)).otherwise(F.col("parent_id"))}
    return out.withColumns(new).select(tree.columns)


def deleted(tree: DataFrame, node_id: str) -> DataFrame:
    """Without a node and all below it."""
    return tree.where(~F.array_contains("way", node_id))


def visible(tree: DataFrame, text: str) -> DataFrame:
    """(id, path) of nodes whose name holds the text, or an ancestor's or a descendant's does."""
    hit = tree.where(F.lower("name").contains(text.lower()))
    above = hit.select(F.explode("way").alias("id"))
    below = pairs(tree).join(hit.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return tree.join(above.union(below).distinct(), "id", "left_semi").select("id", "path")


def renumbered(tree: DataFrame) -> DataFrame:
    """Siblings' sort orders as 0, 10, 20, ... in their present order."""
    order = Window.partitionBy("parent_id").orderBy("sort_order", "created_at", "id")
    return tree.select("id", "parent_id", ((F.row_number().over(order) - 1) * 10).alias("sort_order"))


def repeated_names(tree: DataFrame) -> DataFrame:
    """Names that several siblings have."""
    return tree.groupBy("parent_id", "name").agg(F.count("*").alias("n")).where("n > 1")


def children(tree: DataFrame, parent_id: str | None) -> DataFrame:
    """A node's children, or the roots, in their order: by sort_order, older ones first."""
    here = F.col("parent_id").isNull() if parent_id is None else F.col("parent_id") == parent_id
    return tree.where(here).orderBy("sort_order", "created_at", "id")


def child_types(node_type: Column) -> Column:
    """What may be created below a node: folders take both kinds, documents none."""
    return F.when(node_type == "folder", F.array(F.lit("folder"), F.lit("document"))).otherwise(F.array().cast("array<string>"))


def locked(tree: DataFrame, ids: DataFrame, lock: bool = True) -> DataFrame:
    """Documents of these ids with is_locked set or cleared; other nodes stay."""
    hit = tree.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("is_locked", F.when(F.col("_hit") & (F.col("node_type") == "document"), lock).otherwise(F.coalesce("is_locked", F.lit(False)))).drop("_hit")


def created(tree: DataFrame, new: DataFrame) -> DataFrame:
    """The tree with new nodes (id, parent_id, node_type, name) below known ones, each after its last sibling."""
    last = tree.groupBy("parent_id").agg(F.max("sort_order").alias("_last"))
    after = Window.partitionBy("parent_id").orderBy("name", "id")
    allowed = tree.where("node_type = 'folder'").select(F.col("id").alias("_parent"))
    placed = new.join(allowed, F.col("parent_id") == F.col("_parent"), "left").where("_parent is not null or parent_id is null")
    placed = placed.withColumn("_k", F.row_number().over(after)).join(last.withColumnRenamed("parent_id", "_p"), F.col("parent_id").eqNullSafe(F.col("_p")), "left")
    return tree.unionByName(placed.select(*new.columns, (F.coalesce("_last", F.lit(-1)) + F.col("_k")).cast("int").alias("sort_order")), allowMissingColumns=True)
