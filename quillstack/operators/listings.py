"""Listings of a store by prefix: folders and objects together, in pages that a key continues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.scratch import materialise


def entries(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """(name, is_folder, size, updated_at, n): what lies right below a prefix, of objects (key, size, updated_at).

    A folder's name ends before the delimiter; it has the latest time and the number of the objects below it, and no size.
    """
    below = objects.where(F.col("key").startswith(prefix)).withColumn("_rest", F.expr(f"substr(key, {len(prefix) + 1})"))
    at = F.instr("_rest", delimiter)
    files = below.where(at == 0).select(F.col("key").alias("name"), F.lit(False).alias("is_folder"), "size", "updated_at", F.lit(1).cast("long").alias("n"))
    folder = F.concat(F.lit(prefix), F.expr("substr(_rest, 1, instr(_rest, '" + delimiter.replace("'", "\\'") + "') - 1)"))
    folders = below.where(at > 0).groupBy(folder.alias("name")).agg(F.max("updated_at").alias("updated_at"), F.count("*").alias("n"))
    return files.union(folders.select("name", F.lit(True).alias("is_folder"), F.lit(None).cast("long").alias("size"), "updated_at", "n"))


def _beyond(order: list[tuple[str, bool]], after: tuple) -> Column:
    """Whether a row comes after the last one of a page, by all columns of the order; null is below every value."""
    def past(name: str, rising: bool, value) -> Column:
        c = F.col(name)
        if value is None:
            return c.isNotNull() if rising else F.lit(False)
        v = F.lit(value)
        return F.coalesce(c > v, F.lit(False)) if rising else c.isNull() | (c < v)

    same: list[Column] = []
    ways = []
    for (name, rising), value in zip(order, after, strict=True):
        ways.append(reduce(lambda a, b: a & b, [*same, past(name, rising, value)]))
        same = [*same, F.col(name).eqNullSafe(F.lit(value))]
    return reduce(lambda a, b: a | b, ways)


def page(rows: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """The next rows of a listing, ``limit`` of them at most, in an order (column, rising) whose last column tells rows apart.

    after holds the order's values of the last row that was shown: pages meet without gaps or repeats however many rows
    are equal in the first columns, and a page costs a filter and its own rows, not those before it.
    """
    found = rows.where(_beyond(order, after)) if after is not None else rows
    return found.orderBy(*(F.col(c).asc_nulls_first() if rising else F.col(c).desc_nulls_last() for c, rising in order)).limit(limit)


def by_name(objects: DataFrame, prefix: str = "", delimiter: str = "/", limit: int = 100, after: str | tuple | None = None, rising: bool = True) -> DataFrame:
    """A page of a listing in the order of names, after the last shown (name, is_folder); after a name alone, past both of that name."""
    last = (after, rising) if isinstance(after, str) else after
    return page(entries(objects, prefix, delimiter), [("name", rising), ("is_folder", rising)], limit, last)


def by_time(objects: DataFrame, prefix: str = "", delimiter: str = "/", limit: int = 100, after: tuple | None = None, rising: bool = False) -> DataFrame:
    """A page of a listing in the order of times, then names, after the last shown (updated_at, name, is_folder); without is_folder, past both."""
    last = (*after, rising) if after is not None and len(after) == 2 else after
    return page(entries(objects, prefix, delimiter), [("updated_at", rising), ("name", rising), ("is_folder", rising)], limit, last)


def numbered(rows: DataFrame, order: list[tuple[str, bool]], limit: int) -> DataFrame:
    """All rows with the number of their page, from 0: rows are ranked by ranges of the order, not in one task."""
    keys = [F.col(c).asc_nulls_first() if rising else F.col(c).desc_nulls_last() for c, rising in order]
    placed = materialise(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "listing")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    ranked = placed.withColumn("_at", at).join(F.broadcast(before.select("_range", "_before")), "_range")
    return ranked.withColumn("page", F.floor((F.col("_at") + F.col("_before")) / limit)).drop("_range", "_at", "_before")
