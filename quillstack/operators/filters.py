"""Filters as data: which rows a subscription sees, by a table of columns, operators and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "neq", "lt", "lte", "gt", "gte", "in")
#: Different predicates up to which they are broadcast.
MOST_BROADCAST = 10_000
_EXACT, _ROUND, _TIMES = (T.IntegralType, T.DecimalType), (T.FloatType, T.DoubleType), (T.DateType, T.TimestampType, T.TimestampNTZType)
_KINDS = {"exact": "decimal(38,10)", "round": "double", "time": "timestamp_ntz", "truth": "boolean", "text": "string"}

_CELLS = "array<struct<column_name: string, " + ", ".join(f"{k}: {t}" for k, t in _KINDS.items()) + ", kind: string>>"


def _kind(type_: T.DataType) -> str:
    for name, types in (("exact", _EXACT), ("round", _ROUND), ("time", _TIMES), ("truth", (T.BooleanType,))):
        if isinstance(type_, types):
            return name
    return "text"


def listed(value: Column) -> Column:
    """The values of a list written in braces, quotes around one left out."""
    inner = F.regexp_replace(value, r"^\s*\{|\}\s*$", "")
    return F.transform(F.split(inner, ","), lambda v: F.regexp_replace(F.trim(v), '^"|"$', ""))


def _holds(cell: str, value: str, type_: str) -> Column:
    """Whether the operator holds between a cell and a value of the cell's type; null for what isn't of that type."""
    c, v = F.col(cell), F.col(value).try_cast(type_)
    by = {"eq": c == v, "neq": c != v, "lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v, "in": F.exists(listed(F.col(value)), lambda x: c == x.try_cast(type_))}
    out = F.lit(None).cast("boolean")
    for op in reversed(OPERATORS):
        out = F.when(F.col("op") == op, by[op]).otherwise(out)
    return out


def visible(rows: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """(subscription, key): the rows that all of a subscription's filters (subscription, column_name, op, value) let through.

    Values are compared as the column's type; a null on either side, a value of another type or an unknown operator
    lets nothing through. Filters on columns that the rows lack don't count, but a subscription needs one that
    does. A subscription without filters is in no table and sees every row. Each predicate is judged once for each row,
    whatever number of subscriptions has it.
    """
    known = [f for f in rows.schema.fields if f.name != key]
    filters = filters.where(F.col("column_name").isin([f.name for f in known])).select("subscription", "column_name", "op", "value").distinct()
    predicates = filters.select("column_name", "op", "value").distinct()
    used = {r.column_name for r in predicates.select("column_name").distinct().collect()}  # as many as rows have columns at most
    def cell(f: T.StructField) -> Column:
        kind = _kind(f.dataType)
        return F.struct(F.lit(f.name).alias("column_name"), *((F.col(f.name) if k == kind else F.lit(None)).cast(t).alias(k) for k, t in _KINDS.items()), F.lit(kind).alias("kind"))
    cells = rows.select(F.col(key).alias("_key"), F.explode(F.array(*(cell(f) for f in known if f.name in used)) if used else F.from_json(F.lit("[]"), _CELLS)).alias("c"))
    cells = cells.select("_key", "c.*")
    small = predicates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = cells.join(F.broadcast(predicates) if small else predicates, "column_name")
    holds = F.lit(None).cast("boolean")
    for k, t in _KINDS.items():
        holds = F.when(F.col("kind") == k, _holds(k, "value", t)).otherwise(holds)
    good = met.withColumn("_holds", holds).where("_holds").select("_key", "column_name", "op", "value")
    needs = filters.groupBy("subscription").agg(F.count("*").alias("_needs"))
    found = good.join(F.broadcast(filters) if small and filters.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else filters, ["column_name", "op", "value"]).groupBy("subscription", "_key").agg(F.count("*").alias("_n"))
    return found.join(needs, "subscription").where("_n = _needs").select("subscription", F.col("_key").alias(key))
