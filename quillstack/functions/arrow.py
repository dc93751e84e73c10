"""Plain functions of texts over Arrow columns, a few texts at a time: Python never holds a whole batch as objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of texts that are Python objects at a time, but for a longer one by itself.
MOST = 1 << 20


def _slices(texts: pa.Array) -> Iterator[list]:
    some, size = [], 0
    for t in texts:
        some.append(t.as_py())
        size += len(some[-1] or "")
        if size >= MOST:
            yield some
            some, size = [], 0
    yield some


def mapped(texts: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each text, nulls included, as an Arrow array."""
    return pa.concat_arrays([pa.array([f(t) for t in some], kind) for some in _slices(texts)])


def mapped_some(texts: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each text, null for null; nulls never become objects, so a column with few texts costs what these do."""
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), kind)
    if not texts.null_count:
        return mapped(texts, f, kind)
    there = texts.is_valid()
    at = pc.if_else(there, pc.subtract(pc.cumulative_sum(there.cast(pa.int64())), 1), pa.scalar(None, pa.int64()))
    return mapped(texts.drop_null(), f, kind).take(at)


def of_text(f: Callable[[str], str | None]):
    """The column function of a function from text to text; null stays null."""
    def run(texts: pa.Array) -> pa.Array:
        return mapped_some(texts, f, pa.string())
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())
