"""A value computed once in an expression that names it often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value, however often f names it: a lambda binds it, so no expression is copied."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
