"""Small helpers shared by the column-function modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def lit_array(values: Sequence[str]) -> Column:
    """A literal ``array<string>``."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def try_cast(c, dtype: str) -> Column:
    """Cast that yields NULL instead of failing on bad input (ANSI mode)."""
    return col_of(c).try_cast(dtype)


_CONSTANTS: dict = {}


def constant(key, build) -> Column:
    """A constant expression (literal map or array) built once per Spark context.

    Column objects are immutable expressions, so the same literal can be
    shared by every query; this saves hundreds of driver round trips per
    query for the fixed word lists and lexicon.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    k = (sc.applicationId, key)
    c = _CONSTANTS.get(k)
    if c is None:
        c = _CONSTANTS[k] = build()
    return c
