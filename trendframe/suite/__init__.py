"""Registered queries: one Spark query per operator plus its SQL oracle.

Each module registers ``name -> (callable(spark, sf_dir) -> DataFrame,
DuckDB SQL | None)``. Every query reads the supplied tables (or tables Spark
derives from them) in full. Floating-point outputs are rounded to 6
decimals on both sides so that summation order does not change the value
hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for comparison.

    Computed as ``round(x * 10^d) / 10^d`` - the same arithmetic as the SQL
    oracle's ``round(x, d)`` - so ties in the last digit cannot split the
    two engines.
    """
    m = float(10 ** digits)
    return df.select(*[(F.round(F.col(c) * m, 0) / m).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def sql_windows(ts: str, size_s: int, slide_s: int) -> tuple[str, str, str]:
    """DuckDB pieces for sliding windows: (lateral range, start expr, end expr)."""
    n = size_s // slide_s
    us = slide_s * 1_000_000
    start = f"make_timestamp((epoch_us({ts}) // {us} - k) * {us})"
    end = f"make_timestamp((epoch_us({ts}) // {us} - k) * {us} + {size_s * 1_000_000})"
    return f"range(0, {n}) AS w(k)", start, end


def _load_all():
    from . import (  # noqa: F401
        q_trend, q_clean, q_text, q_rank, q_catalogue, q_retrieval, q_learning, q_stream,
    )


def queries() -> dict[str, Callable]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
