"""Running sums over a whole table, in parallel.

A running sum over all rows, or over a key with most of them, is one task as a
window. Here rows are range-partitioned by key and order and written to the
shared checkpoint folder with their part's number; each part's sums give, by a
small window with one row a part, what lies before it; a second local window
per part adds that to its own running sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet under the shared checkpoint folder and read again: a plan read more than once runs once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its total over the key's rows up to this one in ``order``.

    Without keys the table is one sequence. Nulls count as nothing and come
    first in the order. Rows equal in ``order`` stay together in one part.
    """
    keys, order = list(keys), list(order)
    one = [F.col(k) for k in keys]
    valued = df.withColumns({f"__v_{k}": c for k, c in sums.items()})
    dealt = valued.repartitionByRange(*one, *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    rows = staged(dealt, "scan")
    parts = rows.groupBy(*keys, "__part").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    earlier = Window.partitionBy(*(one or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*keys, "__part", *[F.sum(f"__s_{k}").over(earlier).alias(f"__b_{k}") for k in sums])
    same = [rows[k].eqNullSafe(before[k]) for k in keys]
    on = rows["__part"] == before["__part"]
    for c in same:
        on = on & c
    joined = rows.join(before, on).drop(before["__part"], *[before[k] for k in keys])
    within = Window.partitionBy(*one, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = {k: F.coalesce(F.sum(f"__v_{k}").over(within), F.lit(0)) + F.coalesce(f"__b_{k}", F.lit(0)) for k in sums}
    return joined.select(*df.columns, *[c.alias(k) for k, c in total.items()])
