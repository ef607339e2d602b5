"""Layout of text scans.

Text functions (tokenising, regex extraction, the encoder) cost far more per
row than the scan. A table of few large row groups gives few splits, and
those functions would run on a handful of cores. :func:`spread` then deals
the rows out to the default parallelism. It decides by the length of the
files under the plan, which Catalyst knows without running anything; files
that fill every task slot are read as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def file_bytes(df: DataFrame) -> int:
    """Bytes of the sources under ``df``, by Catalyst's estimate. Starts no job.

    Sources of unknown size (rows of an RDD) count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Deal the rows of a scan out to ``target`` partitions unless its files do so already."""
    spark = df.sparkSession
    target = target or spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if df.isStreaming or file_bytes(df) >= target * split:
        return df
    return df.repartition(target)
