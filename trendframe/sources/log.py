"""Bounded reads of a message log kept as Parquet files (S4 tail, S5 replay of a range).

A log index has one row per file and log partition: the smallest and the
largest offset and the number of messages. It is made by reading two columns,
and kept up by reading them of files that it does not list yet. Both reads
then open only the files whose offsets can matter:

* the last ``n`` messages of a partition lie at or above the largest offset
  that the smallest offsets of enough files with ``n`` messages in all reach;
* a range of offsets lies in the files whose own range meets it.

Offsets may have gaps, files may overlap, hold several partitions and come in
any order. Files are never changed once written, as in a log.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import has_table, tail_per_partition


def log_index(spark: SparkSession, path: str, part: str = "partition", offset: str = "offset",
              stored: str | None = None) -> DataFrame:
    """(file, part, lo, hi, n) of the log's files.

    With ``stored`` the index is kept there: only files that it lacks are
    read, and their rows are appended.
    """
    def read(files: DataFrame) -> DataFrame:
        return files.filter(F.col(offset).isNotNull()).groupBy(F.input_file_name().alias("file"), F.col(part).alias("part")).agg(
            F.min(offset).alias("lo"), F.max(offset).alias("hi"), F.count("*").alias("n"))

    log = spark.read.parquet(path).select(part, offset)
    if stored is None:
        return read(log)
    if not has_table(spark, stored):
        read(log).write.parquet(stored)
        return spark.read.parquet(stored)
    known = {r.file for r in spark.read.parquet(stored).select("file").distinct().collect()}  # one short row a file
    fresh = [f for f in log.inputFiles() if f not in known]
    if fresh:
        read(spark.read.schema(log.schema).parquet(*fresh)).write.mode("append").parquet(stored)
    return spark.read.parquet(stored)


def tail_files(index: DataFrame, n: int) -> DataFrame:
    """(file, part, floor): the files that can hold one of the last ``n`` messages of a partition, and from which offset on."""
    down = Window.partitionBy("part").orderBy(F.col("lo").desc(), "file")
    held = index.withColumn("held", F.sum("n").over(down))
    # at least n messages lie at or above this offset (all of them where there are fewer)
    floor = F.coalesce(F.max(F.when(F.col("held") >= n, F.col("lo"))).over(Window.partitionBy("part")),
                       F.min("lo").over(Window.partitionBy("part")))
    return held.withColumn("floor", floor).filter(F.col("hi") >= F.col("floor")).select("file", "part", "floor")


def _open(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read_tail(spark: SparkSession, path: str, n: int, part: str = "partition", offset: str = "offset",
              index: DataFrame | None = None) -> DataFrame:
    """The last ``n`` messages of every partition, by offset, from the files that can hold them."""
    chosen = tail_files(log_index(spark, path, part, offset) if index is None else index, n)
    floors = chosen.select(F.col("part").alias("__part"), "floor").distinct()
    log = _open(spark, path, [r.file for r in chosen.select("file").distinct().collect()])  # a few files a partition
    recent = log.join(floors, log[part].eqNullSafe(floors["__part"]) & (log[offset] >= floors["floor"])).select(*log.columns)
    return tail_per_partition(recent, part, offset, n)


def read_range(spark: SparkSession, path: str, ranges: Mapping, part: str = "partition", offset: str = "offset",
               index: DataFrame | None = None) -> DataFrame:
    """Messages with ``ranges[partition] = (from, to)``, ``to`` excluded; None leaves an end open.

    Partitions that are not named are not read.
    """
    index = log_index(spark, path, part, offset) if index is None else index
    wanted, meets = F.lit(False), F.lit(False)
    for p, (a, z) in ranges.items():
        inside, touched = F.col(part).eqNullSafe(F.lit(p)), F.col("part").eqNullSafe(F.lit(p))
        if a is not None:
            inside, touched = inside & (F.col(offset) >= a), touched & (F.col("hi") >= a)
        if z is not None:
            inside, touched = inside & (F.col(offset) < z), touched & (F.col("lo") < z)
        wanted, meets = wanted | inside, meets | touched
    files = [r.file for r in index.filter(meets).select("file").distinct().collect()]
    return _open(spark, path, files).filter(wanted)
