"""Sources and sinks.

Feeds arrive either from a message broker (``format("kafka")``) or, where no
broker connector is on the class path, from a directory of JSON/Parquet files;
both give the same DataFrame after ``decode_json``. Keyed stores are Parquet
tables rewritten per touched key, so a replayed micro-batch leaves them
unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


# --------------------------------------------------------------------- reads

def read_events(spark: SparkSession, source: str, schema: T.StructType | None = None, *,
                fmt: str = "kafka", starting: str = "latest", stream: bool = True,
                options: dict | None = None) -> DataFrame:
    """Subscribe to a feed.

    ``fmt="kafka"``: ``source`` is the topic, the result has a string
    ``value`` column to pass to :func:`decode_json`. File formats (``json``,
    ``parquet``): ``source`` is a directory and ``schema`` is required;
    ``starting="earliest"`` with ``stream=False`` replays everything (S5).
    """
    opts = dict(options or {})
    if fmt == "kafka":
        reader = spark.readStream if stream else spark.read
        opts.setdefault("subscribe", source)
        opts.setdefault("startingOffsets", starting)
        df = reader.format("kafka").options(**opts).load()
        return df.select(F.col("value").cast("string").alias("value"),
                         "partition", "offset", "timestamp")
    reader = spark.readStream if stream else spark.read
    # micro-batch size: pass ``maxFilesPerTrigger`` in ``options`` to cap it
    return reader.format(fmt).schema(schema).options(**opts).load(source)


def decode_json(df: DataFrame, col: str, schema: T.StructType | str,
                keep: Sequence[str] = (), corrupt_col: str | None = None) -> DataFrame:
    """Parse a JSON payload with a fixed schema and flatten it.

    With ``corrupt_col`` the raw payload of rows that do not parse, or whose
    fields have the wrong type, is kept in that column (NULL for good rows),
    so bad input can be routed instead of silently vanishing.
    """
    if not corrupt_col:
        return df.select(*keep, F.from_json(F.col(col), schema).alias("__d")).select(*keep, "__d.*")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    known = T.StructType([*schema.fields, T.StructField(corrupt_col, T.StringType())])
    parsed = F.from_json(F.col(col), known, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col})
    return df.select(*keep, parsed.alias("__d")).select(*keep, "__d.*")


def with_event_time(df: DataFrame, col: str = "timestamp", out: str = "event_time") -> DataFrame:
    """S3: event time from an ISO-8601 string; bad input becomes NULL."""
    return df.withColumn(out, F.try_to_timestamp(F.col(col)))


def tail_per_partition(df: DataFrame, part: str, offset: str, n: int) -> DataFrame:
    """The last ``n`` messages of every partition, by offset.

    ``row_number() <= n`` is planned with a partial group limit before the
    shuffle, so a hot partition costs ``n`` rows per task, not the partition.
    """
    w = Window.partitionBy(part).orderBy(F.col(offset).desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Tab-separated dump with declared types and ``\\N`` as NULL."""
    return (spark.read.schema(schema)
            .options(sep="\t", header=str(header).lower(), nullValue="\\N", quote="",
                     mode="PERMISSIVE")
            .csv(path))


# --------------------------------------------------------------------- sinks

def encode_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON document per row in ``value`` (and ``key`` if given)."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], order: str | Sequence[str] | None = None,
                partition_by: str | None = None) -> None:
    """Keyed upsert into a Parquet table, last write wins.

    The batch is reduced to its last row per key. With ``partition_by``
    (normally a day) only the partitions it touches are read and written:
    those of its rows and those that hold one of its keys now, so a key whose
    partition changes moves. Columns are matched by name; a column that the
    batch lacks keeps its stored values for other keys and is NULL for the
    batch's. Writing a batch twice gives the same table. Any error while
    reading the stored table is raised and leaves it as it was.
    """
    spark = df.sparkSession
    new = _last_per_key(df, keys, order)
    if not has_table(spark, path):
        _write(new, path, partition_by)
        return
    base = spark.read.parquet(path)
    if partition_by:
        held = base.join(new.select(*keys), list(keys), "left_semi").select(partition_by)
        touched = [r[0] for r in held.union(new.select(partition_by)).distinct().collect()]  # one value a partition
        inside = F.col(partition_by).isin([v for v in touched if v is not None])
        base = base.filter(inside | F.col(partition_by).isNull() if None in touched else inside)
    merged = base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
    # source and target are the same files: the merged rows are written apart first
    aside = f"{checkpoint_dir(spark)}/merged/{uuid.uuid4().hex}"
    merged.write.parquet(aside)
    merged = spark.read.schema(merged.schema).parquet(aside)
    _write(merged, path, partition_by)
    if partition_by:
        # a partition all of whose keys moved away gets no rows, so overwriting leaves it
        filled = {r[0] for r in merged.select(partition_by).distinct().collect()}
        utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for value in set(touched) - filled:
            text = None if value is None else str(value)
            delete_table(spark, f"{path}/{utils.getPartitionPathString(partition_by, text)}")
    delete_table(spark, aside)


def _write(df: DataFrame, path: str, partition_by: str | None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists and holds anything but marker files."""
    fs, p = _file_system(spark, path)
    return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a folder this library has written, if it is there."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def debug_sink(df: DataFrame, name: str, truncate: bool = False):
    """Print a stream (console) - for interactive debugging only."""
    return (df.writeStream.format("console").outputMode("append")
            .option("truncate", str(truncate).lower()).queryName(name))


def fan_out(sinks: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One micro-batch to several sinks.

    Returned function is a ``foreachBatch`` body: the batch is persisted once,
    so the upstream state and the sources are computed once however many
    sinks there are; each sink receives the batch id for idempotent writes.
    """
    def _run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()
    return _run


# ------------------------------------------------------------- keyed stores

def _last_per_key(df: DataFrame, keys: Sequence[str], order: str | Sequence[str] | None) -> DataFrame:
    """The row with the greatest ``order`` per key; ties go to the greatest row content."""
    columns = [order] if isinstance(order, str) else list(order or [])
    tie = F.xxhash64(*[F.col(c) for c in df.columns if dict(df.dtypes)[c][:3] != "map"])
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in columns], tie.desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def upsert_last(new: DataFrame, base: DataFrame, keys: Sequence[str],
                order: str | Sequence[str] | None = None) -> DataFrame:
    """Upsert by key, last write wins.

    A new row replaces the stored row with the same key. Among several new
    rows for one key the one with the greatest ``order`` wins (arrival order
    must be explicit). Only the batch is ranked (with a group limit before
    the shuffle); the stored rows are kept by an anti join on the keys, which
    adaptive execution turns into a broadcast where the batch is small.
    """
    last = _last_per_key(new, keys, order)
    return base.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def insert_ignore(new: DataFrame, base: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Append new rows whose key is not stored yet; existing ids are skipped.

    Within the new batch the first row per key (by ``order``) is kept.
    Returns the full table (stored rows plus the accepted new rows).
    """
    return base.unionByName(fresh_rows(new, base, key, order).select(*base.columns))


def fresh_rows(new: DataFrame, base: DataFrame | None, key: str, order: str | None = None) -> DataFrame:
    """The rows that :func:`insert_ignore` adds: stored keys go first, then the first row of each key is taken."""
    if base is not None:
        new = new.join(base.select(key), key, "left_anti").select(*new.columns)
    if order:
        return (new.groupBy(key)
                .agg(F.min_by(F.struct(*[F.col(c) for c in new.columns if c != key]),
                              F.col(order)).alias("__v"))
                .select(key, "__v.*").select(*new.columns))
    return new.dropDuplicates([key])


def lookup(df: DataFrame, col: str, value) -> DataFrame:
    """Exact key lookup (pushed to the scan as a filter)."""
    return df.filter(F.col(col) == F.lit(value))
