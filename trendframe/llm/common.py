"""Helpers shared by the operators: staged tables, input sizes, text forms."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendframe.session import checkpoint_dir
from trendframe.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


_FOLDERS: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """The application's folder of staged tables; it goes when the driver ends."""
    path = f"{checkpoint_dir(spark)}/llm/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_end, spark, path)
    return path


def _end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can delete nothing; the folder's name tells whose it was
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it.

    Used where a table is read more than once or lineage has to be cut: the
    files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def released(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that run in here leave no shuffle files behind when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; for files, from their length. No job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` is exact for ASCII-only text."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shipped(spark: SparkSession) -> SparkSession:
    ship(spark)
    return spark


def residue(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Rows of a key from which it is split, and the parts it is split into.
HOT_ROWS = 1000
SALTS = 64


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, salt: Column) -> DataFrame:
    """Left join of ``rows`` with one row per group, where a group may hold most rows.

    Groups of over ``HOT_ROWS`` rows (column ``size``) are copied to every
    salt, so their rows are dealt over ``SALTS`` parts by ``salt``; all other
    rows are joined by key.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    hot = groups.filter(F.col(size) > HOT_ROWS).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cold = groups.filter(F.col(size) <= HOT_ROWS)
    split = salted.join(hot, [key, "salt"])
    rest = salted.join(hot.select(key, "salt"), [key, "salt"], "left_anti").join(cold, key, "left")
    return split.drop("salt").unionByName(rest.drop("salt"))
