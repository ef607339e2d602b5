"""Bounded log reads open few files and equal the full scan, with gaps, overlaps and late files."""

import random

import pytest
from pyspark.sql import functions as F

from trendframe.sources import log as log_module
from trendframe.sources.io import tail_per_partition
from trendframe.sources.log import log_index, read_range, read_tail

SCHEMA = "partition int, offset long, value string"


@pytest.fixture()
def log(spark, tmpdir_path):
    """Files of three partitions: in order with gaps, overlapping, and one large old file."""
    rng = random.Random(6)
    path = f"{tmpdir_path}/log"
    rows = []
    for k in range(20):
        chunk = [(p, 100 * k + o, f"{p}-{k}") for p in (0, 1) for o in sorted(rng.sample(range(130), 40))]
        rows.append({(p, o): (p, o, v) for p, o, v in chunk}.values())
    rows.append([(2, o, "old") for o in range(5)] + [(None, 7, "none"), (1, None, "lost")])
    seen, out = set(), []
    for chunk in rows:
        chunk = [r for r in chunk if r[:2] not in seen]
        seen |= {r[:2] for r in chunk}
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        out += chunk
    return path, out


@pytest.mark.parametrize("n", [1, 50, 10_000])
def test_tail_equals_full_scan(spark, log, n, monkeypatch):
    path, rows = log
    opened, really = [], log_module._open
    monkeypatch.setattr(log_module, "_open", lambda s, p, files: opened.extend(files) or really(s, p, files))
    want = tail_per_partition(spark.createDataFrame([r for r in rows if r[1] is not None], SCHEMA), "partition", "offset", n)
    got = read_tail(spark, path, n)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    every = spark.read.parquet(path).inputFiles()
    assert len(opened) == len(every) if n == 10_000 else len(opened) <= 5 < len(every)


def test_range_equals_filter(spark, log):
    path, rows = log
    got = read_range(spark, path, {0: (500, 700), 2: (None, 3), 7: (0, None)})
    want = [r for r in rows if (r[0] == 0 and 500 <= r[1] < 700) or (r[0] == 2 and r[1] < 3)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(got.inputFiles()) <= 6
    assert read_range(spark, path, {}).collect() == []


def test_index_reads_new_files_only(spark, log, tmpdir_path):
    path, rows = log
    kept = f"{tmpdir_path}/index"
    first = log_index(spark, path, stored=kept).count()
    spark.createDataFrame([(0, 99_999, "new")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    index = log_index(spark, path, stored=kept)
    assert index.count() == first + 1 == log_index(spark, path).count()
    assert log_index(spark, path, stored=kept).count() == first + 1
    assert [r.offset for r in read_tail(spark, path, 1, index=index).filter("partition = 0").collect()] == [99_999]
    assert {r.value for r in read_tail(spark, path, 1, index=index).filter(F.col("partition").isNull()).collect()} == {"none"}
