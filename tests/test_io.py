"""Sources: TSV dumps with the null token, JSON decode with corrupt rows."""

import os

import pytest

from trendframe.schemas import RATINGS_TSV
from trendframe.sources.io import decode_json, read_tsv, upsert_last, write_keyed


def test_read_tsv_null_token(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "ratings.tsv")
    with open(path, "w") as f:
        f.write("tconst\taverageRating\tnumVotes\ntt1\t7.5\t120\ntt2\t\\N\t3\ntt3\t8.0\t\\N\n")
    got = sorted(tuple(r) for r in read_tsv(spark, path, RATINGS_TSV).collect())
    assert got == [("tt1", 7.5, 120), ("tt2", None, 3), ("tt3", 8.0, None)]


def test_decode_json_routes_corrupt_rows(spark):
    raw = ['{"k": 1}', "not json", '{"k" 1}', '{"k": "x"}', '{"k": null}', "{}"]
    df = spark.createDataFrame([(r,) for r in raw], "value string")
    got = [tuple(r) for r in decode_json(df, "value", "k int", corrupt_col="_corrupt").collect()]
    assert got == [(1, None), (None, raw[1]), (None, raw[2]), (None, raw[3]), (None, None), (None, None)]


KEYED = "k string, day string, v double, o int, extra string"


def stored(spark, path, *cols):
    return sorted(tuple(r) for r in spark.read.parquet(path).select(*cols).collect())


def test_write_keyed_moves_a_key_and_keeps_columns(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "keyed")
    write_keyed(spark.createDataFrame([("a", "d1", 1.0, 1, "x"), ("b", "d2", 2.0, 1, "y"), ("c", "d3", 3.0, 1, "z")], KEYED),
                path, ["k"], "o", "day")
    # the batch lacks a column; a changes its partition, whose last key it was
    moved = spark.createDataFrame([("a", "d2", 5.0, 2)], "k string, day string, v double, o int")
    for _ in range(2):  # the second write is a replay
        write_keyed(moved, path, ["k"], "o", "day")
        assert stored(spark, path, "k", "day", "v", "extra") == [
            ("a", "d2", 5.0, None), ("b", "d2", 2.0, "y"), ("c", "d3", 3.0, "z")]


def test_write_keyed_leaves_other_partitions_alone(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "keyed")
    rows = [(f"k{n}", f"d{n % 4}", float(n), 1, "x") for n in range(20)]
    write_keyed(spark.createDataFrame(rows, KEYED), path, ["k"], "o", "day")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    write_keyed(spark.createDataFrame([("k1", "d1", 9.0, 2, "x")], KEYED), path, ["k"], "o", "day")
    assert {os.path.basename(os.path.dirname(f)) for f in before - files()} == {"day=d1"}
    assert len(stored(spark, path, "k")) == 20


def test_write_keyed_winner_and_failing_read(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "keyed")
    write_keyed(spark.createDataFrame([("a", "d1", 1.0, 1, "x"), ("a", "d1", 7.0, 3, "y"), ("a", "d1", 2.0, 2, "z")], KEYED),
                path, ["k"], ["o", "v"], "day")
    assert stored(spark, path, "k", "v", "o") == [("a", 7.0, 3)]
    broken = os.path.join(path, "day=d1")
    bad = [f for f in os.listdir(broken) if f.endswith(".parquet")][0]
    with open(os.path.join(broken, bad), "wb") as f:
        f.write(b"no parquet")
    for f in os.listdir(broken):
        if f.endswith(".crc"):
            os.remove(os.path.join(broken, f))
    with pytest.raises(Exception):
        write_keyed(spark.createDataFrame([("b", "d1", 1.0, 1, "x")], KEYED), path, ["k"], "o", "day")
    assert bad in os.listdir(broken)


def test_upsert_last_ranks_the_batch_only(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, o int, v string")
    new = spark.createDataFrame([("a", 5, "new"), ("a", 4, "newer"), ("c", 0, "new")], "k string, o int, v string")
    out = upsert_last(new, base, ["k"], "o")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 5, "new"), ("b", 2, "old"), ("c", 0, "new")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Anti" in plan
