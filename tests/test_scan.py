"""Running sums, distribution drift and running metrics over whole tables against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendframe.operators.drift import distribution_drift
from trendframe.operators.learn import running_metrics
from trendframe.operators.scan import running_sums


def test_running_sums_of_a_hot_key_and_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, float(i % 7)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(5)
    got = {r.i: r.s for r in running_sums(df, ["k"], ["i"], {"s": F.col("x")}).collect()}
    flat = {r.i: r.s for r in running_sums(df, [], ["i"], {"s": F.col("x")}).collect()}
    for k, i, _ in rows:
        assert got[i] == sum(x or 0 for kk, j, x in rows if kk == k and j <= i)
        assert flat[i] == sum(x or 0 for _, j, x in rows if j <= i)
    assert running_sums(df.filter("false"), ["k"], ["i"], {"s": F.col("x")}).collect() == []


def slow_drift(ref, cur):
    ref, cur = ([x for x in s if x is not None and not math.isnan(x)] for s in (ref, cur))
    both = sorted(set(ref) | set(cur))
    ks = max((abs(sum(x <= v for x in ref) / len(ref) - sum(x <= v for x in cur) / len(cur)) for v in both), default=None) \
        if ref and cur else None
    q1, q3 = (np.quantile(ref, q) for q in (0.25, 0.75)) if ref else (None, None)
    out = None if not ref else sum(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) for x in cur)
    return len(ref), len(cur), ks, q1, q3, out


@pytest.mark.parametrize("keys", [["k"], []])
def test_distribution_drift(spark, keys):
    rng = random.Random(3)
    nan = float("nan")

    def made(n, shift):
        return [(rng.choice(["a", "a", "b", None]), rng.choice([None, nan, 5.0, rng.gauss(shift, 3), rng.gauss(shift, 3), 40.0 if shift else 1.0]))
                for _ in range(n)]

    ref, cur = made(300, 0) + [("only ref", 1.0), ("one", 2.0)], made(200, 2) + [("only cur", 3.0), ("one", 2.0), ("none", None)]
    schema = "k string, x double"
    got = distribution_drift(spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema), "x", keys).collect()
    groups = {k for k, x in ref + cur if x is not None and not math.isnan(x)} if keys else {"all"}
    assert len(got) == len(groups)
    for r in got:
        own = [[x for k, x in s if not keys or k == r.k] for s in (ref, cur)]
        for a, b in zip(r[len(keys):], slow_drift(*own)):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12)


def test_distribution_drift_of_nothing(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert distribution_drift(none, none, "x", ["k"]).collect() == []
    assert distribution_drift(none, none, "x").collect() == []


def test_running_metrics_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(i, 1000.0 + (0 if i < 5 else rng.gauss(0, 2)), 1000.0 + rng.gauss(0, 1)) for i in range(200)]
    got = {r.i: r for r in running_metrics(spark.createDataFrame(rows, "i int, y double, p double").repartition(4), None, ["i"], "y", "p").collect()}
    for n in (1, 5, 6, 77, 200):
        y, p = (np.array([r[k] for r in rows[:n]]) for k in (1, 2))
        r = got[n - 1]
        assert r.running_mae == pytest.approx(np.abs(y - p).mean()) and r.running_rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
        assert r.running_r2 is None if n <= 5 else r.running_r2 == pytest.approx(1 - ((y - p) ** 2).mean() / y.var())
