"""Inverted lists against the exact search: recall, visits, odd vectors, hot lists."""

import numpy as np
import pytest

from trendframe.operators import ivf
from trendframe.operators.ivf import Lists, cluster, knn_lists, learn_lists
from trendframe.operators.knn import knn


def pairs(df):
    return {(r.qid, r.id) for r in df.collect()}


def frames(spark, rows):
    c = spark.createDataFrame(rows, "id long, embedding array<double>")
    return c.selectExpr("id AS qid", "embedding AS qvec"), c


def test_recall_on_the_supplied_vectors(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = c.selectExpr("id AS qid", "embedding AS qvec")
    exact = pairs(knn(q, c, 10, exclude_self=True))
    got = knn_lists(q, c, 10, learn_lists(c, lists=16, sample=250), exclude_self=True)
    assert len(pairs(got) & exact) >= 0.9 * len(exact)
    assert sorted({r["rank"] for r in got.collect()}) == list(range(1, 11))


@pytest.mark.parametrize("split", [65_536, 20])
def test_clustered_vectors_need_few_visits(spark, monkeypatch, split):
    monkeypatch.setattr(ivf, "SPLIT_ROWS", split)  # small splits: a list with a third of all rows is dealt out
    monkeypatch.setattr(ivf, "BLOCK_ROWS", split)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 24))
    home = np.where(rng.random(600) < 0.34, 0, rng.integers(0, 12, 600))
    q, c = frames(spark, [(i, (middle[h] + 0.2 * rng.normal(size=24)).tolist()) for i, h in enumerate(home)])
    lists = learn_lists(c, lists=12, n=5)
    assert lists.probes <= 4
    exact = pairs(knn(q, c, 5, exclude_self=True))
    assert len(pairs(knn_lists(q, c, 5, lists, exclude_self=True)) & exact) >= 0.9 * len(exact)


def test_all_lists_are_the_exact_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(80)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    q, c = frames(spark, rows)
    x = np.array([v for _, v in rows[:80] if any(v)])
    every = Lists(cluster(x / np.sqrt((x * x).sum(1))[:, None], 5), 5)
    assert pairs(knn_lists(q, c, 4, every)) == pairs(knn(q, c, 4))


def test_no_vectors(spark):
    q, c = frames(spark, [(1, None)])
    assert knn_lists(q, c, 3, learn_lists(c)).collect() == []
