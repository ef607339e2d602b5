"""Nearest neighbours: probing against all codes, results against all rows, recall, odd vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendframe.llm import ann as A
from trendframe.llm.common import shipped

SCHEMA = "vec_id long, embedding array<double>, score int, rank int"


def frame(spark, rows):
    return shipped(spark).createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def slow(rows, n=5):
    live = [(i, np.array(v)) for i, v in rows]
    out = {}
    for i, q in live:
        if i % 50 == 0:
            best = {}
            for j, v in live:
                if j != i:
                    c = float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())))
                    best[j] = max(best.get(j, -2), c)
            out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.integers(0, 64), st.integers(0, 2**64 - 1), st.integers(0, 63))
def test_probing_finds_every_code_within_the_radius(found, radius, query, bit):
    code = np.array(found + [query, query ^ (1 << bit)], np.uint64)
    got = A.Index(code).within(np.uint64(query), radius)
    want = np.flatnonzero(np.bitwise_count(code ^ np.uint64(query)) <= radius)
    assert got.tolist() == want.tolist()


def test_recall_against_all_rows(spark):
    p = "/root/testdata/sf0.1/embeddings.parquet"
    df = shipped(spark).read.parquet(p)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = slow(rows)
    # a small sample and several slices and blocks, so that rows beyond the sample are found by their codes
    got = results(A.nearest(df, F.expr("vec_id % 50 = 0"), sample=400, slice_rows=600, block_rows=16))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {q: dict(slow([r for r in rows if r[0] == q] + [x for x in rows if x[0] in dict(got[q])])[q]) for q in got}
    assert all(abs(s - scores[q][i]) < 1e-12 for q in got for i, s in got[q])


def test_few_rows_ties_and_copies(spark):
    v, w = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.0]
    rows = [(0, v), (7, v), (3, v), (9, [2.0, 4.0, 6.0]), (50, w)]
    assert results(A.nearest(frame(spark, rows), F.expr("vec_id % 50 = 0"))) == slow(rows)
    copies = [(i, v) for i in range(200)] + [(i, w) for i in range(200, 300)]
    got = results(A.nearest(frame(spark, copies), F.expr("vec_id % 50 = 0")))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in slow(copies).items()}


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -1.0]), (100, [1e-200, 2e-200]), (4, [1e200, -1e200])]
    odd = [(None, [1.0, 0.0]), (50, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0])]
    got = results(A.nearest(frame(spark, good + odd), F.expr("vec_id % 50 = 0")))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [1, 4, 100, 2], 100: [1, 0, 4, 2]}
    assert got[0][1][1] == pytest.approx(2**-0.5, abs=1e-15) and got[100][0][1] == pytest.approx(3 / 10**0.5, abs=1e-15)
    twice = [(0, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.1]), (0, [1.0, 0.0])]
    assert results(A.nearest(frame(spark, twice), F.expr("vec_id % 50 = 0"))) == slow(twice)
    assert A.nearest(frame(spark, []), F.expr("vec_id % 50 = 0")).collect() == []
    assert A.nearest(frame(spark, odd), F.expr("vec_id % 50 = 0")).collect() == []


def test_any_dimension(spark):
    rng = np.random.default_rng(1)
    for dim in (1, 5, 100):
        rows = [(i, rng.normal(size=dim).tolist()) for i in range(120)]
        got, want = results(A.nearest(frame(spark, rows), F.expr("vec_id % 50 = 0"), sample=50)), slow(rows)
        assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
