"""Operator tests on hand-made fixtures."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from trendframe.operators import rank as R
from trendframe.operators.joins import match_titles
from trendframe.operators.knn import knn
from trendframe.operators.learn import minibatch_step, prequential_per_key, sgd_prequential
from trendframe.operators.windows import delta_features, momentum, trailing_mean
from trendframe.plans.catalogue import discover
from trendframe.plans.retrieval import select_relevant
from trendframe.sources.io import insert_ignore, upsert_last
from trendframe.streaming.state import cooldown


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fuzzy_title_match(spark):
    cat = spark.createDataFrame([("t1", 1, "Location"), ("t2", 2, "Dune"), ("t3", 3, "dune"),
                                 ("t4", 4, "The Batman"), ("t5", 5, "Up")],
                                "tconst string, pos int, primaryTitle string")
    q = spark.createDataFrame([("DUNE",), ("cat",), ("batman",), ("the batman returns",), ("zzz",),
                               ("",), ("u",)], "query_title string")
    got = dict(rows(match_titles(q, cat), "query_title", "id"))
    # duplicate title: last id wins; containment on characters ('cat' in 'location');
    # both directions; a 1-char query matches the first title containing it; no match; empty skipped
    assert got == {"DUNE": "t3", "cat": "t1", "batman": "t4", "the batman returns": "t4", "u": "t3"}


def test_fuzzy_title_match_empty_option(spark):
    cat = spark.createDataFrame([("t1", 1, "Alpha"), ("t2", 2, "Beta")], "tconst string, pos int, primaryTitle string")
    q = spark.createDataFrame([("",)], "query_title string")
    assert rows(match_titles(q, cat, skip_empty=False), "query_title", "id") == [("", "t1")]


def test_top_comments(spark):
    df = spark.createDataFrame(
        [("m", "Great film " + "x" * 60, 5.0, 1), ("m", "GREAT FILM " + "x" * 60, 9.0, 2),
         ("m", "other", 5.0, 3), ("m", "third", 7.0, 4), ("m", "fourth", 1.0, 5)],
        "k string, text string, score double, o int")
    got = rows(R.top_comments(df, "k", "text", "score", "o"), "rank", "o")
    # same first 50 chars in other case: the earlier one is kept; equal scores: earlier first
    assert got == [(1, 4), (2, 1), (3, 3)]


def test_history_features(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 20, 40, 70, 110, 160, 220])],
                               "k string, t int, x double")
    out = trailing_mean(delta_features(df, "k", ["t"], ["x"]), "k", ["t"], ["x"], n=5)
    out = momentum(out, "k", ["t"], "x")
    got = [(r.t, r.delta_x, r.ma_x, r.trend_momentum) for r in out.orderBy("t").collect()]
    assert got[0] == (0, 0.0, 10.0, 0.0)          # no prior rows
    assert got[1] == (1, 0.0, 10.0, 0.0)          # one prior row
    assert got[2] == (2, 20.0, 15.0, 10.0)        # two prior rows
    assert got[6] == (6, 60.0, (20 + 40 + 70 + 110 + 160) / 5, 50.0)  # six priors, mean of last 5


def test_relevance_thresholds(spark):
    def run(n_match, n_rows):
        data = [("q", i + 1, "dune review" if i < n_match else "other text", f"r{i}") for i in range(n_rows)]
        r = spark.createDataFrame(data, "question_id string, rank int, text string, review_id string")
        titles = spark.createDataFrame([("q", "dune")], "question_id string, title string")
        k = select_relevant(r, titles).collect()
        return len(k), {x.strategy for x in k}, {x.mention_count for x in k}
    assert run(10, 40) == (10, {"strict"}, {10})
    assert run(9, 40) == (25, {"semantic"}, {25})
    assert run(0, 7) == (7, {"semantic"}, {7})
    r = spark.createDataFrame([("q", 1, "x", "r0")], "question_id string, rank int, text string, review_id string")
    t = spark.createDataFrame([("q", None)], "question_id string, title string")
    assert [x.strategy for x in select_relevant(r, t).collect()] == ["all"]


def test_discover_dedupe(spark):
    def src(rows_):
        return spark.createDataFrame(rows_, "id int, title string, popularity double, release_date string, rank int")
    movies = src([(1, "A", 10.0, "2024-01-01", 1)])
    tv = src([(1, "A tv", 50.0, None, 1)])
    now_playing = src([(1, "A again", 99.0, "2024-01-01", 1), (2, "B", 1.0, "2024-01-30", 1)])
    out = discover([("trending_movie", "movie", movies, None), ("trending_tv", "tv", tv, None),
                    ("now_playing", "movie", now_playing, 10)], F.lit("2024-01-31").cast("timestamp"), n=None)
    got = rows(out, "media_type", "id", "discovery_source")
    # same id as movie and as tv are different items; same movie id in two sources: earlier wins
    assert got == [("movie", 1, "trending_movie"), ("movie", 2, "now_playing"), ("tv", 1, "trending_tv")]


def test_cooldown(spark):
    t0 = dt.datetime(2024, 1, 1)
    secs = [0, 599, 600, 1199, 1201, 1800]
    df = spark.createDataFrame([("k", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)],
                               "key string, id int, ts timestamp")
    got = [r.id for r in cooldown(df, "key", "ts", 600).orderBy("id").collect()]
    # 599 s too early; 600 s passes; the clock restarts only at a passed row
    assert got == [0, 2, 4]


def test_knn_exact_and_chunked(spark):
    rng = np.random.default_rng(7)
    qv, cv = rng.normal(size=(13, 8)), rng.normal(size=(57, 8))
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qv)], "qid int, qvec array<double>")
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cv)], "id int, embedding array<double>")
    qn, cn = qv / np.linalg.norm(qv, axis=1)[:, None], cv / np.linalg.norm(cv, axis=1)[:, None]
    sims = qn @ cn.T
    expect = sorted((i, int(j)) for i in range(13) for j in np.argsort(-sims[i])[:5])
    for blocks, slices in ((1, 1), (1, 4), (3, 2), (20, 9)):
        got = rows(knn(q, c.repartition(3), 5, blocks=blocks, slices=slices), "qid", "id")
        assert got == expect


def test_knn_ties_zero_vectors_and_small_batches(spark, monkeypatch):
    from trendframe.operators import knn as K

    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid int, qvec array<double>")
    same = [(k, [2.0, 0.0]) for k in range(40, 0, -1)]
    c = spark.createDataFrame(same + [(99, [0.0, 0.0]), (98, None), (97, [0.0, 1.0])], "id int, embedding array<double>")
    # 40 equal rows: the smaller ids win; a zero or missing vector has no neighbours and is none
    want = [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert rows(knn(q, c, 3, blocks=2, slices=3), "qid", "id", "rank") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(knn(q, c, 50, blocks=1, slices=1), "qid", "id")[-1] == (1, 97)
    # a task returns at most n rows per query, whatever the tiles
    monkeypatch.setattr(K, "TILE_ROWS", 4)
    i, j, sim = K.local_top(np.array([[1.0, 0.0]] * 3), np.array([[1.0, 0.0]] * 41), 3)
    assert i.tolist() == [0] * 3 + [1] * 3 + [2] * 3 and j.tolist() == [0, 1, 2] * 3
    own = knn(c.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")), c, 1, exclude_self=True, blocks=2, slices=2)
    assert dict(rows(own, "qid", "id"))[1] == 2 and dict(rows(own, "qid", "id"))[40] == 1


def test_prequential_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X, y = rng.normal(size=(40, 3)), rng.normal(size=40) * 10 + 50
    X[:, 2] = 1.0  # constant feature: scaled to 0
    df = spark.createDataFrame([("k", i, *map(float, X[i]), float(y[i])) for i in range(40)],
                               "key string, t int, a double, b double, c double, y double")
    got = [r.prediction for r in prequential_per_key(df, "key", ["t"], ["a", "b", "c"], "y").orderBy("t").collect()]
    want, _ = sgd_prequential(X, y)
    assert np.allclose(got, want, atol=1e-9)
    assert got[0] == 0.0


def test_minibatch_single_row_equals_sequential(spark):
    X, y = np.array([[1.0, 2.0], [3.0, 1.0], [0.5, 4.0]]), np.array([10.0, 20.0, 5.0])
    state = None
    preds = []
    for i in range(3):
        b = spark.createDataFrame([(float(X[i, 0]), float(X[i, 1]), float(y[i]))], "a double, b double, y double")
        out, state = minibatch_step(b, ["a", "b"], "y", state)
        preds.append(out.first().prediction)
    want, _ = sgd_prequential(X, y)
    assert np.allclose(preds, want, atol=1e-9)


def test_keyed_stores(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    new = spark.createDataFrame([("b", 9.0, 1), ("c", 3.0, 1), ("c", 4.0, 2)], "id string, v double, o int")
    ins = rows(insert_ignore(new.select("id", "v", "o"), base.withColumn("o", F.lit(0)), "id", "o"), "id", "v")
    assert ins == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    up = rows(upsert_last(new, base, ["id"], "o"), "id", "v")
    assert up == [("a", 1.0), ("b", 9.0), ("c", 4.0)]


def test_fuzzy_title_match_empty_catalogue_title(spark):
    cat = spark.createDataFrame([("t0", 0, "  "), ("t1", 1, "Alpha"), ("t2", 2, "Beta")],
                                "tconst string, pos int, primaryTitle string")
    q = spark.createDataFrame([("alpha",), ("gamma",), ("bet",)], "query_title string")
    got = dict(rows(match_titles(q, cat), "query_title", "id"))
    # exact match wins; otherwise the empty title (position 0) is inside every query
    assert got == {"alpha": "t1", "gamma": "t0", "bet": "t0"}


def test_running_r2_and_two_ids_per_title(spark):
    from trendframe.operators.aggregate import regression_metrics
    from trendframe.operators.learn import running_metrics
    from trendframe.plans.learning import online_learning

    y, p = [1e9 + v for v in (1.0, 2.0, 4.0, 4.0)], [1e9 + v for v in (1.5, 2.0, 3.0, 5.0)]
    df = spark.createDataFrame(list(zip(range(4), y, p)), "t int, y double, p double")
    got = [r.running_r2 for r in running_metrics(df, None, ["t"], "y", "p").orderBy("t").collect()]
    assert got[0] is None and np.allclose(got[1:], [1 - 0.25 / 0.5, 1 - 1.25 / (14 / 3), 1 - 2.25 / 6.75])
    assert np.isclose(regression_metrics(df, "y", "p").first()["r2"], 1 - 2.25 / 6.75)

    rows = [("a", i, dt.datetime(2024, 1, 1 + k), 1.0, 5.0, 3, 0.1, 2.0, 1.0, 10.0 * i + k) for k in range(3) for i in (1, 2)]
    trends = spark.createDataFrame(rows, "movie_title string, movie_id int, window_start timestamp, popularity double, "
                                         "vote_average double, mentions_count long, avg_sentiment double, "
                                         "avg_reddit_score double, mentions_rate double, trend_score double")
    out = online_learning(trends).collect()
    assert sorted(r.actual_trend_score for r in out) == sorted(r[-1] for r in rows)
    assert all(r.features["popularity"] == 1.0 for r in out)


def test_cooldown_of_a_hot_key_equals_a_plain_loop(spark):
    import random
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(sorted(rng.randrange(200_000) for _ in range(3000)))]
    rng.shuffle(rows)
    want, last = [], None
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if last is None or r[2] - last >= dt.timedelta(seconds=600):
            want.append(r[1])
            last = r[2]
    df = spark.createDataFrame(rows, "key string, id int, ts timestamp")
    assert sorted(r.id for r in cooldown(df, "key", "ts", 600, tie="id").collect()) == sorted(want)


def test_minibatch_history_equals_single_steps(spark):
    from trendframe.operators.learn import minibatch_history

    rng = np.random.default_rng(11)
    data = [(int(t), float(rng.normal(5, 2)), None if k % 9 == 0 else float(rng.normal()), None if k % 7 == 0 else float(rng.normal(20, 4)))
            for k, t in enumerate(np.repeat(np.arange(6), 8))]
    df = spark.createDataFrame(data, "t int, a double, b double, y double")
    got = sorted((r.t, r.a, r.prediction) for r in minibatch_history(df, "t", ["a", "b"], "y").collect())
    want, state = [], None
    for t in range(6):
        out, state = minibatch_step(df.filter(F.col("t") == t), ["a", "b"], "y", state)
        want += [(r.t, r.a, r.prediction) for r in out.collect()]
    want = sorted(want)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)
