"""What the search, the merge and the lists move grows no faster than their tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendframe.functions.text import INDEX_BOILERPLATE, extract_mentions
from trendframe.operators import ivf, knn as K
from trendframe.operators.clean import index_filter
from trendframe.plans import indexing, retrieval
from trendframe.suite import q_retrieval


def slow(queries, rows, n):
    sims = np.round(queries @ rows.T, 12)
    return [[(int(j), s[j]) for j in np.lexsort((np.arange(len(s)), -s))[:n]] for s in sims]


@pytest.mark.parametrize("kind", ["spread", "close", "copies"])
def test_screened_scores_are_exact(kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(5000, 8))
    if kind == "close":  # nearer to one another than single precision tells
        rows = np.ones((5000, 8)) + 1e-8 * rows
    if kind == "copies":
        rows = rows[rng.integers(0, 5, 5000)]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    queries = rows[::900]
    i, j, sim = K.local_top(queries, rows, 7)
    for q, want in enumerate(slow(queries, rows, 7)):
        got = list(zip(j[i == q].tolist(), sim[i == q].tolist()))
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=2e-12)
        if kind != "close":
            assert [r for r, _ in got] == [r for r, _ in want]


def test_a_query_gives_n_rows_whatever_lies_under_its_plan(spark, monkeypatch):
    c = spark.range(3000).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    q = c.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    want = {(r.qid, r.id) for r in K.knn(q, c, 3, blocks=1, slices=1).collect()}
    monkeypatch.setattr(K, "file_bytes", lambda df: 2 << 30)  # texts that are read beside the vectors
    monkeypatch.setattr(K, "TILE_QUERIES", 100)
    met = []
    plain = K.top_per_key
    monkeypatch.setattr(K, "top_per_key", lambda df, *a, **k: (met.append(df.count()), plain(df, *a, **k))[1])
    assert {(r.qid, r.id) for r in K.knn(q, c, 3).collect()} == want
    assert met == [9000]


def test_a_title_is_searched_once(spark, monkeypatch):
    meta = spark.createDataFrame([("m1", [1.0, 0.0], "A", "G", "k"), ("m2", [0.0, 1.0], "B", "H", "l")],
                                 "meta_id string, embedding array<double>, cast string, genres string, keywords string")
    qs = spark.range(40).select(
        F.when(F.col("id") != 7, F.col("id")).alias("question_id"), F.lit("q").alias("question"),
        F.when(F.col("id") % 2 == 0, "dune").when(F.col("id") != 9, "heat").alias("title"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("tvec"))
    asked = []
    plain = retrieval.knn
    monkeypatch.setattr(retrieval, "knn", lambda q, *a, **k: (asked.append(q.count()), plain(q, *a, **k))[1])
    got = {r.question_id: r.meta_id for r in retrieval.expand_questions(qs, meta, ask="title").collect()}
    assert asked == [2] and len(got) == 40
    assert got == {k: (None if k in (None, 9) else "m1" if k % 2 == 0 else "m2") for k in got}


def test_matches_come_with_the_neighbours_and_texts_are_cut(spark):
    reviews = spark.createDataFrame([(str(k), [1.0, k / 50], ("x" * 600 if k % 2 else "") + " dune") for k in range(30)],
                                    "review_id string, embedding array<double>, text string") \
        .withColumn("timestamp", F.lit("no time"))
    qs = spark.createDataFrame([(1, "dune", [1.0, 0.0]), (2, None, [0.0, 1.0]), (3, "other", [1.0, 0.3])],
                               "question_id int, title string, qvec array<double>")
    plain = retrieval.nearest(qs, reviews, 20, now=F.lit("2024-01-31"))
    want = retrieval.select_relevant(plain, qs, shown=501)
    got = retrieval.select_relevant(retrieval.nearest(qs, reviews, 20, now=F.lit("2024-01-31"), titles=qs, shown=501))
    cols = ["question_id", "review_id", "rank", "strategy", "mention_count", "is_match", "text"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert got.agg(F.max(F.length("text"))).first()[0] == 501


def test_only_added_reviews_are_encoded(spark, monkeypatch):
    words = "a review that is long enough to be kept in the index of reviews"
    feed = spark.range(20).select((F.col("id") % 10).cast("string").alias("comment_id"), F.concat(F.lit(words + " "), F.col("id").cast("string")).alias("text"),
                                  F.lit("u").alias("author"), F.lit("reddit").alias("source"), F.lit("films").alias("subreddit"),
                                  F.col("id").alias("score"), F.col("id").alias("timestamp"))
    base = indexing.review_rows(feed.filter("id < 3")).withColumn("score", F.lit(-1.0))
    met = []
    plain = indexing.embed_hashed
    monkeypatch.setattr(indexing, "embed_hashed", lambda df, *a: (met.append(df.count()), plain(df, *a))[1])
    got = {r.review_id: r.score for r in indexing.index_reviews(feed, base, order="timestamp").collect()}
    assert got == {str(k): -1.0 if k < 3 else float(k) for k in range(10)}
    assert met == [7]


def test_assigned_vectors_come_in_bounded_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([[1.0, k / 100] for k in range(10_000)])], ["id", "v"])
    out = list(ivf.assigned([batch, batch.slice(0, 0)], np.eye(64)[:, :2] + 0.01, 40))
    assert sum(len(b) for b in out) == 400_000 and max(len(b) for b in out) <= ivf.ASSIGNED


@pytest.mark.parametrize("pairs", [0, 16_384])
@pytest.mark.parametrize("n", [1, 7, 400])
def test_copies_of_one_row_crowd_few_queries(monkeypatch, pairs, n):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(6000, 8))
    rows[rng.random(6000) < 0.4] = rows[17]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    queries = np.concatenate([rows[17:18], rows[rng.integers(0, 6000, 200)], [[np.nan] * 8]])
    monkeypatch.setattr(K, "PAIRS", pairs or 1)
    i, j, sim = K.local_top(queries, rows, n)
    for q, want in enumerate(slow(queries[:-1], rows, n)):
        assert j[i == q].tolist() == [r for r, _ in want]
        assert np.allclose(sim[i == q], [s for _, s in want], atol=2e-12)
    assert i.max() == 200


def test_the_running_best_are_not_sorted_each_time(monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60_000, 8))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    met, plain = [], K._best
    monkeypatch.setattr(K, "_best", lambda *a: (met.append(len(a[0])), plain(*a))[1])
    K.local_top(rows[:100], rows, 10)
    assert met == [1000]


def test_blocks_fill_all_slots_evenly(spark, monkeypatch):
    slots = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(K, "TILE_QUERIES", 100)
    count = lambda n: spark.range(1).select(K.block_count(spark.range(n))).first()[0]
    assert count(0) == 1 and count(150) == 2
    assert count(100 * (slots + 1)) == 2 * slots
    monkeypatch.setattr(K, "BLOCK_ROWS", 200)
    assert count(200 * (2 * slots + 1)) == 3 * slots


def reviews_of(spark):
    return spark.createDataFrame(
        [(str(k), [1.0, k / 50], f"A Dune {k}", "A Dune", "films", 0.5, 1.0) for k in range(30)],
        "review_id string, embedding array<double>, text string, movie_title_original string, subreddit string, sentiment double, score double") \
        .withColumn("timestamp", F.lit("no time"))


def test_debug_view_searches_once(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])], "question_id int, qvec array<double>")
    got = retrieval.retrieve_debug(qs, reviews_of(spark), 25, now=F.lit("2024-01-31"), show=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = sorted(got.collect(), key=lambda r: (str(r.question_id), r.rank))
    assert got.columns == ["question_id", "rank", "text", "distance", "movie_title", "subreddit", "sentiment", "score", "full_context_length"]
    assert [(r.question_id, r.rank) for r in rows] == [(q, k) for q in (1, 2, None) for k in (1, 2, 3, 4)]
    assert [r.text for r in rows[:4]] == ["A Dune 0", "A Dune 1", "A Dune 2", "A Dune 3"]
    head = [len(f"[Review {k}] (positive, score: 1.0, from r/films)\nA Dune {x}") for k, x in zip(range(1, 26), range(25))]
    assert {r.full_context_length for r in rows[:4]} == {sum(head) + 2 * 24}
    assert {r.full_context_length for r in rows[8:]} == {None}  # as a join by the question leaves it


def test_a_review_is_lower_cased_once(spark):
    qs = spark.createDataFrame([(1, "dune", [1.0, 0.0]), (2, "other", [0.0, 1.0])], "question_id int, title string, qvec array<double>")
    got = retrieval.nearest(qs, reviews_of(spark), 5, now=F.lit("2024-01-31"), titles=qs)
    assert "contains(lower(text" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r.question_id, r.is_match, r.text[:6]) for r in got.collect()} == {(1, True, "A Dune"), (2, False, "A Dune")}
    assert "__low" not in got.columns


def test_a_long_run_of_capitalised_words_is_one_mention(spark):
    words = "Ab  Čd\n" * 60_000
    df = spark.createDataFrame([(words + "end of it. Next One, x",)], "text string")
    got = df.select(extract_mentions("text").alias("m")).first().m
    assert got == [" ".join(words.split()), "Next One"]


@pytest.mark.parametrize("ties", [False, True])
def test_early_rows_are_screened_by_a_first_bound(monkeypatch, ties):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(6000, 16))
    if ties:
        rows[::7] = rows[3]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    queries = np.concatenate([rows[:200], [[np.nan] * 16]])
    met, plain = [], K.Top.take
    monkeypatch.setattr(K.Top, "take", lambda self, found, *a: (met.append(sum(len(i) for i, _ in found)), plain(self, found, *a))[1])
    i, j, sim = K.local_top(queries, rows, 10)
    for q, want in enumerate(slow(queries[:-1], rows, 10)):
        assert j[i == q].tolist() == [r for r, _ in want]
        assert np.allclose(sim[i == q], [s for _, s in want], atol=2e-12)
    assert i.max() == 199
    assert ties or sum(met) < 200 * 20  # 10 a query are kept


def test_a_reader_of_ids_moves_no_text(spark):
    feed = spark.range(20).select(F.when(F.col("id") > 3, F.col("id").cast("string")).alias("comment_id"), F.lit("u").alias("author"),
                                  F.concat(F.lit("a review that is long enough to be kept in the index of reviews "), F.col("id").cast("string")).alias("text"),
                                  F.lit("reddit").alias("source"), F.lit("films").alias("subreddit"), F.col("id").alias("score"), F.col("id").alias("timestamp"))
    ids = indexing.review_rows(feed, embed=False).select("review_id")
    node = ids._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Repartition":
        node = node.children().head()
    assert "text" not in node.output().mkString(",")
    got = sorted(r.review_id for r in ids.collect())
    assert [x for x in got if len(x) < 3] == sorted(str(k) for k in range(4, 20)) and len(got) == 20


def test_only_texts_in_time_are_scored(spark):
    scored = spark.sparkContext.accumulator(0)
    score = F.udf(lambda t: scored.add(1) or 0.5, "double")
    times = ["2024-01-30T00:00:00", "2023-01-01T00:00:00", "no time"]
    rows = spark.createDataFrame([(str(k), [1.0, k / 50], f"text {k}", times[k % 3]) for k in range(30)],
                                 "review_id string, embedding array<double>, text string, timestamp string").withColumn("sentiment", score("text"))
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "question_id int, qvec array<double>")
    got = retrieval.nearest(qs, rows, 30, now=F.lit("2024-01-31"), shown=501).collect()
    assert sorted(int(r.review_id) for r in got if r.question_id == 1) == [k for k in range(30) if k % 3 != 1]
    assert {r.sentiment for r in got} == {0.5}
    assert scored.value == 20


def test_a_text_is_filtered_by_one_lower_casing(spark):
    df = spark.createDataFrame([("x" * 60, "u"), ("I AM A BOT " + "x" * 60, "u"), ("y" * 60, "AutoModerator"), (None, "u"), ("z" * 60, None),
                                ("Please make sure there are no SPOILERS " + "x" * 60, "u")], "text string, author string")
    got = index_filter(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(coalesce(text") == 1
    assert not any(p in r.text.lower() for r in got.collect() for p in INDEX_BOILERPLATE)
    assert {r.text[0] for r in got.collect()} >= {"x", "z"} and "y" not in {r.text[0] for r in got.collect()}
    assert index_filter(df, phrases=()).count() == 4


def asked_of(spark, n=40):
    """Questions of three vectors; ids that come twice or are null, vectors that are null or zero."""
    ids, vecs = [*range(n - 6), 1, 2, None, None, n, n + 1], [[1.0, 0.1], [0.1, 1.0], [1.0, 1.0]]
    return spark.createDataFrame([(x, "dune" if k % 2 else None, None if x == n else [0.0, 0.0] if x == n + 1 else vecs[k % 3]) for k, x in enumerate(ids)],
                                 "question_id int, title string, qvec array<double>")


@pytest.mark.parametrize("part", [4, 10_000])
def test_equal_vectors_are_searched_once(spark, monkeypatch, part):
    c = spark.range(300).select((F.col("id") % 200).alias("id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    want = K.knn(asked_of(spark), c, 5, q_id="question_id").collect()
    monkeypatch.setattr(K, "SHARED", part)
    met, plain = [], K.knn
    monkeypatch.setattr(K, "knn", lambda q, *a, **k: (met.append(q.count()), plain(q, *a, **k))[1])
    got = plain(asked_of(spark), c, 5, q_id="question_id", once=True)
    assert got.columns == ["question_id", "id", "similarity", "rank"] and sorted(map(str, got.collect())) == sorted(map(str, want))
    assert met == [4]  # three and the zero vector
    assert max(r[0] for r in K.different(asked_of(spark), "qvec").select("__parts").collect()) == (4 if part == 4 else 1)
    with pytest.raises(ValueError):
        plain(asked_of(spark), c, 5, q_id="question_id", once=True, exclude_self=True)


@pytest.mark.parametrize("order", ["after", "before"])
def test_rows_of_a_shared_search_are_those_of_each_question(spark, order):
    times = ["2024-01-30T00:00:00", "2023-01-01T00:00:00", "no time"]
    reviews = spark.createDataFrame([(str(k % 24) if k != 9 else None, [1.0, k % 24 / 50], f"A Dune {k % 24}", times[k // 24 + k % 2]) for k in range(30)],
                                    "review_id string, embedding array<double>, text string, timestamp string")
    qs = asked_of(spark)
    want, got = (retrieval.nearest(qs, reviews, 8, now=F.lit("2024-01-31"), titles=qs, shown=501, filter_order=order, once=once) for once in (False, True))
    assert sorted(got.columns) == sorted(want.columns)
    cols = ["question_id", "review_id", "rank", "similarity", "title", "is_match", "text"]
    rows = sorted(map(str, got.select(cols).drop("rank").collect()))
    assert rows == sorted(map(str, want.select(cols).drop("rank").collect())) and len(rows) > 100
    twice = F.col("question_id").isNull() | F.col("question_id").isin(1, 2)  # their equal ranks may change places
    assert sorted(map(str, got.filter(~twice).select("question_id", "rank").collect())) == sorted(map(str, want.filter(~twice).select("question_id", "rank").collect()))


def test_expanded_questions_are_searched_once(spark, monkeypatch):
    meta = spark.createDataFrame([("m1", [1.0, 0.0], "A,B", "G", "k"), ("m2", [0.0, 1.0], "C", "H", "l")],
                                 "meta_id string, embedding array<double>, cast string, genres string, keywords string")
    reviews = reviews_of(spark).withColumn("source", F.lit("reddit"))
    qs = spark.range(40).select(F.col("id").alias("question_id"), F.concat(F.lit("tell me about dune"), F.col("id").cast("string")).alias("question"),
                                F.array(F.lit(1.0), F.lit(0.0)).alias("qvec"))

    def encode(df, text, out):  # by length, as the registered query does
        return df.withColumn(out, F.array(F.pmod(F.length(text), F.lit(2)).cast("double"), F.lit(0.5)))

    met, plain = [], K.knn
    monkeypatch.setattr(K, "knn", lambda q, *a, **k: (met.append(q.count()), plain(q, *a, **k))[1])
    summary, _ = retrieval.retrieve(qs, reviews, 20, now=F.lit("2024-01-31"), metadata=meta, encode=encode)
    assert met == [2, 2]  # of 40 titles, of 40 expanded questions
    assert summary._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # metadata are not searched for again
    got = {r.question_id: r for r in summary.collect()}
    assert len(got) == 40 and {r.retrieved for r in got.values()} == {20} and {r.strategy for r in got.values()} == {"semantic"}
    for k, r in got.items():  # "dune7" and "dune17" have 5 and 6 characters
        m, tail = ("m1", "A B G k") if len(r.title) % 2 else ("m2", "C H l")
        assert (r.title, r.meta_id, r.expanded) == (f"dune{k}", m, f"tell me about dune{k} {tail}")


def test_questions_are_dealt_out_before_their_titles_are_extracted(spark, tmpdir_path):
    spark.range(30).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.when(F.col("id") % 3 > 0, "user").alias("role"),
                           F.lit("Tell me about Dune").alias("text")).coalesce(1).write.parquet(f"{tmpdir_path}/conversations.parquet")
    spark.range(7).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")).write.parquet(f"{tmpdir_path}/embeddings.parquet")
    qs = q_retrieval.questions(spark, tmpdir_path)
    assert "Repartition" in qs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.question_id for r in qs.collect()) == [k * 1000 + 1 for k in range(30) if k % 3] + [q_retrieval.MORE, q_retrieval.MORE + 1]


def test_a_long_text_is_stripped_by_its_beginning_only(spark):
    texts = ["x" * 50, "x" * 49, " " * 300 + "x" * 50, " " * 300 + "x" * 49 + "\n" * 300, "x" + " " * 300 + "y", "　x" * 30, "x" * 5000, " " * 300, "", None]
    df = spark.createDataFrame([(k, t, "u") for k, t in enumerate(texts)], "k int, text string, author string")
    assert sorted(r.k for r in index_filter(df).collect()) == [k for k, t in enumerate(texts) if len((t or "").strip()) >= 50]
