"""Scalable and plug-in paths: lexicon join, Arrow analyzers/encoders, query expansion."""

import math

from pyspark.sql import functions as F

from trendframe.functions.sentiment import LEXICON, sentiment, sentiment_join, sentiment_udf
from trendframe.functions.vectors import cosine, embed_hashed, embed_pandas
from trendframe.plans.retrieval import expand_questions

SF = "/root/testdata/sf0.001"


def test_sentiment_join_equals_map_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lex = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    a = {r.doc_id: r.s for r in docs.select("doc_id", sentiment("text").alias("s")).collect()}
    b = {r.doc_id: r.sentiment for r in sentiment_join(docs, "doc_id", "text", lex).collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_sentiment_udf_plugin(spark):
    df = spark.createDataFrame([("good good",), ("",), (None,)], "t string")
    udf = sentiment_udf(lambda: (lambda t: float(len(t.split()))))
    assert [r.s for r in df.select(udf("t").alias("s")).collect()] == [2.0, 0.0, 0.0]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "dune part two"), (2, "dune part two"), (3, "")], "id int, text string")
    e = embed_hashed(df, "text", dim=64).orderBy("id").collect()
    assert len(e[0].embedding) == 64
    assert e[0].embedding == e[1].embedding
    assert math.isclose(sum(x * x for x in e[0].embedding), 1.0, rel_tol=1e-5)
    enc = embed_pandas(lambda: (lambda texts: [[float(len(t)), 1.0] for t in texts]), dim=2)
    got = [r.v for r in df.orderBy("id").select(enc("text").alias("v")).collect()]
    assert got == [[13.0, 1.0], [13.0, 1.0], [0.0, 1.0]]
    sim = df.select(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first().c
    assert math.isclose(sim, 1 / math.sqrt(2))


def test_expand_questions(spark):
    meta = spark.createDataFrame(
        [("tmdb_1", [1.0, 0.0], "A,B,C,D", "Drama,Action", "k1,k2,k3,k4"),
         ("tmdb_2", [0.0, 1.0], None, "Comedy", None)],
        "meta_id string, embedding array<double>, cast string, genres string, keywords string")
    qs = spark.createDataFrame([(1, "dune reviews", [0.9, 0.1]), (2, "fun", [0.1, 0.9]), (3, "none", None)],
                               "question_id int, question string, tvec array<double>")
    got = {r.question_id: r.expanded for r in expand_questions(qs, meta).collect()}
    assert got == {1: "dune reviews A B C Drama Action k1 k2 k3", 2: "fun Comedy", 3: "none"}
