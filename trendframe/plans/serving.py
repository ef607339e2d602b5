"""C2 trending-now ranking and C9 predictions view.

C2 joins the newest catalogue record of each title with per-title discussion
statistics (mention count, mean sentiment, three best distinct comments),
scores it and ranks it. Plan: the catalogue side is a per-title first-row
(partial group limit), the discussion side a semi join on catalogue titles,
one algebraic aggregate and a capped top-3 per title; the final join is on
the lower-cased title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import rescale, trend_score_serving, trend_score_variant
from ..functions.sentiment import LEXICON, sentiment
from ..operators.aggregate import discussion_stats
from ..operators.joins import enrich_left, known_only
from ..operators.partitioning import spread
from ..operators.rank import first_per_key, rank_top, top_comments


def trending_now(catalogue: DataFrame, discussion: DataFrame, n: int = 20,
                 lexicon=LEXICON) -> DataFrame:
    """Current titles ranked by the serving trend score.

    ``catalogue``: ``event_id, title, popularity, vote_average,
    release_date``; ``discussion``: ``event_id, movie_title, text, author,
    score``. The whole feeds are used.
    """
    first = first_per_key(catalogue, "title", "event_id")
    disc = discussion.filter(F.col("movie_title").isNotNull() & (F.col("movie_title") != "")
                       & F.col("text").isNotNull() & (F.col("text") != ""))
    disc = known_only(disc, first, "movie_title", "title")
    # text work runs in every task slot, also where few files or a small join side give few tasks
    disc = spread(disc.select(F.lower("movie_title").alias("title_key"), "event_id", "score", "text")).select(
        "title_key", "event_id", "score", F.substring("text", 1, 200).alias("text"),
        rescale(sentiment("text", lexicon)).alias("sentiment01"))
    stats = discussion_stats(disc)
    comments = top_comments(disc, "title_key", "text", "score", "event_id", k=3)
    top3 = comments.groupBy("title_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("__c"))
    top3 = top3.select("title_key", F.transform("__c", lambda c: c["text"]).alias("top_comments"))
    j = enrich_left(first, stats, "title", "title_key", {"mentions": 0, "sentiment": 0.5})
    j = enrich_left(j, top3, "title", "title_key")
    j = j.withColumn("top_comments", F.coalesce("top_comments", F.array().cast("array<string>")))
    scored = j.select(
        "title", "release_date", F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
        F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"),
        F.col("mentions").cast("bigint").alias("mentions"), F.col("sentiment").cast("double").alias("sentiment"),
        "top_comments",
        trend_score_serving(F.coalesce("popularity", F.lit(0.0)), "mentions", "sentiment").alias("trendScore"))
    scored = scored.withColumn("prediction", trend_score_variant("trendScore", "prediction"))
    return rank_top(scored, "trendScore", n, tie="title")


def predictions_view(trending: DataFrame, n: int = 10) -> DataFrame:
    """Actual versus predicted score of the top ``n`` trending titles."""
    return rank_top(trending, "trendScore", n, tie="title").select(
        F.col("title").alias("movie_title"), F.col("trendScore").alias("actual_trend_score"),
        F.col("prediction").alias("predicted_trend_score"))
