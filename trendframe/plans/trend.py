"""The trend job - two feeds to scored trend rows (batch or streaming).

catalogue feed  -> sliding window per (title, id): mean popularity / vote
discussion feed -> one row per mention -> sliding window per title:
                   count, mean sentiment, mean score
join on (window, title) -> defaults for missing discussion -> trend score

Plan shape: each side is one partial aggregate + one shuffle on its group
keys; the two aggregated sides (one row per window and title, far smaller
than the feeds) are joined on (window, title). Adaptive execution turns
that join into a broadcast join when it measures a side small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import trend_score
from ..operators.clean import explode_mentions
from ..operators.windows import catalogue_window, discussion_window


def trend_join(cat: DataFrame, disc: DataFrame, how: str = "inner") -> DataFrame:
    """Join the two windowed aggregates on the window and the title.

    Joins on the ``window`` struct when both sides keep it (required for a
    bounded stream-stream join state), else on ``window_start``.
    """
    on_struct = "window" in cat.columns and "window" in disc.columns
    keys = ["window", "movie_title"] if on_struct else ["window_start", "movie_title"]
    if not on_struct:
        d = disc.withColumnRenamed("window_end", "__we")
        return (cat.join(d, keys, how)
                .withColumn("window_end", F.coalesce(F.col("window_end"), F.col("__we")))
                .drop("__we"))
    j = cat.join(disc.drop("window_start", "window_end"), keys, how)
    if on_struct:
        j = j.withColumn("window_start", F.col("window.start")) \
             .withColumn("window_end", F.col("window.end"))
    return j


def fill_defaults(df: DataFrame) -> DataFrame:
    """discussion misses become 0 / 0.0; mentions as a float rate."""
    return (df.withColumn("mentions_count", F.coalesce(F.col("mentions_count"), F.lit(0)).cast("bigint"))
            .withColumn("avg_sentiment", F.coalesce(F.col("avg_sentiment"), F.lit(0.0)))
            .withColumn("avg_reddit_score", F.coalesce(F.col("avg_reddit_score"), F.lit(0.0)))
            .withColumn("mentions_rate", F.col("mentions_count").cast("double")))


def trend_scores(catalogue: DataFrame, discussion: DataFrame, *, size: str = "5 minutes",
                 slide: str = "1 minute", delay: str = "10 minutes", how: str = "inner",
                 weights=(0.4, 0.3, 0.3), now=None) -> DataFrame:
    """Scored trend rows keyed by (movie_title, window_start).

    ``catalogue`` needs ``event_time, title, movie_id, popularity,
    vote_average, vote_count``; ``discussion`` needs ``event_time,
    movie_mentions, sentiment_score, score``. ``now`` fixes
    ``processed_time`` (default: the current time).
    """
    streaming = catalogue.isStreaming or discussion.isStreaming
    mentions = explode_mentions(discussion.withColumnRenamed("score", "reddit_score"),
                                "movie_mentions", "movie_title",
                                keep=["sentiment_score", "event_time", "reddit_score"])
    disc = discussion_window(mentions, size, slide, delay=delay, keep_window=streaming)
    cat = catalogue_window(catalogue, size, slide, delay=delay, keep_window=streaming)
    j = fill_defaults(trend_join(cat, disc, how))
    w1, w2, w3 = weights
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return j.select(
        "window_start", "window_end", "movie_title", "movie_id",
        F.col("avg_popularity").alias("popularity"), F.col("avg_vote").alias("vote_average"),
        "mentions_count", "avg_sentiment", "avg_reddit_score", "mentions_rate",
        trend_score("avg_popularity", "mentions_rate", "avg_sentiment", w1, w2, w3).alias("trend_score"),
        stamp.alias("processed_time"),
    )


def trend_scores_one_pass(catalogue: DataFrame, discussion: DataFrame, *, size: str = "5 minutes",
                          slide: str = "1 minute", delay: str = "10 minutes",
                          inner: bool = True, weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """C1 variant: tag and union the feeds, one windowed aggregate per title.

    One stateful operator instead of three. Equal to :func:`trend_scores`
    when each title has one id (the catalogue groups by title and id).
    Each side gets its own watermark before the union, so the slower feed
    governs the emitted windows.
    """
    from ..operators.windows import watermarked

    c = watermarked(catalogue, "event_time", delay).select(
        "event_time", F.col("title").alias("movie_title"), "movie_id", "popularity",
        "vote_average", "vote_count", F.lit(None).cast("double").alias("sentiment_score"),
        F.lit(None).cast("double").alias("reddit_score"), F.lit(0).alias("is_mention"))
    d = explode_mentions(discussion.withColumnRenamed("score", "reddit_score"), "movie_mentions",
                         "movie_title", keep=["sentiment_score", "event_time", "reddit_score"])
    d = watermarked(d, "event_time", delay).select(
        "event_time", "movie_title", F.lit(None).cast("int").alias("movie_id"),
        F.lit(None).cast("double").alias("popularity"), F.lit(None).cast("double").alias("vote_average"),
        F.lit(None).cast("int").alias("vote_count"), "sentiment_score", "reddit_score",
        F.lit(1).alias("is_mention"))
    u = c.unionByName(d)
    agg = u.groupBy(F.window("event_time", size, slide).alias("window"), "movie_title").agg(
        F.max("movie_id").alias("movie_id"),
        F.avg("popularity").alias("popularity"), F.avg("vote_average").alias("vote_average"),
        F.sum("is_mention").cast("bigint").alias("mentions_count"),
        F.avg("sentiment_score").alias("avg_sentiment"), F.avg("reddit_score").alias("avg_reddit_score"),
        F.count("popularity").alias("__n_cat"))
    if inner:
        agg = agg.filter((F.col("__n_cat") > 0) & (F.col("mentions_count") > 0))
    agg = fill_defaults(agg.withColumn("window_start", F.col("window.start"))
                        .withColumn("window_end", F.col("window.end")))
    w1, w2, w3 = weights
    return agg.select("window_start", "window_end", "movie_title", "movie_id", "popularity",
                      "vote_average", "mentions_count", "avg_sentiment", "avg_reddit_score",
                      "mentions_rate",
                      trend_score("popularity", "mentions_rate", "avg_sentiment", w1, w2, w3)
                      .alias("trend_score"))
