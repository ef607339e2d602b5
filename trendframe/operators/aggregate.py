"""Grouped and global aggregations.

All aggregates are algebraic (count, sum, avg, min/max, max_by), so Spark
combines them map-side before the shuffle: a key with a third of all rows
reaches its reducer as one partial row per map task. The only collecting
aggregates (A8 credits, A14 context) are applied after a per-key row cap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import accuracy, label, rescale
from ..functions.text import ellipsis


def discussion_stats(df: DataFrame, key: str = "title_key", sentiment: str = "sentiment01",
                     digits: int = 2) -> DataFrame:
    """A3: per title - mention count and mean 0..1 sentiment rounded."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"),
                               F.round(F.avg(sentiment), digits).alias("sentiment"))


def most_discussed(df: DataFrame, title: str = "movie_title", ts: str = "event_time",
                   order: str = "review_id", mentions: str | None = "mentions",
                   sentiment: str = "sentiment") -> DataFrame:
    """A4: per lower+trim title: discussions, summed mentions, mean sentiment
    (0.5 when missing), newest time, last seen original title, score = count*10."""
    k = F.lower(F.trim(F.col(title)))
    src = df.withColumn("__k", k)
    m = F.coalesce(F.col(mentions), F.lit(0)) if mentions else F.lit(0)
    agg = src.groupBy("__k").agg(
        F.max_by(F.col(title), F.struct(F.col(ts), F.col(order))).alias("title"),
        F.count(F.lit(1)).alias("discussions"),
        F.sum(m).cast("bigint").alias("mentions"),
        F.round(F.avg(F.coalesce(F.col(sentiment), F.lit(0.5))), 2).alias("sentiment"),
        F.max(ts).alias("latest_timestamp"), F.max("__k").alias("__name"))
    # on an aggregate: pushed below, the filter would work the titles out once more for each of its tests
    agg = agg.filter(F.col("__name").isNotNull() & (F.col("__name") != "") & (F.col("__name") != "unknown"))
    return agg.withColumn("trend_score", F.col("discussions") * 10).drop("__k", "__name")


def most_discussed_served(df: DataFrame, now, hours: float = 24, n: int = 10, metadata: DataFrame | None = None,
                          title: str = "movie_title", ts: str = "event_time", **kw) -> DataFrame:
    """A4 as it is served: the last ``hours`` only, most discussions first
    (then title), ``n`` titles, with the release date, votes and overview of
    the title's metadata (J9) or their defaults."""
    from .clean import recent
    from .joins import attach_metadata

    top = (most_discussed(recent(df, ts, hours, now), title=title, ts=ts, **kw)
           .orderBy(F.col("discussions").desc(), "title").limit(n))
    return top if metadata is None else attach_metadata(top, metadata, "title")


def trend_totals(df: DataFrame, key: str = "movie_title", sentiment: str = "avg_sentiment") -> DataFrame:
    """A5: row count (named 'movies tracked' upstream), distinct titles, mean sentiment."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_distinct(key).alias("distinct_titles"),
                  F.coalesce(F.avg(sentiment), F.lit(0.0)).alias("average_sentiment"))


def dashboard_summary(df: DataFrame, score: str = "trendScore", pred: str = "prediction",
                      mentions: str = "mentions", sentiment01: str = "sentiment") -> DataFrame:
    """Count, mean score, mean clamped accuracy (score > 0), titles with
    mentions, mean sentiment mapped from 0..1 to -1..1 (all rounded to 2)."""
    acc = accuracy(pred, score)
    return df.agg(
        F.count(F.lit(1)).alias("total_movies"),
        F.round(F.avg(score), 2).alias("avg_trend_score"),
        F.round(F.coalesce(F.avg(acc), F.lit(0.0)), 2).alias("model_accuracy"),
        F.count_if(F.col(mentions) > 0).alias("movies_with_reddit"),
        F.round(rescale(F.avg(F.coalesce(F.col(sentiment01), F.lit(0.5))), (0.0, 1.0), (-1.0, 1.0)), 2)
        .alias("average_sentiment"))


def distinct_titles(df: DataFrame, col: str = "movie_title_original") -> DataFrame:
    """Sorted distinct titles."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def credits_pivot(df: DataFrame, key: str = "tconst", name: str = "primaryName",
                  category: str = "category", order: str = "ordering") -> DataFrame:
    """Actors (actor or actress), directors and writers per title, in billing order.

    Apply after a per-title cap (J6): the lists are bounded by that cap.
    """
    def role(*cats):
        return F.sort_array(F.collect_list(F.when(F.col(category).isin(*cats),
                                                  F.struct(F.col(order), F.col(name)))))

    agg = df.groupBy(key).agg(role("actor", "actress").alias("__a"), role("director").alias("__d"),
                              role("writer").alias("__w"))
    return agg.select(key, *[F.transform(c, lambda s: s[name]).alias(o)
                             for c, o in (("__a", "actors"), ("__d", "directors"), ("__w", "writers"))])


def regression_metrics(df: DataFrame, y: str, yhat: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 (batch form; grouped by ``keys`` if given).

    R2 compares mean squares, so large targets lose no digits; it is NULL
    where the target does not vary.
    """
    err = F.col(y) - F.col(yhat)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            (F.lit(1.0) - F.try_divide(F.avg(err * err), F.var_pop(y))).alias("r2")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def chart_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A10: mean accuracy floored at 0 (not capped), mean absolute error, count."""
    a, p = F.col(actual), F.col(predicted)
    acc = F.lit(100.0) - F.abs(F.try_divide(p - a, a) * 100)
    return df.agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), acc)), F.lit(0.0)).alias("avg_accuracy"),
                  F.coalesce(F.avg(F.abs(p - a)), F.lit(0.0)).alias("avg_error"),
                  F.count(F.lit(1)).alias("n"))


def source_volume(df: DataFrame, source: str, ts: str, expected: Sequence[str] = ()) -> DataFrame:
    """Messages and newest message per source, with an active/idle flag, and their total.

    ``expected`` names sources that are listed even when nothing came from
    them; these are idle. The total has source NULL.
    """
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("messages"), F.max(ts).alias("last_message"))
    quiet = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in expected]).cast("array<string>")).alias(source))
    both = counts.unionByName(quiet.join(counts, source, "left_anti").withColumn("messages", F.lit(0).cast("bigint")),
                              allowMissingColumns=True)
    total = both.agg(F.lit(None).cast("string").alias(source), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
                     F.max("last_message").alias("last_message"))
    return both.unionByName(total).withColumn(
        "status", F.when(F.col("messages") > 0, "active").otherwise("idle"))


def discovery_counts(df: DataFrame, source: str = "discovery_source") -> DataFrame:
    """Rows per discovery source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def assemble_context(df: DataFrame, keys: Sequence[str], rank: str, text: str = "text",
                     sentiment: str = "sentiment", score: str = "score",
                     subreddit: str = "subreddit", n: int = 50, cut: int = 500,
                     extra: Sequence[Column] = ()) -> DataFrame:
    """Numbered, labelled, cut texts joined by blank lines, per key.

    Only the first ``n`` rows per key (by ``rank``, 1-based and dense) enter
    the context; ``extra`` aggregates are computed in the same pass over
    all rows of the key. Input rows per key must be bounded (they are the
    top-n neighbours of one question).
    """
    lab = label(F.coalesce(F.col(sentiment), F.lit(0.0)), -0.1, 0.1)
    piece = F.format_string("[Review %d] (%s, score: %s, from r/%s)\n%s", F.col(rank), lab,
                            F.coalesce(F.col(score).cast("string"), F.lit("0")),
                            F.coalesce(F.col(subreddit), F.lit("")), ellipsis(text, cut))
    agg = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col(rank) <= n, F.struct(F.col(rank), piece.alias("p")))))
        .alias("__l"), *extra)
    extra_names = [c for c in agg.columns if c not in (*keys, "__l")]
    return agg.select(*keys, F.array_join(F.transform("__l", lambda s: s["p"]), "\n\n").alias("context"),
                      F.size("__l").alias("n_reviews"), *extra_names)
