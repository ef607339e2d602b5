"""Event-time windows and per-key history features.

``windowed`` is the same call for batch and streaming input: on a streaming
DataFrame the watermark bounds the state and lets closed windows be emitted
once; on a batch DataFrame the watermark is a no-op.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def watermarked(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Declare the allowed lateness of event time ``ts`` (streams only)."""
    return df.withWatermark(ts, delay) if df.isStreaming else df


def windowed(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str],
             aggs: Sequence[Column], delay: str | None = "10 minutes",
             keep_window: bool = False) -> DataFrame:
    """Sliding-window aggregate per key.

    Each row falls in ``size/slide`` windows; Spark expands the rows and
    aggregates them with a partial (map-side) aggregate before the shuffle
    on ``(window, keys)``, so a hot key costs one partial row per task.
    With ``keep_window`` the ``window`` struct is kept (stream-stream joins
    must join on it so that the join state carries the watermark).
    """
    src = watermarked(df, ts, delay) if delay else df
    out = src.groupBy(F.window(F.col(ts), size, slide).alias("window"), *keys).agg(*aggs)
    flat = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    rest = [c for c in out.columns if c != "window"]
    return out.select(*(["window"] if keep_window else []), *flat, *rest)


def discussion_window(df: DataFrame, size: str = "5 minutes", slide: str = "1 minute",
                      ts: str = "event_time", title: str = "movie_title",
                      delay: str | None = "10 minutes", keep_window: bool = False) -> DataFrame:
    """A1: per window and mentioned title - count, mean sentiment, mean score."""
    return windowed(df, ts, size, slide, [title],
                    [F.count(F.lit(1)).alias("mentions_count"),
                     F.avg("sentiment_score").alias("avg_sentiment"),
                     F.avg("reddit_score").alias("avg_reddit_score")],
                    delay=delay, keep_window=keep_window)


def catalogue_window(df: DataFrame, size: str = "5 minutes", slide: str = "1 minute",
                     ts: str = "event_time", delay: str | None = "10 minutes",
                     keep_window: bool = False) -> DataFrame:
    """A2: per window, title and id - mean popularity, vote, vote count."""
    out = windowed(df, ts, size, slide, ["title", "movie_id"],
                   [F.avg("popularity").alias("avg_popularity"),
                    F.avg("vote_average").alias("avg_vote"),
                    F.avg("vote_count").alias("avg_vote_count")],
                   delay=delay, keep_window=keep_window)
    return out.withColumnRenamed("title", "movie_title")


# ---------------------------------------------------------------- W9 - W11
# The inputs here are windowed trend rows: one row per (title, window), so a
# title's history grows with time, not with the raw feed volume.

def _w(key: str, order: Sequence[str]):
    return Window.partitionBy(key).orderBy(*order)


def delta_features(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str],
                   prefix: str = "delta_", min_prior: int = 2) -> DataFrame:
    """Current minus previous value; 0 unless at least ``min_prior`` prior rows."""
    w = _w(key, order)
    prior = F.row_number().over(w) - 1
    out = df
    for c in cols:
        out = out.withColumn(prefix + c, F.when(prior >= min_prior,
                                                F.col(c) - F.lag(c, 1).over(w)).otherwise(F.lit(0.0)))
    return out


def trailing_mean(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str],
                  n: int = 5, prefix: str = "ma_") -> DataFrame:
    """Mean of up to ``n`` prior rows (current row excluded); current value if none."""
    w = _w(key, order).rowsBetween(-n, -1)
    out = df
    for c in cols:
        out = out.withColumn(prefix + c, F.coalesce(F.avg(c).over(w), F.col(c).cast("double")))
    return out


def momentum(df: DataFrame, key: str, order: Sequence[str], y: str,
             out: str = "trend_momentum") -> DataFrame:
    """Last minus second-last prior target; 0 with fewer than two priors."""
    w = _w(key, order)
    return df.withColumn(out, F.coalesce(F.lag(y, 1).over(w) - F.lag(y, 2).over(w), F.lit(0.0)))
