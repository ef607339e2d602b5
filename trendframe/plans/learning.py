"""Online learning on the trend rows.

Features per title in time order (F26 hour / weekday, W9 deltas, W10
trailing means - or, in the rating-aware variant, F27 + W11 momentum), a
prequential model per title (T6), running metrics (A9) and prediction rows
with a feature map (S12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import time_parts, trend_features
from ..operators.learn import prequential_per_key
from ..operators.windows import delta_features, momentum, trailing_mean

TREND_FEATURES = ("popularity", "mentions_count", "mentions_rate", "avg_sentiment", "vote_average",
                  "avg_reddit_score", "hour", "day_of_week", "delta_mentions", "delta_sentiment",
                  "delta_popularity", "ma_mentions", "ma_sentiment")


def online_features(trends: DataFrame, key: str = "movie_title", ts: str = "window_start",
                    ident: str = "movie_id") -> DataFrame:
    """F26 + W9 + W10: the trend learner's features (history excludes the current row).

    Rows of one title and window are ordered by ``ident``.
    """
    h, dow = time_parts(ts)
    t = trends.withColumn("hour", h).withColumn("day_of_week", dow)
    t = delta_features(t, key, [ts, ident], ["mentions_count", "avg_sentiment", "popularity"])
    t = trailing_mean(t, key, [ts, ident], ["mentions_count", "avg_sentiment"], n=5)
    return (t.withColumnRenamed("delta_mentions_count", "delta_mentions")
             .withColumnRenamed("delta_avg_sentiment", "delta_sentiment")
             .withColumnRenamed("ma_mentions_count", "ma_mentions")
             .withColumnRenamed("ma_avg_sentiment", "ma_sentiment")
             .withColumn("delta_mentions", F.col("delta_mentions").cast("double")))


def rating_features(trends: DataFrame, key: str = "movie_title", ts: str = "window_start",
                    current_year: int = 2025) -> DataFrame:
    """F27 + W11: the rating-aware learner's features on an enriched trend table
    (``imdb_rating, imdb_votes, imdb_year, vote_count`` columns)."""
    t = momentum(trends, key, [ts], "trend_score")
    feats = trend_features("imdb_rating", "imdb_votes", "imdb_year", "popularity", "vote_average",
                           "vote_count", "mentions_count", "avg_sentiment", "trend_momentum", current_year)
    return t.select(key, ts, "trend_score", *[c.alias(n) for n, c in feats.items()])


def online_learning(trends: DataFrame, key: str = "movie_title", ts: str = "window_start",
                    ident: str = "movie_id", model_version: str = "v1") -> DataFrame:
    """Prequential predictions per title with running metrics and a feature map.

    One row per trend row: a title with two ids in a window has two, in the
    order of ``ident``. The features go through the scan with their row.
    """
    f = online_features(trends, key, ts, ident)
    preds = prequential_per_key(f, key, [ts, ident], TREND_FEATURES, "trend_score", carry=TREND_FEATURES)
    fmap = F.create_map(*[x for c in TREND_FEATURES for x in (F.lit(c), F.col(c).cast("double"))])
    return preds.select(
        key, ident, F.col(ts).alias("timestamp"), F.col("actual").alias("actual_trend_score"),
        F.col("prediction").alias("predicted_trend_score"), F.col("error").alias("prediction_error"),
        F.lit(model_version).alias("model_version"), fmap.alias("features"), "mae", "rmse", "r2")
