"""Ranking, top-k, latest-per-key and dedupe operators.

Every "first / top n per key" here is ``row_number() <= n`` over a window.
Spark plans that with a partial group limit before the shuffle
(``WindowGroupLimit``), so a key holding a third of all rows costs each map
task only ``n`` rows for it - no group is ever gathered whole.
Arrival order is always an explicit column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import label
from ..functions.text import ellipsis


def _orders(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key by ``order`` (ties broken by the order list)."""
    w = Window.partitionBy(*keys).orderBy(*_orders(order))
    out = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank_col) if rank_col else out.drop("__rn")


def latest_per_key(df: DataFrame, key: str, ts: str, order: str = "trend_score",
                   limit: int | None = 10, tie: str | None = None) -> DataFrame:
    """Newest row per key, then the best ``limit`` rows by ``order``."""
    latest = top_per_key(df, [key], [F.col(ts).desc()], 1)
    ranked = latest.orderBy(F.col(order).desc(), F.col(tie or key))
    return ranked.limit(limit) if limit else ranked


def with_change(latest: DataFrame, hist: DataFrame, key: str, ts: str, value: str,
                lookback_s: int = 86400, out: str = "change_24h") -> DataFrame:
    """``value`` minus the value of the key's newest row at least ``lookback_s`` older.

    ``latest`` has one row per key. Only those keys' history is read, and the
    older row is an arg-max (combined map-side), not a window over the whole
    history. NULL when there is no such older row.
    """
    until = latest.select(F.col(key).alias("__k"), (F.col(ts) - F.make_dt_interval(secs=F.lit(lookback_s))).alias("__until"))
    older = (hist.filter(F.col(value).isNotNull())
             .join(until, (F.col(key) == F.col("__k")) & (F.col(ts) <= F.col("__until")))
             .groupBy("__k").agg(F.max_by(value, ts).alias("__old")))
    return (latest.join(older, F.col(key) == F.col("__k"), "left")
            .withColumn(out, F.col(value) - F.col("__old")).drop("__k", "__old"))


def top_trending(df: DataFrame, now, hours: float = 1.0, k: int = 5, key: str = "movie_title",
                 ts: str = "window_start") -> DataFrame:
    """Latest row per title among windows that started in the last ``hours``,
    top ``k`` by score, with a sentiment label (+-0.2) and the 24 h change."""
    from .clean import recent

    latest = top_per_key(recent(df, ts, hours, now), [key], [F.col(ts).desc()], 1)
    latest = with_change(latest, df, key, ts, "trend_score")
    return (latest.select(key, "trend_score", "change_24h",
                          label("avg_sentiment", -0.2, 0.2).alias("sentiment"))
            .orderBy(F.col("trend_score").desc(), F.col(key)).limit(k))


def history(df: DataFrame, key: str, value, ts: str = "window_start", n: int = 50) -> DataFrame:
    """One key's rows newest first (``n`` rows) with ``current_score`` = newest."""
    rows = df.filter(F.col(key) == F.lit(value)).orderBy(F.col(ts).desc()).limit(n)
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return rows.withColumn("current_score", F.first("trend_score").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def top_comments(df: DataFrame, key: str, text: str, score: str, order: str, k: int = 3,
                 cut: int = 200, dedupe_chars: int = 50) -> DataFrame:
    """Per key, text cut to ``cut`` chars, dedupe on the lower-cased first
    ``dedupe_chars`` chars keeping the earliest, then top ``k`` by score
    (earlier arrival first among equal scores)."""
    c = df.withColumn("__text", F.substring(F.col(text), 1, cut)) \
          .withColumn("__dk", F.lower(F.substring(F.col(text), 1, dedupe_chars)))
    first = top_per_key(c, [key, "__dk"], [F.col(order)], 1)
    best = top_per_key(first, [key], [F.col(score).desc(), F.col(order)], k, rank_col="rank")
    return best.withColumn(text, F.col("__text")).drop("__text", "__dk")


def top_rated(basics: DataFrame, ratings: DataFrame, min_votes: int = 10000, n: int = 100) -> DataFrame:
    """Titles with at least ``min_votes`` votes, best rating first (file order breaks ties)."""
    j = basics.join(ratings, "tconst", "inner").filter(F.col("numVotes") >= min_votes)
    return j.orderBy(F.col("averageRating").desc(), F.col("pos")).limit(n)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first message per key in arrival order."""
    return top_per_key(df, [key], [F.col(order)], 1)


def rank_top(df: DataFrame, score: str, n: int = 20, tie: str | Sequence[str] | None = None) -> DataFrame:
    """Sort by ``score`` descending (ties by ``tie``) and keep ``n`` rows."""
    ties = [tie] if isinstance(tie, str) else list(tie or [])
    return df.orderBy(F.col(score).desc(), *[F.col(t) for t in ties]).limit(n)


def first_sufficient(df: DataFrame, key: str, rank: str, min_results: int = 5) -> DataFrame:
    """Per key, results of query variants up to and including the first
    variant (by ``rank``) that returned at least ``min_results`` rows."""
    counts = df.groupBy(key, rank).agg(F.count(F.lit(1)).alias("__n"))
    stop = (counts.filter(F.col("__n") >= min_results).groupBy(key)
            .agg(F.min(rank).alias("__stop")))
    return (df.join(stop, key, "left")
            .filter(F.col("__stop").isNull() | (F.col(rank) <= F.col("__stop"))).drop("__stop"))


def cap_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most ``n`` rows per key in arrival order."""
    return top_per_key(df, [key], [F.col(order)], n)


def sample_sources(df: DataFrame, n: int = 5, order: str = "rank", text: str = "text",
                   sentiment: str = "sentiment", source: str = "source",
                   subreddit: str = "subreddit", keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """The first ``n`` relevant texts per question, cut to 200 chars, labelled."""
    top = top_per_key(df, list(keys), [F.col(order)], n)
    return top.select(*keys, order, ellipsis(text, 200).alias("text"),
                      label(F.coalesce(F.col(sentiment), F.lit(0.0)), -0.1, 0.1).alias("sentiment"),
                      F.when(F.col(source) == "tmdb", F.lit("TMDB Review"))
                      .otherwise(F.coalesce(F.col(subreddit), F.lit("reddit"))).alias("source_label"),
                      F.col(source).alias("source_type"))
