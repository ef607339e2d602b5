"""C1 trend job and its parts (A1, A2, J1, F22, F25, T2) over the events feed."""

from __future__ import annotations

from ..operators.clean import explode_mentions
from ..operators.windows import catalogue_window, discussion_window
from ..plans.trend import trend_scores, trend_scores_one_pass
from ..sources import testbed as tb
from . import ntz, register, rounded, sql_windows

DAY, SIX_H = 86400, 6 * 3600

_W_LAT, _W_START, _W_END = sql_windows("event_time", DAY, SIX_H)
_M_LAT, _M_START, _M_END = sql_windows("event_time", 300, 60)

_CA = f"""
ca AS (
  SELECT {_W_START} AS window_start, {_W_END} AS window_end, title AS movie_title, movie_id,
         avg(popularity) AS popularity, avg(vote_average) AS vote_average
  FROM catalogue, {_W_LAT}
  GROUP BY ALL)"""

_DA = f"""
dx AS (
  SELECT unnest(movie_mentions) AS movie_title, sentiment_score, score, event_time
  FROM discussion WHERE len(movie_mentions) > 0),
da AS (
  SELECT {_W_START} AS window_start, {_W_END} AS window_end, movie_title,
         count(*) AS mentions_count,
         avg(sentiment_score) AS avg_sentiment, avg(score) AS avg_reddit_score
  FROM dx, {_W_LAT}
  GROUP BY ALL)"""


def _trend_sql(join: str) -> str:
    select = f"""
SELECT coalesce(ca.window_start, da.window_start) AS window_start,
       coalesce(ca.window_end, da.window_end) AS window_end,
       coalesce(ca.movie_title, da.movie_title) AS movie_title, ca.movie_id,
       round(ca.popularity, 6) AS popularity, round(ca.vote_average, 6) AS vote_average,
       CAST(coalesce(da.mentions_count, 0) AS BIGINT) AS mentions_count,
       round(coalesce(da.avg_sentiment, 0.0), 6) AS avg_sentiment,
       round(coalesce(da.avg_reddit_score, 0.0), 6) AS avg_reddit_score,
       round(CAST(coalesce(da.mentions_count, 0) AS DOUBLE), 6) AS mentions_rate,
       round(0.4 * ca.popularity + 0.3 * coalesce(da.mentions_count, 0) * 10
             + 0.3 * (coalesce(da.avg_sentiment, 0.0) + 1) * 50, 6) AS trend_score,
       TIMESTAMP '{tb.NOW}' AS processed_time
FROM ca {join} da ON ca.window_start = da.window_start AND ca.movie_title = da.movie_title"""
    return tb.with_ctes(select, "catalogue", "discussion", extra=_CA + "," + _DA)


def _c1(spark, d, how="inner"):
    out = trend_scores(tb.catalogue(spark, d), tb.discussion(spark, d), size="1 day",
                       slide="6 hours", how=how, now=tb.NOW)
    return rounded(ntz(out, "processed_time"))


@register("trend_scores", _trend_sql("JOIN"))
def q_trend_scores(spark, d):
    """C1 flagship: inner join of the windowed feeds (1 day windows every 6 h)."""
    return _c1(spark, d)


@register("trend_scores_full_outer", _trend_sql("FULL OUTER JOIN"))
def q_trend_scores_full(spark, d):
    """J1 option: full outer join (titles present on one side only are kept)."""
    return _c1(spark, d, how="full")


@register("trend_scores_left", _trend_sql("LEFT JOIN"))
def q_trend_scores_left(spark, d):
    """J1 option: left join (catalogue windows without discussion get defaults)."""
    return _c1(spark, d, how="left")


_ONE_PASS_SQL = _trend_sql("JOIN").replace(f"TIMESTAMP '{tb.NOW}' AS processed_time", "NULL AS __drop") \
    .replace(",\n       NULL AS __drop", "")


@register("trend_scores_one_pass", _ONE_PASS_SQL)
def q_trend_scores_one_pass(spark, d):
    """C1 one-pass variant (union + one aggregate); equal for one id per title."""
    out = trend_scores_one_pass(tb.catalogue(spark, d), tb.discussion(spark, d),
                                size="1 day", slide="6 hours")
    return rounded(out)


@register("discussion_window", tb.with_ctes(f"""
SELECT {_M_START} AS window_start, {_M_END} AS window_end, movie_title,
       count(*) AS mentions_count, round(avg(sentiment_score), 6) AS avg_sentiment,
       round(avg(score), 6) AS avg_reddit_score
FROM (SELECT unnest(movie_mentions) AS movie_title, sentiment_score, score, event_time
      FROM discussion WHERE len(movie_mentions) > 0), {_M_LAT}
GROUP BY ALL""", "discussion"))
def q_discussion_window(spark, d):
    """A1: 5-minute windows sliding by 1 minute, per mentioned title."""
    m = explode_mentions(tb.discussion(spark, d).withColumnRenamed("score", "reddit_score"),
                         keep=["sentiment_score", "event_time", "reddit_score"])
    return rounded(discussion_window(m, "5 minutes", "1 minute"))


@register("catalogue_window", tb.with_ctes(f"""
SELECT {_M_START} AS window_start, {_M_END} AS window_end, title AS movie_title, movie_id,
       round(avg(popularity), 6) AS avg_popularity, round(avg(vote_average), 6) AS avg_vote,
       round(avg(vote_count), 6) AS avg_vote_count
FROM catalogue, {_M_LAT}
GROUP BY ALL""", "catalogue"))
def q_catalogue_window(spark, d):
    """A2: 5-minute windows sliding by 1 minute, per title and id."""
    return rounded(catalogue_window(tb.catalogue(spark, d), "5 minutes", "1 minute"))
