"""Serving and ranking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.score import accuracy, rescale
from ..functions.sentiment import sentiment
from ..operators import rank as R
from ..operators.aggregate import (chart_metrics, dashboard_summary, discussion_stats,
                                   source_volume, trend_totals)
from ..operators.joins import enrich_left, known_only
from ..plans.serving import predictions_view, trending_now
from ..plans.trend import trend_scores
from ..session import checkpoint_dir
from ..sources import testbed as tb
from ..sources.log import log_index, read_range, read_tail
from . import register, rounded
from ._sql import lexicon_cte, sentiment_ctes, sround, with_trends


def trends(spark, d):
    """C1 trend rows (1 day windows every 6 h) - input of the serving queries."""
    return trend_scores(tb.catalogue(spark, d), tb.discussion(spark, d), size="1 day",
                        slide="6 hours", now=tb.NOW).drop("processed_time")


# ------------------------------------------------------------------ W1 - W3

@register("latest_trends", with_trends(f"""
SELECT movie_title, round(trend_score, 6) AS trend_score, round(popularity, 6) AS popularity,
       mentions_count, round(avg_sentiment, 6) AS avg_sentiment, window_start, window_end
FROM trends WHERE window_start > TIMESTAMP '{tb.NOW}' - INTERVAL 24 HOUR
QUALIFY row_number() OVER (PARTITION BY movie_title ORDER BY window_start DESC) = 1
ORDER BY trend_score DESC, movie_title LIMIT 10"""))
def q_latest_trends(spark, d):
    """W1 + P9: newest window per title in the last 24 h, best 10 by score."""
    from ..operators.clean import recent
    t = recent(trends(spark, d), "window_start", 24, F.lit(tb.NOW))
    out = R.latest_per_key(t, "movie_title", "window_start", limit=10)
    return rounded(out.select("movie_title", "trend_score", "popularity", "mentions_count",
                              "avg_sentiment", "window_start", "window_end"))


@register("top_trending", with_trends(f"""
SELECT movie_title, round(trend_score, 6) AS trend_score, round(change_24h, 6) AS change_24h,
       CASE WHEN avg_sentiment > 0.2 THEN 'positive' WHEN avg_sentiment < -0.2 THEN 'negative'
            ELSE 'neutral' END AS sentiment
FROM (SELECT *, trend_score - last(trend_score) OVER (
             PARTITION BY movie_title ORDER BY window_start
             RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 24 HOURS PRECEDING) AS change_24h
      FROM trends)
WHERE window_start > TIMESTAMP '{tb.NOW}' - INTERVAL 12 HOUR
QUALIFY row_number() OVER (PARTITION BY movie_title ORDER BY window_start DESC) = 1
ORDER BY trend_score DESC, movie_title LIMIT 5"""))
def q_top_trending(spark, d):
    """W2 + F3: top 5 titles of the last 12 h with label and real 24 h change."""
    return rounded(R.top_trending(trends(spark, d), F.lit(tb.NOW), hours=12, k=5))


@register("title_history", with_trends("""
SELECT movie_title, round(trend_score, 6) AS trend_score, mentions_count, window_start,
       round(first_value(trend_score) OVER (ORDER BY window_start DESC), 6) AS current_score
FROM (SELECT * FROM trends WHERE movie_title = 'Title 9' ORDER BY window_start DESC LIMIT 50)"""))
def q_title_history(spark, d):
    """W3 + P10: one title's newest 50 windows and its current score."""
    h = R.history(trends(spark, d), "movie_title", "Title 9")
    return rounded(h.select("movie_title", "trend_score", "mentions_count", "window_start",
                            "current_score"))


@register("trend_totals", with_trends("""
SELECT count(*) AS total_rows, count(DISTINCT movie_title) AS distinct_titles,
       round(coalesce(avg(avg_sentiment), 0.0), 6) AS average_sentiment FROM trends"""))
def q_trend_totals(spark, d):
    """A5: trend row count, distinct titles, mean sentiment."""
    return rounded(trend_totals(trends(spark, d)))


# ------------------------------------------------------------------ W4 - W7

@register("top_comments", tb.with_ctes("""
SELECT movie_title, CAST(rank AS INTEGER) AS rank, substr(text, 1, 200) AS text, score, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY movie_title ORDER BY score DESC, event_id) AS rank
      FROM (SELECT * FROM discussion_text
            QUALIFY row_number() OVER (PARTITION BY movie_title, lower(substr(text, 1, 50))
                                       ORDER BY event_id) = 1))
WHERE rank <= 3""", "discussion", "discussion_text"))
def q_top_comments(spark, d):
    """Three best distinct comments per title."""
    t = R.top_comments(tb.discussion_text(spark, d), "movie_title", "text", "score", "event_id")
    return t.select("movie_title", "rank", "text", "score", "event_id")


@register("top_rated", tb.with_ctes("""
SELECT b.tconst, b.primaryTitle, r.averageRating, r.numVotes
FROM basics b JOIN ratings r ON r.tconst = b.tconst
WHERE r.numVotes >= 30 ORDER BY r.averageRating DESC, b.pos LIMIT 100""", "basics", "ratings"))
def q_top_rated(spark, d):
    """W5 + J5: rated titles with >= 30 votes, best 100."""
    out = R.top_rated(tb.basics(spark, d), tb.ratings(spark, d), min_votes=30, n=100)
    return out.select("tconst", "primaryTitle", "averageRating", "numVotes")


@register("first_per_title", tb.with_ctes("""
SELECT title, event_id, popularity FROM catalogue
QUALIFY row_number() OVER (PARTITION BY title ORDER BY event_id) = 1""", "catalogue"))
def q_first_per_title(spark, d):
    """First message of each title."""
    out = R.first_per_key(tb.catalogue(spark, d), "title", "event_id")
    return out.select("title", "event_id", "popularity")


@register("tail_scan", """
SELECT event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200""")
def q_tail_scan(spark, d):
    """The newest 200 messages of every partition (event type) by offset."""
    from ..sources.io import tail_per_partition
    ev = tb.table(spark, d, "events")
    return tail_per_partition(ev, "event_type", "event_id", 200).select("event_id", "event_type", "value")


def _log(spark, d) -> str:
    """The events as a log of files in the order of their offsets (those of a partition have gaps)."""
    path = f"{checkpoint_dir(spark)}/log/{uuid.uuid4().hex}"
    tb.table(spark, d, "events").repartitionByRange(16, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return path


@register("log_tail", """
SELECT event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200""")
def q_log_tail(spark, d):
    """The newest 200 messages of every partition, from the files that can hold them."""
    path = _log(spark, d)
    index = log_index(spark, path, "event_type", "event_id", stored=path + "-index")
    return read_tail(spark, path, 200, "event_type", "event_id", index).select("event_id", "event_type", "value")


@register("log_replay", """
SELECT event_id, event_type, value FROM events WHERE CASE event_type
  WHEN 'click' THEN event_id >= 1000 AND event_id < 3000 WHEN 'view' THEN event_id < 500
  WHEN 'error' THEN event_id >= (SELECT max(event_id) - 100 FROM events) ELSE event_type = 'signup' END""")
def q_log_replay(spark, d):
    """Given offsets of some partitions, one from the earliest, one to the newest, one whole."""
    last = tb.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    out = read_range(spark, _log(spark, d), {"click": (1000, 3000), "view": (None, 500), "error": (last - 100, None),
                                             "signup": (None, None)}, "event_type", "event_id")
    return out.select("event_id", "event_type", "value")


# ------------------------------------------------------------- C2 and parts

_C2_CTES = lexicon_cte() + """,
first AS (SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY title ORDER BY event_id) = 1),
disc AS (SELECT dt.*, lower(movie_title) AS title_key FROM discussion_text dt
         WHERE movie_title IS NOT NULL AND movie_title <> '' AND text IS NOT NULL AND text <> ''
           AND lower(movie_title) IN (SELECT lower(title) FROM first)),""" + \
    sentiment_ctes("disc", "event_id", "text", "sent") + """,
ds AS (SELECT d.*, (s.compound + 1) / 2 AS sentiment01 FROM disc d JOIN sent s ON s.sid = d.event_id),
stats AS (SELECT title_key, count(*) AS mentions, """ + sround("avg(sentiment01)", 2) + """ AS sentiment
          FROM ds GROUP BY title_key),
dd AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY title_key, lower(substr(text, 1, 50))
                                                   ORDER BY event_id) = 1),
tc AS (SELECT title_key, substr(text, 1, 200) AS text,
              row_number() OVER (PARTITION BY title_key ORDER BY score DESC, event_id) AS rank FROM dd),
top3 AS (SELECT title_key, list(text ORDER BY rank) AS top_comments FROM tc WHERE rank <= 3
         GROUP BY title_key),
j AS (SELECT f.title, f.release_date, coalesce(f.popularity, 0.0) AS popularity,
             coalesce(f.vote_average, 0.0) AS vote_average,
             CAST(coalesce(s.mentions, 0) AS BIGINT) AS mentions,
             CAST(coalesce(s.sentiment, 0.5) AS DOUBLE) AS sentiment,
             coalesce(t.top_comments, []) AS top_comments
      FROM first f LEFT JOIN stats s ON s.title_key = lower(f.title)
                   LEFT JOIN top3 t ON t.title_key = lower(f.title)),
sc AS (SELECT *, """ + sround("popularity * 0.4 + mentions * 2 + sentiment * 100", 2) + """ AS trendScore
       FROM j),
c2 AS (SELECT *, """ + sround("trendScore * 0.95", 2) + """ AS prediction FROM sc
       ORDER BY trendScore DESC, title LIMIT 20)"""


def _c2_sql(select: str) -> str:
    return tb.with_ctes(select, "catalogue", "discussion", "discussion_text", extra=_C2_CTES)


def _c2(spark, d):
    return trending_now(tb.catalogue(spark, d), tb.discussion_text(spark, d), n=20)


@register("trending_now", _c2_sql("""
SELECT title, release_date, round(popularity, 6) AS popularity, round(vote_average, 6) AS vote_average,
       mentions, sentiment, array_to_string(top_comments, ' || ') AS top_comments, trendScore, prediction
FROM c2"""))
def q_trending_now(spark, d):
    """C2 (+ S4, W6, J3, F1, F2, A3, W4, J2, F23, F24, W7) over the whole feeds."""
    out = _c2(spark, d).withColumn("top_comments", F.array_join("top_comments", " || "))
    return rounded(out)


@register("predictions_view", _c2_sql("""
SELECT title AS movie_title, trendScore AS actual_trend_score, prediction AS predicted_trend_score
FROM c2 ORDER BY trendScore DESC, title LIMIT 10"""))
def q_predictions_view(spark, d):
    """Actual versus predicted score of the top 10."""
    return predictions_view(_c2(spark, d))


@register("dashboard_summary", _c2_sql("""
SELECT count(*) AS total_movies, """ + sround("avg(trendScore)", 2) + """ AS avg_trend_score,
       """ + sround("""coalesce(avg(CASE WHEN trendScore > 0 THEN greatest(0.0, least(100.0,
             100.0 - abs((prediction - trendScore) / trendScore * 100))) END), 0.0)""", 2) + """ AS model_accuracy,
       count(*) FILTER (WHERE mentions > 0) AS movies_with_reddit,
       """ + sround("(avg(coalesce(sentiment, 0.5)) - 0.0) / 1.0 * 2.0 + -1.0", 2) + """ AS average_sentiment
FROM c2"""))
def q_dashboard_summary(spark, d):
    """A6 + F28: summary over the trending list."""
    return dashboard_summary(_c2(spark, d))


@register("chart_metrics", _c2_sql("""
SELECT round(coalesce(avg(greatest(0.0, 100.0 - abs((prediction - trendScore) / trendScore * 100))), 0.0), 6)
         AS avg_accuracy,
       round(coalesce(avg(abs(prediction - trendScore)), 0.0), 6) AS avg_error, count(*) AS n
FROM (SELECT * FROM c2 ORDER BY trendScore DESC, title LIMIT 10)"""))
def q_chart_metrics(spark, d):
    """A10: chart accuracy (floored at 0 only) and mean absolute error of the top 10."""
    pv = predictions_view(_c2(spark, d))
    return rounded(chart_metrics(pv, "actual_trend_score", "predicted_trend_score"))


@register("discussion_stats", tb.with_ctes("""
SELECT d.title_key, count(*) AS mentions, """ + sround("avg((s.compound + 1) / 2)", 2) + """ AS sentiment
FROM disc d JOIN sent s ON s.sid = d.event_id GROUP BY d.title_key""",
    "catalogue", "discussion", "discussion_text",
    extra=lexicon_cte() + """,
disc AS (SELECT *, lower(movie_title) AS title_key FROM discussion_text),""" +
    sentiment_ctes("disc", "event_id", "text", "sent")))
def q_discussion_stats(spark, d):
    """A3 + F1 + F2: mentions and mean 0..1 sentiment per title."""
    disc = tb.discussion_text(spark, d).withColumn("title_key", F.lower("movie_title")) \
        .withColumn("sentiment01", rescale(sentiment("text")))
    return discussion_stats(disc)


@register("known_only", tb.with_ctes("""
SELECT event_id, movie_title FROM discussion_text
WHERE lower(movie_title) IN (SELECT lower(title) FROM catalogue)""",
    "catalogue", "discussion", "discussion_text"))
def q_known_only(spark, d):
    """Discussion rows about catalogue titles (semi join)."""
    k = known_only(tb.discussion_text(spark, d), tb.catalogue(spark, d))
    return k.select("event_id", "movie_title")


@register("enrich_left", tb.with_ctes("""
SELECT f.title, f.popularity, CAST(coalesce(s.mentions, 0) AS BIGINT) AS mentions
FROM (SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY title ORDER BY event_id) = 1) f
LEFT JOIN (SELECT lower(movie_title) AS title_key, count(*) AS mentions FROM discussion_text
           GROUP BY 1) s ON s.title_key = lower(f.title)""",
    "catalogue", "discussion", "discussion_text"))
def q_enrich_left(spark, d):
    """Newest-first catalogue rows left-joined to discussion counts (default 0)."""
    first = R.first_per_key(tb.catalogue(spark, d), "title", "event_id")
    stats = tb.discussion_text(spark, d).groupBy(F.lower("movie_title").alias("title_key")) \
        .agg(F.count(F.lit(1)).alias("mentions"))
    j = enrich_left(first, stats, "title", "title_key", {"mentions": 0})
    return j.select("title", "popularity", F.col("mentions").cast("bigint").alias("mentions"))


@register("accuracy", with_trends("""
SELECT movie_title, window_start,
       CASE WHEN trend_score > 0 THEN round(greatest(0.0, least(100.0,
            100.0 - abs((prediction - trend_score) / trend_score * 100))), 6) END AS accuracy,
       prediction, round(trend_score * 1.5, 6) AS score_x15
FROM (SELECT *, """ + sround("trend_score * 0.95", 2) + """ AS prediction FROM trends)"""))
def q_accuracy(spark, d):
    """F28 + F24: clamped accuracy of the 0.95 heuristic prediction per trend row."""
    from ..functions.score import trend_score_variant
    t = trends(spark, d).withColumn("prediction", trend_score_variant("trend_score", "prediction"))
    return rounded(t.select("movie_title", "window_start",
                            accuracy("prediction", "trend_score").alias("accuracy"), "prediction",
                            trend_score_variant("trend_score", "catalogue").alias("score_x15")))


@register("source_volume", """
WITH known AS (SELECT event_type, count(*) AS messages, max(ts) AS last_message FROM events GROUP BY event_type),
     every AS (SELECT * FROM known
               UNION ALL SELECT x, 0, NULL FROM (SELECT unnest(['click', 'share']) AS x) q
               WHERE x NOT IN (SELECT event_type FROM known)),
     summed AS (SELECT * FROM every
                UNION ALL SELECT NULL, CAST(sum(messages) AS BIGINT), max(last_message) FROM every)
SELECT event_type, CAST(messages AS BIGINT) AS messages, last_message,
       CASE WHEN messages > 0 THEN 'active' ELSE 'idle' END AS status FROM summed""")
def q_source_volume(spark, d):
    """Messages and newest message per source topic, quiet topics included, and in all."""
    return source_volume(tb.table(spark, d, "events"), "event_type", "ts", expected=["click", "share"])


@register("collection_count", "SELECT count(*) AS total_reviews FROM documents")
def q_collection_count(spark, d):
    """Size of the review collection."""
    return tb.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("total_reviews"))


@register("latest_catalogue", tb.with_ctes("""
SELECT event_id, title, popularity, popularity * 1.5 AS trendScore, release_date FROM catalogue
ORDER BY event_time DESC, event_id DESC LIMIT 10""", "catalogue"))
def q_latest_catalogue(spark, d):
    """W13 + F24: the newest 10 catalogue records scored ``popularity * 1.5``."""
    from ..functions.score import trend_score_variant
    c = tb.catalogue(spark, d)
    newest = c.orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(10)
    return newest.select("event_id", "title", "popularity",
                         trend_score_variant("popularity", "catalogue").alias("trendScore"), "release_date")
