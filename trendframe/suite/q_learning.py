"""Online-learning and keyed-state queries (W9-W11, F26, F27, A9, T5-T8 batch twins, C8, S12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.aggregate import regression_metrics
from ..operators.learn import minibatch_history, prequential_per_key, running_metrics
from ..plans.learning import TREND_FEATURES, online_features, online_learning, rating_features
from ..session import checkpoint_dir
from ..sources import testbed as tb
from ..sources.io import write_keyed
from ..streaming.state import cooldown, first_seen
from . import ntz, register, rounded
from ._sql import sround, with_trends
from .q_rank import trends

_FEAT_SQL = with_trends("""
SELECT movie_title, window_start, round(popularity, 6) AS popularity, mentions_count,
       round(avg_sentiment, 6) AS avg_sentiment, CAST(hour(window_start) AS DOUBLE) AS hour,
       CAST(isodow(window_start) - 1 AS DOUBLE) AS day_of_week,
       CAST(CASE WHEN row_number() OVER w - 1 >= 2 THEN mentions_count - lag(mentions_count) OVER w ELSE 0 END
            AS DOUBLE) AS delta_mentions,
       round(CASE WHEN row_number() OVER w - 1 >= 2 THEN avg_sentiment - lag(avg_sentiment) OVER w ELSE 0.0 END, 6)
           AS delta_sentiment,
       round(CASE WHEN row_number() OVER w - 1 >= 2 THEN popularity - lag(popularity) OVER w ELSE 0.0 END, 6)
           AS delta_popularity,
       round(coalesce(avg(mentions_count) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), mentions_count), 6)
           AS ma_mentions,
       round(coalesce(avg(avg_sentiment) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), avg_sentiment), 6)
           AS ma_sentiment
FROM trends WINDOW w AS (PARTITION BY movie_title ORDER BY window_start)""")


@register("online_features", _FEAT_SQL)
def q_online_features(spark, d):
    """F26 + W9 + W10: hour, weekday, deltas (0 unless 2 priors), trailing means."""
    f = online_features(trends(spark, d))
    return rounded(f.select("movie_title", "window_start", "popularity", "mentions_count", "avg_sentiment",
                            "hour", "day_of_week", "delta_mentions", "delta_sentiment", "delta_popularity",
                            "ma_mentions", "ma_sentiment"))


def _enriched(spark, d):
    return trends(spark, d).withColumn("imdb_rating", F.col("vote_average")) \
        .withColumn("imdb_votes", (F.col("popularity") * 100).cast("bigint")) \
        .withColumn("imdb_year", F.lit(None).cast("int")) \
        .withColumn("vote_count", F.col("mentions_count"))


@register("rating_features", with_trends("""
SELECT movie_title, window_start, round(trend_score, 6) AS trend_score, round(r, 6) AS imdb_rating,
       round(v, 6) AS imdb_votes, round(ln(1 + v), 6) AS imdb_votes_log, CAST(5.0 AS DOUBLE) AS movie_age,
       round(p, 6) AS tmdb_popularity, round(r, 6) AS tmdb_vote_average, round(m, 6) AS tmdb_vote_count,
       round(ln(1 + m), 6) AS tmdb_vote_count_log, round(m, 6) AS reddit_mentions,
       round(ln(1 + m), 6) AS reddit_mentions_log, round(s, 6) AS sentiment_score,
       CAST(CASE WHEN s > 0.2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS sentiment_positive,
       round(r / 10.0 * (1.0 + v / 100000.0), 6) AS quality_score, round(m / (v + 1), 6) AS engagement_rate,
       round(mom, 6) AS trend_momentum, round(r * p / 100, 6) AS rating_popularity,
       round(s * m, 6) AS sentiment_mentions
FROM (SELECT *, vote_average AS r, CAST(trunc(popularity * 100) AS DOUBLE) AS v, popularity AS p,
             CAST(mentions_count AS DOUBLE) AS m, avg_sentiment AS s,
             coalesce(lag(trend_score, 1) OVER w - lag(trend_score, 2) OVER w, 0.0) AS mom
      FROM trends WINDOW w AS (PARTITION BY movie_title ORDER BY window_start))"""))
def q_rating_features(spark, d):
    """F27 + W11: the rating-aware learner's features with trend momentum."""
    return rounded(rating_features(_enriched(spark, d)))


@register("regression_metrics", with_trends(f"""
SELECT movie_title, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
       round(1.0 - avg(e * e) / nullif(var_pop(y), 0), 6) AS r2
FROM (SELECT movie_title, trend_score AS y, trend_score - {sround('trend_score * 0.95', 2)} AS e FROM trends)
GROUP BY movie_title"""))
def q_regression_metrics(spark, d):
    """MAE, RMSE, R2 per title of the 0.95 heuristic prediction."""
    t = trends(spark, d).withColumn("prediction", F.round(F.col("trend_score") * 0.95, 2))
    return rounded(regression_metrics(t, "trend_score", "prediction", ["movie_title"]))


@register("running_metrics", with_trends(f"""
SELECT movie_title, window_start,
       round(avg(abs(e)) OVER w, 6) AS running_mae, round(sqrt(avg(e * e) OVER w), 6) AS running_rmse,
       round(CASE WHEN var_pop(trend_score) OVER w > 1e-9 THEN 1.0 - avg(e * e) OVER w / var_pop(trend_score) OVER w END, 6) AS running_r2
FROM (SELECT *, trend_score - {sround('trend_score * 0.95', 2)} AS e FROM trends)
WINDOW w AS (PARTITION BY movie_title ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_running_metrics(spark, d):
    """A9 running form: cumulative MAE, RMSE and R2 per title."""
    t = trends(spark, d).withColumn("prediction", F.round(F.col("trend_score") * 0.95, 2))
    r = running_metrics(t, "movie_title", ["window_start"], "trend_score", "prediction")
    return rounded(r.select("movie_title", "window_start", "running_mae", "running_rmse", "running_r2"))


@register("running_metrics_all", with_trends(f"""
SELECT movie_title, movie_id, window_start,
       round(avg(abs(e)) OVER w, 6) AS running_mae, round(sqrt(avg(e * e) OVER w), 6) AS running_rmse,
       round(CASE WHEN var_pop(trend_score) OVER w > 1e-9 THEN 1.0 - avg(e * e) OVER w / var_pop(trend_score) OVER w END, 6) AS running_r2
FROM (SELECT *, trend_score - {sround('trend_score * 0.95', 2)} AS e FROM trends)
WINDOW w AS (ORDER BY window_start, movie_title, movie_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_running_metrics_all(spark, d):
    """A9 running form over all titles in one sequence, scanned in parallel."""
    t = trends(spark, d).withColumn("prediction", F.round(F.col("trend_score") * 0.95, 2))
    r = running_metrics(t, None, ["window_start", "movie_title", "movie_id"], "trend_score", "prediction")
    return rounded(r.select("movie_title", "movie_id", "window_start", "running_mae", "running_rmse", "running_r2"))


#: Trend rows with the learner's features in the order of TREND_FEATURES as one list.
_ROWS = """
rws AS (SELECT movie_title, movie_id, window_start, window_end, trend_score AS y, row_number() OVER w AS i, [
  popularity, CAST(mentions_count AS DOUBLE), mentions_rate, avg_sentiment, vote_average, avg_reddit_score,
  CAST(hour(window_start) AS DOUBLE), CAST(isodow(window_start) - 1 AS DOUBLE),
  CAST(CASE WHEN row_number() OVER w > 2 THEN mentions_count - lag(mentions_count) OVER w ELSE 0 END AS DOUBLE),
  CASE WHEN row_number() OVER w > 2 THEN avg_sentiment - lag(avg_sentiment) OVER w ELSE 0.0 END,
  CASE WHEN row_number() OVER w > 2 THEN popularity - lag(popularity) OVER w ELSE 0.0 END,
  coalesce(avg(mentions_count) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), mentions_count),
  coalesce(avg(avg_sentiment) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), avg_sentiment)] AS x
  FROM trends WINDOW w AS (PARTITION BY movie_title ORDER BY window_start, movie_id))"""


def _each(expr: str) -> str:
    """A list with ``expr`` of each feature number ``k``."""
    return f"list_transform(range(1, {len(TREND_FEATURES) + 1}), lambda k: {expr})"


_ZERO = _each("0.0::DOUBLE")
#: One row of each title a round: predict with the model so far, measure, learn.
_PREQUENTIAL = f"""
lrn(movie_title, i, mean, m2, w, b, ae, se, ym, yq, y, p) AS (
  SELECT DISTINCT movie_title, CAST(0 AS BIGINT), {_ZERO}, {_ZERO}, {_ZERO}, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
         0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM rws
  UNION ALL
  SELECT movie_title, i, mean1, m21, {_each("w[k] - 0.01 * (e * xs1[k] + 0.001 * w[k])")}, b - 0.01 * e,
         ae + abs(y - p), se + (y - p) * (y - p), ym1, yq + (y - ym) * (y - ym1), y, p
  FROM (SELECT *, b + list_dot_product(w, xs1) - y AS e
    FROM (SELECT *, {_each("CASE WHEN m21[k] > i * 1e-18 THEN (x[k] - mean1[k]) / sqrt(m21[k] / i) ELSE 0.0 END")} AS xs1
      FROM (SELECT *, {_each("m2[k] + (x[k] - mean[k]) * (x[k] - mean1[k])")} AS m21
        FROM (SELECT r.movie_title, r.i, r.x, r.y, mean, m2, w, b, ae, se, ym, yq, ym + (r.y - ym) / r.i AS ym1,
                     {_each("mean[k] + (r.x[k] - mean[k]) / r.i")} AS mean1,
                     b + list_dot_product(w, {_each("CASE WHEN m2[k] > (r.i - 1) * 1e-18 THEN (r.x[k] - mean[k]) / sqrt(m2[k] / (r.i - 1)) ELSE 0.0 END")}) AS p
              FROM lrn JOIN rws r ON r.movie_title = lrn.movie_title AND r.i = lrn.i + 1) z1) z2) z3) z4)"""


def _learned(select: str) -> str:
    """``select`` over ``lrn l JOIN rws r``: the models after each row, with the row."""
    inner = f"WITH RECURSIVE {_ROWS.strip()},{_PREQUENTIAL} {select}"
    return with_trends(f"SELECT * FROM ({inner})")


_MEASURES = """round(l.y, 6) AS {y}, round(l.p, 6) AS {p}, round(abs(l.y - l.p), 6) AS {e}, round(l.ae / l.i, 6) AS mae,
  round(sqrt(l.se / l.i), 6) AS rmse, round(CASE WHEN l.yq > l.i * 1e-18 THEN 1.0 - l.se / l.yq END, 6) AS r2"""
_JOINED = "FROM lrn l JOIN rws r ON r.movie_title = l.movie_title AND r.i = l.i"


@register("prequential_per_title", _learned(f"""
SELECT r.movie_title, r.movie_id, r.window_start, {_MEASURES.format(y='actual', p='prediction', e='error')} {_JOINED}"""))
def q_prequential(spark, d):
    """T6 (b): per-title prequential scaler + SGD linear model on all 13 features."""
    f = online_features(trends(spark, d))
    return rounded(prequential_per_key(f, "movie_title", ["window_start", "movie_id"], TREND_FEATURES, "trend_score"))


_STORED = ("SELECT r.movie_title, r.movie_id, r.window_start AS \"timestamp\", 'v1' AS model_version, "
           + _MEASURES.format(y="actual_trend_score", p="predicted_trend_score", e="prediction_error") + ", "
           + ", ".join(f"round(r.x[{k}], 6) AS {c}" for k, c in enumerate(TREND_FEATURES, 1)) + f" {_JOINED}")


def _flat(out):
    """Prediction rows with the feature map as columns."""
    return rounded(ntz(out.select("movie_title", "movie_id", "timestamp", "model_version", "actual_trend_score",
                                  "predicted_trend_score", "prediction_error", "mae", "rmse", "r2",
                                  *[F.col("features")[c].alias(c) for c in TREND_FEATURES]), "timestamp"))


@register("online_learning", _learned(_STORED))
def q_online_learning(spark, d):
    """C8 + S12: prediction rows with the feature map, read back from the keyed table they are written to."""
    path = f"{checkpoint_dir(spark)}/predictions/{uuid.uuid4().hex}"
    write_keyed(online_learning(trends(spark, d)), path, ["movie_title", "movie_id", "timestamp"], order="timestamp")
    return _flat(spark.read.parquet(path))


#: Features, their covariances within a day and with the target, as lists.
_K = len(TREND_FEATURES)


@register("global_learner", with_trends(f"""
SELECT movie_title, movie_id, window_start, round(y, 6) AS actual, round(prediction, 6) AS prediction
FROM (
  WITH RECURSIVE {_ROWS.strip()},
  tr AS (SELECT *, CAST(window_start AS DATE) AS day FROM rws),
  av AS (SELECT day, count(*) AS nb, avg(y) AS my, [{', '.join(f'avg(x[{k}])' for k in range(1, _K + 1))}] AS mx,
                [{', '.join(f'covar_pop(x[{k}], y)' for k in range(1, _K + 1))}] AS cy,
                [{', '.join(f'[{", ".join(f"covar_pop(x[{min(j, k)}], x[{max(j, k)}])" for k in range(1, _K + 1))}]' for j in range(1, _K + 1))}] AS c
         FROM tr GROUP BY day),
  mo AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM av),
  st(i, n, mean, m2, w, b) AS (
    SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), {_ZERO}, {_ZERO}, {_ZERO}, 0.0::DOUBLE
    UNION ALL
    SELECT i, nn, mean1, m21, list_transform(range(1, {_K + 1}), lambda k: w[k] - 0.01 * (
             b * off[k] * inv[k] + inv[k] * list_sum(list_transform(range(1, {_K + 1}), lambda j: (c[k][j] + off[k] * off[j]) * inv[j] * w[j]))
             - (cy[k] + my * off[k]) * inv[k] + 0.001 * w[k])),
           b - 0.01 * (b + list_sum(list_transform(range(1, {_K + 1}), lambda j: w[j] * off[j] * inv[j])) - my)
    FROM (SELECT *, {_each("CASE WHEN m21[k] > nn * 1e-18 THEN 1.0 / sqrt(m21[k] / nn) ELSE 0.0 END")} AS inv, {_each("mx[k] - mean1[k]")} AS off
      FROM (SELECT mo.*, st.n + nb AS nn, {_each("mean[k] + (mx[k] - mean[k]) * nb / (st.n + nb)")} AS mean1, w, b,
                   {_each("m2[k] + c[k][k] * nb + (mx[k] - mean[k]) * (mx[k] - mean[k]) * st.n * nb / (st.n + nb)")} AS m21
            FROM st JOIN mo ON mo.i = st.i + 1) z1) z2)
  SELECT tr.movie_title, tr.movie_id, tr.window_start, tr.y, st.b + list_sum({_each(
    "CASE WHEN st.n > 0 AND st.m2[k] > st.n * 1e-18 THEN st.w[k] * (tr.x[k] - st.mean[k]) / sqrt(st.m2[k] / st.n) ELSE 0.0 END")}) AS prediction
  FROM tr JOIN mo ON mo.day = tr.day JOIN st ON st.i = mo.i - 1)"""))
def q_global_learner(spark, d):
    """T6 (a): one model of all 13 features for all titles, updated once a day, each row predicted before its day is learned."""
    t = online_features(trends(spark, d)).withColumn("day", F.to_date("window_start"))
    out = minibatch_history(t, "day", TREND_FEATURES, "trend_score")
    return rounded(out.select("movie_title", "movie_id", "window_start", F.col("trend_score").alias("actual"), "prediction"))


@register("first_seen", tb.with_ctes("""
SELECT title, event_id, event_time FROM catalogue
QUALIFY row_number() OVER (PARTITION BY title ORDER BY event_time) = 1""", "catalogue"))
def q_first_seen(spark, d):
    """T7 batch twin: the first appearance of every title."""
    return first_seen(tb.catalogue(spark, d), "title", "event_time").select("title", "event_id", "event_time")


@register("cooldown", tb.with_ctes("""
SELECT title, event_id, event_time FROM (
  WITH RECURSIVE ev AS (SELECT title, event_id, event_time,
                               row_number() OVER (PARTITION BY title ORDER BY event_time, event_id) AS rn
                        FROM catalogue),
  chain(title, rn, pass_time) AS (
    SELECT title, rn, event_time FROM ev WHERE rn = 1
    UNION ALL
    SELECT c.title, n.rn, n.event_time
    FROM chain c JOIN LATERAL (SELECT min(e.rn) AS rn FROM ev e
                               WHERE e.title = c.title AND e.event_time >= c.pass_time + INTERVAL 600 SECOND) m ON true
    JOIN ev n ON n.title = c.title AND n.rn = m.rn)
  SELECT e.title, e.event_id, e.event_time FROM chain c JOIN ev e ON e.title = c.title AND e.rn = c.rn)""",
    "catalogue"))
def q_cooldown(spark, d):
    """T8 batch twin: a title passes again only 600 s after its last pass."""
    c = tb.catalogue(spark, d).select("title", "event_id", "event_time")
    return cooldown(c, "title", "event_time", 600, tie="event_id")
