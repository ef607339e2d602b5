"""Numeric, date and scoring column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, try_cast

# ------------------------------------------------------------------ F2 / F3


def rescale(col, frm=(-1.0, 1.0), to=(0.0, 1.0)) -> Column:
    """linear map from range ``frm`` to range ``to``."""
    (a, b), (c, d) = frm, to
    return (col_of(col) - F.lit(a)) / F.lit(b - a) * F.lit(d - c) + F.lit(c)


def label(col, lo: float, hi: float, names=("negative", "neutral", "positive")) -> Column:
    """threshold label with strict comparisons: ``> hi`` / ``< lo`` / else.

    Variants used: +-0.2 (trend), +-0.1 (retrieval), 33/66 on 0..100
    (gauge), +-0.3 (card colour), 0.4/0.6 on 0..1.
    """
    neg, mid, pos = names
    c = col_of(col)
    return F.when(c > hi, pos).when(c < lo, neg).otherwise(mid)


# --------------------------------------------------------------- F22 - F25

def trend_score(popularity="popularity", mentions="mentions_rate", sentiment="avg_sentiment",
                w1: float = 0.4, w2: float = 0.3, w3: float = 0.3) -> Column:
    """streaming trend score ``w1*pop + w2*mentions*10 + w3*(sent+1)*50``."""
    return (F.lit(w1) * col_of(popularity) + F.lit(w2) * col_of(mentions) * 10
            + F.lit(w3) * (col_of(sentiment) + 1) * 50)


def trend_score_serving(popularity="popularity", mentions="mentions", sentiment01="sentiment") -> Column:
    """serving score ``0.4*pop + 2*mentions + 100*sentiment01`` rounded to 2."""
    return F.round(col_of(popularity) * 0.4 + col_of(mentions) * 2 + col_of(sentiment01) * 100, 2)


def trend_score_variant(col, kind: str) -> Column:
    """``catalogue`` = popularity*1.5; ``discussed`` = count*10;
    ``prediction`` = round(0.95*score, 2)."""
    c = col_of(col)
    if kind == "catalogue":
        return c * 1.5
    if kind == "discussed":
        return c * 10
    if kind == "prediction":
        return F.round(c * 0.95, 2)
    raise ValueError(kind)


# ------------------------------------------------------------ F28, F29, A10

def accuracy(pred, actual, clamp: bool = True) -> Column:
    """``100 - |pred-actual|/actual*100``, clamped to 0..100; only for actual > 0."""
    p, a = col_of(pred), col_of(actual)
    acc = F.lit(100.0) - F.abs(F.try_divide(p - a, a) * 100)
    if clamp:
        acc = F.greatest(F.lit(0.0), F.least(F.lit(100.0), acc))
    return F.when(a > 0, acc)


def composite_rating(a, b) -> Column:
    """mean of two ratings when both are present and non-zero."""
    x, y = col_of(a), col_of(b)
    return F.when((x.isNotNull()) & (x != 0) & (y.isNotNull()) & (y != 0), x * 0.5 + y * 0.5)


# ------------------------------------------------------------ dates F14-F15

def release_status(release_date, now) -> Column:
    """``upcoming`` / ``just released`` (<= 7 days) / ``released``; NULL for a bad date.

    ``now`` is a timestamp column/literal (a parameter, so results are
    reproducible). Days are whole days elapsed since the release midnight.
    """
    rd = F.try_to_timestamp(col_of(release_date), F.lit("yyyy-MM-dd"))
    n = col_of(now)
    days = F.floor((F.unix_micros(n.cast("timestamp")) - F.unix_micros(rd)) / 86400000000).cast("int")
    return (F.when(rd.isNull(), F.lit(None).cast("string"))
            .when(rd > n.cast("timestamp"), "upcoming")
            .when(days <= 7, "just released").otherwise("released"))


def days_since(release_date, now) -> Column:
    """whole days from the release midnight to ``now``; negative before it, NULL for a bad date."""
    rd = F.try_to_timestamp(col_of(release_date), F.lit("yyyy-MM-dd"))
    return F.floor((F.unix_micros(col_of(now).cast("timestamp")) - F.unix_micros(rd))
                   / 86400000000).cast("int")


def release_year(release_date) -> Column:
    """first four characters of the date as an int, NULL if not a number."""
    return try_cast(F.substring(col_of(release_date), 1, 4), "int")


# --------------------------------------------------------------------- F21

def freshness_score(release_date, popularity, source, now, bonus_source="now_playing") -> Column:
    """``max(0, 100 - days/7) + 0.5*popularity + 20 if now_playing``.

    No or bad date counts as 9999 days. Future dates give negative days and
    so a freshness above 100, as upstream.
    """
    d = F.coalesce(days_since(release_date, now), F.lit(9999))
    return (F.greatest(F.lit(0.0), F.lit(100.0) - d / 7.0)
            + F.coalesce(col_of(popularity), F.lit(0.0)) * 0.5
            + F.when(col_of(source) == bonus_source, 20).otherwise(0))


# ---------------------------------------------------------- F20, F26, F27

def time_parts(ts) -> tuple[Column, Column]:
    """(hour, day of week with Monday = 0); 0 when the time is missing."""
    t = col_of(ts)
    return (F.coalesce(F.hour(t), F.lit(0)).cast("double"),
            F.coalesce(F.weekday(t), F.lit(0)).cast("double"))


def parse_basics_cols(start_year="startYear", runtime="runtimeMinutes", genres="genres"):
    """int year and runtime (NULL if not a number), genres as an array."""
    g = col_of(genres)
    return (try_cast(col_of(start_year), "int"), try_cast(col_of(runtime), "int"),
            F.when(g.isNotNull(), F.split(g, ",")).otherwise(F.array().cast("array<string>")))


def trend_features(imdb_rating="imdb_rating", imdb_votes="imdb_votes", imdb_year="imdb_year",
                   popularity="popularity", vote_average="vote_average", vote_count="vote_count",
                   mentions="reddit_mentions", sentiment="avg_sentiment", momentum="trend_momentum",
                   current_year: int = 2025) -> dict[str, Column]:
    """the engineered feature set of the rating-aware learner."""
    r = F.coalesce(col_of(imdb_rating), F.lit(0.0)).cast("double")
    v = F.coalesce(col_of(imdb_votes), F.lit(0)).cast("double")
    y = F.coalesce(col_of(imdb_year), F.lit(2020)).cast("double")
    p = F.coalesce(col_of(popularity), F.lit(0.0)).cast("double")
    va = F.coalesce(col_of(vote_average), F.lit(0.0)).cast("double")
    vc = F.coalesce(col_of(vote_count), F.lit(0)).cast("double")
    m = F.coalesce(col_of(mentions), F.lit(0)).cast("double")
    s = F.coalesce(col_of(sentiment), F.lit(0.0)).cast("double")
    return {
        "imdb_rating": r,
        "imdb_votes": v,
        "imdb_votes_log": F.log1p(v),
        "movie_age": F.lit(float(current_year)) - y,
        "tmdb_popularity": p,
        "tmdb_vote_average": va,
        "tmdb_vote_count": vc,
        "tmdb_vote_count_log": F.log1p(vc),
        "reddit_mentions": m,
        "reddit_mentions_log": F.log1p(m),
        "sentiment_score": s,
        "sentiment_positive": F.when(s > 0.2, 1.0).otherwise(0.0),
        "quality_score": r / 10.0 * (F.lit(1.0) + v / 100000.0),
        "engagement_rate": m / (v + 1),
        "trend_momentum": F.coalesce(col_of(momentum), F.lit(0.0)).cast("double"),
        "rating_popularity": r * p / 100,
        "sentiment_mentions": s * m,
    }


# --------------------------------------------------------------------- F32

def epoch_time(col) -> Column:
    """F32: epoch seconds to a UTC timestamp (no zone: wall clock in UTC)."""
    return F.timestamp_seconds(col_of(col)).cast("timestamp_ntz")


# --------------------------------------------------------------------- F34

def nested_credits(cast="cast", crew="crew", genres="genres", n_cast: int = 3):
    """(top-n cast names, director names, genre names as CSV).

    ``cast`` is ``array<struct<name, order>>`` in billing order, ``crew`` is
    ``array<struct<name, job>>``, ``genres`` is ``array<struct<name>>``.
    """
    top = F.transform(F.slice(col_of(cast), 1, n_cast), lambda p: p["name"])
    directors = F.transform(F.filter(col_of(crew), lambda p: p["job"] == "Director"),
                            lambda p: p["name"])
    g = F.array_join(F.transform(col_of(genres), lambda x: x["name"]), ",")
    return top, directors, g
