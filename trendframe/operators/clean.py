"""Projections, filters and predicates.

All of these are narrow transformations (no shuffle). Filters are written as
plain column predicates so Catalyst pushes the simple ones into the Parquet
scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col_of
from ..functions.text import INDEX_BOILERPLATE, INDEX_EXCLUDED_AUTHORS


# ---------------------------------------------------------------- P1 - P3

def normalize_catalogue(df: DataFrame, source: str = "tmdb", enriched: bool = False) -> DataFrame:
    """The 15 catalogue fields, numeric gaps as 0 and text gaps as ''.

    ``enriched`` adds the nested ``imdb_data`` and ``credits`` structs
    (empty credits lists when missing).
    """
    def has(c):
        return c in df.columns

    def pick(c, default, dtype):
        return (F.coalesce(F.col(c).cast(dtype), F.lit(default).cast(dtype)) if has(c)
                else F.lit(default).cast(dtype)).alias(c)

    cols = [
        F.col("movie_id").cast("int").alias("movie_id") if has("movie_id") else F.col("id").cast("int").alias("movie_id"),
        F.col("title").alias("title"),
        (F.col("original_title") if has("original_title") else F.lit(None).cast("string")).alias("original_title"),
        pick("popularity", 0.0, "double"), pick("vote_average", 0.0, "double"),
        pick("vote_count", 0, "int"), pick("release_date", "", "string"),
        (F.coalesce(F.col("genre_ids"), F.array().cast("array<int>")) if has("genre_ids")
         else F.array().cast("array<int>")).alias("genre_ids"),
        pick("overview", "", "string"), pick("adult", False, "boolean"),
        pick("original_language", "", "string"), pick("poster_path", "", "string"),
        pick("backdrop_path", "", "string"), F.col("timestamp").cast("string").alias("timestamp"),
        F.lit(source).alias("source"),
    ]
    if enriched:
        empty = F.array().cast("array<string>")
        cols.append((F.col("imdb_data") if has("imdb_data") else F.lit(None).cast(
            "struct<tconst:string,title:string,year:int,imdb_rating:double,imdb_votes:bigint,source:string>"
        )).alias("imdb_data"))
        cr = F.col("credits") if has("credits") else F.lit(None).cast(
            "struct<cast:array<string>,directors:array<string>>")
        cols.append(F.struct(F.coalesce(cr["cast"], empty).alias("cast"),
                             F.coalesce(cr["directors"], empty).alias("directors")).alias("credits"))
    return df.select(*cols)


def coalesce_cols(*cols) -> Column:
    """First non-empty value (``title`` else ``name``; ``release_date`` else ``first_air_date``)."""
    return F.coalesce(*[F.nullif(col_of(c), F.lit("")) for c in cols])


def normalize_discussion(df: DataFrame, kind: str, title_as_mention: bool = False) -> DataFrame:
    """One discussion shape from a comment, post or targeted record.

    * ``comment``: text = body; id = comment id.
    * ``post``: mentions come from title + body while ``text`` is the body.
    * ``targeted``: id = post id for posts, else comment id. Such records name
      their title but mention none, so the trend job would drop them; with
      ``title_as_mention`` their title is their mention.
    Missing author becomes ``[deleted]``. Output columns are the canonical
    discussion columns; use ``unionByName(allowMissingColumns=True)`` to
    merge kinds.
    """
    from ..functions.text import extract_mentions

    author = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("[deleted]"))
    if kind == "comment":
        return df.select(F.col("comment_id"), "post_id", "post_title", "text",
                         author.alias("author"), "score", "created_utc",
                         extract_mentions(F.col("text")).alias("movie_mentions"),
                         "subreddit", "timestamp", F.lit("reddit").alias("source"),
                         F.lit("comment").alias("type"))
    if kind == "post":
        return df.select("post_id", "title", "text", author.alias("author"), "score",
                         "num_comments", "upvote_ratio", "created_utc",
                         extract_mentions(F.concat_ws(" ", "title", "text")).alias("movie_mentions"),
                         "subreddit", "url", "timestamp", F.lit("reddit").alias("source"),
                         F.lit("post").alias("type"))
    if kind == "targeted":
        return df.select(
            F.when(F.col("type") == "post", F.col("post_id")).otherwise(F.col("comment_id")).alias("id"),
            "type", "movie_id", "movie_title", "movie_year", "search_query", "text",
            author.alias("author"), "score", "subreddit", "timestamp",
            (F.when(F.col("movie_title").isNotNull(), F.array("movie_title")) if title_as_mention
             else F.lit(None).cast("array<string>")).alias("movie_mentions"),
            F.lit("reddit_targeted").alias("source"), F.lit(True).alias("targeted_search"))
    raise ValueError(kind)


# ---------------------------------------------------------------- P4 - P8

def gate(df: DataFrame, mentions: str = "movie_mentions", text: str = "text",
         min_len: int = 50) -> DataFrame:
    """Publish a message if it mentions something or is longer than ``min_len``."""
    return df.filter((F.coalesce(F.size(mentions), F.lit(0)) > 0)
                     | (F.coalesce(F.length(text), F.lit(0)) > min_len))


# The characters Python's ``str.strip()`` removes (``str.isspace``), derived by rule.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace like ``str.strip()`` (no regex)."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def index_filter(df: DataFrame, text: str = "text", author: str = "author", min_len: int = 50,
                 authors: Sequence[str] = INDEX_EXCLUDED_AUTHORS,
                 phrases: Sequence[str] = INDEX_BOILERPLATE) -> DataFrame:
    """P5: text worth indexing - long enough, not a bot, not boilerplate."""
    t = F.coalesce(F.col(text), F.lit(""))
    # what a text's beginning holds it holds as a whole: only others are stripped whole
    cond = ((F.length(strip_ws(F.substring(t, 1, 4 * min_len))) >= min_len) | (F.length(strip_ws(t)) >= min_len)) & \
        ~F.lower(F.coalesce(F.col(author), F.lit(""))).isin(*authors)
    if phrases:  # an array of one, so that a text is lower-cased once, not once a phrase
        cond = cond & ~F.exists(F.array(F.lower(t)), lambda low: reduce(or_, [low.contains(p) for p in phrases]))
    return df.filter(cond)


# Bot markers of the quality filter (case-sensitive).
QUALITY_MARKERS = ("I am a bot", "[deleted]", "[removed]", "AutoModerator")


def quality_filter(df: DataFrame, text: str = "text", lo: int = 50, hi: int = 1000,
                   markers: Sequence[str] = QUALITY_MARKERS) -> DataFrame:
    """Keep ``lo``..``hi`` characters without bot markers (case-sensitive)."""
    t = F.col(text)
    cond = F.length(t).between(lo, hi)
    for m in markers:
        cond = cond & ~t.contains(m)
    return df.filter(cond)


# Topic words of the topic filter.
TOPIC_WORDS = ("movie", "film", "watch", "review")


def topic_filter(df: DataFrame, col: str = "title", words: Sequence[str] = TOPIC_WORDS) -> DataFrame:
    """Keep rows whose (lower-cased) title holds any topic word."""
    low = F.lower(F.col(col))
    cond = F.lit(False)
    for w in words:
        cond = cond | low.contains(w)
    return df.filter(cond)


def explode_mentions(df: DataFrame, col: str = "movie_mentions", out: str = "movie_title",
                     keep: Sequence[str] = ()) -> DataFrame:
    """One row per mention; rows without mentions (or NULL) drop out."""
    return df.filter(F.size(col) > 0).select(F.explode(col).alias(out), *keep)


# --------------------------------------------------------------- P9 - P15

def recent(df: DataFrame, ts: str, hours: float, now, inclusive: bool = False,
           keep_bad: bool = False) -> DataFrame:
    """Rows newer than ``now - hours``.

    ``now`` is a parameter (literal or column) so results are reproducible.
    ``ts`` may be a timestamp or an ISO string; with ``keep_bad`` rows whose
    time does not parse are kept (the lenient post-filter of retrieval).
    """
    t = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        t = F.try_to_timestamp(t)
    cutoff = col_of(now).cast("timestamp") - F.make_interval(secs=F.lit(float(hours) * 3600.0))
    cutoff = cutoff.cast("timestamp_ntz") if dict(df.dtypes).get(ts) == "timestamp_ntz" else cutoff
    cond = (t >= cutoff) if inclusive else (t > cutoff)
    if keep_bad:
        cond = t.isNull() | cond
    return df.filter(cond)


def title_contains(df: DataFrame, col: str, s: str) -> DataFrame:
    """Case-insensitive substring match on a title."""
    return df.filter(F.locate(s.lower(), F.lower(F.col(col))) > 0)


def isin_filter(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep rows whose ``col`` is in a fixed set."""
    return df.filter(F.col(col).isin(*values))


def drop_unknown(df: DataFrame, col: str) -> DataFrame:
    """Drop blank or ``unknown`` keys (after lower + trim)."""
    k = F.lower(F.trim(F.col(col)))
    return df.filter(k.isNotNull() & (k != "") & (k != "unknown"))


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL or empty text."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return df.filter(cond)
