"""C4 review index and C5 title-metadata index.

Both are narrow per-row pipelines (filters, column functions, the encoder)
followed by one keyed merge into the stored collection: an anti join for
insert-if-absent (C4) and a per-key arg-max for last-write-wins (C5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentiment import LEXICON, sentiment
from ..functions.text import attribute_title, csv_head, doc_id, extract_mentions, search_text
from ..functions.vectors import embed_hashed
from ..operators.partitioning import spread
from ..operators.clean import index_filter, require
from ..sources.io import fresh_rows, upsert_last


def review_rows(feed: DataFrame, lexicon=LEXICON, embed: bool = True, keep=(), pick=None) -> DataFrame:
    """C4 without the merge: the review documents that would be stored.

    ``feed`` columns: ``text, author, source, subreddit, score, timestamp``
    and optionally ``comment_id, post_id, movie_title, movie_mentions``;
    ``keep`` lists further feed columns to carry through. ``pick`` chooses rows
    of the filtered feed with their ``__id``, before the text functions run.
    """
    cols = set(feed.columns)
    ident = doc_id(*[c if c in cols else F.lit(None).cast("string") for c in ("comment_id", "post_id")], content=F.col("text"))
    # the id may be a hash of the text: made before the rows are dealt out, so a reader of ids moves no text
    f = spread(index_filter(feed).withColumn("__id", ident))
    if pick is not None:
        f = pick(f)
    if "movie_mentions" not in cols:
        f = f.withColumn("movie_mentions", extract_mentions("text"))
    if "movie_title" not in cols:
        f = f.withColumn("movie_title", F.lit(None).cast("string"))
    title = attribute_title("source", "movie_title", "subreddit", "movie_mentions")
    rows = f.select(
        F.col("__id").alias("review_id"),
        "text",
        F.lower(title).alias("movie_title"), title.alias("movie_title_original"),
        "timestamp", sentiment("text", lexicon).alias("sentiment"),
        F.coalesce("source", F.lit("reddit")).alias("source"),
        F.coalesce("subreddit", F.lit("")).alias("subreddit"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.size("movie_mentions").cast("bigint").alias("mentions"),
        *keep,
    )
    return embed_hashed(rows, "text") if embed else rows


def index_reviews(feed: DataFrame, base: DataFrame | None = None, embed: bool = True,
                  order: str | None = None) -> DataFrame:
    """C4: feed -> review collection; an id already stored is skipped.

    Stored ids and repeats go before the text functions, so only rows that are added are scored and encoded.
    """
    stored = None if base is None else base.select(F.col("review_id").alias("__id"))
    rows = review_rows(feed, embed=embed, pick=lambda f: fresh_rows(f, stored, "__id", order))
    return rows if base is None else base.select(*rows.columns).unionByName(rows)


def metadata_rows(titles: DataFrame, embed: bool = True, keep=()) -> DataFrame:
    """C5 without the merge: one metadata document per title.

    ``titles``: ``id, title, overview, release_date, vote_average,
    popularity, media_type, genres (array), cast (array), keywords (array),
    imdb_rating``; ``keep`` lists further columns to carry through.
    """
    t = require(titles, ["id"])
    rows = t.select(
        F.concat(F.lit("tmdb_"), F.col("id").cast("string")).alias("meta_id"),
        search_text("title", "overview", "genres", "cast", "keywords").alias("document"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.col("id").cast("string").alias("tmdb_id"),
        F.coalesce("overview", F.lit("")).alias("overview"),
        F.coalesce("release_date", F.lit("")).alias("release_date"),
        F.coalesce(F.col("vote_average").cast("double"), F.lit(0.0)).alias("vote_average"),
        F.coalesce(F.col("popularity").cast("double"), F.lit(0.0)).alias("popularity"),
        F.coalesce("media_type", F.lit("movie")).alias("media_type"),
        csv_head("genres").alias("genres"), csv_head("cast", 10).alias("cast"),
        F.col("imdb_rating").cast("double").alias("imdb_rating"),
        csv_head("keywords", 10).alias("keywords"),
        *keep,
    )
    return embed_hashed(rows, "document") if embed else rows


def index_metadata(titles: DataFrame, base: DataFrame | None = None, order: str | None = None,
                   embed: bool = True) -> DataFrame:
    """Titles -> metadata collection, upsert by id (last write wins).

    ``order``: the column of ``titles`` by which the last of repeated ids is
    told; it is not stored.
    """
    rows = metadata_rows(titles, embed=embed, keep=[order] if order else [])
    stored = [c for c in rows.columns if c != order]
    base = rows.limit(0) if base is None else base
    return upsert_last(rows, base.select(*stored), ["meta_id"], order).select(*stored)
