"""C3 catalogue enrichment and U1 multi-source discovery.

C3: title dumps (basics, ratings, principals, names) enrich a catalogue feed.
Basics are filtered by type and joined to ratings; feed titles are matched
exactly, then by containment (the n-gram blocked join), then by original
title, else the feed's own rating is used; the matched title gets its top
billed credits pivoted into actors / directors / writers.

U1: several ranked source lists are unioned, tagged, and deduplicated on
(media type, id) with the earlier source winning; W8 ranks the result by
freshness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import composite_rating, freshness_score, parse_basics_cols
from ..operators.aggregate import credits_pivot
from ..operators.clean import isin_filter
from ..operators.joins import attach_ratings, credits, enrich_cascade
from ..operators.rank import rank_top, top_per_key

MOVIE_TYPES = ("movie", "tvMovie")


def parse_basics(basics: DataFrame) -> DataFrame:
    """typed year/runtime and genre list next to the raw columns."""
    year, runtime, genres = parse_basics_cols()
    return basics.withColumn("year", year).withColumn("runtime", runtime) \
        .withColumn("genre_list", genres)


def title_catalogue(basics: DataFrame, ratings: DataFrame, types: Sequence[str] = MOVIE_TYPES) -> DataFrame:
    """P12 + F20 + J4: typed titles of the wanted kinds with their ratings (left join)."""
    return attach_ratings(parse_basics(isin_filter(basics, "titleType", types)), ratings, "left")


def catalogue_enrich(basics: DataFrame, ratings: DataFrame, principals: DataFrame, names: DataFrame,
                     movies: DataFrame, types: Sequence[str] = MOVIE_TYPES, n_credits: int = 5) -> DataFrame:
    """One enriched row per feed movie.

    ``movies``: ``movie_id, title, original_title, vote_average,
    vote_count, release_date``.
    """
    cat = isin_filter(basics, "titleType", types)
    enriched = enrich_cascade(movies, cat, ratings)
    cr = credits_pivot(credits(principals, names, n_credits))
    rt = parse_basics(cat).select(F.col("tconst").alias("__id"), "runtime", "genre_list")
    out = (enriched.join(cr.withColumnRenamed("tconst", "__id"),
                         F.col("imdb_data.tconst") == F.col("__id"), "left").drop("__id")
           .join(rt, F.col("imdb_data.tconst") == F.col("__id"), "left").drop("__id"))
    empty = F.array().cast("array<string>")
    return out.select(
        "movie_id", "title", F.col("imdb_data.tconst").alias("tconst"),
        F.col("imdb_data.title").alias("imdb_title"), F.col("imdb_data.year").alias("year"), "runtime",
        F.col("imdb_data.imdb_rating").alias("imdb_rating"), F.col("imdb_data.imdb_votes").alias("imdb_votes"),
        F.col("imdb_data.source").alias("match_source"),
        composite_rating("vote_average", "imdb_data.imdb_rating").alias("composite_rating"),
        F.coalesce("actors", empty).alias("actors"), F.coalesce("directors", empty).alias("directors"),
        F.coalesce("writers", empty).alias("writers"), F.coalesce("genre_list", empty).alias("genres"))


def discover(sources: Sequence[tuple[str, str, DataFrame, int | None]], now,
             n: int | None = 20, order: Sequence[Column | str] = ("rank",)) -> DataFrame:
    """U1 + F21 + W8: union ranked sources, dedupe, rank by freshness.

    ``sources``: ``(name, media_type, df, top)`` in priority order; each
    ``df`` has ``id, title, popularity, release_date`` and the columns of
    ``order``, by which its list is sorted; ``top`` keeps only the first rows
    of a source (``None`` = all; the list is then never ranked as a whole).
    Dedupe key: (media type, id); the earlier source, then the better place
    in its list, wins.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = []
    for prio, (name, media, df, top) in enumerate(sources):
        d = df if top is None else df.orderBy(*by).limit(top)
        parts.append(d.withColumns({"discovery_source": F.lit(name), "media_type": F.lit(media),
                                    "__prio": F.lit(prio)}))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    dedup = top_per_key(u, ["media_type", "id"], [F.col("__prio"), *by], 1).drop("__prio")
    scored = dedup.withColumn("freshness", freshness_score("release_date", "popularity",
                                                           "discovery_source", now))
    return rank_top(scored, "freshness", n, tie=["discovery_source", "id"]) if n else scored


def merge_feeds(discussion: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review records join the discussion feed with ``source = 'tmdb'`` and
    ``score`` = their rating, or 5 when the rating is missing or 0."""
    r = reviews.withColumn("score", F.coalesce(F.nullif(F.col("rating").cast("double"), F.lit(0.0)),
                                               F.lit(5.0))) \
        .withColumn("source", F.lit("tmdb")).drop("rating")
    return discussion.unionByName(r, allowMissingColumns=True)
