"""Joins (J2-J10, J12).

Equi joins are left to Catalyst and adaptive execution: a side is broadcast
only when its measured runtime size is under the broadcast threshold, else
both sides are shuffled on the keys (and skewed partitions split).
The containment join (J7) is blocked on character n-grams so it never forms
the product of the two title sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import try_cast
from ..functions.text import match_any, norm_key, title_variants


def enrich_left(cat: DataFrame, stats: DataFrame, cat_key: str = "title", stats_key: str = "title_key",
                defaults: dict | None = None) -> DataFrame:
    """Catalogue rows left-joined to per-title statistics on the lower-cased title."""
    c = cat.withColumn("__k", F.lower(F.col(cat_key)))
    j = c.join(stats.withColumnRenamed(stats_key, "__k"), "__k", "left").drop("__k")
    for col, v in (defaults or {}).items():
        j = j.withColumn(col, F.coalesce(F.col(col), F.lit(v)))
    return j


def known_only(disc: DataFrame, cat: DataFrame, disc_key: str = "movie_title",
               cat_key: str = "title") -> DataFrame:
    """Discussion rows whose lower-cased title is a catalogue title (semi join)."""
    keys = cat.select(F.lower(F.col(cat_key)).alias("__k")).distinct()
    return disc.withColumn("__k", F.lower(F.col(disc_key))).join(keys, "__k", "left_semi").drop("__k")


def attach_ratings(basics: DataFrame, ratings: DataFrame, how: str = "left") -> DataFrame:
    """Title basics with their rating and vote count (left or inner)."""
    return basics.join(ratings, "tconst", how)


def credits(principals: DataFrame, names: DataFrame, limit: int = 5, key: str = "tconst",
            order: str = "ordering") -> DataFrame:
    """The first ``limit`` principals per title (billing order), with names.

    The cap is applied before the name lookup, as upstream: a capped
    principal without a known name is simply dropped afterwards. The cap is
    a partial group limit before the shuffle, so hot titles are cheap.
    """
    from .rank import top_per_key

    top = top_per_key(principals, [key], [F.col(order)], limit)
    return top.join(names, "nconst", "inner")


def _grams(col, n: int):
    """All character n-grams of a string column (empty array if shorter)."""
    s = F.col(col) if isinstance(col, str) else col
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))),
                       lambda i: s.substr(i, F.lit(n)))


def _all_short_grams(col: str):
    """All 1- and 2-character substrings (blocking keys for very short titles)."""
    s = F.col(col)
    return F.array_distinct(F.concat(_grams(s, 1), F.filter(_grams(s, 2), lambda g: F.length(g) == 2)))


def match_titles(queries: DataFrame, catalogue: DataFrame, q_col: str = "query_title",
                 title_col: str = "primaryTitle", id_col: str = "tconst", pos_col: str = "pos",
                 skip_empty: bool = True) -> DataFrame:
    """Fuzzy title match.

    Tier 1: exact match of ``lower(trim(title))``. Tier 2 (rest): the first
    catalogue title, in catalogue order, that contains the query title or is
    contained in it. Duplicate catalogue titles keep the position of their
    first row and the id of their last row (keyed-map semantics).

    Tier 2 is an n-gram blocked join, exact and product-free: if ``q`` is a
    substring of ``t`` then every 3-gram of ``q`` occurs in ``t``, so
    ``q`` only needs to meet the titles holding its *rarest* 3-gram (and
    symmetrically). A ``q`` of up to 3 characters looks up the first title of
    that gram; a ``t`` under 3 characters blocks on its whole value. Every candidate is re-checked with ``contains``
    and the earliest catalogue position wins per query (an aggregate, so
    map-side combined).
    """
    cat = (catalogue.select(norm_key(title_col).alias("t"), F.col(id_col).alias("id"),
                            F.col(pos_col).alias("pos"))
           .filter(F.col("t").isNotNull())
           .groupBy("t").agg(F.min("pos").alias("pos"), F.max_by("id", "pos").alias("id")))
    q = queries.select(F.col(q_col).alias("query_title")).distinct() \
        .withColumn("q", norm_key("query_title")).filter(F.col("q").isNotNull())
    if skip_empty:
        q = q.filter(F.col("q") != "")

    exact = q.join(cat.withColumnRenamed("t", "q"), "q", "inner") \
             .select("query_title", "id", F.lit("exact").alias("match"))
    rest = q.join(cat.select(F.col("t").alias("q")), "q", "left_anti")

    # q inside t: block on q's rarest 3-gram (frequency among catalogue titles)
    cgrams = cat.select("t", "pos", "id", F.explode(F.array_distinct(_grams("t", 3))).alias("g")) \
        .filter(F.length("g") == 3)
    gfreq = cgrams.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    qlong = rest.filter(F.length("q") > 3)
    qg = (qlong.select("query_title", "q", F.explode(F.array_distinct(_grams("q", 3))).alias("g"))
          .join(gfreq, "g", "left")
          .groupBy("query_title", "q").agg(F.min_by("g", F.coalesce("f", F.lit(0))).alias("g")))
    in_t = qg.join(cgrams, "g").filter(F.col("t").contains(F.col("q")))
    # a q of up to three characters is a gram itself: the first title of each gram
    # is found before the join, so a common gram is one row
    cshort = cat.select("pos", "id", F.explode(F.array_distinct(F.concat(_all_short_grams("t"), _grams("t", 3)))).alias("g"))
    first_of = cshort.groupBy("g").agg(F.min("pos").alias("pos"), F.min_by("id", "pos").alias("id"))
    qshort = rest.filter(F.length("q") <= 3).withColumn("g", F.col("q"))
    in_t_short = qshort.join(first_of, "g")
    # t inside q: block on t's rarest 3-gram (frequency among query titles)
    qgrams = rest.select("query_title", "q", F.explode(F.array_distinct(_grams("q", 3))).alias("g")) \
        .filter(F.length("g") == 3)
    qfreq = qgrams.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    tg = (cat.filter(F.length("t") >= 3)
          .select("t", "pos", "id", F.explode(F.array_distinct(_grams("t", 3))).alias("g"))
          .join(qfreq, "g", "left")
          .groupBy("t", "pos", "id").agg(F.min_by("g", F.coalesce("f", F.lit(0))).alias("g")))
    t_in = tg.join(qgrams, "g").filter(F.col("q").contains(F.col("t")))
    # very short t inside q (an empty t is inside every q)
    qshortg = rest.select("query_title", "q", F.explode(_all_short_grams("q")).alias("g"))
    tshort = cat.filter((F.length("t") < 3) & (F.length("t") > 0)).withColumn("g", F.col("t"))
    t_in_short = tshort.join(qshortg, "g")

    cols = ["query_title", "pos", "id"]
    cands = (in_t.select(*cols).unionByName(in_t_short.select(*cols))
             .unionByName(t_in.select(*cols)).unionByName(t_in_short.select(*cols)))
    partial = cands.groupBy("query_title").agg(F.min("pos").alias("pos"), F.min_by("id", "pos").alias("id"))
    # An empty catalogue title is inside every query title; with
    # ``skip_empty=False`` an empty query title is inside every catalogue
    # title. Each case contributes one catalogue row (the catalogue is grouped
    # by title), a scalar subquery of the plan - no product, and no job here.
    one = F.min_by(F.struct("pos", "id"), "pos").alias("one")
    special = [(F.col("q") != "", cat.filter(F.col("t") == "").agg(one).scalar())]
    if not skip_empty:
        special.append((F.col("q") == "", cat.agg(one).scalar()))
    r = rest.select("query_title", "q").join(partial, "query_title", "left")
    for cond, found in special:
        better = cond & found["pos"].isNotNull() & (F.col("pos").isNull() | (found["pos"] < F.col("pos")))
        r = r.withColumn("id", F.when(better, found["id"]).otherwise(F.col("id"))) \
             .withColumn("pos", F.when(better, found["pos"]).otherwise(F.col("pos")))
    partial = r.filter(F.col("id").isNotNull())
    partial = partial.select("query_title", "id", F.lit("partial").alias("match"))
    return exact.unionByName(partial)


def enrich_cascade(movies: DataFrame, catalogue: DataFrame, ratings: DataFrame) -> DataFrame:
    """Catalogue match by title, else by original title, else own rating.

    ``movies``: ``movie_id, title, original_title, vote_average, vote_count,
    release_date``. Result: one ``imdb`` struct per movie with the matched
    id, rating and votes, ``source`` = ``dataset`` or ``tmdb_fallback``.
    """
    # Each movie asks with its title (priority 1) and, if different, its
    # original title (priority 2); one match over all spellings, joined once,
    # and the best priority per movie wins (an aggregate, map-side combined).
    asks = movies.select("movie_id", F.col("title").alias("query_title"), F.lit(1).alias("__p")).unionByName(
        movies.filter(F.col("original_title").isNotNull() & (F.col("original_title") != F.col("title")))
        .select("movie_id", F.col("original_title").alias("query_title"), F.lit(2).alias("__p")))
    m = match_titles(asks.select("query_title"), catalogue)
    best = (asks.join(m, "query_title").groupBy("movie_id")
            .agg(F.min_by("id", "__p").alias("id")))
    r = ratings.select(F.col("tconst").alias("id"), "averageRating", "numVotes")
    c = catalogue.select(F.col("tconst").alias("id"), F.col("primaryTitle").alias("__t"),
                         try_cast("startYear", "int").alias("__y"))
    found = best.join(r, "id", "left").join(c, "id", "left").select("movie_id", F.struct(
        F.col("id").alias("tconst"), F.col("__t").alias("title"), F.col("__y").alias("year"),
        F.col("averageRating").alias("imdb_rating"), F.col("numVotes").cast("bigint").alias("imdb_votes"),
        F.lit("dataset").alias("source")).alias("__m"))
    year = try_cast(F.substring(F.coalesce(F.col("release_date"), F.lit("")), 1, 4), "int")
    fallback = F.struct(F.concat(F.lit("tmdb_"), F.col("movie_id").cast("string")).alias("tconst"),
                        F.col("title").alias("title"), year.alias("year"),
                        F.col("vote_average").cast("double").alias("imdb_rating"),
                        F.col("vote_count").cast("bigint").alias("imdb_votes"),
                        F.lit("tmdb_fallback").alias("source"))
    j = movies.join(found, "movie_id", "left")
    return j.withColumn("imdb_data", F.coalesce(F.col("__m"), fallback)).drop("__m")


def attach_metadata(df: DataFrame, meta: DataFrame, key: str = "title") -> DataFrame:
    """Fill release date, vote, rating and overview from title metadata
    (exact title); misses get ``N/A`` / 0 / 0 / ''."""
    m = meta.select(F.col("title").alias(key), F.col("release_date").alias("__rd"),
                    F.col("vote_average").alias("__va"), F.col("imdb_rating").alias("__ir"),
                    F.col("overview").alias("__ov"))
    # Upstream looks the title up with limit 1: keep one metadata row per title, the
    # one with the newest release date, then the best rating (the same on every run).
    m = m.groupBy(key).agg(F.max(F.struct("__rd", "__ir", "__va", "__ov")).alias("__m")) \
        .select(key, "__m.*")
    return (df.join(m, key, "left")
            .withColumn("releaseDate", F.coalesce(F.col("__rd"), F.lit("N/A")))
            .withColumn("voteAverage", F.coalesce(F.col("__va"), F.lit(0.0)))
            .withColumn("imdbRating", F.coalesce(F.col("__ir"), F.lit(0.0)))
            .withColumn("overview", F.coalesce(F.col("__ov"), F.lit("")))
            .drop("__rd", "__va", "__ir", "__ov"))


def variant_match(df: DataFrame, text: str, title) -> DataFrame:
    """Flag texts that contain any spelling variant of a title."""
    return df.withColumn("is_match", match_any(text, title_variants(title)))
