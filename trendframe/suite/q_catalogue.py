"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as T
from ..operators import rank as R
from ..operators.aggregate import credits_pivot, discovery_counts
from ..operators.joins import attach_metadata, attach_ratings, credits, match_titles
from ..plans.catalogue import catalogue_enrich, discover, merge_feeds, title_catalogue
from ..sources import testbed as tb
from . import register, rounded

TYPES = ("ECONOMY", "MEDIUM", "PROMO", "STANDARD")
_TYPES_SQL = ", ".join(f"'{t}'" for t in TYPES)

_CAT = f"""
catf AS (SELECT * FROM basics WHERE titleType IN ({_TYPES_SQL})),
cat AS (SELECT lower(trim(primaryTitle)) AS t, min(pos) AS pos, arg_max(tconst, pos) AS id
        FROM catf WHERE primaryTitle IS NOT NULL GROUP BY 1)"""


def _match_sql(qsrc: str) -> str:
    return f"""(
  WITH q AS (SELECT DISTINCT query_title, lower(trim(query_title)) AS q FROM ({qsrc}) s
             WHERE query_title IS NOT NULL AND lower(trim(query_title)) <> '')
  SELECT q.query_title, c.id, 'exact' AS match FROM q JOIN cat c ON c.t = q.q
  UNION ALL
  SELECT q.query_title, arg_min(c.id, c.pos) AS id, 'partial' AS match
  FROM q JOIN cat c ON contains(c.t, q.q) OR contains(q.q, c.t)
  WHERE q.q NOT IN (SELECT t FROM cat)
  GROUP BY q.query_title)"""


_CREDITS = """
cr AS (SELECT p.tconst, p.ordering, p.category, n.primaryName
       FROM (SELECT * FROM principals QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY ordering) <= 5) p
       JOIN names n ON n.nconst = p.nconst),
pv AS (SELECT tconst,
              coalesce(list(primaryName ORDER BY ordering) FILTER (WHERE category IN ('actor', 'actress')), [])
                  AS actors,
              coalesce(list(primaryName ORDER BY ordering) FILTER (WHERE category = 'director'), []) AS directors,
              coalesce(list(primaryName ORDER BY ordering) FILTER (WHERE category = 'writer'), []) AS writers
       FROM cr GROUP BY tconst)"""

_C3 = _CAT + "," + _CREDITS + f""",
m1 AS {_match_sql("SELECT title AS query_title FROM movies")},
m2 AS {_match_sql("SELECT original_title AS query_title FROM movies")},
e AS (SELECT mv.*,
             CASE WHEN m1.id IS NOT NULL THEN m1.id
                  WHEN mv.original_title IS NOT NULL AND mv.original_title <> mv.title THEN m2.id END AS mid
      FROM movies mv LEFT JOIN m1 ON m1.query_title = mv.title
                     LEFT JOIN m2 ON m2.query_title = mv.original_title),
c3 AS (
  SELECT e.movie_id, e.title, e.release_date, coalesce(e.mid, 'tmdb_' || CAST(e.movie_id AS VARCHAR)) AS tconst,
         CASE WHEN e.mid IS NOT NULL THEN cf.primaryTitle ELSE e.title END AS imdb_title,
         CASE WHEN e.mid IS NOT NULL THEN TRY_CAST(cf.startYear AS INTEGER)
              ELSE TRY_CAST(substr(coalesce(e.release_date, ''), 1, 4) AS INTEGER) END AS year,
         TRY_CAST(cf.runtimeMinutes AS INTEGER) AS runtime,
         CASE WHEN e.mid IS NOT NULL THEN r.averageRating ELSE CAST(e.vote_average AS DOUBLE) END AS imdb_rating,
         CASE WHEN e.mid IS NOT NULL THEN CAST(r.numVotes AS BIGINT) ELSE CAST(e.vote_count AS BIGINT) END
             AS imdb_votes,
         CASE WHEN e.mid IS NOT NULL THEN 'dataset' ELSE 'tmdb_fallback' END AS match_source,
         e.vote_average,
         coalesce(pv.actors, []) AS actors, coalesce(pv.directors, []) AS directors,
         coalesce(pv.writers, []) AS writers,
         CASE WHEN cf.genres IS NOT NULL THEN string_split(cf.genres, ',') ELSE [] END AS genres
  FROM e LEFT JOIN catf cf ON cf.tconst = e.mid LEFT JOIN ratings r ON r.tconst = e.mid
         LEFT JOIN pv ON pv.tconst = e.mid)"""


def _c3_sql(select: str) -> str:
    return tb.with_ctes(select, "basics", "ratings", "principals", "names", "movies", extra=_C3)


def _c3(spark, d):
    return catalogue_enrich(tb.basics(spark, d), tb.ratings(spark, d), tb.principals(spark, d),
                            tb.names(spark, d), tb.movies(spark, d), types=TYPES)


@register("catalogue_enrich", _c3_sql("""
SELECT movie_id, title, tconst, imdb_title, year, runtime, imdb_rating, imdb_votes, match_source,
       CASE WHEN vote_average IS NOT NULL AND vote_average <> 0 AND imdb_rating IS NOT NULL AND imdb_rating <> 0
            THEN round(vote_average * 0.5 + imdb_rating * 0.5, 6) END AS composite_rating,
       array_to_string(actors, ', ') AS actors, array_to_string(directors, ', ') AS directors,
       array_to_string(writers, ', ') AS writers, array_to_string(genres, ', ') AS genres
FROM c3"""))
def q_catalogue_enrich(spark, d):
    """C3 (P12 F20 J4 J7 J8 J6 A8 F29): enriched catalogue rows."""
    out = _c3(spark, d)
    for c in ("actors", "directors", "writers", "genres"):
        out = out.withColumn(c, F.array_join(c, ", "))
    return rounded(out)


@register("search_queries", _c3_sql("""
SELECT movie_id,
       array_to_string(list_filter([
         CASE WHEN substr(release_date, 1, 4) <> '' THEN title || ' ' || substr(release_date, 1, 4) ELSE title END,
         CASE WHEN len(actors) > 0 THEN title || ' ' || array_to_string(actors[1:2], ' ') END,
         CASE WHEN len(directors) > 0 THEN title || ' ' || directors[1] END], lambda q: q IS NOT NULL), ' | ')
         AS queries
FROM c3"""))
def q_search_queries(spark, d):
    """ordered search queries per enriched movie."""
    out = _c3(spark, d).join(tb.movies(spark, d).select("movie_id", "release_date"), "movie_id")
    q = T.build_queries("title", "release_date", "actors", "directors")
    return out.select("movie_id", F.array_join(q, " | ").alias("queries"))


@register("match_titles", tb.with_ctes(f"""
SELECT query_title, id, match FROM {_match_sql("SELECT title AS query_title FROM movies")}""",
    "basics", "movies", extra=_CAT))
def q_match_titles(spark, d):
    """Exact, then containment title match (n-gram blocked, product-free)."""
    cat = tb.basics(spark, d).filter(F.col("titleType").isin(*TYPES))
    return match_titles(tb.movies(spark, d).select(F.col("title").alias("query_title")), cat)


@register("title_catalogue", tb.with_ctes(f"""
SELECT b.tconst, TRY_CAST(b.startYear AS INTEGER) AS year, TRY_CAST(b.runtimeMinutes AS INTEGER) AS runtime,
       array_to_string(CASE WHEN b.genres IS NOT NULL THEN string_split(b.genres, ',') ELSE [] END, '|') AS genres,
       r.averageRating, r.numVotes
FROM basics b LEFT JOIN ratings r ON r.tconst = b.tconst
WHERE b.titleType IN ({_TYPES_SQL})""", "basics", "ratings"))
def q_title_catalogue(spark, d):
    """P12 + F20 + J4: typed titles of the wanted kinds with ratings (left join)."""
    t = title_catalogue(tb.basics(spark, d), tb.ratings(spark, d), TYPES)
    return t.select("tconst", "year", "runtime", F.array_join("genre_list", "|").alias("genres"),
                    "averageRating", "numVotes")


@register("ratings_left", tb.with_ctes("""
SELECT b.tconst, r.averageRating, r.numVotes FROM basics b LEFT JOIN ratings r ON r.tconst = b.tconst""",
    "basics", "ratings"))
def q_ratings_left(spark, d):
    """All titles with their rating if any."""
    return attach_ratings(tb.basics(spark, d), tb.ratings(spark, d), "left") \
        .select("tconst", "averageRating", "numVotes")


@register("credits", tb.with_ctes("SELECT tconst, ordering, category, primaryName FROM cr",
                                  "principals", "names", extra=_CREDITS))
def q_credits(spark, d):
    """First five billed people per title (cap before the name lookup)."""
    return credits(tb.principals(spark, d), tb.names(spark, d)) \
        .select("tconst", "ordering", "category", "primaryName")


@register("credits_pivot", tb.with_ctes("""
SELECT tconst, array_to_string(actors, ', ') AS actors, array_to_string(directors, ', ') AS directors,
       array_to_string(writers, ', ') AS writers FROM pv""", "principals", "names", extra=_CREDITS))
def q_credits_pivot(spark, d):
    """Actors / directors / writers per title in billing order."""
    p = credits_pivot(credits(tb.principals(spark, d), tb.names(spark, d)))
    return p.select("tconst", *[F.array_join(c, ", ").alias(c) for c in ("actors", "directors", "writers")])


# ------------------------------------------------------------------- U1 etc.

_SOURCES = (("trending_movie", "view", "movie", None), ("trending_tv", "click", "tv", None),
            ("now_playing", "purchase", "movie", 10), ("popular_tv", "signup", "tv", 10),
            ("popular", "error", "movie", 5))


def _source(spark, d, event_type, media, prio):
    ev = tb.table(spark, d, "events").filter(F.col("event_type") == event_type)
    # the lists overlap in part: each later one has ids of its own
    ev = ev.withColumn("id", F.get_json_object("props", "$.k").cast("int") + 40 * prio)
    rd = F.date_format(F.date_add(F.lit("2023-10-01").cast("date"), F.col("id") * 2), "yyyy-MM-dd")
    return ev.select("id", F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"),
                     F.col("value").alias("popularity"),
                     (rd if media == "movie" else F.lit(None).cast("string")).alias("release_date"),
                     "event_id")


def _discover(spark, d, n=20):
    srcs = [(name, media, _source(spark, d, et, media, prio), top)
            for prio, (name, et, media, top) in enumerate(_SOURCES)]
    return discover(srcs, F.lit(tb.TODAY).cast("timestamp"), n, order=[F.col("popularity").desc(), F.col("event_id")])


def _discover_sql(select: str) -> str:
    parts = []
    for prio, (name, et, media, top) in enumerate(_SOURCES):
        rd = ("strftime(DATE '2023-10-01' + id * 2, '%Y-%m-%d')" if media == "movie" else "CAST(NULL AS VARCHAR)")
        lim = f"WHERE rank <= {top}" if top else ""
        parts.append(f"""SELECT id, 'Title ' || CAST(id AS VARCHAR) AS title, popularity, {rd} AS release_date, rank,
               '{name}' AS discovery_source, '{media}' AS media_type, {prio} AS prio
        FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) + {40 * prio} AS id, value AS popularity,
                     row_number() OVER (ORDER BY value DESC, event_id) AS rank
              FROM events WHERE event_type = '{et}') {lim}""")
    union = "\n        UNION ALL ".join(parts)
    fresh = ("greatest(0.0, 100.0 - CAST(coalesce(date_diff('day', try_strptime(release_date, '%Y-%m-%d'), "
             f"TIMESTAMP '{tb.TODAY}'), 9999) AS DOUBLE) / 7) + coalesce(popularity, 0.0) * 0.5 "
             "+ CASE WHEN discovery_source = 'now_playing' THEN 20 ELSE 0 END")
    return f"""WITH u AS ({union}),
dd AS (SELECT * EXCLUDE (prio) FROM u
       QUALIFY row_number() OVER (PARTITION BY media_type, id ORDER BY prio, rank) = 1),
fr AS (SELECT *, {fresh} AS freshness FROM dd)
{select}"""


@register("discover", _discover_sql("""
SELECT id, title, media_type, discovery_source, round(freshness, 6) AS freshness
FROM fr ORDER BY freshness DESC, discovery_source, id LIMIT 20"""))
def q_discover(spark, d):
    """U1 + F21 + W8: five ranked sources, deduped, top 20 by freshness."""
    return rounded(_discover(spark, d).select("id", "title", "media_type", "discovery_source", "freshness"))


@register("discovery_counts", _discover_sql("SELECT discovery_source, count(*) AS n FROM fr GROUP BY 1"))
def q_discovery_counts(spark, d):
    """Rows per discovery source after the dedupe."""
    return discovery_counts(_discover(spark, d, n=None))


@register("merge_feeds", tb.with_ctes("""
SELECT post_id, movie_title, score, source FROM discussion
UNION ALL
SELECT NULL AS post_id, d.source AS movie_title,
       coalesce(nullif(CASE WHEN l.quality = 1 THEN 8.0 WHEN l.quality = 0 THEN 0.0 END, 0.0), 5.0) AS score,
       'tmdb' AS source
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""", "discussion"))
def q_merge_feeds(spark, d):
    """Review records merged into the discussion feed (score = rating or 5)."""
    disc = tb.discussion(spark, d).select("post_id", "movie_title", "score", "source")
    docs, labels = tb.table(spark, d, "documents"), tb.table(spark, d, "labels")
    rev = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("movie_title"),
        F.when(F.col("quality") == 1, 8.0).when(F.col("quality") == 0, 0.0).alias("rating"))
    return merge_feeds(disc, rev).select("post_id", "movie_title", "score", "source")


@register("first_sufficient", """
WITH c AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT l_partkey, min(l_linenumber) AS stop FROM c WHERE n >= 5 GROUP BY 1)
SELECT l.l_orderkey, l.l_partkey, l.l_linenumber FROM lineitem l LEFT JOIN s ON s.l_partkey = l.l_partkey
WHERE s.stop IS NULL OR l.l_linenumber <= s.stop""")
def q_first_sufficient(spark, d):
    """Per title, results of query variants up to the first with >= 5 results
    (variant = line number, result = line item)."""
    li = tb.table(spark, d, "lineitem")
    return R.first_sufficient(li, "l_partkey", "l_linenumber", 5).select("l_orderkey", "l_partkey",
                                                                          "l_linenumber")


@register("cap_per_parent", """
SELECT source, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""")
def q_cap_per_parent(spark, d):
    """At most 10 comments per post (source) in arrival order."""
    return R.cap_per_key(tb.table(spark, d, "documents"), "source", "doc_id", 10).select("source", "doc_id")


@register("nested_credits", """
WITH n AS (SELECT p_partkey,
                  list_transform(string_split(p_name, ' '), lambda w, i: {'name': w, 'ord': i}) AS cast_list,
                  [{'name': p_brand, 'job': 'Director'}, {'name': p_type, 'job': 'Producer'},
                   {'name': upper(p_name), 'job': 'Director'}] AS crew,
                  [{'name': p_type}, {'name': p_brand}] AS genres
           FROM part)
SELECT p_partkey,
       array_to_string(list_transform(cast_list[1:3], lambda c: c.name), ', ') AS top_cast,
       array_to_string(list_transform(list_filter(crew, lambda c: c.job = 'Director'), lambda c: c.name), ', ')
           AS directors,
       array_to_string(list_transform(genres, lambda g: g.name), ',') AS genres
FROM n""")
def q_nested_credits(spark, d):
    """names from nested cast / crew / genre structs."""
    p = tb.table(spark, d, "part")
    cast = F.transform(F.split("p_name", " "), lambda w, i: F.struct(w.alias("name"), (i + 1).alias("ord")))
    crew = F.array(F.struct(F.col("p_brand").alias("name"), F.lit("Director").alias("job")),
                   F.struct(F.col("p_type").alias("name"), F.lit("Producer").alias("job")),
                   F.struct(F.upper("p_name").alias("name"), F.lit("Director").alias("job")))
    genres = F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name")))
    n = p.select("p_partkey", cast.alias("cast"), crew.alias("crew"), genres.alias("genres"))
    top, dirs, g = S.nested_credits("cast", "crew", "genres", 3)
    return n.select("p_partkey", F.array_join(top, ", ").alias("top_cast"),
                    F.array_join(dirs, ", ").alias("directors"), g.alias("genres"))


@register("release_dates", tb.with_ctes(f"""
SELECT event_id, TRY_CAST(substr(release_date, 1, 4) AS INTEGER) AS release_year,
       CASE WHEN try_strptime(release_date, '%Y-%m-%d') IS NULL THEN NULL
            WHEN try_strptime(release_date, '%Y-%m-%d') > TIMESTAMP '{tb.TODAY}' THEN 'upcoming'
            WHEN date_diff('day', try_strptime(release_date, '%Y-%m-%d'), TIMESTAMP '{tb.TODAY}') <= 7
                THEN 'just released'
            ELSE 'released' END AS status,
       CAST(date_diff('day', try_strptime(release_date, '%Y-%m-%d'), TIMESTAMP '{tb.TODAY}') AS INTEGER) AS days_since
FROM catalogue""", "catalogue"))
def q_release_dates(spark, d):
    """F14 + F15: release year and status relative to a fixed day."""
    c = tb.catalogue(spark, d)
    now = F.lit(tb.TODAY).cast("timestamp")
    return c.select("event_id", S.release_year("release_date").alias("release_year"),
                    S.release_status("release_date", now).alias("status"),
                    S.days_since("release_date", now).alias("days_since"))


@register("time_parts", """
SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week,
       make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS ts_seconds
FROM events""")
def q_time_parts(spark, d):
    """F26 + F32: hour, weekday (Monday = 0), epoch seconds back to a UTC time."""
    ev = tb.table(spark, d, "events")
    h, dow = S.time_parts("ts")
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return ev.select("event_id", h.alias("hour"), dow.alias("day_of_week"),
                     S.epoch_time(secs).alias("ts_seconds"))


@register("metadata_lookup", _c3_sql("""
SELECT m.title, coalesce(x.release_date, 'N/A') AS releaseDate,
       coalesce(x.vote_average, 0.0) AS voteAverage, coalesce(x.imdb_rating, 0.0) AS imdbRating
FROM (SELECT DISTINCT title FROM movies) m
LEFT JOIN (SELECT imdb_title AS title, arg_min(release_date, movie_id) AS release_date,
                  arg_min(vote_average, movie_id) AS vote_average, arg_min(imdb_rating, movie_id) AS imdb_rating
           FROM c3 WHERE match_source = 'dataset' GROUP BY imdb_title) x ON x.title = m.title"""))
def q_metadata_lookup(spark, d):
    """Fill release date and ratings from title metadata (exact title), defaults otherwise."""
    c3 = _c3(spark, d).filter(F.col("match_source") == "dataset") \
        .join(tb.movies(spark, d).select("movie_id", "release_date", "vote_average"), "movie_id")
    meta = c3.groupBy(F.col("imdb_title").alias("title")).agg(
        F.min_by(F.struct("release_date", "vote_average", "imdb_rating"), "movie_id").alias("m")) \
        .select("title", "m.release_date", "m.vote_average", "m.imdb_rating", F.lit("").alias("overview"))
    titles = tb.movies(spark, d).select("title").distinct()
    out = attach_metadata(titles, meta, "title")
    return out.select("title", "releaseDate", "voteAverage", "imdbRating")

