"""Domain feeds derived from the supplied test tables.

The library's operators take domain DataFrames (a catalogue feed, a
discussion feed, title dumps, a review collection). The supplied tables are
a generic star schema, so this module maps them onto those shapes with plain
projections. Every mapping is stated twice: as a DataFrame function and as a
SQL text (``SQL[name]``) that the DuckDB oracle uses as a common table
expression, so both engines read exactly the same derived rows.

Mapping (fixed choices):

* catalogue feed  = ``events`` with ``event_type = 'view'``; title id ``k``
  from the JSON ``props``; popularity = ``value``; event time = ``ts``.
* discussion feed = ``events`` with ``event_type = 'click'``; the mentioned
  title = ``k``; score = ``value``; sentiment a fixed function of
  ``event_id`` in -1..1 (the events carry no text).
* the text of a click = the document with number ``event_id`` modulo the
  number of documents, so every click has a text and every document is used.
* reviews         = ``documents``; subreddit = ``source``; score =
  ``n_chars``; review ``i`` was posted ``i`` modulo ``REVIEW_HOURS`` hours
  before the fixed "now", so a time filter keeps the same share at any size.
* title basics    = ``part``; ratings = ``lineitem`` aggregated by part;
  principals = ``lineitem`` rows (person = supplier, role from the return
  flag); names = ``supplier``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import decode_json

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed reference instant for "now" in all time-relative queries: the test
# events run from 2024-01-01 to 2024-01-30.
NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-31"


#: Hours before "now" over which reviews are spread.
REVIEW_HOURS = 336

_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, defined once per session (file listing and footer
    reading are not repeated for every query that reads it)."""
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), sf_dir, name)
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df


def _title(k):
    return F.concat(F.lit("Title "), k.cast("string"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    ev = decode_json(ev, "props", "k int", keep=["event_id", "ts", "user_id", "value"])
    return ev.select(
        "event_id",
        F.col("k").alias("movie_id"),
        _title(F.col("k")).alias("title"),
        _title(F.col("k")).alias("original_title"),
        F.col("value").alias("popularity"),
        (F.col("user_id") % 100 / 10.0).alias("vote_average"),
        F.col("user_id").cast("int").alias("vote_count"),
        F.date_format(F.date_add(F.lit("2023-10-01").cast("date"), F.col("k") * 2),
                      "yyyy-MM-dd").alias("release_date"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("ts").alias("event_time"),
        F.lit("tmdb").alias("source"),
    )


def discussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    ev = decode_json(ev, "props", "k int", keep=["event_id", "ts", "user_id", "value"])
    return ev.select(
        "event_id",
        F.col("event_id").cast("string").alias("post_id"),
        _title(F.col("k")).alias("movie_title"),
        F.array(_title(F.col("k"))).alias("movie_mentions"),
        F.col("value").alias("score"),
        (((F.col("event_id") * 7919) % 2001 - 1000) / 1000.0).alias("sentiment_score"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("ts").alias("event_time"),
        F.lit("reddit").alias("source"),
    )


def discussion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discussion messages with text: every click carries a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    disc = discussion(spark, sf_dir).withColumn("doc_id", F.pmod(F.col("event_id"), n_docs))
    return disc.join(docs, "doc_id", "inner").drop("doc_id")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # wall-clock arithmetic on a zone-free timestamp (independent of the session zone)
    ts = F.timestamp_add("HOUR", -F.pmod(F.col("doc_id"), F.lit(REVIEW_HOURS)), F.lit(NOW).cast("timestamp_ntz"))
    return d.select(
        F.col("doc_id").cast("string").alias("review_id"),
        "doc_id", "text", "lang",
        F.col("source").alias("subreddit"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("source").alias("author"),
        ts.alias("event_time"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


def basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("tconst"),
        F.col("p_partkey").alias("pos"),
        F.col("p_type").alias("titleType"),
        F.col("p_name").alias("primaryTitle"),
        F.upper(F.col("p_name")).alias("originalTitle"),
        (F.lit(1950) + F.col("p_size")).cast("string").alias("startYear"),
        F.col("p_size").cast("string").alias("runtimeMinutes"),
        F.concat_ws(",", F.col("p_brand"), F.col("p_type")).alias("genres"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_partkey")
            .agg(F.round(F.avg("l_quantity") / 5.0, 1).alias("averageRating"),
                 F.count("*").cast("int").alias("numVotes"))
            .select(F.concat(F.lit("tt"), F.col("l_partkey").cast("string")).alias("tconst"),
                    "averageRating", "numVotes"))


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cat = (F.when(F.col("l_returnflag") == "A", "actor")
           .when(F.col("l_returnflag") == "R", "director")
           .otherwise("writer"))
    return li.select(
        F.concat(F.lit("tt"), F.col("l_partkey").cast("string")).alias("tconst"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordering"),
        F.concat(F.lit("nm"), F.col("l_suppkey").cast("string")).alias("nconst"),
        cat.alias("category"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue feed to enrich: one movie per part, titled exactly, with
    extra words (contains a dump title) or by its last word (contained);
    every tenth has titles that no dump knows."""
    p = table(spark, sf_dir, "part")
    form = F.col("p_partkey") % 3
    unknown = F.col("p_partkey") % 10 == 9
    title = (F.when(unknown, F.concat(F.lit("zzqx "), F.col("p_partkey").cast("string")))
             .when(form == 0, F.col("p_name"))
             .when(form == 1, F.concat(F.lit("the "), F.col("p_name"), F.lit(" returns")))
             .otherwise(F.element_at(F.split("p_name", " "), -1)))
    return p.select(F.col("p_partkey").alias("movie_id"), title.alias("title"),
                    F.when(unknown, F.concat(F.lit("qqzx "), F.col("p_partkey").cast("string")))
                    .otherwise(F.upper("p_name")).alias("original_title"),
                    F.round(F.col("p_retailprice") / 200.0, 1).alias("vote_average"),
                    F.col("p_size").alias("vote_count"),
                    F.concat((F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-06-15"))
                    .alias("release_date"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("nm"), F.col("s_suppkey").cast("string")).alias("nconst"),
                    F.col("s_name").alias("primaryName"))


# SQL twins (DuckDB dialect) of the derivations above.
SQL = {
    "catalogue": """
        SELECT event_id,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS movie_id,
               'Title ' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS title,
               'Title ' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS original_title,
               value AS popularity,
               CAST(user_id % 100 AS DOUBLE) / 10 AS vote_average,
               CAST(user_id AS INTEGER) AS vote_count,
               strftime(DATE '2023-10-01' + CAST(json_extract_string(props, '$.k') AS INTEGER) * 2,
                        '%Y-%m-%d') AS release_date,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
               ts AS event_time,
               'tmdb' AS source
        FROM events WHERE event_type = 'view'""",
    "discussion": """
        SELECT event_id,
               CAST(event_id AS VARCHAR) AS post_id,
               'Title ' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS movie_title,
               ['Title ' || CAST(json_extract_string(props, '$.k') AS INTEGER)] AS movie_mentions,
               value AS score,
               CAST((event_id * 7919) % 2001 - 1000 AS DOUBLE) / 1000 AS sentiment_score,
               'u' || CAST(user_id AS VARCHAR) AS author,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
               ts AS event_time,
               'reddit' AS source
        FROM events WHERE event_type = 'click'""",
    "discussion_text": """
        SELECT d.*, doc.text FROM discussion d
        JOIN documents doc ON doc.doc_id = d.event_id % (SELECT count(*) FROM documents)""",
    "reviews": f"""
        SELECT CAST(doc_id AS VARCHAR) AS review_id, doc_id, text, lang,
               source AS subreddit, CAST(n_chars AS DOUBLE) AS score, source AS author,
               TIMESTAMP '2024-01-31 00:00:00' - to_hours(doc_id % {REVIEW_HOURS}) AS event_time,
               strftime(TIMESTAMP '2024-01-31 00:00:00' - to_hours(doc_id % {REVIEW_HOURS}),
                        '%Y-%m-%dT%H:%M:%S') AS "timestamp"
        FROM documents""",
    "basics": """
        SELECT 'tt' || CAST(p_partkey AS VARCHAR) AS tconst, p_partkey AS pos,
               p_type AS titleType, p_name AS primaryTitle, upper(p_name) AS originalTitle,
               CAST(1950 + p_size AS VARCHAR) AS startYear,
               CAST(p_size AS VARCHAR) AS runtimeMinutes,
               p_brand || ',' || p_type AS genres
        FROM part""",
    "ratings": """
        SELECT 'tt' || CAST(l_partkey AS VARCHAR) AS tconst,
               round(avg(l_quantity) / 5.0, 1) AS averageRating,
               CAST(count(*) AS INTEGER) AS numVotes
        FROM lineitem GROUP BY l_partkey""",
    "principals": """
        SELECT 'tt' || CAST(l_partkey AS VARCHAR) AS tconst,
               l_orderkey * 8 + l_linenumber AS ordering,
               'nm' || CAST(l_suppkey AS VARCHAR) AS nconst,
               CASE WHEN l_returnflag = 'A' THEN 'actor'
                    WHEN l_returnflag = 'R' THEN 'director' ELSE 'writer' END AS category
        FROM lineitem""",
    "movies": """
        SELECT p_partkey AS movie_id,
               CASE WHEN p_partkey % 10 = 9 THEN 'zzqx ' || p_partkey
                    WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'the ' || p_name || ' returns'
                    ELSE string_split(p_name, ' ')[-1] END AS title,
               CASE WHEN p_partkey % 10 = 9 THEN 'qqzx ' || p_partkey ELSE upper(p_name) END AS original_title,
               CAST(round(CAST(CAST(p_retailprice / 200.0 AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DOUBLE)
                   AS vote_average,
               p_size AS vote_count, CAST(1950 + p_size AS VARCHAR) || '-06-15' AS release_date
        FROM part""",
    "names": """
        SELECT 'nm' || CAST(s_suppkey AS VARCHAR) AS nconst, s_name AS primaryName
        FROM supplier""",
}


def with_ctes(sql: str, *names: str, extra: str = "") -> str:
    """Prefix ``sql`` with the SQL twins of the named derived tables.

    ``extra`` holds further ``name AS (...)`` definitions (comma-separated)
    that may refer to the derived tables.
    """
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    if extra.strip():
        parts.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + sql
