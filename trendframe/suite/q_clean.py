"""Projection / filter / source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators.drift import distribution_drift, drift
from ..sources import io
from ..sources import testbed as tb
from . import ntz, register, rounded
from ._sql import mentions_sql
from .q_rank import _c2_sql


@register("normalize_catalogue", tb.with_ctes("""
SELECT movie_id, title, original_title, coalesce(popularity, 0.0) AS popularity,
       coalesce(vote_average, 0.0) AS vote_average, coalesce(vote_count, 0) AS vote_count,
       coalesce(release_date, '') AS release_date, 0 AS n_genres, '' AS overview, false AS adult,
       '' AS original_language, '' AS poster_path, '' AS backdrop_path, "timestamp", 'tmdb' AS source,
       0 AS n_cast
FROM catalogue""", "catalogue"))
def q_normalize_catalogue(spark, d):
    """The 15 catalogue fields with defaults, plus the enriched credits struct."""
    n = C.normalize_catalogue(tb.catalogue(spark, d), enriched=True)
    return rounded(n.select("movie_id", "title", "original_title", "popularity", "vote_average", "vote_count",
                            "release_date", F.size("genre_ids").alias("n_genres"), "overview", "adult",
                            "original_language", "poster_path", "backdrop_path", "timestamp", "source",
                            F.size("credits.cast").alias("n_cast")))


@register("coalesce_title", """
SELECT p_partkey, coalesce(nullif(CASE WHEN p_size < 10 THEN '' ELSE p_name END, ''), p_brand) AS title
FROM part""")
def q_coalesce_title(spark, d):
    """``title`` else ``name`` (empty text counts as missing)."""
    p = tb.table(spark, d, "part")
    t = F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.col("p_name"))
    return p.select("p_partkey", C.coalesce_cols(t, "p_brand").alias("title"))


def _conv_shapes(spark, d):
    c = tb.table(spark, d, "conversations")
    comments = c.filter(F.col("turn") > 0).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("conv_id").cast("string").alias("post_id"), F.lit(None).cast("string").alias("post_title"),
        "text", F.lit(None).cast("string").alias("author"), F.col("turn").cast("double").alias("score"),
        F.lit(None).cast("string").alias("created_utc"), F.lit("conv").alias("subreddit"),
        F.lit(None).cast("string").alias("timestamp"))
    posts = c.filter(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("post_id"), F.substring("text", 1, 40).alias("title"),
        F.expr("substring(text, 41)").alias("text"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("author"),
        F.lit(1.0).alias("score"), F.lit(0).alias("num_comments"), F.lit(1.0).alias("upvote_ratio"),
        F.lit(None).cast("string").alias("created_utc"), F.lit("conv").alias("subreddit"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("timestamp"))
    return comments, posts


@register("normalize_discussion", f"""
SELECT conv_id || '_' || turn AS id, 'comment' AS type, '[deleted]' AS author,
       CAST(len({mentions_sql('text')}) AS INTEGER) AS n_mentions, text
FROM conversations WHERE turn > 0
UNION ALL
SELECT CAST(conv_id AS VARCHAR), 'post', 'u' || CAST(conv_id AS VARCHAR),
       CAST(len({mentions_sql("concat_ws(' ', substr(text, 1, 40), substr(text, 41))")}) AS INTEGER),
       substr(text, 41)
FROM conversations WHERE turn = 0""")
def q_normalize_discussion(spark, d):
    """Comments and posts to one discussion shape (post mentions from title + body)."""
    comments, posts = _conv_shapes(spark, d)
    u = C.normalize_discussion(comments, "comment").unionByName(
        C.normalize_discussion(posts, "post"), allowMissingColumns=True)
    return u.select(F.coalesce("comment_id", "post_id").alias("id"), "type", "author",
                    F.size("movie_mentions").alias("n_mentions"), "text")


@register("normalize_targeted", """
SELECT CASE WHEN turn = 0 THEN 'p' || conv_id ELSE 'c' || conv_id || '_' || turn END AS id,
       CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS type,
       CASE WHEN conv_id % 3 = 0 THEN '[deleted]' ELSE 'u' || conv_id END AS author, 'reddit_targeted' AS source,
       CASE WHEN conv_id % 4 <> 0 THEN 'Title ' || conv_id END AS mention, text
FROM conversations""")
def q_normalize_targeted(spark, d):
    """Targeted search records, their title taken as their mention."""
    n = F.col("conv_id").cast("string")
    c = tb.table(spark, d, "conversations").select(
        F.when(F.col("turn") == 0, "post").otherwise("comment").alias("type"), F.concat(F.lit("p"), n).alias("post_id"),
        F.concat(F.lit("c"), n, F.lit("_"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("conv_id").cast("int").alias("movie_id"), F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("Title "), n)).alias("movie_title"),
        F.lit("2024").alias("movie_year"), F.lit("q").alias("search_query"), "text",
        F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), n)).alias("author"),
        F.lit(1.0).alias("score"), F.lit("conv").alias("subreddit"), F.lit(None).cast("string").alias("timestamp"))
    out = C.normalize_discussion(c, "targeted", title_as_mention=True)
    return out.select("id", "type", "author", "source", F.try_element_at("movie_mentions", F.lit(1)).alias("mention"), "text")


@register("require_id", """
SELECT page_id FROM (SELECT page_id, url FROM pages UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 2 = 0 THEN '' END FROM pages)
WHERE page_id IS NOT NULL AND url IS NOT NULL AND url <> ''""")
def q_require_id(spark, d):
    """Drop rows without an id (NULL or empty): the pages, and a copy of each without a url."""
    p = tb.table(spark, d, "pages").select("page_id", "url")
    bare = p.select((-1 - F.col("page_id")).alias("page_id"), F.when(F.col("page_id") % 2 == 0, "").alias("url"))
    return C.require(p.unionByName(bare), ["page_id", "url"]).select("page_id")


@register("decode_json", """
SELECT event_id, CASE WHEN json_valid(p) THEN CAST(json_extract_string(p, '$.k') AS INTEGER) END AS k,
       CASE WHEN NOT json_valid(p) THEN p END AS corrupt
FROM (SELECT event_id, props AS p FROM events UNION ALL SELECT -1 - event_id, substr(props, 2) FROM events WHERE event_id % 7 = 0)""")
def q_decode_json(spark, d):
    """JSON payload decoded with a fixed schema and flattened: every event, and broken copies of some."""
    ev = tb.table(spark, d, "events").select("event_id", F.col("props").alias("p"))
    broken = ev.filter(F.col("event_id") % 7 == 0).select((-1 - F.col("event_id")).alias("event_id"), F.expr("substring(p, 2)").alias("p"))
    ev = ev.unionByName(broken)
    return io.decode_json(ev, "p", "k int", keep=["event_id"], corrupt_col="corrupt")


@register("event_time", tb.with_ctes("""
SELECT event_id, TRY_CAST("timestamp" AS TIMESTAMP) AS event_time FROM catalogue""", "catalogue"))
def q_event_time(spark, d):
    """S3: event time parsed from the ISO string (bad input gives NULL)."""
    c = io.with_event_time(tb.catalogue(spark, d).drop("event_time"), "timestamp")
    return ntz(c.select("event_id", "event_time"), "event_time")


@register("encode_json", """
SELECT CAST(to_json({'event_id': event_id, 'event_type': event_type, 'value': value}) AS VARCHAR) AS value
FROM events""")
def q_encode_json(spark, d):
    """Every row serialised as one JSON document."""
    return io.encode_json(tb.table(spark, d, "events").select("event_id", "event_type", "value"))


@register("chart_rows", _c2_sql("""
SELECT substr(title, 1, 15) || '...' AS name, trendScore AS score, popularity, mentions * 2 AS mentions
FROM c2 ORDER BY trendScore DESC, title LIMIT 5"""))
def q_chart_rows(spark, d):
    """top 5 trending titles as chart points (title cut to 15 + '...', mentions x 2)."""
    from ..plans.serving import trending_now
    t = trending_now(tb.catalogue(spark, d), tb.discussion_text(spark, d), n=5)
    return t.select(F.concat(F.substring("title", 1, 15), F.lit("...")).alias("name"),
                    F.col("trendScore").alias("score"), "popularity", (F.col("mentions") * 2).alias("mentions"))


@register("drift", f"""
WITH ref AS (SELECT event_type, value FROM events
             WHERE ts >= TIMESTAMP '{tb.NOW}' - INTERVAL 48 HOUR AND ts < TIMESTAMP '{tb.NOW}' - INTERVAL 24 HOUR),
cur AS (SELECT event_type, value FROM events WHERE ts >= TIMESTAMP '{tb.NOW}' - INTERVAL 24 HOUR),
st AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd
       FROM ref GROUP BY 1),
grid AS (SELECT event_type, unnest(range(0, 10)) AS bin FROM st),
b AS (SELECT x.event_type, x.tag,
             CASE WHEN st.hi - st.lo > 0 THEN least(9, greatest(0, CAST(floor((x.value - st.lo) / (st.hi - st.lo) * 10)
                  AS INTEGER))) ELSE 0 END AS bin
      FROM (SELECT *, 'ref' AS tag FROM ref UNION ALL SELECT *, 'cur' FROM cur) x JOIN st USING (event_type)
      WHERE x.value IS NOT NULL),
h AS (SELECT g.event_type, g.bin, count(b.tag) FILTER (WHERE b.tag = 'ref') AS n_ref,
             count(b.tag) FILTER (WHERE b.tag = 'cur') AS n_cur
      FROM grid g LEFT JOIN b ON b.event_type = g.event_type AND b.bin = g.bin GROUP BY 1, 2),
p AS (SELECT *, (n_ref + 0.5) / (sum(n_ref) OVER (PARTITION BY event_type) + 5.0) AS p_ref,
             (n_cur + 0.5) / (sum(n_cur) OVER (PARTITION BY event_type) + 5.0) AS p_cur FROM h)
SELECT p.event_type, round(sum((p_cur - p_ref) * ln(p_cur / p_ref)), 6) AS psi, o.n_current, o.null_rate, o.outliers
FROM p LEFT JOIN (
  SELECT c.event_type, count(*) AS n_current, CAST(count(*) FILTER (WHERE c.value IS NULL) AS DOUBLE) / count(*)
         AS null_rate, count(*) FILTER (WHERE abs(c.value - st.mu) > 3.0 * st.sd) AS outliers
  FROM cur c JOIN st USING (event_type) GROUP BY 1) o ON o.event_type = p.event_type
GROUP BY p.event_type, o.n_current, o.null_rate, o.outliers""")
def q_drift(spark, d):
    """Value drift per event type, last 24 h against the 24 h before."""
    return rounded(drift(*_days(spark, d), "value", ["event_type"]))


def _days(spark, d):
    """The 24 hours before the last and the last 24 hours of events."""
    ev = tb.table(spark, d, "events")
    now = F.lit(tb.NOW).cast("timestamp_ntz")
    day = F.expr("INTERVAL 24 HOURS")
    return ev.filter((F.col("ts") >= now - day - day) & (F.col("ts") < now - day)), ev.filter(F.col("ts") >= now - day)


def _distribution_sql(ref: str, cur: str, key: str) -> str:
    return f"""
WITH ref AS ({ref}), cur AS ({cur}),
x AS (SELECT k, v, sum(r) AS r, sum(c) AS c FROM (SELECT k, v, 1 AS r, 0 AS c FROM ref UNION ALL SELECT k, v, 0, 1 FROM cur)
      WHERE v IS NOT NULL GROUP BY k, v),
s AS (SELECT k, abs(sum(r) OVER w / nullif(sum(r) OVER (PARTITION BY k), 0) - sum(c) OVER w / nullif(sum(c) OVER (PARTITION BY k), 0)) AS d
      FROM x WINDOW w AS (PARTITION BY k ORDER BY v)),
q AS (SELECT k, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n FROM ref GROUP BY k),
o AS (SELECT cur.k, count(v) AS n, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS far
      FROM cur LEFT JOIN q ON q.k = cur.k GROUP BY cur.k)
SELECT {key}n_reference, n_current, round(ks, 6) AS ks, round(q1, 6) AS q1, round(q3, 6) AS q3, iqr_outliers
FROM (SELECT s.k, any_value(q.n) AS n_reference, any_value(o.n) AS n_current, max(d) AS ks, any_value(q1) AS q1, any_value(q3) AS q3,
             any_value(far) AS iqr_outliers FROM s JOIN q ON q.k = s.k JOIN o ON o.k = s.k GROUP BY s.k)"""


_EVENT_DAYS = [f"SELECT {{key}} AS k, value AS v FROM events WHERE ts >= TIMESTAMP '{tb.NOW}' - INTERVAL {a} HOUR{b}"
               for a, b in ((48, f" AND ts < TIMESTAMP '{tb.NOW}' - INTERVAL 24 HOUR"), (24, ""))]


@register("drift_distribution", _distribution_sql(*[x.format(key="event_type") for x in _EVENT_DAYS], "k AS event_type, "))
def q_drift_distribution(spark, d):
    """Kolmogorov-Smirnov distance and quartile outliers per event type, last 24 h against the 24 h before."""
    return rounded(distribution_drift(*_days(spark, d), "value", ["event_type"]))


@register("drift_distribution_global", _distribution_sql(
    "SELECT 1 AS k, l_extendedprice AS v FROM lineitem WHERE l_returnflag <> 'R'",
    "SELECT 1 AS k, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'R'", ""))
def q_drift_distribution_global(spark, d):
    """The same over one group that holds a whole table (prices of items sent back against all others)."""
    li = tb.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    back = F.col("l_returnflag") == "R"
    return rounded(distribution_drift(li.filter(~back), li.filter(back), "l_extendedprice"))
