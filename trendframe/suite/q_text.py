"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sentiment import sentiment
from ..operators import clean as C
from ..operators.aggregate import distinct_titles, most_discussed, most_discussed_served
from ..operators.partitioning import spread
from ..plans.indexing import review_rows
from ..sources import testbed as tb
from ..sources.io import insert_ignore, upsert_last
from . import register
from ._sql import (attribute_sql, lexicon_cte, mentions_sql, sentiment_ctes, sround, strip_ws_sql, _list)


def review_feed(spark, d):
    """Reviews as a discussion feed (the document id is the comment id)."""
    return tb.reviews(spark, d).withColumnRenamed("review_id", "comment_id") \
        .withColumn("source", F.lit("reddit"))


def index(spark, d):
    """C4 rows (without the vector) with the event time kept for ordering."""
    return review_rows(review_feed(spark, d), embed=False, keep=["event_time"])


_EXCL = _list(T.INDEX_EXCLUDED_AUTHORS)
_IDX_CTES = lexicon_cte() + f""",
f AS (SELECT * FROM reviews
      WHERE length({strip_ws_sql("coalesce(text, '')")}) >= 50
        AND NOT list_contains({_EXCL}, lower(coalesce(author, '')))
        AND NOT contains(lower(coalesce(text, '')), '{T.INDEX_BOILERPLATE[0]}')
        AND NOT contains(lower(coalesce(text, '')), '{T.INDEX_BOILERPLATE[1]}')),""" + \
    sentiment_ctes("f", "review_id", "text", "sent") + f""",
fm AS (SELECT *, {mentions_sql('text')} AS mm FROM f),
ft AS (SELECT *, {attribute_sql("'reddit'", 'NULL', 'subreddit', 'mm')} AS title FROM fm),
idx AS (SELECT ft.review_id, ft.text, lower(ft.title) AS movie_title, ft.title AS movie_title_original,
               ft."timestamp", s.compound AS sentiment, 'reddit' AS source,
               coalesce(ft.subreddit, '') AS subreddit, coalesce(ft.author, '') AS author,
               coalesce(ft.score, 0.0) AS score, CAST(len(ft.mm) AS BIGINT) AS mentions, ft.event_time
        FROM ft JOIN sent s ON s.sid = ft.review_id)"""


def _idx_sql(select: str) -> str:
    return tb.with_ctes(select, "reviews", extra=_IDX_CTES)


# ----------------------------------------------------------------- F1 / F4-F7

@register("sentiment", tb.with_ctes("""
SELECT d.doc_id, s.compound AS sentiment FROM documents d JOIN sent s ON s.sid = d.doc_id""",
    extra=lexicon_cte() + "," + sentiment_ctes("documents", "doc_id", "text", "sent")))
def q_sentiment(spark, d):
    """Lexicon compound sentiment of every document (whole texts)."""
    return spread(tb.table(spark, d, "documents")).select("doc_id", sentiment("text").alias("sentiment"))


@register("extract_mentions", f"""
SELECT doc_id, array_to_string(m, ' | ') AS mentions, CAST(len(m) AS INTEGER) AS n_mentions
FROM (SELECT doc_id, {mentions_sql('text')} AS m FROM documents)""")
def q_extract_mentions(spark, d):
    """capitalised word runs of every document."""
    m = T.extract_mentions("text")
    return spread(tb.table(spark, d, "documents")).select(
        "doc_id", F.array_join(m, " | ").alias("mentions"), F.size(m).alias("n_mentions"))


@register("explode_mentions", f"""
SELECT doc_id, unnest(m) AS mention
FROM (SELECT doc_id, {mentions_sql('text')} AS m FROM documents) WHERE len(m) > 0""")
def q_explode_mentions(spark, d):
    """One row per mention."""
    docs = tb.table(spark, d, "documents").withColumn("m", T.extract_mentions("text"))
    return C.explode_mentions(docs, "m", "mention", keep=["doc_id"]).select("doc_id", "mention")


@register("attribute_title", tb.with_ctes(f"""
SELECT review_id, {attribute_sql("src", 'own', 'sub', 'mm')} AS title
FROM (SELECT *, {mentions_sql('text')} AS mm,
             CASE WHEN doc_id % 5 = 0 THEN 'tmdb' ELSE 'reddit' END AS src,
             CASE WHEN doc_id % 10 = 0 THEN 'Review Title' END AS own,
             CASE doc_id % 4 WHEN 0 THEN 'StarWars' WHEN 1 THEN 'netflix' ELSE subreddit END AS sub
      FROM reviews)""", "reviews"))
def q_attribute_title(spark, d):
    """F5 + F6 + J10: the title each review is about - its own, its group's, or its first mention."""
    n = F.col("doc_id")
    r = tb.reviews(spark, d).withColumns({
        "mm": T.extract_mentions("text"), "src": F.when(n % 5 == 0, "tmdb").otherwise("reddit"),
        "own": F.when(n % 10 == 0, "Review Title"),
        "sub": F.when(n % 4 == 0, "StarWars").when(n % 4 == 1, "netflix").otherwise(F.col("subreddit"))})
    return r.select("review_id", T.attribute_title("src", "own", "sub", "mm").alias("title"))


@register("doc_id", """
SELECT conv_id, turn,
       coalesce(nullif(CASE WHEN role = 'assistant' THEN conv_id || '_' || turn END, ''),
                sha256(coalesce(text, ''))) AS doc_id
FROM conversations""")
def q_doc_id(spark, d):
    """comment id, else a content hash (stable under retries)."""
    c = tb.table(spark, d, "conversations")
    cid = F.when(F.col("role") == "assistant",
                 F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", T.doc_id(cid, content=F.col("text")).alias("doc_id"))


@register("publish_gate", f"""
SELECT kind, id FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents
                      UNION ALL SELECT 'title', p_partkey, lower(p_name) FROM part
                      UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
WHERE len({mentions_sql('text')}) > 0 OR length(coalesce(text, '')) > 50""")
def q_publish_gate(spark, d):
    """Publish messages that mention a title or are longer than 50 chars: documents, turns, titles in lower case."""
    rows = spread(tb.table(spark, d, "documents")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        tb.table(spark, d, "part").select(F.lit("title").alias("kind"), F.col("p_partkey").alias("id"), F.lower("p_name").alias("text"))
    ).unionByName(tb.table(spark, d, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    return C.gate(rows.withColumn("m", T.extract_mentions("text")), "m", "text").select("kind", "id")


# --------------------------------------------------------------- P5-P7, F13

@register("index_filter", tb.with_ctes(f"""
SELECT review_id FROM (
  SELECT review_id, CASE WHEN doc_id % 7 = 0 THEN 'AutoModerator' ELSE author END AS author,
         CASE doc_id % 11 WHEN 0 THEN text || ' Please make sure there are NO spoilers'
              WHEN 1 THEN 'This post has been removed. ' || text ELSE text END AS text FROM reviews)
WHERE length({strip_ws_sql("coalesce(text, '')")}) >= 50
  AND NOT list_contains({_EXCL}, lower(coalesce(author, '')))
  AND NOT contains(lower(coalesce(text, '')), '{T.INDEX_BOILERPLATE[0]}')
  AND NOT contains(lower(coalesce(text, '')), '{T.INDEX_BOILERPLATE[1]}')""", "reviews"))
def q_index_filter(spark, d):
    """P5: texts worth indexing; some rows come from a bot or hold boilerplate."""
    n, text = F.col("doc_id"), F.col("text")
    r = tb.reviews(spark, d).withColumns({
        "author": F.when(n % 7 == 0, "AutoModerator").otherwise(F.col("author")),
        "text": F.when(n % 11 == 0, F.concat(text, F.lit(" Please make sure there are NO spoilers")))
        .when(n % 11 == 1, F.concat(F.lit("This post has been removed. "), text)).otherwise(text)})
    return C.index_filter(r).select("review_id")


@register("quality_filter", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 9 < 4 THEN text || ["
          + ", ".join(f"'{m}'" for m in C.QUALITY_MARKERS) + "][doc_id % 9 + 1] ELSE text END AS text FROM documents) "
          "WHERE length(text) BETWEEN 50 AND 1000 AND "
          + " AND ".join(f"NOT contains(text, '{m}')" for m in C.QUALITY_MARKERS))
def q_quality_filter(spark, d):
    """50..1000 characters, no bot markers (four in nine texts hold one)."""
    k = (F.col("doc_id") % 9).cast("int")
    marker = F.element_at(F.array(*[F.lit(m) for m in C.QUALITY_MARKERS]), F.least(k + 1, F.lit(4)))
    docs = tb.table(spark, d, "documents").withColumn(
        "text", F.when(k < 4, F.concat(F.col("text"), marker)).otherwise(F.col("text")))
    return C.quality_filter(docs).select("doc_id")


@register("topic_filter", f"""
SELECT conv_id, turn FROM conversations
WHERE contains(lower(text), 'eredon') OR contains(lower(text), 'leau') OR contains(lower(text), 'movie')""")
def q_topic_filter(spark, d):
    """Turns that hold a topic word anywhere in their text (words of the invented prose)."""
    c = tb.table(spark, d, "conversations")
    return C.topic_filter(c, "text", ("eredon", "leau", "movie")).select("conv_id", "turn")


@register("ellipsis", """
SELECT doc_id,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS cut200,
       CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS cut500
FROM documents""")
def q_ellipsis(spark, d):
    """cut with a mark only when longer."""
    return tb.table(spark, d, "documents").select(
        "doc_id", T.ellipsis("text", 200).alias("cut200"), T.ellipsis("text", 500).alias("cut500"))


# ------------------------------------------------------------------ F10, F11

def _extract_title_sql(x: str) -> str:
    t = f"lower(trim({x}))"
    for pat in T.TITLE_FILLERS:
        t = f"regexp_replace({t}, '{pat.replace(chr(39), chr(39) * 2)}', '', 'g')"
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({t}) >= 3 THEN {t} END"


@register("extract_title", f"""
SELECT conv_id, turn, {_extract_title_sql('text')} AS title
FROM conversations WHERE role = 'user'""")
def q_extract_title(spark, d):
    """the title inside each question."""
    c = tb.table(spark, d, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", T.extract_title("text").alias("title"))


def _spellings(spark, d):
    p = tb.table(spark, d, "part")
    forms = [F.col("p_name"), F.concat("p_name", F.lit(" part two")), F.concat("p_name", F.lit(" 2")),
             F.concat_ws(" season ", "p_name", F.col("p_size").cast("string")),
             F.concat_ws(": ", F.lower("p_brand"), "p_name"),
             F.concat_ws(" and the ", "p_name", F.lower("p_type"))]
    return p.select(F.explode(F.array(*forms)).alias("title")).distinct()


_SPELLINGS_SQL = """
sp AS (SELECT DISTINCT title FROM (
  SELECT p_name AS title FROM part UNION ALL SELECT p_name || ' part two' FROM part
  UNION ALL SELECT p_name || ' 2' FROM part
  UNION ALL SELECT p_name || ' season ' || CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT lower(p_brand) || ': ' || p_name FROM part
  UNION ALL SELECT p_name || ' and the ' || lower(p_type) FROM part))"""


def _variants_sql(x: str) -> str:
    t = f"lower(trim({x}))"
    has = " OR ".join(f"contains({t}, '{m}')" for m in T.SEQUEL_MARKERS)
    base = f"trim(regexp_replace({t}, '{T.SEQUEL_SUFFIX}', ''))"
    forms = ", ".join(("{b}".replace("{b}", base) if f == "{b}" else f"{base} || '{f[3:]}'")
                      for f in T.SEQUEL_FORMS)
    sequel = f"CASE WHEN ({has}) AND {base} <> '' THEN [{forms}] ELSE [] END"
    parts = f"string_split_regex({t}, '\\s+season\\s+')"
    sb, sn = f"trim({parts}[1])", f"trim({parts}[2])"
    season = (f"CASE WHEN contains({t}, 'season') AND len({parts}) = 2 "
              f"THEN [{sb}, {sb} || ' season ' || {sn}, {sb} || ' s' || {sn}] ELSE [] END")
    fb = f"trim(string_split_regex({t}, ':|(?:\\s+(?:and|the|of)\\s+)')[1])"
    fr = f"CASE WHEN (contains({t}, ':') OR contains({t}, ' and ')) AND length({fb}) > 3 THEN [{fb}] ELSE [] END"
    return f"list_concat([{t}], {sequel}, {season}, {fr})"


@register("title_variants", f"""
WITH {_SPELLINGS_SQL.strip()},
v AS (SELECT title, {_variants_sql('title')} AS l FROM sp)
SELECT title, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS variants FROM v""")
def q_title_variants(spark, d):
    """literal spellings of part-derived titles (sequel, season, franchise forms)."""
    s = _spellings(spark, d)
    return s.select("title", F.array_join(T.title_variants("title"), "|").alias("variants"))


# --------------------------------------------------------------- F16-F18

def _fmt_votes_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR {v} = 0 THEN 'N/A' "
            f"WHEN {v} >= 1000000 THEN printf('%.1fM', {sround(f'{v} / 1000000.0', 1)}) "
            f"WHEN {v} >= 1000 THEN CAST(CAST({sround(f'{v} / 1000.0', 0)} AS BIGINT) AS VARCHAR) || 'K' "
            f"ELSE CAST(CAST({v} AS BIGINT) AS VARCHAR) END")


def _parse_votes_sql(s: str) -> str:
    num = f"TRY_CAST(regexp_extract({s}, '([\\d.]+)([KM])?', 1) AS DOUBLE)"
    suf = f"regexp_extract({s}, '([\\d.]+)([KM])?', 2)"
    mult = f"CASE WHEN {suf} = 'K' THEN 1000.0 WHEN {suf} = 'M' THEN 1000000.0 ELSE 1.0 END"
    return f"CAST(trunc({num} * {mult}) AS BIGINT)"


@register("votes_format_parse", f"""
SELECT o_orderkey, fv AS formatted, {_parse_votes_sql('fv')} AS parsed,
       {_parse_votes_sql('CAST(o_custkey AS VARCHAR)')} AS parsed_plain
FROM (SELECT *, {_fmt_votes_sql('CAST(trunc(o_totalprice * 10) AS BIGINT)')} AS fv FROM orders)""")
def q_votes(spark, d):
    """F17 then F16: vote counts to ``x.yM``/``xK`` text and back; plain numbers."""
    o = tb.table(spark, d, "orders")
    fv = T.format_votes((F.col("o_totalprice") * 10).cast("bigint"))
    o = o.withColumn("formatted", fv)
    return o.select("o_orderkey", "formatted", T.parse_votes("formatted").alias("parsed"),
                    T.parse_votes(F.col("o_custkey").cast("string")).alias("parsed_plain"))


@register("extract_title_id", r"""
SELECT page_id, nullif(regexp_extract(url, '/(tt\d+)/', 1), '') AS from_url,
       nullif(regexp_extract(html, '/(tt\d+)/', 1), '') AS from_html
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/title/tt' || page_id || '/x' ELSE url END AS url,
             CASE WHEN page_id % 3 = 0 THEN html || '<a href="/title/tt0' || page_id || '/">' ELSE html END AS html
      FROM pages)""")
def q_extract_title_id(spark, d):
    """``tt`` ids in page URLs and bodies (in every second and every third)."""
    n = F.col("page_id").cast("string")
    p = tb.table(spark, d, "pages").withColumns({
        "url": F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/title/tt"), n, F.lit("/x"))).otherwise(F.col("url")),
        "html": F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit('<a href="/title/tt0'), n, F.lit('/">')))
        .otherwise(F.col("html"))})
    return p.select("page_id", T.extract_title_id("url").alias("from_url"),
                    T.extract_title_id("html").alias("from_html"))


# ------------------------------------------------------------- C4 and users

@register("index_reviews", _idx_sql("""
SELECT review_id, movie_title, movie_title_original, "timestamp", sentiment, source, subreddit, author,
       score, mentions, CAST(length(text) AS INTEGER) AS text_chars FROM idx"""))
def q_index_reviews(spark, d):
    """C4 (P5 F7 F5 F1 S14) without the vector column."""
    i = index(spark, d)
    return i.select("review_id", "movie_title", "movie_title_original", "timestamp", "sentiment", "source",
                    "subreddit", "author", "score", "mentions", F.length("text").alias("text_chars"))


@register("most_discussed", _idx_sql(f"""
SELECT arg_max(movie_title, event_time) AS title, count(*) AS discussions,
       CAST(sum(coalesce(mentions, 0)) AS BIGINT) AS mentions,
       {sround('avg(coalesce(sentiment, 0.5))', 2)} AS sentiment,
       max(event_time) AS latest_timestamp, count(*) * 10 AS trend_score
FROM idx WHERE lower(trim(movie_title)) NOT IN ('', 'unknown') AND movie_title IS NOT NULL
GROUP BY lower(trim(movie_title))"""))
def q_most_discussed(spark, d):
    """A4: most discussed titles of the review index."""
    return most_discussed(index(spark, d), title="movie_title", ts="event_time", order="review_id")


@register("most_discussed_served", _idx_sql(f"""
SELECT t.title, t.discussions, t.mentions, t.sentiment, t.trend_score,
       coalesce(m.release_date, 'N/A') AS "releaseDate", coalesce(m.vote_average, 0.0) AS "voteAverage"
FROM (SELECT arg_max(movie_title, (event_time, review_id)) AS title, count(*) AS discussions,
             CAST(sum(coalesce(mentions, 0)) AS BIGINT) AS mentions,
             {sround('avg(coalesce(sentiment, 0.5))', 2)} AS sentiment, count(*) * 10 AS trend_score
      FROM idx WHERE lower(trim(movie_title)) NOT IN ('', 'unknown') AND movie_title IS NOT NULL
        AND event_time > TIMESTAMP '{tb.NOW}' - INTERVAL 100 HOUR
      GROUP BY lower(trim(movie_title)) ORDER BY discussions DESC, title LIMIT 20) t
LEFT JOIN (SELECT lower(source) AS title, '20' || min(substr(source, 4)) AS release_date,
                  CAST(max(length(source)) AS DOUBLE) AS vote_average
           FROM documents GROUP BY 1
           UNION ALL SELECT 'the', '2020', 8.0) m ON m.title = t.title"""))
def q_most_discussed_served(spark, d):
    """A4 as served: last 100 h, most discussed first, 20 titles, with metadata or defaults."""
    meta = tb.table(spark, d, "documents").groupBy(F.lower("source").alias("title")).agg(
        F.concat(F.lit("20"), F.min(F.expr("substring(source, 4)"))).alias("release_date"),
        F.max(F.length("source")).cast("double").alias("vote_average"))
    meta = meta.unionByName(spark.range(1).select(F.lit("the").alias("title"), F.lit("2020").alias("release_date"),
                                                  F.lit(8.0).alias("vote_average")))
    meta = meta.withColumns({"imdb_rating": F.lit(0.0), "overview": F.lit("")})
    out = most_discussed_served(index(spark, d), F.lit(tb.NOW), 100, 20, meta, order="review_id")
    return out.select("title", "discussions", "mentions", "sentiment", "trend_score", "releaseDate", "voteAverage")


@register("distinct_titles", _idx_sql("""
SELECT DISTINCT movie_title_original FROM idx WHERE movie_title_original IS NOT NULL"""))
def q_distinct_titles(spark, d):
    """Sorted distinct titles of the review index (no row cap)."""
    return distinct_titles(index(spark, d))


@register("drop_unknown", _idx_sql("""
SELECT review_id, movie_title FROM (
  SELECT review_id, movie_title FROM idx
  UNION ALL SELECT review_id || '-', CASE CAST(review_id AS BIGINT) % 3 WHEN 0 THEN ' Unknown ' WHEN 1 THEN '  ' END FROM idx)
WHERE lower(trim(movie_title)) IS NOT NULL AND lower(trim(movie_title)) NOT IN ('', 'unknown')"""))
def q_drop_unknown(spark, d):
    """P13 + F33: drop blank or unknown titles: the index, and a copy of each row without a title."""
    r = index(spark, d).select("review_id", "movie_title")
    k = F.col("review_id").cast("long") % 3
    bare = r.select(F.concat("review_id", F.lit("-")).alias("review_id"), F.when(k == 0, " Unknown ").when(k == 1, "  ").alias("movie_title"))
    return C.drop_unknown(r.unionByName(bare), "movie_title").select("review_id", "movie_title")


@register("time_filter_lenient", tb.with_ctes(f"""
SELECT review_id FROM (SELECT review_id,
       CASE WHEN score < 100 THEN 'not a time' ELSE "timestamp" END AS ts_text FROM reviews)
WHERE TRY_CAST(ts_text AS TIMESTAMP) IS NULL
   OR TRY_CAST(ts_text AS TIMESTAMP) >= TIMESTAMP '{tb.NOW}' - INTERVAL 168 HOUR""", "reviews"))
def q_time_filter_lenient(spark, d):
    """Last 168 h; texts whose time does not parse are kept."""
    r = tb.reviews(spark, d).withColumn(
        "ts_text", F.when(F.col("score") < 100, F.lit("not a time")).otherwise(F.col("timestamp")))
    out = C.recent(r, "ts_text", 168, F.lit(tb.NOW), inclusive=True, keep_bad=True)
    return out.select("review_id")


@register("insert_ignore", """
WITH base AS (SELECT CAST(d.doc_id AS VARCHAR) AS review_id, CAST(l.quality AS DOUBLE) AS score, 'base' AS src
              FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
new AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(n_chars AS DOUBLE) AS score, 'new' AS src
        FROM documents)
SELECT * FROM base
UNION ALL SELECT * FROM new WHERE review_id NOT IN (SELECT review_id FROM base)""")
def q_insert_ignore(spark, d):
    """Add reviews whose id is not stored yet; stored ids are left as they are."""
    docs, labels = tb.table(spark, d, "documents"), tb.table(spark, d, "labels")
    base = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("review_id"),
                                              F.col("quality").cast("double").alias("score"),
                                              F.lit("base").alias("src"))
    new = docs.select(F.col("doc_id").cast("string").alias("review_id"),
                      F.col("n_chars").cast("double").alias("score"), F.lit("new").alias("src"))
    return insert_ignore(new, base, "review_id")


@register("upsert_last", tb.with_ctes("""
SELECT tconst, value, src FROM (
  SELECT tconst, CAST(pos AS DOUBLE) AS value, 'base' AS src, 0 AS prio, NULL AS ordering FROM basics
  UNION ALL
  SELECT tconst, l_quantity AS value, 'update' AS src, 1 AS prio, ordering
  FROM (SELECT 'tt' || CAST(l_partkey AS VARCHAR) AS tconst, l_quantity,
               l_orderkey * 8 + l_linenumber AS ordering FROM lineitem))
QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY prio DESC, ordering DESC) = 1""", "basics"))
def q_upsert_last(spark, d):
    """Keyed upsert, the newest update per key wins over the stored row."""
    base = tb.basics(spark, d).select("tconst", F.col("pos").cast("double").alias("value"),
                                      F.lit("base").alias("src"))
    li = tb.table(spark, d, "lineitem")
    new = li.select(F.concat(F.lit("tt"), F.col("l_partkey").cast("string")).alias("tconst"),
                    F.col("l_quantity").alias("value"), F.lit("update").alias("src"),
                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordering"))
    return upsert_last(new, base, ["tconst"], "ordering").select("tconst", "value", "src")

