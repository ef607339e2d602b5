"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import embed_hashed
from ..operators.clean import title_contains
from ..operators.ivf import knn_lists, learn_lists
from ..operators.knn import knn
from ..operators.partitioning import spread
from ..plans.indexing import index_metadata, index_reviews, metadata_rows, review_rows
from ..plans.retrieval import nearest, retrieve, retrieve_debug, select_relevant
from ..sources import testbed as tb
from . import register, rounded
from .q_catalogue import _CREDITS
from .q_text import _IDX_CTES, _extract_title_sql, _variants_sql, index, review_feed

N_NEIGHBOURS = 100
#: Number of the first question that is no turn.
MORE = 10 ** 12
HOURS = 168


def questions(spark, d):
    """Questions: all user turns and two more, one that names a word of many reviews and one without a title.

    The vectors are dealt out by number, so each question has one.
    """
    more = spark.range(2).select((F.col("id") + MORE).alias("question_id"),
                                 F.when(F.col("id") == 0, "Tell me about tion").otherwise("movie?").alias("question"))
    c = spread(tb.table(spark, d, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))).unionByName(more)
    e, n = _vectors(spark, d)
    return c.withColumn("vec_id", F.pmod("question_id", n)).join(e, "vec_id").select(
        "question_id", "question", F.col("embedding").alias("qvec"))


def review_index(spark, d):
    """C4 review rows, each with one of the supplied vectors, dealt out by number."""
    e, n = _vectors(spark, d)
    return index(spark, d).withColumn("vec_id", F.pmod(F.col("review_id").cast("long"), n)).join(e, "vec_id").drop("vec_id")


def by_length(spark, d):
    """A stand-in encoder that SQL can follow: a text's vector is the supplied one numbered by its length."""
    e, n = _vectors(spark, d)

    def encode(df, text, out):
        return (df.withColumn("vec_id", F.pmod(F.length(text), n).cast("long"))
                .join(e.withColumnRenamed("embedding", out), "vec_id", "left").drop("vec_id"))
    return encode


def _vectors(spark, d):
    e = tb.table(spark, d, "embeddings").select("vec_id", "embedding")
    return e, e.agg(F.count(F.lit(1)).alias("n")).scalar()


_RET = _IDX_CTES + f""",
coll AS MATERIALIZED (SELECT idx.*, e.embedding FROM idx
         JOIN embeddings e ON e.vec_id = CAST(idx.review_id AS BIGINT) % (SELECT count(*) FROM embeddings)),
uq AS (SELECT conv_id * 1000 + turn AS question_id, text FROM conversations WHERE role = 'user'
       UNION ALL VALUES ({MORE}, 'Tell me about tion'), ({MORE + 1}, 'movie?')),
ut AS (SELECT question_id, text AS question, {_extract_title_sql('text')} AS title FROM uq),
qs AS MATERIALIZED (SELECT ut.*, {_variants_sql('title')} AS variants, e.embedding AS qvec
       FROM ut JOIN embeddings e ON e.vec_id = ut.question_id % (SELECT count(*) FROM embeddings)),
nn AS MATERIALIZED (SELECT q.question_id, q.title, q.variants, co.*,
              round(list_cosine_similarity(CAST(q.qvec AS DOUBLE[]), CAST(co.embedding AS DOUBLE[])), 12) AS similarity
       FROM qs q, coll co
       QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY similarity DESC, co.review_id)
               <= {N_NEIGHBOURS}),
tf AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, review_id) AS rank
       FROM nn WHERE TRY_CAST("timestamp" AS TIMESTAMP) IS NULL
                  OR TRY_CAST("timestamp" AS TIMESTAMP) >= TIMESTAMP '{tb.NOW}' - INTERVAL {HOURS} HOUR),
mt AS (SELECT *, CASE WHEN title IS NOT NULL THEN
                   len(list_filter(variants, lambda v: contains(lower(text), v))) > 0 END AS is_match
       FROM tf),
cn AS (SELECT *, count(*) FILTER (WHERE is_match) OVER (PARTITION BY question_id) AS n_strict,
              count(*) OVER (PARTITION BY question_id) AS n_all FROM mt),
st AS (SELECT *, CASE WHEN title IS NULL THEN 'all' WHEN n_strict >= 10 THEN 'strict' ELSE 'semantic' END
                 AS strategy FROM cn),
kept AS (SELECT * EXCLUDE (rank),
                CAST(CASE strategy WHEN 'all' THEN n_all WHEN 'strict' THEN n_strict ELSE least(n_all, 25) END
                     AS BIGINT) AS mention_count,
                row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank
         FROM st
         WHERE strategy = 'all' OR (strategy = 'strict' AND is_match) OR (strategy = 'semantic' AND rank <= 25)),
ctx AS (SELECT question_id,
               string_agg('[Review ' || rank || '] ('
                          || CASE WHEN coalesce(sentiment, 0.0) > 0.1 THEN 'positive'
                                  WHEN coalesce(sentiment, 0.0) < -0.1 THEN 'negative' ELSE 'neutral' END
                          || ', score: ' || coalesce(CAST(score AS VARCHAR), '0') || ', from r/'
                          || coalesce(subreddit, '') || ')' || chr(10)
                          || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END,
                          chr(10) || chr(10) ORDER BY rank) AS context,
               count(*) AS n_reviews
        FROM kept WHERE rank <= 50 GROUP BY question_id)"""


def _ret_sql(select: str) -> str:
    return tb.with_ctes(select, "reviews", extra=_RET)


@register("knn", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT qid, id, round(similarity, 6) AS similarity, rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 12) AS similarity,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id)
              AS INTEGER) AS rank
  FROM e a, e b WHERE a.vec_id <> b.vec_id)
WHERE rank <= 10""")
def q_knn(spark, d):
    """The 10 nearest other vectors of every vector (exact, no pair table)."""
    e = tb.table(spark, d, "embeddings")
    out = knn(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")),
              e.select(F.col("vec_id").alias("id"), "embedding"), 10, exclude_self=True)
    return rounded(out.select("qid", "id", "similarity", "rank"))


@register("knn_lists")
def q_knn_lists(spark, d):
    """J11 by inverted lists: the 10 nearest of the vectors in the lists visited (recall in tests/test_ivf.py)."""
    e = tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    out = knn_lists(q, e, 10, learn_lists(e), exclude_self=True)
    return rounded(out.select("qid", "id", "similarity", "rank"))


@register("retrieve", _ret_sql("""
SELECT q.question_id, q.title, coalesce(r.retrieved, 0) AS retrieved, s.strategy, s.mention_count,
       coalesce(s.sources_count, 0) AS sources_count, md5(ctx.context) AS context_md5,
       CAST(length(ctx.context) AS INTEGER) AS context_chars, CAST(ctx.n_reviews AS INTEGER) AS n_reviews
FROM qs q
LEFT JOIN (SELECT question_id, count(*) AS retrieved FROM tf GROUP BY 1) r ON r.question_id = q.question_id
LEFT JOIN (SELECT question_id, any_value(strategy) AS strategy, any_value(mention_count) AS mention_count,
                  count(*) AS sources_count FROM kept GROUP BY 1) s ON s.question_id = q.question_id
LEFT JOIN ctx ON ctx.question_id = q.question_id"""))
def q_retrieve(spark, d):
    """C6 (F10 J11 P15 F11 J12 W12 A14): per question - title, retrieved, strategy, context."""
    summary, _ = retrieve(questions(spark, d), review_index(spark, d), N_NEIGHBOURS, HOURS,
                          F.lit(tb.NOW))
    return summary.select("question_id", "title", "retrieved", "strategy", "mention_count", "sources_count",
                          F.md5("context").alias("context_md5"), F.length("context").alias("context_chars"),
                          "n_reviews")


def metadata_index(spark, d):
    """C5 metadata documents, each with one of the supplied vectors, dealt out by number."""
    e, n = _vectors(spark, d)
    m = metadata_rows(meta_titles(spark, d), embed=False)
    return m.withColumn("vec_id", F.pmod(F.col("tmdb_id").cast("long"), n)).join(e, "vec_id").drop("vec_id")


def q_retrieve_expanded(spark, d):
    """C6 with F12: questions expanded by their nearest title metadata before the search."""
    summary, _ = retrieve(questions(spark, d), review_index(spark, d), N_NEIGHBOURS, HOURS, F.lit(tb.NOW),
                          metadata=metadata_index(spark, d), encode=by_length(spark, d))
    return summary.select("question_id", "title", "meta_id", F.md5("expanded").alias("expanded_md5"), "retrieved",
                          "strategy", F.md5("context").alias("context_md5"), "n_reviews")


@register("retrieve_samples", _ret_sql("""
SELECT question_id, CAST(rank AS INTEGER) AS rank,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text,
       CASE WHEN coalesce(sentiment, 0.0) > 0.1 THEN 'positive'
            WHEN coalesce(sentiment, 0.0) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment,
       CASE WHEN source = 'tmdb' THEN 'TMDB Review' ELSE coalesce(subreddit, 'reddit') END AS source_label,
       source AS source_type
FROM kept WHERE rank <= 5"""))
def q_retrieve_samples(spark, d):
    """First five relevant reviews per question, cut and labelled (rows kept aligned)."""
    _, samples = retrieve(questions(spark, d), review_index(spark, d), N_NEIGHBOURS, HOURS, F.lit(tb.NOW))
    return samples


@register("variant_match", _ret_sql("""
SELECT question_id, review_id, is_match FROM mt WHERE title IS NOT NULL"""))
def q_variant_match(spark, d):
    """J12 + F11: which retrieved texts contain a spelling of the question's title."""
    qs = questions(spark, d).withColumn("title", T.extract_title("question"))
    rows = nearest(qs, review_index(spark, d), N_NEIGHBOURS, hours=HOURS, now=F.lit(tb.NOW), titles=qs)
    return rows.filter(F.col("title").isNotNull()).select("question_id", "review_id", "is_match")


@register("relevance", _ret_sql("""
SELECT question_id, review_id, CAST(rank AS INTEGER) AS rank, strategy, mention_count FROM kept"""))
def q_relevance(spark, d):
    """Strict literal matches when there are >= 10, else the 25 most similar."""
    qs = questions(spark, d).withColumn("title", T.extract_title("question"))
    rows = nearest(qs, review_index(spark, d), N_NEIGHBOURS, hours=HOURS, now=F.lit(tb.NOW), titles=qs)
    kept = select_relevant(rows)
    return kept.select("question_id", "review_id", "rank", "strategy", "mention_count")


@register("retrieve_debug", _ret_sql(f"""
SELECT n.question_id, CAST(n.rank AS INTEGER) AS rank,
       CASE WHEN length(n.text) > 300 THEN substr(n.text, 1, 300) || '...' ELSE n.text END AS text,
       round(1.0 - n.similarity, 6) AS distance, n.movie_title_original AS movie_title, n.subreddit,
       n.sentiment, n.score, c.full_context_length
FROM tf n LEFT JOIN (
  SELECT question_id, CAST(length(string_agg('[Review ' || rank || '] ('
           || CASE WHEN coalesce(sentiment, 0.0) > 0.1 THEN 'positive'
                   WHEN coalesce(sentiment, 0.0) < -0.1 THEN 'negative' ELSE 'neutral' END
           || ', score: ' || coalesce(CAST(score AS VARCHAR), '0') || ', from r/' || coalesce(subreddit, '') || ')'
           || chr(10) || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END,
           chr(10) || chr(10) ORDER BY rank)) AS INTEGER) AS full_context_length
  FROM tf GROUP BY question_id) c ON c.question_id = n.question_id
WHERE n.rank <= 20"""))
def q_retrieve_debug(spark, d):
    """Top 20 neighbours with distance and the full context length."""
    out = retrieve_debug(questions(spark, d), review_index(spark, d), N_NEIGHBOURS, HOURS, F.lit(tb.NOW))
    return rounded(out)


@register("title_contains", tb.with_ctes("""
SELECT tconst, primaryTitle FROM basics WHERE contains(lower(primaryTitle), 'ring')""", "basics"))
def q_title_contains(spark, d):
    """Case-insensitive substring filter on titles."""
    return title_contains(tb.basics(spark, d), "primaryTitle", "Ring").select("tconst", "primaryTitle")


# ------------------------------------------------------------- C5, F8, F9, F12

def meta_titles(spark, d):
    """Title records for the metadata index: dump titles with ratings and credits."""
    from ..operators.aggregate import credits_pivot
    from ..operators.joins import credits
    b, r = tb.basics(spark, d), tb.ratings(spark, d)
    cr = credits_pivot(credits(tb.principals(spark, d), tb.names(spark, d)))
    j = b.join(r, "tconst", "left").join(cr, "tconst", "left")
    return j.select(F.col("pos").alias("id"), F.col("primaryTitle").alias("title"),
                    F.concat_ws(" ", F.lower("titleType"), "primaryTitle").alias("overview"),
                    F.concat("startYear", F.lit("-01-01")).alias("release_date"),
                    F.col("averageRating").alias("vote_average"), F.col("numVotes").alias("popularity"),
                    F.lit("movie").alias("media_type"), F.split("genres", ",").alias("genres"),
                    F.coalesce("actors", F.array().cast("array<string>")).alias("cast"),
                    F.split("primaryTitle", " ").alias("keywords"), F.col("averageRating").alias("imdb_rating"))


_META = _CREDITS + """,
mt0 AS (SELECT b.pos AS id, b.primaryTitle AS title, lower(b.titleType) || ' ' || b.primaryTitle AS overview,
               b.startYear || '-01-01' AS release_date, r.averageRating AS vote_average,
               r.numVotes AS popularity, 'movie' AS media_type, string_split(b.genres, ',') AS genres,
               coalesce(pv.actors, []) AS "cast", string_split(b.primaryTitle, ' ') AS keywords,
               r.averageRating AS imdb_rating
        FROM basics b LEFT JOIN ratings r ON r.tconst = b.tconst LEFT JOIN pv ON pv.tconst = b.tconst),
meta AS (SELECT 'tmdb_' || CAST(id AS VARCHAR) AS meta_id,
                concat_ws(' ', coalesce(title, ''), nullif(overview, ''),
                          CASE WHEN len(genres) > 0 THEN array_to_string(genres, ' ') END,
                          CASE WHEN len("cast") > 0 THEN array_to_string("cast"[1:5], ' ') END,
                          CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, ' ') END) AS document,
                coalesce(title, '') AS title, CAST(id AS VARCHAR) AS tmdb_id, coalesce(overview, '') AS overview,
                coalesce(release_date, '') AS release_date, coalesce(CAST(vote_average AS DOUBLE), 0.0) AS vote_average,
                coalesce(CAST(popularity AS DOUBLE), 0.0) AS popularity, media_type,
                CASE WHEN len(genres) > 0 THEN array_to_string(genres, ',') END AS genres,
                CASE WHEN len("cast") > 0 THEN array_to_string("cast"[1:10], ',') END AS "cast",
                CAST(imdb_rating AS DOUBLE) AS imdb_rating,
                CASE WHEN len(keywords) > 0 THEN array_to_string(keywords[1:10], ',') END AS keywords
         FROM mt0 WHERE id IS NOT NULL)"""


@register("index_metadata", tb.with_ctes("SELECT * FROM meta", "basics", "ratings", "principals", "names",
                                         extra=_META))
def q_index_metadata(spark, d):
    """C5 (P14 F8 F9 S15) without the vector: one metadata document per title."""
    return metadata_rows(meta_titles(spark, d), embed=False)


@register("expand_query", tb.with_ctes("""
SELECT meta_id, concat_ws(' ', list_concat(['tell me about ' || title],
         CASE WHEN "cast" IS NOT NULL AND "cast" <> '' THEN string_split("cast", ',')[1:3] ELSE [] END,
         CASE WHEN genres IS NOT NULL AND genres <> '' THEN string_split(genres, ',') ELSE [] END,
         CASE WHEN keywords IS NOT NULL AND keywords <> '' THEN string_split(keywords, ',')[1:3] ELSE [] END))
       AS expanded
FROM meta""", "basics", "ratings", "principals", "names", extra=_META))
def q_expand_query(spark, d):
    """question + top 3 cast + genres + top 3 keywords of the title metadata."""
    m = metadata_rows(meta_titles(spark, d), embed=False)
    q = F.concat(F.lit("tell me about "), F.col("title"))
    return m.select("meta_id", T.expand_query(q, "cast", "genres", "keywords").alias("expanded"))


@register("embed", r"""
SELECT doc_id, CAST(256 AS INTEGER) AS dim,
       CAST(CASE WHEN regexp_matches(coalesce(text, ''), '\p{L}') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm
FROM documents""")
def q_embed(spark, d):
    """Hashed n-gram encoder - every text gets a unit vector of 256 floats."""
    e = embed_hashed(tb.table(spark, d, "documents").select("doc_id", "text"), "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


# ------------------------------------------------ C6 with expansion, C4 and C5 with their merge

_QS = _RET[_RET.index("ut AS ("):_RET.index("nn AS ")]
_EXPANDED_QS = f"""
q0 AS (SELECT question_id, text AS question, {_extract_title_sql('text')} AS title FROM uq),
nv AS (SELECT count(*) AS n FROM embeddings),
qt AS (SELECT q0.*, e.embedding AS tvec FROM q0 LEFT JOIN embeddings e ON e.vec_id = length(q0.title) % (SELECT n FROM nv)),
mv AS (SELECT meta.*, e.embedding AS mvec FROM meta
       JOIN embeddings e ON e.vec_id = CAST(meta.tmdb_id AS BIGINT) % (SELECT n FROM nv)),
n1 AS (SELECT question_id, meta_id, "cast" AS mcast, genres AS mgenres, keywords AS mkeywords FROM qt, mv
       WHERE tvec IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(list_cosine_similarity(
           CAST(tvec AS DOUBLE[]), CAST(mvec AS DOUBLE[])), 12) DESC, meta_id) = 1),
qx AS (SELECT qt.question_id, qt.question, qt.title, n1.meta_id,
              CASE WHEN n1.meta_id IS NULL THEN qt.question ELSE concat_ws(' ', list_concat([qt.question],
                CASE WHEN mcast IS NOT NULL AND mcast <> '' THEN string_split(mcast, ',')[1:3] ELSE [] END,
                CASE WHEN mgenres IS NOT NULL AND mgenres <> '' THEN string_split(mgenres, ',') ELSE [] END,
                CASE WHEN mkeywords IS NOT NULL AND mkeywords <> '' THEN string_split(mkeywords, ',')[1:3] ELSE [] END))
              END AS expanded
       FROM qt LEFT JOIN n1 ON n1.question_id = qt.question_id),
qs AS MATERIALIZED (SELECT qx.*, {_variants_sql('title')} AS variants, e.embedding AS qvec FROM qx JOIN embeddings e ON e.vec_id = length(qx.expanded) % (SELECT n FROM nv)),
"""
_EXPANDED = _RET.replace(_QS, _EXPANDED_QS.lstrip())

register("retrieve_expanded", tb.with_ctes("""
SELECT q.question_id, q.title, q.meta_id, md5(q.expanded) AS expanded_md5, coalesce(r.retrieved, 0) AS retrieved,
       s.strategy, md5(ctx.context) AS context_md5, CAST(ctx.n_reviews AS INTEGER) AS n_reviews
FROM qs q
LEFT JOIN (SELECT question_id, count(*) AS retrieved FROM tf GROUP BY 1) r ON r.question_id = q.question_id
LEFT JOIN (SELECT question_id, any_value(strategy) AS strategy FROM kept GROUP BY 1) s ON s.question_id = q.question_id
LEFT JOIN ctx ON ctx.question_id = q.question_id""", "reviews", "basics", "ratings", "principals", "names",
    extra=_META.strip().rstrip(",") + ",\n" + _EXPANDED))(q_retrieve_expanded)


@register("index_reviews_merge", tb.with_ctes("""
SELECT review_id, score, 256 AS dim,
       CAST(CASE WHEN regexp_matches(text, '\\p{L}') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm
FROM (SELECT review_id, -1.0 AS score, text FROM idx WHERE CAST(review_id AS BIGINT) % 3 = 0
      UNION ALL
      SELECT review_id, score, text FROM idx WHERE CAST(review_id AS BIGINT) % 3 <> 0)""", "reviews", extra=_IDX_CTES))
def q_index_reviews_merge(spark, d):
    """C4 as one call: rows with their vector, merged; stored ids are skipped, of repeats the oldest is kept."""
    feed = review_feed(spark, d)
    later = feed.withColumns({"score": F.col("score") + 1000, "timestamp": F.lit("2024-02-01T00:00:00")})
    base = review_rows(feed.filter(F.col("doc_id") % 3 == 0)).withColumn("score", F.lit(-1.0))
    out = index_reviews(later.unionByName(feed), base, order="timestamp")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("review_id", "score", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


@register("index_metadata_merge", tb.with_ctes("""
SELECT meta_id, title, popularity, 256 AS dim FROM (
  SELECT meta_id, title, popularity FROM meta
  UNION ALL SELECT 'tmdb_' || CAST(-id - 1 AS VARCHAR), 'old', 0.0 FROM mt0 WHERE id % 5 = 0)""",
    "basics", "ratings", "principals", "names", extra=_META))
def q_index_metadata_merge(spark, d):
    """C5 as one call: documents with their vector, the newest of repeats wins over stored ones."""
    titles = meta_titles(spark, d).withColumn("seen", F.lit(2))
    older = titles.withColumns({"title": F.lit("older"), "seen": F.lit(1)})
    gone = titles.filter(F.col("id") % 5 == 0).withColumns({"id": -F.col("id") - 1, "title": F.lit("old")})
    kept = metadata_rows(gone).withColumn("popularity", F.lit(0.0))
    stored = kept.unionByName(metadata_rows(titles.filter(F.col("id") % 2 == 0).withColumn("title", F.lit("stored"))))
    out = index_metadata(older.unionByName(titles), stored, order="seen")
    return out.select("meta_id", "title", "popularity", F.size("embedding").alias("dim"))
