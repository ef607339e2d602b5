"""C6 retrieval over a table of questions and C7 its debug view.

For every question: extract the title (F10); optionally expand the question
with the nearest title metadata (J11 n=1 + F12); take the top ``n`` reviews
by cosine similarity (J11); apply the time filter *after* the top-n, keeping
rows whose time does not parse (P15); decide relevance (F11 + J12 + W12);
assemble the numbered context of the first 50 kept reviews (A14) and the
first five samples (W15). All steps are per-question and bounded by ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ellipsis, expand_query, extract_title, match_any, title_variants
from ..operators.aggregate import assemble_context
from ..operators.clean import recent
from ..operators.knn import block_count, knn
from ..operators.rank import sample_sources
from ..operators.scan import staged


#: Characters of a text that a context shows.
SHOWN = 500


def nearest(questions: DataFrame, reviews: DataFrame, n: int = 100, q_vec: str = "qvec",
            hours: float | None = 168, now=None, filter_order: str = "after",
            title_filter: str | None = None, titles: DataFrame | None = None, shown: int | None = None,
            blocks=None, once: bool = False) -> DataFrame:
    """J11 + P11 + P15: the ``n`` most similar reviews per question.

    ``filter_order="after"`` (upstream behaviour) applies the time filter to
    the top-n, so fewer than ``n`` rows may remain; ``"before"`` filters the
    collection first. ``title_filter`` keeps reviews whose lower-cased title
    contains it. With ``titles`` (``question_id, title``) rows get ``title``
    and ``is_match``, whether the whole text has a spelling of it (J12); with
    ``shown`` only so many characters of a text go on. ``blocks`` and
    ``once`` are for :func:`knn`; with ``once`` the times meet the rows found
    for a vector, not those of each of its questions.
    """
    coll = reviews
    if title_filter:
        coll = coll.filter(F.col("movie_title").contains(title_filter.lower()))
    if hours is not None and filter_order == "before":
        coll = recent(coll, "timestamp", hours, now, inclusive=True, keep_bad=True)
    after = hours is not None and filter_order == "after"
    fresh = recent(coll, "timestamp", hours, now, inclusive=True, keep_bad=True) if after else coll

    def timed(found):  # how many reviews of an id are in time; it may come more than once
        return found.join(fresh.groupBy("review_id").agg(F.count(F.lit(1)).cast("int").alias("__fresh")), "review_id", "left")

    nn = knn(questions, coll, n, q_id="question_id", q_vec=q_vec, c_id="review_id", c_vec="embedding",
             blocks=blocks, once=once, mark=timed if once and after else None)
    # ranked before the texts come in: a text moves once a review, not once a neighbour
    if once and after:
        nn = nn.filter(F.col("__fresh") > 0).select("question_id", "review_id", "similarity", "rank",
                                                    F.explode(F.sequence(F.lit(1), "__fresh")).alias("__fresh")).drop("__fresh")
    elif after:
        nn = recent(nn.join(coll.select("review_id", "timestamp"), "review_id"), "timestamp", hours, now,
                    inclusive=True, keep_bad=True).drop("timestamp")
    coll = fresh  # only these are scored and moved
    w = Window.partitionBy("question_id").orderBy("rank")
    nn = nn.withColumn("rank", F.row_number().over(w))
    if titles is not None:
        # the spellings are made once a question and meet its neighbours before the texts do, so whole texts go no further
        nn = nn.join(titles.select("question_id", "title", title_variants("title").alias("__variants")), "question_id", "left")
        coll = coll.withColumn("__low", F.lower("text"))  # once a review, not once a neighbour and spelling
    if shown is not None:
        coll = coll.withColumn("text", F.substring("text", 1, shown))
    rows = nn.join(coll.drop("embedding"), "review_id")
    if titles is not None:
        rows = rows.withColumn("is_match", F.when(F.col("title").isNotNull(), match_any("__low", F.col("__variants"), lowered=True))) \
            .drop("__variants", "__low")
    return rows


def select_relevant(rows: DataFrame, titles: DataFrame | None = None, min_strict: int = 10,
                    fallback: int = 25, shown: int | None = None) -> DataFrame:
    """Strict literal matches if there are at least ``min_strict``, else
    the ``fallback`` most similar; questions without a title keep all rows.

    Adds ``strategy`` and ``mention_count`` per question; rows keep their
    similarity order in ``rank`` (renumbered within the kept rows). Without
    ``titles`` the rows bring ``title`` and ``is_match`` along (from
    :func:`nearest`). Whole texts are matched; with ``shown`` only so many
    characters go on from there.
    """
    r = rows
    if titles is not None:
        spelt = titles.select("question_id", "title", title_variants("title").alias("__variants"))
        r = rows.join(spelt, "question_id", "left")
        r = r.withColumn("is_match", F.when(F.col("title").isNotNull(), match_any("text", F.col("__variants")))).drop("__variants")
    if shown is not None:
        r = r.withColumn("text", F.substring("text", 1, shown))
    wq = Window.partitionBy("question_id")
    r = r.withColumn("__strict", F.count_if(F.col("is_match")).over(wq)) \
         .withColumn("__all", F.count(F.lit(1)).over(wq))
    strategy = (F.when(F.col("title").isNull(), F.lit("all"))
                .when(F.col("__strict") >= min_strict, F.lit("strict")).otherwise(F.lit("semantic")))
    r = r.withColumn("strategy", strategy)
    keep = ((F.col("strategy") == "all") | ((F.col("strategy") == "strict") & F.col("is_match"))
            | ((F.col("strategy") == "semantic") & (F.col("rank") <= fallback)))
    mention = (F.when(F.col("strategy") == "all", F.col("__all"))
               .when(F.col("strategy") == "strict", F.col("__strict"))
               .otherwise(F.least(F.col("__all"), F.lit(fallback))))
    kept = r.filter(keep).withColumn("mention_count", mention.cast("bigint")) \
        .withColumn("retrieved", F.col("__all").cast("bigint"))
    w = Window.partitionBy("question_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).drop("__strict", "__all")


def expand_questions(questions: DataFrame, metadata: DataFrame, title_vec: str = "tvec", ask: str = "question_id") -> DataFrame:
    """F12 + J11 (n=1): add the nearest metadata's cast, genres and keywords to the question.

    With ``ask="title"`` a title is searched once, however many questions ask for it,
    and so are titles to which the encoder gives one vector.
    """
    asked = F.when(F.col("question_id").isNotNull(), F.col(ask))
    titles = (questions.filter(F.col(title_vec).isNotNull() & asked.isNotNull())
              .select(asked.alias("__asked"), title_vec).distinct())
    nn = knn(titles, metadata, 1, q_id="__asked", q_vec=title_vec, c_id="meta_id", c_vec="embedding", once=True)
    meta = metadata.select("meta_id", "cast", "genres", "keywords")
    j = questions.withColumn("__asked", asked).join(nn.select("__asked", "meta_id"), "__asked", "left").drop("__asked") \
        .join(meta, "meta_id", "left")
    return j.withColumn("expanded", F.when(F.col("meta_id").isNotNull(),
                                           expand_query("question", "cast", "genres", "keywords"))
                        .otherwise(F.col("question")))


def retrieve(questions: DataFrame, reviews: DataFrame, n: int = 100, hours: float = 168, now=None,
             context_n: int = 50, samples: int = 5, metadata: DataFrame | None = None, encode=None):
    """Returns ``(summary, samples)``.

    ``questions``: ``question_id, question, qvec`` (the question's vector,
    from the encoder or a supplied table). ``reviews``: the review index
    (C4) with ``embedding``. With ``metadata`` (C5, with ``embedding``) and
    ``encode(df, text_col, out_col)`` every question with a title is expanded
    by its nearest title's metadata, and the expanded text is what is encoded
    and searched for, once where the encoder gives equal vectors; the summary
    then has ``meta_id`` and ``expanded``.
    """
    titled = questions.withColumn("title", extract_title("question"))
    extra, blocks = [], block_count(questions) if metadata is None else None
    if metadata is not None:
        extra = ["meta_id", "expanded"]
        # read several times each: without it titles are extracted and the titles' metadata searched anew for every reader
        titled = staged(encode(titled.drop("qvec"), "title", "tvec"), "titled")
        titled = encode(expand_questions(titled, metadata, ask="title").drop("tvec"), "expanded", "qvec")
        titled = staged(titled.select("question_id", "title", *extra, "qvec"), "expanded")
    # one character more tells whether a text was cut
    rows = nearest(titled, reviews, n, hours=hours, now=now, titles=titled, shown=SHOWN + 1, blocks=blocks,
                   once=metadata is not None)
    kept = select_relevant(rows)
    # one aggregation over the kept rows: context of the first ``context_n``,
    # counts over all of them (the neighbour rows are computed once)
    ctx = assemble_context(kept, ["question_id"], "rank", n=context_n, extra=[
        F.first("strategy").alias("strategy"), F.first("mention_count").alias("mention_count"),
        F.first("retrieved").alias("retrieved"), F.count(F.lit(1)).alias("sources_count")])
    summary = (titled.select("question_id", "title", *extra).join(ctx, "question_id", "left")
               .withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))
               .withColumn("sources_count", F.coalesce("sources_count", F.lit(0))))
    return summary, sample_sources(kept, samples)


def retrieve_debug(questions: DataFrame, reviews: DataFrame, n: int = 100, hours: float = 168,
                   now=None, show: int = 20) -> DataFrame:
    """The first ``show`` neighbours with distance, cut text and the
    context length of all retrieved rows (no title logic)."""
    rows = nearest(questions, reviews, n, hours=hours, now=now, shown=SHOWN + 1)
    # one pass over the neighbours: a join of both views would search twice
    top = F.struct("rank", ellipsis("text", 300).alias("text"), (F.lit(1.0) - F.col("similarity")).alias("distance"),
                   F.col("movie_title_original").alias("movie_title"), "subreddit", "sentiment", "score")
    both = assemble_context(rows, ["question_id"], "rank", n=n, extra=[
        F.collect_list(F.when(F.col("rank") <= show, top)).alias("__top")])
    length = F.when(F.col("question_id").isNotNull(), F.length("context")).alias("full_context_length")
    return both.select("question_id", F.explode("__top").alias("__top"), length).select(
        "question_id", "__top.*", "full_context_length")
