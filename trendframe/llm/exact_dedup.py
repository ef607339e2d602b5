"""Exact deduplication by content-defined chunk recipes.

A text is cut where its content says so: after the first sentence or line
end that follows at least ``min_chunk`` characters, or at ``max_chunk``
characters where there is none. Equal texts therefore have equal chunks, and
long texts that share passages share chunks. Each different chunk gets a
verified identifier ``(hash, rank)``: chunks are grouped by hash *and* text,
so two chunks with one hash but different texts get different ranks. A
document becomes its ordered identifier list - its recipe - and documents are
compared by recipe alone. Chunk text is shuffled once, after map-side
deduplication; whole documents are never shuffled.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, staged

MIN_CHUNK = 1024
MAX_CHUNK = 8192


def chunked(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The chunks of a text, in order; their concatenation is the text."""
    cut = f"(?s).{{{min_chunk - 1},{max_chunk - 1}}}?[.!?\\n]|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _chunk_table(docs: DataFrame, chunks: Column, chunk_hash) -> DataFrame:
    one = docs.select(F.explode(chunks).alias("chunk"))
    return one.select(chunk_hash(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK,
                chunk_hash=F.xxhash64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z. The row with the
    largest id of a group stays (nulls are smallest). Of repeated rows, with
    the same id and text, exactly one stays, whichever; all of them count in
    ``group_size``. A null text counts as the empty text, whose recipe is the
    empty list. An empty table gives an empty result. Other columns, whatever
    their names, are not read. ``chunk_hash`` is replaceable to test what
    happens when hashes collide.
    """
    src = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    chunks = chunked(F.col("t"), min_chunk, max_chunk)
    distinct = _chunk_table(src, chunks, chunk_hash)
    collided = staged(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "collided")
    plain = src.select("id", F.monotonically_increasing_id().alias("row"), F.sha2("t", 256).alias("sha"),
                       F.transform(chunks, lambda c: chunk_hash(c)).alias("hashes"), "t")
    if collided.isEmpty():
        # every hash stands for one text: rank 0 throughout
        recipes = plain.select("id", "row", "sha", F.col("hashes").alias("recipe"))
    else:
        recipes = _ranked(plain, chunks, distinct.join(collided, "h", "left_semi"), chunk_hash)
    recipes = staged(recipes, "recipes")
    groups = recipes.groupBy("recipe").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    groups = staged(groups, "groups")
    joined = join_groups(recipes, groups, "recipe", "n", F.col("row"))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.size("recipe").alias("n_chunks"))


def _ranked(plain: DataFrame, chunks: Column, ambiguous: DataFrame, chunk_hash) -> DataFrame:
    """Recipes as (hash, rank) lists; only chunks with an ambiguous hash look up their rank."""
    # the texts that share one hash, each written once; a smaller text sorts first
    texts = ambiguous.select("h", "chunk")
    ranks = staged(texts.alias("a").join(texts.alias("b"), F.expr("a.h = b.h AND b.chunk <= a.chunk"))
                   .groupBy("a.h", "a.chunk").agg(F.count("*").alias("rank")), "ranks")
    parts = staged(plain.select("id", "row", "sha", F.posexplode_outer(chunks).alias("pos", "chunk"))
                   .withColumn("h", F.when(F.col("chunk").isNotNull(), chunk_hash(F.col("chunk")))), "parts")
    return (parts.join(ranks, ["h", "chunk"], "left")
            .groupBy("id", "row", "sha")
            .agg(F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct(
                "pos", "h", F.coalesce("rank", F.lit(0)).alias("rank"))))).alias("parts"))
            .select("id", "row", "sha", F.transform("parts", lambda p: F.struct(p["h"], p["rank"])).alias("recipe")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are matched back by id and text digest. Where one row was repeated
    as a whole, a single copy of it stays.
    """
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    kept = (exact_dedup(docs, id_col, text_col, **kw)
            .groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
            .agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).filter("kept"))
    kept = staged(kept, "kept")
    tagged = docs.withColumn("kept_sha_of_row", digest)

    def matched(rows: DataFrame) -> DataFrame:
        return tagged.join(rows, tagged[id_col].eqNullSafe(rows["kept_id"]) &
                           (tagged["kept_sha_of_row"] == rows["kept_sha"]), "left_semi")

    once = matched(kept.filter("copies = 1")).drop("kept_sha_of_row")
    if kept.filter("copies > 1").isEmpty():
        return once
    repeated = matched(kept.filter("copies > 1")).dropDuplicates([id_col, "kept_sha_of_row"])
    return once.unionByName(repeated.drop("kept_sha_of_row"))
