"""Source divergence audit by a token-start pointer sort.

A shard is a slice of an Arrow text buffer. Pointers to the starts of its
terms are sorted in place of the terms by multikey quicksort: eight bytes at a
time, and only inside runs of pointers that agree so far. Equal runs yield, by
language and source, a term's occurrences and the documents that hold it.
Spark adds the shards' counts; a term that makes up most of the corpus is one
row a shard and source.

Each language keeps the terms of enough documents. Every source of a language
is compared with its other sources and with the language as a whole by
smoothed shares, in whole numbers. The distance between two sources is summed
over blocks of terms, each a dense table of bounded size; terms absent from
all sources of a block differ by the same amount and need no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# The bytes of a term are letters and all bytes beyond ASCII.
IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

#: Bytes of text whose pointers are sorted together.
SLICE_BYTES = 16 << 20
#: Bytes of a term compared by words; what is left of longer terms is compared whole.
WORD_BYTES = 64
#: Terms and sources of one dense table.
BLOCK_TERMS, BLOCK_SOURCES = 512, 128


def term_pointers(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each term; document i is ``data[docs[i]:docs[i + 1]]``."""
    inside = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[docs] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end - start, np.searchsorted(docs, start, "right") - 1


def _word(low: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each term as one number, zero beyond its end; ``low`` ends in eight spare bytes."""
    at = np.lib.stride_tricks.sliding_window_view(low, 8)[start + 8 * k]
    word = at.view(">u8").ravel().astype(np.uint64)
    spare = (8 * np.clip(8 * (k + 1) - length, 0, 8)).astype(np.uint64)
    return np.where(spare < 64, word >> spare << spare, np.uint64(0))


def multikey_sort(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by the bytes of their terms, and the number of each one's run of equal terms."""
    def bounds(*keys):
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return new

    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _word(low, start, length, 0)
    order = np.argsort(key)
    new = bounds(key[order])
    k = 1
    while True:
        # runs of several terms of which some go on; one that ends here has no byte left and so comes first
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        longest = np.maximum.reduceat(length[order], np.flatnonzero(new))
        on = np.flatnonzero(np.repeat((size > 1) & (longest > 8 * k), size))
        if not len(on):
            break
        run = np.cumsum(new)[on]
        ptr = order[on]
        if 8 * k >= WORD_BYTES:
            rest = [low[s + 8 * k:s + n].tobytes() for s, n in zip(start[ptr].tolist(), length[ptr].tolist())]
            names = {x: i for i, x in enumerate(sorted(set(rest)))}
            key = np.array([names[x] for x in rest])
        else:
            key = _word(low, start[ptr], length[ptr], k)
        inner = np.lexsort((key, run))
        order[on] = ptr[inner]
        new[on] |= bounds(run, key[inner])
        if 8 * k >= WORD_BYTES:
            break
        k += 1
    return order, np.cumsum(new) - 1


def gathered(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The terms at the pointers as an Arrow string column."""
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[at])).cast(pa.string())


def slice_counts(data: np.ndarray, docs: np.ndarray, group: np.ndarray):
    """(terms, term, group, occurrences, documents) of the equal runs of a slice; ``group`` is by document."""
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    start, length, doc = term_pointers(data, docs)
    order, run = multikey_sort(low, start, length)
    if not len(order):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none, none
    first = np.flatnonzero(np.diff(run, prepend=-1))
    # documents lie group by group, so a run's documents in order are its groups in order
    pair = np.sort((run.astype(np.uint64) << np.uint64(32)) | doc[order].astype(np.uint64))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    at = np.flatnonzero(fresh)
    run_of, group_of = (pair[at] >> np.uint64(32)).astype(np.int64), group[(pair[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    seen = np.ones(len(at), bool)
    seen[1:] = (run_of[1:] != run_of[:-1]) | (group_of[1:] != group_of[:-1])
    seg = np.flatnonzero(seen)
    n = np.diff(np.append(at[seg], len(pair)))
    df = np.diff(np.append(seg, len(at)))
    return gathered(low, start[order[first]], length[order[first]]), run_of[seg], group_of[seg], n, df


def _long_counts(data: np.ndarray):
    """As ``slice_counts`` for one very long document, read in slices cut between terms."""
    totals: dict[str, int] = {}
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE_BYTES)
        if b < len(data):
            gap = np.flatnonzero(~IN_TERM[data[a:b]])
            while not len(gap) and b < len(data):  # a term longer than a slice
                a2, b = b, min(len(data), b + SLICE_BYTES)
                gap = np.flatnonzero(~IN_TERM[data[a2:b]]) + (a2 - a)
            b = a + int(gap[-1]) + 1 if len(gap) and b < len(data) else b
        terms, term, _, n, _ = slice_counts(data[a:b], np.array([0, b - a]), np.zeros(1, np.int64))
        for t, c in zip(terms.take(pa.array(term)).to_pylist(), n.tolist()):
            totals[t] = totals.get(t, 0) + c
        a = b
    k = np.arange(len(totals))
    return pa.array(list(totals), pa.string()), k, np.zeros(len(k), np.int64), np.array(list(totals.values()), np.int64), \
        np.ones(len(k), np.int64)


def batch_counts(b: pa.RecordBatch):
    """Record batches (lang, source, term, n, df) of a batch (text, lang, source) without nulls."""
    t = pa.Table.from_batches([b])
    codes = [t.column(k).combine_chunks().dictionary_encode() for k in ("lang", "source")]
    lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes)
    group = lang * max(1, len(codes[1].dictionary)) + source
    order = np.argsort(group, kind="stable")
    text = t.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(order))
    group = group[order]
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(text):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[a]:offsets[z]]
        if len(part) > SLICE_BYTES:
            terms, term, _, n, df = _long_counts(part)
            g = np.full(len(term), group[a])
        else:
            terms, term, g, n, df = slice_counts(part, offsets[a:z + 1] - offsets[a], group[a:z])
        width = max(1, len(codes[1].dictionary))
        yield pa.RecordBatch.from_arrays(
            [codes[0].dictionary.take(pa.array(g // width)), codes[1].dictionary.take(pa.array(g % width)),
             terms.take(pa.array(term)), pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])
        a = z


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each group of ``docs``."""
    def run(batches):
        for b in batches:
            yield from batch_counts(b)

    return docs.select("text", "lang", "source").mapInArrow(
        run, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (n + 5) / (total + 5 v)), exact; 1 where there is no term."""
    return (f"1 + coalesce((cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(19,0))) "
            f"div nullif(cast({total} as decimal(19,0)) + 5 * cast(v as decimal(18,0)), 0), 0L)")


def _tile(t: pa.Table) -> pa.Table:
    """Partial distances between the sources of one tile: (lang, source, item, part, terms, apart).

    Rows without a term name all sources of the tile with their share of an
    absent term.
    """
    named = t.column("term").is_null().to_numpy()
    side = t.column("block").to_numpy()
    heads = np.flatnonzero(named)
    names = pa.array(t.column("source").take(pa.array(heads)).to_pylist(), pa.string())
    base, block = t.column("p").to_numpy()[heads], side[heads]
    rows = t.filter(pa.array(~named))
    terms = rows.column("term").combine_chunks().dictionary_encode()
    width = len(terms.dictionary)
    table = np.repeat(base[:, None], max(1, width), 1)
    where = {x: i for i, x in enumerate(names.to_pylist())}
    at = np.array([where[x] for x in rows.column("source").to_pylist()], np.int64)
    table[at, terms.indices.to_numpy(zero_copy_only=False)] = rows.column("p").to_numpy()
    out = []
    across = t.column("x")[0].as_py() != t.column("y")[0].as_py()
    for i in range(len(names)):
        j = np.flatnonzero(block != block[i]) if across else np.delete(np.arange(len(names)), i)
        out.append((np.full(len(j), i), j, np.abs(table[j, :width] - table[i, :width]).sum(1), np.abs(base[j] - base[i])))
    i, j, part, apart = (np.concatenate(x) for x in zip(*out))
    return pa.table([pa.array([t.column("lang")[0].as_py()] * len(i), pa.string()), names.take(pa.array(i)),
                     names.take(pa.array(j)), pa.array(part), pa.array(np.full(len(i), width)), pa.array(apart)],
                    ["lang", "source", "item", "part", "terms", "apart"])


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs.

    Part ``pair`` lists the language's other sources, farthest first; part
    ``term`` the ``top`` terms that the source uses more than its language.
    Null text, lang and source count as ''. Each row is a document, repeated
    ones too. A source without terms is compared like any other; an empty
    table gives no rows. Other columns are not read.
    """
    docs = docs.select(*[F.coalesce(k, F.lit("")).alias(k) for k in ("text", "lang", "source")])
    counts = staged(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).filter(
        F.col("df") >= least_docs).select("lang", "term", "total")
    kept = staged(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    rows = staged(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "counts")
    used = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = staged(docs.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(
        langs, "lang", "left").fillna(0, ["size", "v", "all"]), "groups")
    share = staged(rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", F.expr(_share("n", "size")).alias("p"), F.expr(_share("total", "all")).alias("q")), "shares")

    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = F.row_number().over(by).alias("rank")
    terms = share.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", ranked).filter(F.col("rank") <= top)

    # tiles (lang, cut, x, y): a block of terms, two blocks of sources
    sizes = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("sources")).filter("sources > 1").select(
        "lang", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).alias("cuts"),
        F.ceil(F.col("sources") / BLOCK_SOURCES).alias("blocks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")
    heads = groups.withColumn("p", F.expr(_share("0", "size"))).join(sizes, "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "p", block, "blocks",
        F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    cells = share.join(sizes, "lang").select(
        "lang", "source", "term", "p", block, "blocks", F.pmod(F.xxhash64("term"), F.col("cuts")).alias("cut"))
    tiles = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "cut", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "block", "source", "term", "p")
    found = tiles.groupBy("lang", "cut", "x", "y").applyInArrow(
        _tile, "lang string, source string, item string, part long, terms long, apart long")
    found = found.groupBy("lang", "source", "item").agg(
        F.sum("part").alias("part"), F.sum("terms").alias("terms"), F.max("apart").alias("apart"))
    pairs = found.join(groups.select("lang", "source", "v"), ["lang", "source"]).select(
        "lang", "source", "item", (F.col("part") + (F.col("v") - F.col("terms")) * F.col("apart")).alias("value"))
    pairs = pairs.withColumn("rank", ranked)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
