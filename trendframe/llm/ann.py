"""Approximate nearest neighbours by multi-index hashing.

A vector's code is the signs of its coordinates under a rotation that is
learned on a bounded sample by iterative quantisation. Codes are cut into four
substrings, and a slice of the rows is indexed by each. Codes within ``r``
bits of a query's agree with it, in at least one substring, to within
``r // 4`` bits (the pigeonhole principle), so probing those substrings finds
every code within the radius; survivors of the whole code's distance are
ranked by their cosine.

The radius is a query's own. From pairs of the sample comes the distance that
codes of vectors with a given cosine rarely exceed; the query's fifth best
cosine known so far, first among the sample and then, by a narrower probe, in
the slice, gives the radius. The more rows there are, the nearer the
neighbours and the smaller the radius.

Every row is indexed and every query meets every slice: queries in blocks,
rows in slices of bounded size, one task for each two of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BITS, PARTS = 64, 4
#: Rows on which rotation and radii are learned.
SAMPLE = 4096
#: Of the sample's pairs at a cosine, the share whose codes lie within the radius.
REACH = 0.98
#: Bits by which the first probe is narrower.
NARROW = 6
#: Rows of a slice, queries of a block, queries whose sample scores are held at a time.
SLICE_ROWS, BLOCK_ROWS, TILE = 1 << 17, 1 << 13, 512
#: Steps of cosine in the table of radii.
STEPS = 200


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def learn_rotation(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Matrix (dimension, BITS) of iterative quantisation: principal axes, then the rotation nearest to its own signs."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :BITS]
    rng = np.random.default_rng(42)
    rot = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0][:axes.shape[1]]
    y = x @ axes
    for _ in range(rounds if len(x) else 0):
        u, _, v = np.linalg.svd(np.where(y @ rot >= 0, 1.0, -1.0).T @ y, full_matrices=False)
        rot = (u @ v).T
    return axes @ rot


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation >= 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def learn_radii(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """By step of cosine, the code distance that ``REACH`` of the pairs at that cosine or just above stay within."""
    c = codes(x, rotation)
    hist = np.zeros((STEPS + 1, BITS + 1), np.int64)
    for a in range(0, len(x), TILE):
        sim = x[a:a + TILE] @ x.T
        far = np.bitwise_count(c[a:a + TILE, None] ^ c[None, :])
        off = np.arange(len(x))[None, :] != np.arange(a, a + len(sim))[:, None]
        np.add.at(hist, (step(sim[off]), far[off]), 1)
    out = np.full(STEPS + 1, BITS)
    for k in range(STEPS + 1):
        near = hist[k:k + STEPS // 20].sum(0)
        if near.sum() >= 20:
            out[k] = np.searchsorted(np.cumsum(near), REACH * near.sum())
        elif k:
            out[k] = out[k - 1]  # too few pairs so near: what the next farther ones need
    return np.minimum.accumulate(out)


def step(cosine) -> np.ndarray:
    return np.clip(np.floor((np.asarray(cosine) + 1) * STEPS / 2), 0, STEPS).astype(np.int64)


def cosines(q: np.ndarray, rows: np.ndarray, q_norm: float, norms: np.ndarray) -> np.ndarray:
    """Row by row in the same order of additions, so equal vectors score alike wherever they are held."""
    return (rows * q).sum(1) / (norms * q_norm)


def ball(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)) <= radius)


class Index:
    """Substring tables of a slice's codes."""

    def __init__(self, code: np.ndarray):
        self.code = code
        sub = code[:, None] >> np.arange(0, BITS, BITS // PARTS).astype(np.uint64)
        self.sub = (sub & np.uint64(0xFFFF)).astype(np.int64)
        self.rows = [np.argsort(self.sub[:, k], kind="stable") for k in range(PARTS)]
        self.ends = [np.concatenate([[0], np.cumsum(np.bincount(self.sub[:, k], minlength=1 << 16))]) for k in range(PARTS)]
        self.balls: dict[int, np.ndarray] = {}

    def within(self, query: int, radius: int) -> np.ndarray:
        """Rows whose code differs from ``query`` in at most ``radius`` bits."""
        if radius >= BITS:
            return np.arange(len(self.code))
        hit = np.zeros(len(self.code), bool)
        # radius = PARTS * r + a: within r bits in one of the first a + 1 substrings, or within r - 1 in another
        r, a = divmod(radius, PARTS)
        for k in range(PARTS):
            reach = r if k <= a else r - 1
            if reach < 0:
                continue
            if reach not in self.balls:
                self.balls[reach] = ball(reach)
            at = self.balls[reach] ^ (int(query) >> (16 * k) & 0xFFFF)
            lo, n = self.ends[k][at], self.ends[k][at + 1] - self.ends[k][at]
            full = n > 0
            lo, n = lo[full], n[full]
            ends = np.cumsum(n)
            pos = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - n), n)
            hit[self.rows[k][pos]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.code[found] ^ query) <= radius]


class Model:
    """Rotation, radii and the sample itself, whose size is bounded by ``SAMPLE``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.unit = vectors / self.norms[:, None]
        self.rotation = learn_rotation(self.unit)
        self.radii = learn_radii(self.unit, self.rotation)

    def radius(self, nth: float) -> int:
        return int(self.radii[step(nth)]) if np.isfinite(nth) else BITS


def _first(ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best scores, ties to the smaller id."""
    if len(score) > 4 * n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:n]]
    return np.lexsort((ids, -score))[:n]


def search(model: Model, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, n: int):
    """(query id, id, score) of the rows found; a query's own id is no candidate.

    Rows with equal vectors are looked at once: only the ``n + 1`` smallest
    ids of a vector can be among ``n`` results.
    """
    norms = np.sqrt((vectors * vectors).sum(1))
    index = Index(codes(vectors / norms[:, None], model.rotation))
    q_norm = np.sqrt((q * q).sum(1))
    q_unit = q / q_norm[:, None]
    q_code = codes(q_unit, model.rotation)
    out = []
    for a in range(0, len(q), TILE):
        near = q_unit[a:a + TILE] @ model.unit.T
        near[q_ids[a:a + TILE, None] == model.ids[None, :]] = -np.inf
        known = np.sort(np.partition(near, -n, axis=1)[:, -n:], axis=1)[:, 0] if near.shape[1] >= n else np.full(len(near), -np.inf)
        for i, nth in enumerate(known, a):
            wide = model.radius(nth)
            radius = max(0, wide - NARROW)
            while True:
                rows = index.within(q_code[i], radius)
                rows = rows[ids[rows] != q_ids[i]]
                score = cosines(q[i], vectors[rows], q_norm[i], norms[rows])
                best = _first(ids[rows], score, n)
                if len(best) == n:
                    wide = min(wide, model.radius(max(nth, score[best[-1]])))
                if radius >= (wide if len(best) == n else BITS):
                    break
                # fewer than n within the radius: it grows until there are n or it holds all rows
                radius = wide if radius < wide else min(BITS, radius + NARROW)
            out.append((np.full(len(best), q_ids[i]), ids[rows[best]], score[best]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, np.zeros(0))


def _once(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of rows, of each different vector those with the ``most`` smallest ids."""
    raw = np.ascontiguousarray(vectors)
    _, which = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.lexsort((ids, which))
    again = np.zeros(len(by), bool)
    again[1:] = (which[by[1:]] == which[by[:-1]]) & (ids[by[1:]] == ids[by[:-1]])
    by = by[~again]
    first = np.searchsorted(which[by], which[by])
    return by[np.arange(len(by)) - first < most]


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim)


def nearest(rows: DataFrame, is_query, n: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            sample: int = SAMPLE, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query``, the ``n`` nearest rows by cosine.

    Ties go to the smaller id. A query with fewer than ``n`` candidates gets
    all of them. Rows take no part whose id or vector is null, whose vector
    is zero or empty, holds a null or non-finite component, or has another
    length than most vectors. An id that repeats is one candidate, by its best
    vector, and one query, with the best results of its vectors. An empty
    table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    v = F.col(vec_col).cast("array<double>")
    big = F.array_max(F.transform(v, F.abs))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # scaled by a power of two where squares would leave the range of doubles; cosines stay as they are
    power = F.floor(F.log2(big))
    scaled = F.when((big > 1e-100) & (big < 1e100), v).otherwise(
        F.transform(v, lambda x: x * F.pow(F.lit(2.0), -F.floor(power / 2)) * F.pow(F.lit(2.0), -(power - F.floor(power / 2)))))
    live = rows.filter(F.col(id_col).isNotNull() & sound & (big > 0)).select(
        F.col(id_col).cast("long").alias("id"), scaled.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    live = staged(live.withColumn("dim", F.size("v")), "vectors")
    dims = live.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("q")).orderBy(
        F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, live = dims.dim, live.filter(F.col("dim") == dims.dim)
    fit = live.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()
    model = Model(fit.column("id").to_numpy(), _matrix(fit.column("v"), dim))
    blocks = math.ceil(dims.q / block_rows) or 1
    slices = max(math.ceil(dims.n / slice_rows), math.ceil(spark.sparkContext.defaultParallelism / blocks))

    def dealt(part, own, parts, other, copies):
        salt = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
        return part.select("id", "v", salt.alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    shared = spark.sparkContext.broadcast(model)  # ``sample`` vectors at most

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left):
            m = shared.value
            q_ids, q = left.column("id").to_numpy(), _matrix(left.column("v"), dim)
            ids, vectors = right.column("id").to_numpy(), _matrix(right.column("v"), dim)
            keep = _once(ids, vectors, n + 1) if len(ids) else np.zeros(0, np.int64)
            found = search(m, q_ids, q, ids[keep], vectors[keep], n)
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    q = dealt(live.filter("q"), "block", blocks, "slice", slices)
    c = dealt(live, "slice", slices, "block", blocks)
    found = q.groupBy("block", "slice").cogroup(c.groupBy("block", "slice")).applyInArrow(
        run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(
        "query_id", "rank", "vec_id", "score")
