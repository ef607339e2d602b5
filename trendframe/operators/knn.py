"""Exact top-n nearest neighbours by cosine similarity.

Queries are dealt into blocks of bounded size, so that a block's running top
``n`` fits a task; each block meets the whole collection, which streams past it
in batches, in ascending id (no product join, nothing through the driver, no
broadcast). Where blocks are fewer than task slots the collection is dealt into
slices too. A query returns at most ``n`` rows a slice; a per-query
``row_number() <= n`` (a partial group limit before the shuffle) merges them.

Tiles are scored in single precision. Only rows that may reach a query's
``n``-th best so far, the error of that product allowed for, are scored again
in double precision, so the result is exact. The work is the product of both
sizes by nature; memory is bounded by the block.

Queries of equal vectors may be searched once (``once``): each different vector
is searched for, then its rows go to all queries that have it.

Similarities are rounded to 12 decimals, so equal vectors tie whatever tile
they were scored in; ties go to the smaller id. A zero or null vector has no
direction and takes no part, as a query or as a neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .partitioning import file_bytes
from .rank import top_per_key

#: Queries of a block; bytes of files whose rows make up a slice of the collection.
BLOCK_ROWS = 49_152
SLICE_BYTES = 4 << 30
#: Queries and collection rows whose scores are held at a time; pairs scored again at a time.
TILE_QUERIES, TILE_ROWS = 1024, 512
#: Rows of a tile whose best stands for them when a first bound is looked for.
GROUP = 16
PAIRS = 16_384
#: Queries of one vector that get its rows in one part.
SHARED = 256


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors; a zero vector becomes NaN."""
    flat = column.combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, np.nan)[:, None]


def _best(query: np.ndarray, row: np.ndarray, sim: np.ndarray, n: int):
    """The ``n`` best (query, row, sim) of each query; the smaller row wins a tie."""
    order = np.lexsort((row, -sim, query))
    query, row, sim = query[order], row[order], sim[order]
    new = np.ones(len(query), bool)
    new[1:] = query[1:] != query[:-1]
    first = np.flatnonzero(new)
    keep = np.arange(len(query)) - first[np.cumsum(new) - 1] < n
    return query[keep], row[keep], sim[keep]


class Top:
    """Running ``n`` best rows of a tile of queries (unit vectors); rows come in the order in which ties are broken."""

    def __init__(self, queries: np.ndarray, n: int):
        self.q, self.q32, self.n = queries, queries.astype(np.float32), n
        self.slack = (queries.shape[1] + 8) * 2.0 ** -23  # error of a single-precision product of unit vectors
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new, self.waiting, self.room = [], 0, max(n, 16) * len(queries) // 2
        self.least = np.full(len(queries), -np.inf)  # the n-th best
        self.floor = np.full(len(queries), -3, np.float32)  # what a row must reach in single precision
        self.bounded = False

    def bound(self, rows32: np.ndarray, own=None):
        """A first floor: the ``n``-th best of the groups' best rows, below which no row is among the ``n`` best.

        Without it nearly every row met early on is one of the best so far, to be scored again and trimmed away.
        """
        groups = []
        for b in range(0, len(rows32), TILE_ROWS):
            sims = self.scores(rows32, b, own)
            while sims.shape[1] > TILE_ROWS // GROUP and sims.shape[1] % 2 == 0:
                half = sims.shape[1] // 2
                sims = np.maximum(sims[:, :half], sims[:, half:])
            groups.append(sims)
        groups = np.concatenate(groups, axis=1)
        place = groups.shape[1] - self.n
        least = np.partition(groups, place, axis=1)[:, place]
        self.floor = np.maximum(self.floor, least - np.float32(2 * self.slack))
        self.bounded = True

    def scores(self, rows32: np.ndarray, b: int, own=None) -> np.ndarray:
        """Single-precision products of the queries and the tile of rows that begins at ``b``."""
        sims = self.q32 @ rows32[b:b + TILE_ROWS].T
        if own is not None:
            here = (own[1] >= b) & (own[1] < b + sims.shape[1])
            sims[own[0][here], own[1][here] - b] = -np.inf
        return sims

    def meet(self, rows: np.ndarray, rows32: np.ndarray, at: np.ndarray, own=None):
        """Rows number ``at``, all finite; ``own`` are (query, place among the rows) pairs to leave out."""
        if not self.bounded and len(rows) >= 2 * self.n * GROUP:
            self.bound(rows32, own)
        found, waiting = [], 0
        for b in range(0, len(rows), TILE_ROWS):
            sims = self.scores(rows32, b, own)
            wide = sims.shape[1]
            some = np.flatnonzero(sims.max(axis=1) >= self.floor)
            if not len(some):
                continue
            sims = sims[some] if len(some) < len(sims) else sims
            hit = sims >= self.floor[some, None]
            i, j = np.divmod(np.flatnonzero(hit), wide)
            if len(i) > self.n:
                many = np.flatnonzero(np.bincount(i) > self.n)
                if len(many):  # the n best of the tile alone, and what may tie with them
                    best = sims[many]
                    hit[many] &= best >= np.partition(best, wide - self.n, axis=1)[:, wide - self.n, None] - np.float32(2 * self.slack)
                    i, j = np.divmod(np.flatnonzero(hit), wide)
            i = some[i]
            if len(i):
                found.append((i, j + b))
                waiting += len(i)
            if waiting >= self.room:
                self.take(found, rows, at)
                found, waiting = [], 0
        self.take(found, rows, at)

    def take(self, found: list, rows: np.ndarray, at: np.ndarray):
        """Score the pairs (query, place) again in double precision."""
        if not found:
            return
        i, j = (np.concatenate(x) for x in zip(*found))
        low, high = int(j.min()), int(j.max()) + 1
        if 8 * len(i) > len(self.q) * (high - low):
            exact = (self.q @ rows[low:high].T)[i, j - low]
        else:
            exact = np.empty(len(i))
            for a in range(0, len(i), PAIRS):
                exact[a:a + PAIRS] = np.einsum("ij,ij->i", self.q[i[a:a + PAIRS]], rows[j[a:a + PAIRS]])
        exact = np.round(exact, 12)
        better = exact > self.least[i]  # a later row loses a tie
        self.new.append((i[better], at[j[better]], exact[better]))
        self.waiting += len(self.new[-1][0])
        if self.waiting >= self.room:
            self.trim()

    def trim(self):
        """Keep the ``n`` best of each query; of equal ones those that came first, in that order."""
        i, row, sim = (np.concatenate(x) for x in zip(self.best, *self.new))
        self.new, self.waiting = [], 0
        order = np.argsort(i.astype(np.int16) if len(self.q) < 2 ** 15 else i, kind="stable")
        i, row, sim = i[order], row[order], sim[order]
        held = np.bincount(i, minlength=len(self.q))
        most = held.max(initial=0)
        if most >= self.n:
            if most * len(held) > 4 * len(i) + PAIRS:  # a few queries hold most of the pairs
                i, row, sim = _best(i, row, sim, self.n)
                held = np.bincount(i, minlength=len(held))
                full = held == self.n
                self.least[full] = sim[np.cumsum(held)[full] - 1]
            else:
                first = np.cumsum(held) - held
                sims = np.full((len(held), most), -np.inf)
                sims[i, np.arange(len(i)) - first[i]] = sim
                self.least = np.partition(sims, most - self.n, axis=1)[:, most - self.n]
                keep, tie = sim > self.least[i], sim == self.least[i]
                left = self.n - np.bincount(i[keep], minlength=len(held))
                ties = np.cumsum(np.append(0, tie))  # of the pairs before
                keep |= tie & (ties[:-1] - ties[first[i]] < left[i])
                i, row, sim = i[keep], row[keep], sim[keep]
            self.floor = np.maximum(self.least - self.slack, self.floor).astype(np.float32)
        self.best = i, row, sim

    def settle(self):
        """(query, row, similarity) of the best rows so far."""
        self.trim()
        return _best(*self.best, self.n)


def local_top(queries: np.ndarray, rows: np.ndarray, n: int, same: np.ndarray | None = None):
    """(query, row, similarity) of the ``n`` most similar rows of each query.

    ``same[q]`` is the row that is the query itself, -1 for none; it is left out.
    """
    live = np.flatnonzero(np.isfinite(rows).all(axis=1))
    place = np.full(len(rows) + 1, -1)
    place[live] = np.arange(len(live))
    rows, out = rows[live], []
    rows32 = rows.astype(np.float32)
    for a in range(0, len(queries), TILE_QUERIES):
        top, own = Top(queries[a:a + TILE_QUERIES], n), None
        if same is not None:
            own = place[same[a:a + TILE_QUERIES]]
            own = np.flatnonzero(own >= 0), own[own >= 0]
        top.meet(rows, rows32, live, own)
        i, j, sim = top.settle()
        out.append((i + a, j, sim))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def scorer(n: int, exclude_self: bool):
    """Cogroup function: the ``n`` best rows (id, v) of the right for each query (id, v) of the left."""
    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "cid", "similarity"]
        kinds = [left["id"].type, right["id"].type, pa.float64()]
        if not len(left) or not len(right):
            return pa.table([pa.array([], k) for k in kinds], names)
        right = right.sort_by("id")  # a smaller index is a smaller id
        same = None
        if exclude_self:
            place = {x: k for k, x in enumerate(right["id"].to_pylist())}
            same = np.array([place.get(x, -1) for x in left["id"].to_pylist()], np.int64)
        i, j, sim = local_top(_matrix(left["v"]), _matrix(right["v"]), n, same)
        return pa.table([left["id"].take(pa.array(i)), right["id"].take(pa.array(j)), pa.array(sim)], names)
    return scored


def block_count(queries: DataFrame) -> Column:
    """Blocks for a table of queries, a scalar subquery of the plan (no job here).

    Blocks for all task slots come before slices, as a query returns ``n`` rows from each slice.
    Above the number of slots it is a multiple of it, so that no slot waits for the last blocks.
    """
    slots, some = queries.sparkSession.sparkContext.defaultParallelism, F.count(F.lit(1))
    blocks = F.greatest(F.floor(some / BLOCK_ROWS) + 1, F.least(F.lit(2 * slots), F.floor(some / TILE_QUERIES) + 1))
    return queries.agg(F.when(blocks > slots, F.ceil(blocks / slots) * slots).otherwise(blocks)).scalar()


class Block:
    """A block of queries that a slice of the collection streams past."""

    def __init__(self, parts: list[pa.RecordBatch], n: int, exclude_self: bool):
        self.ids = pa.chunked_array([p["qid"] for p in parts])
        m = _matrix(pa.chunked_array([p["v"] for p in parts]))
        self.live = np.flatnonzero(np.isfinite(m).all(axis=1))
        self.tops = [Top(m[self.live[a:a + TILE_QUERIES]], n) for a in range(0, len(self.live), TILE_QUERIES)]
        self.rows, self.met, self.held, self.known = [], 0, None, {}
        if exclude_self:
            for k, x in enumerate(self.ids.take(pa.array(self.live)).to_pylist()):
                self.known.setdefault(x, []).append(k)

    def meet(self, part: pa.RecordBatch | None):
        """The next rows; the last one waits, as of rows with a query's own id only the last is itself."""
        parts = [p for p in (self.held, part) if p is not None]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        last = len(rows) - (part is not None)
        self.held, now = rows.slice(last) if part is not None else None, rows.slice(0, last)
        if not last:
            return
        m = _matrix(pa.chunked_array([now["v"]]))
        live = np.flatnonzero(np.isfinite(m).all(axis=1))
        m, at = m[live], live + self.met
        m32, own = m.astype(np.float32), [[] for _ in self.tops]
        if self.known:
            ids = rows["cid"].to_pylist() + [object()]  # a null id is an id like any other
            for place, j in enumerate(live.tolist()):
                for k in self.known.get(ids[j], ()) if ids[j] != ids[j + 1] else ():
                    own[k // TILE_QUERIES].append((k % TILE_QUERIES, place))
        for top, mine in zip(self.tops, own):
            top.meet(m, m32, at, np.array(mine).T if mine else None)
        self.rows.append(now["cid"])
        self.met += last

    def found(self):
        """The best rows of every query, once all rows have come."""
        self.meet(None)
        cids = pa.chunked_array(self.rows)
        for t, top in enumerate(self.tops if self.rows else ()):
            i, j, sim = top.settle()
            yield pa.RecordBatch.from_arrays(
                [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (
                    self.ids.take(pa.array(self.live[i + t * TILE_QUERIES])), cids.take(pa.array(j)), pa.array(sim))],
                ["qid", "cid", "similarity"])


def searcher(n: int, exclude_self: bool):
    """Arrow function over rows (place, side, qid, cid, v): of each place its queries (side 0), then rows in ascending id."""
    def run(batches):
        place, parts, block = None, [], None
        for batch in batches:
            places, sides = (batch[c].to_numpy() for c in ("place", "side"))
            cut = np.flatnonzero((np.diff(places) != 0) | (np.diff(sides) != 0)) + 1
            for a, z in zip([0, *cut], [*cut, len(places)]):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if places[a] != place:
                    if block:
                        yield from block.found()
                    place, parts, block = places[a], [], None
                if sides[a] == 0:
                    parts.append(part)
                elif parts or block:
                    if block is None:
                        block, parts = Block(parts, n, exclude_self), []
                    block.meet(part)
        if block:
            yield from block.found()
    return run


def _key(vec: str) -> Column:
    """Equal for equal vectors only: a hash of all numbers, far shorter than the vector."""
    return F.unhex(F.sha2(F.col(vec).cast("string"), 256)).alias("__key")


def different(queries: DataFrame, q_vec: str) -> DataFrame:
    """``__key, q_vec`` of each different vector, and the parts into which its queries are dealt."""
    return queries.filter(F.col(q_vec).isNotNull()).groupBy(_key(q_vec)).agg(
        F.first(q_vec).alias(q_vec), F.ceil(F.count(F.lit(1)) / SHARED).alias("__parts"))


def shared(queries: DataFrame, found: DataFrame, q_id: str, q_vec: str) -> DataFrame:
    """The rows ``found`` for each ``__key`` go to every query of that vector.

    The queries of a very common vector are dealt into parts, each of which gets its rows.
    """
    slots = queries.sparkSession.sparkContext.defaultParallelism
    parts = different(queries, q_vec).select("__key", "__parts")
    q = queries.filter(F.col(q_vec).isNotNull()).select(q_id, _key(q_vec)).join(parts, "__key") \
        .withColumn("__part", F.pmod(F.xxhash64(q_id), F.col("__parts"))).drop("__parts")
    rows = found.groupBy("__key").agg(F.collect_list(F.struct(*[c for c in found.columns if c not in ("__key", "rank")])).alias("__rows")) \
        .join(parts, "__key").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))).drop("__parts")
    q, rows = (x.repartition(2 * slots, "__key", "__part") for x in (q, rows))  # whichever side is broadcast
    return q.join(rows, ["__key", "__part"]).select(q_id, F.inline("__rows"))


def knn(queries: DataFrame, collection: DataFrame, n: int, q_id: str = "qid", q_vec: str = "qvec",
        c_id: str = "id", c_vec: str = "embedding", exclude_self: bool = False,
        blocks: int | Column | None = None, slices: int | None = None, once: bool = False,
        mark: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Top ``n`` collection rows per query by cosine similarity (ties: smaller id).

    Returns ``q_id, c_id, similarity, rank``. ``exclude_self`` leaves out
    pairs with equal ids (when both sides are the same table). ``blocks`` is
    taken from the number of queries if not given (:func:`block_count` of a
    cheaper table with as many rows saves reading ``queries`` twice);
    ``slices`` so that all task slots have work. Planning starts no job.

    With ``once`` queries of equal vectors are searched once (``queries`` is
    then read more than once); ``mark`` may add columns that depend on the row
    alone, and must keep each pair once.
    """
    if once:
        if exclude_self:
            raise ValueError("queries of equal vectors differ in the row that is themselves")
        found = knn(different(queries, q_vec), collection, n, "__key", q_vec, c_id, c_vec, blocks=blocks, slices=slices)
        return top_per_key(shared(queries, mark(found) if mark else found, q_id, q_vec), [q_id],
                           [F.col("similarity").desc(), F.col(c_id)], n, rank_col="rank")
    ship(queries.sparkSession)
    slots = queries.sparkSession.sparkContext.defaultParallelism
    blocks = block_count(queries) if blocks is None else F.lit(blocks) if isinstance(blocks, int) else blocks
    if slices is None:
        least = file_bytes(collection) // SLICE_BYTES + 1
        slices = F.greatest(F.lit(least), F.ceil(F.lit(slots) / F.col("blocks")))
    else:
        slices = F.lit(slices)
    q_type, c_type = queries.schema[q_id].dataType, collection.schema[c_id].dataType
    kinds = {queries.schema[q_vec].dataType.simpleString(), collection.schema[c_vec].dataType.simpleString()}
    v_type = kinds.pop() if len(kinds) == 1 else "array<double>"

    def dealt(df, ident, vec, own, parts, other):
        rows = (df.filter(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).cast(v_type).alias("v"))
                .withColumn("blocks", blocks.cast("int")).withColumn("slices", slices.cast("int")))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)))
        return rows.withColumn("place", F.col("block") * F.col("slices") + F.col("slice"))

    q = dealt(queries, q_id, q_vec, "block", "blocks", "slice").select(
        "place", F.lit(0).alias("side"), F.col("id").alias("qid"), F.lit(None).cast(c_type).alias("cid"), "v")
    c = dealt(collection, c_id, c_vec, "slice", "slices", "block").select(
        "place", F.lit(1).alias("side"), F.lit(None).cast(q_type).alias("qid"), F.col("id").alias("cid"), "v")
    rows = q.unionByName(c).repartitionById(2 * slots, F.pmod("place", F.lit(2 * slots)).cast("int"))
    rows = rows.sortWithinPartitions("place", "side", F.asc_nulls_last("cid"))
    pairs = rows.mapInArrow(searcher(n, exclude_self),
                            f"qid {q_type.simpleString()}, cid {c_type.simpleString()}, similarity double")
    out = pairs.select(F.col("qid").alias(q_id), F.col("cid").alias(c_id), "similarity")
    return top_per_key(out, [q_id], [F.col("similarity").desc(), F.col(c_id)], n, rank_col="rank")
