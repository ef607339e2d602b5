"""J11 for large collections: an inverted-list index over the vectors.

A bounded sample is clustered into ``lists`` directions (k-means by cosine);
every row of the collection belongs to the list of its nearest centroid. A
query visits the lists of its ``probes`` nearest centroids only, and there
every row is compared exactly. How many lists are visited is learned on the
sample: as many as hold ``target`` of its rows' true neighbours. Clustered
vectors need few; vectors without structure need many, and :func:`knn` is then
as good.

Lists differ in size. A list's rows are dealt over splits and its queries over
blocks of bounded size, and every block meets every split in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .knn import _matrix, local_top, scorer
from .rank import top_per_key

#: Rows that centroids and probes are learned on.
SAMPLE = 8192
#: Rows that one Arrow batch of assigned vectors holds.
ASSIGNED = 16_384
#: Rows of a split and queries of a block.
SPLIT_ROWS, BLOCK_ROWS = 65_536, 8192


@dataclass
class Lists:
    """Centroids (unit vectors) and the number of lists a query visits."""

    centroids: np.ndarray
    probes: int


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def cluster(x: np.ndarray, lists: int, rounds: int = 15) -> np.ndarray:
    """k-means by cosine on unit vectors; a centroid without rows keeps its place."""
    c = x[np.random.default_rng(42).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        some = np.sqrt((total * total).sum(1)) > 0
        c[some] = _unit(total[some])
    return c


def learn_lists(collection: DataFrame, c_id: str = "id", c_vec: str = "embedding", lists: int = 64, n: int = 10,
                target: float = 0.97, sample: int = SAMPLE) -> Lists:
    """Cluster the ``sample`` rows of the smallest id hash; null and zero vectors take no part."""
    rows = collection.filter(F.col(c_vec).isNotNull()).orderBy(F.xxhash64(c_id), c_id).select(c_vec).limit(sample).toArrow()
    x = _matrix(rows.column(0)) if len(rows) else np.zeros((0, 1))
    x = x[np.isfinite(x).all(1)]
    if len(x) < 2:
        return Lists(x[:1], 1)
    c = cluster(x, min(lists, len(x)))
    order = np.argsort(-(x @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), 1)
    home = order[:, 0]
    q, near, _ = local_top(x, x, n, np.arange(len(x)))
    visits = np.sort(place[q, home[near]])  # how many lists come before the neighbour's
    return Lists(c, int(visits[min(len(visits) - 1, int(np.ceil(target * len(visits))))]) + 1)


def assigned(batches, centroids: np.ndarray, most: int):
    """(id, v, list) batches of bounded size from (id, v) batches of any size."""
    step = max(1, ASSIGNED // most)  # a row is copied ``most`` times
    for b in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
        m = _matrix(pa.chunked_array([b.column(1)]))
        live = np.flatnonzero(np.isfinite(m).all(1))
        near = np.argsort(-(m[live] @ centroids.T), axis=1, kind="stable")[:, :most]
        rows = b.take(pa.array(np.repeat(live, near.shape[1])))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])


def assign(df: DataFrame, ident: str, vec: str, lists: Lists, most: int = 1) -> DataFrame:
    """(id, v, list): a row for each of the ``most`` nearest lists of every vector."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(lists.centroids)  # ``lists`` vectors
    src = df.filter(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).alias("v"))

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(lambda batches: assigned(batches, shared.value, most), f"id {kinds['id']}, v {kinds['v']}, list int")


def knn_lists(queries: DataFrame, collection: DataFrame, n: int, lists: Lists, q_id: str = "qid", q_vec: str = "qvec",
              c_id: str = "id", c_vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """As :func:`trendframe.operators.knn.knn`, over the lists that each query visits: ``q_id, c_id, similarity, rank``."""
    ship(queries.sparkSession)
    if not len(lists.centroids):
        lists = Lists(np.zeros((1, 1)), 1)
    asked = assign(queries, q_id, q_vec, lists, lists.probes)
    held = assign(collection, c_id, c_vec, lists)
    sizes = held.groupBy("list").agg((F.floor(F.count("*") / SPLIT_ROWS) + 1).cast("int").alias("splits")).join(
        asked.groupBy("list").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("blocks")), "list")

    def dealt(df, own, parts, other, copies):
        d = df.join(sizes, "list")
        return d.select("list", "id", "v", F.pmod(F.xxhash64("id"), F.col(parts)).cast("int").alias(own),
                        F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(other))

    q, c = dealt(asked, "block", "blocks", "split", "splits"), dealt(held, "split", "splits", "block", "blocks")
    kinds = queries.schema[q_id].dataType.simpleString(), collection.schema[c_id].dataType.simpleString()
    place = ["list", "block", "split"]
    found = q.groupBy(*place).cogroup(c.groupBy(*place)).applyInArrow(
        scorer(n, exclude_self), f"qid {kinds[0]}, cid {kinds[1]}, similarity double")
    out = found.select(F.col("qid").alias(q_id), F.col("cid").alias(c_id), "similarity")
    return top_per_key(out, [q_id], [F.col("similarity").desc(), F.col(c_id)], n, rank_col="rank")
