"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint: the bit-wise majority of the XXH64
values of its word shingles. Each different fingerprint gets its row of the
pivot distance table, the Hamming distances to ``PIVOTS`` reference
fingerprints. By the triangle inequality two fingerprints within ``radius``
bits differ by at most ``radius`` in every one of these coordinates, so pairs
with a larger maximum coordinate difference are discarded unseen and only
survivors are compared bit by bit.

Which fingerprints meet at all is decided by equal bits: of ``radius + 2``
bit blocks, two fingerprints within ``radius`` bits agree in at least two, so
meeting on every pair of blocks loses none. Meeting places with very many
fingerprints are dealt over tiles of bounded size that cover every pair. Each
place returns a spanning forest of its links, never all pairs, and connected
components are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, released, staged

PIVOTS = 16
#: Fingerprints in a meeting place above which it is split into tiles.
TILE = 2048
#: Links found in a place after which they are reduced to a forest.
LINKS = 1 << 19


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text; 0 where it has no word.

    A-Z is lower-cased; words are runs without ASCII white space. A text with
    fewer words than a shingle has one shingle, all its words.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    starts = ends + 1 - size
    n = len(w) - words + 1
    shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[words - 1:].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory on very long texts
        part = h[k:k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, 42) for k in range(n)], np.uint64)


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)


def block_masks(radius: int) -> list[int]:
    """Masks of the bit pairs of blocks on which fingerprints meet."""
    m = radius + 2
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def place_links(place: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (x, y) between fingerprints of one place, rows sorted by place.

    Rows are compared with the row ``lag`` below, for growing lags, while any
    two rows that far apart share a place.
    """
    n, i_all, j_all, held, lag = len(place), [], [], 0, 1
    alive = np.arange(n)
    while True:
        alive = alive[alive + lag < n]
        alive = alive[place[alive] == place[alive + lag]]
        if not len(alive):
            break
        i, j = alive, alive + lag
        for c in range(table.shape[1]):  # coordinate by coordinate: most pairs go at once
            near = np.abs(table[i, c] - table[j, c]) <= radius
            i, j = i[near], j[near]
            if not len(i):
                break
        if len(i):
            close = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            i_all.append(i[close])
            j_all.append(j[close])
            held += len(i)
            if held > LINKS:
                root = forest(np.concatenate(i_all), np.concatenate(j_all), n)
                i = np.flatnonzero(root != np.arange(n))
                i_all, j_all, held = [i], [root[i]], 0
        lag += 1
    if not i_all:
        return fp[:0], fp[:0]
    root = forest(np.concatenate(i_all), np.concatenate(j_all), n)
    i = np.flatnonzero(root != np.arange(n))
    return fp[i], fp[root[i]]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all within ``radius`` bits.

    ``fps`` has one row per different ``fp``.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m - (1 << 64) if m >> 63 else m).alias("m"))
                      for k, m in enumerate(block_masks(radius))])
    keyed = fps.select("fp", F.explode(masks).alias("x")).select(
        "fp", F.col("x.k").alias("k"), F.col("fp").bitwiseAND(F.col("x.m")).alias("v"))
    crowd = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(crowd, ["k", "v"])
    # a place of n fingerprints has s strips; tile (s, t) holds strips s and t
    strips = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    strip = F.pmod(F.xxhash64("fp"), strips).cast("int")
    tiles = (met.withColumns({"strips": strips, "strip": strip})
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
             .filter("strips = 1 OR strip <> other")
             .select("fp", F.xxhash64("k", "v", F.least("strip", "other"), F.greatest("strip", "other")).alias("place")))
    tiles = tiles.repartition("place").sortWithinPartitions("place", "fp")
    refs = pivots()

    def run(batches):
        place, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(a, b):
            x, y = place_links(place[a:b], fp[a:b], distance_table(fp[a:b], refs), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for b in batches:
            fp = np.concatenate([fp, b.column(0).to_numpy().view(np.uint64)])
            place = np.concatenate([place, b.column(1).to_numpy()])
            if not len(place):
                continue
            cut = int(np.searchsorted(place, place[-1]))  # the last place may go on in the next batch
            if cut:
                yield found(0, cut)
                place, fp = place[cut:], fp[cut:]
        if len(place):
            yield found(0, len(place))

    return tiles.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, roots left out.

    Large-star and small-star steps alternate until the links no longer
    change; each round is a table in the shared folder.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = both.join(low, "a")
        out = out.filter("b > a") if large else out
        moved = out.select(F.col("b").alias("x"), "low")
        if not large:
            moved = moved.union(low.select(F.col("a").alias("x"), "low"))
        return moved.filter("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct()

    def mark(t: DataFrame):
        return t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = staged(edges.filter("a <> b"), "links")
    seen = mark(now)
    while seen[0]:
        new = staged(star(star(now, True), False), "links")
        state = mark(new)
        released(now)
        now = new
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = 3, radius: int = 3) -> DataFrame:
    """id, fp (signed 64-bit) and component_id, the smallest id reachable, for each row.

    A null text counts as empty; empty texts share fingerprint 0 and are
    linked like any others. Rows may repeat. Null ids are never a component's
    id unless all its ids are null. An empty table gives an empty result;
    other columns are not read.
    """
    marked = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = staged(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "fps")
    roots = components(links(fps.select("fp"), radius))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("size"))
    # documents alone in their component need no lookup
    named = staged(rooted.join(lows.filter("size > 1"), "root")
                   .select("fp", "n", "component_id", F.lit(True).alias("named")), "named")
    return join_groups(marked, named, "fp", "n", F.col("id")).select(
        "id", "fp", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that carry their component's smallest id, with all columns.

    Should that id be repeated, one row with it stays.
    """
    found = simhash_components(docs, id_col, text_col, **kw)
    kept = staged(found.filter(F.col("id").eqNullSafe(F.col("component_id")))
                  .groupBy(F.col("id").alias("kept_id")).agg(F.count("*").alias("copies")), "kept")

    def matched(rows: DataFrame) -> DataFrame:
        return docs.join(rows, docs[id_col].eqNullSafe(rows["kept_id"]), "left_semi")

    once = matched(kept.filter("copies = 1"))
    if kept.filter("copies > 1").isEmpty():
        return once
    return once.unionByName(matched(kept.filter("copies > 1")).dropDuplicates([id_col]))
