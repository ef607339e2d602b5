"""Best-fit packing of token pieces into sequences, with bound-certified repacking.

Every document becomes its token ids and an end id. Longer documents are cut
into pieces of the sequence size, the first of which may be shorter. Pieces
are dealt at random into groups of bounded size; each group is packed by
best-fit decreasing. Dual-feasible functions give a lower bound on the bins
any packing of the group needs: a group that meets it is certified optimal.
The pieces in bins with free space of all uncertified groups are dealt out
anew - so groups exchange documents - and packed again while that lowers the
number of bins. Full pieces are sequences by themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged
from .tokens import encoder

#: Pieces in a group, on average: what one task holds at a time.
GROUP = 8192
#: Rounds of exchange at most.
ROUNDS = 6

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids; only the first may be short."""
    first = n if n <= size else n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """Tokenise each text and list its pieces. A null text is empty: its end id alone."""
    def run(batches):
        enc, tail = encoder(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_py() or "") + tail
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                         for k, (s, n) in enumerate(cut_points(len(ids) // 4, size))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    free = 0                                               # bit r: some bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room[r - n].append(b)
        free |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def bin_bound(lengths: np.ndarray, size: int) -> int:
    """A number of bins below which no packing exists.

    The largest total over two families of dual-feasible functions: rounding
    long items up to a bin while dropping items shorter than a threshold, and
    integer parts of (k + 1) times the item.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    for t in range(1, size // 2 + 1):
        f = np.where(x > size - t, size, np.where(x >= t, x, 0))
        best = max(best, -(-int((count * f).sum()) // size))
    for k in range(1, 21):
        up = (k + 1) * x
        f = np.where(up % size == 0, k * x, (up // size) * size)  # scaled by size * k
        best = max(best, -(-int((count * f).sum()) // (size * k)))
    return best


def _packed(size: int, round_no: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, size)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32", "uid"]].copy()
        out["sequence_id"] = (np.int64(round_no + 1) << 56) + (np.int64(key[0]) << 28) + bins
        out["offset"] = offsets
        # bins that a further round may improve: with room, in a group above its bound
        out["open"] = (fill[bins] < size) & (len(fill) > bin_bound(lengths, size))
        return out
    return run


PACKED = PIECES + ", uid long, sequence_id long, offset long, open boolean"


def pack(found: DataFrame, size: int = 1024, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to every row of a piece table.

    Offsets are gapless from 0 in every sequence. Rows may repeat and ids may
    be null; each row is placed once. An empty table gives an empty result.
    """
    found = staged(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = found.filter(F.col("length") == size).withColumns(
        {"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long"), "open": F.lit(False)})
    todo, done, replaced = found.filter(F.col("length") < size), [full], None
    n = todo.count()
    for k in range(rounds):
        if not n:
            break
        groups = -(-n // group)
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(groups)))
        now = staged(dealt.groupBy("g").applyInPandas(_packed(size, k), PACKED), "packed")
        bins = now.select("sequence_id").distinct().count()
        if replaced is not None and bins >= replaced[1]:
            released(now)
            done.append(replaced[0])
            break
        closed, left = now.filter(~F.col("open")), now.filter("open")
        done.append(closed)
        n, old_bins = left.count(), left.select("sequence_id").distinct().count()
        todo, replaced = left.select("doc_id", "piece", "start", "length", "ids_crc32", "uid"), (left, old_bins)
    else:
        if replaced is not None:
            done.append(replaced[0])
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("uid", "open")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, **kw) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    A null text is empty and gives one piece with the end id alone; texts of
    any length are tokenised whole. Rows with null or repeated ids are packed
    like any other. An empty table gives an empty result; other columns are
    not read.
    """
    return pack(pieces(docs, path, end_id, size), size, **kw)
