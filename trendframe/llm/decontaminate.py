"""Benchmark decontamination by SimHash of item-sized windows.

An item of L words is looked for in every window of L words of a document (in
the whole document, where that is shorter). Windows and items have weighted
shingles of ``SHINGLE`` words, weighted by how often they occur, and a 64-bit
SimHash of them. Multi-index Hamming blocks - eight bytes, each met within
two bits - find all items within ``RADIUS`` bits of a window: a pair that
differs by at most 23 bits differs by at most two in some byte. Candidates
are then decided by their exact weighted Jaccard similarity.

A window that reaches a positive similarity has a shingle in common with the
item, so windows are formed only around shingles that some item has: that
skips no window that could match.

The benchmark is read in blocks of bounded size, each of which is broadcast
and held against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
BYTE_RADIUS = 2
RADIUS = 8 * (BYTE_RADIUS + 1) - 1
#: Words of benchmark text in a block, on average; a block is what is broadcast.
BLOCK_WORDS = 500_000
#: Windows that are compared at a time.
WINDOWS = 2048
#: Words whose hashes a worker remembers.
CACHE = 500_000

_WORD = re.compile(r"\w+")
_FILTER_BITS = 20
_NEAR = np.array([[int(a ^ b).bit_count() <= BYTE_RADIUS for b in range(256)] for a in range(256)])


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


_word_hash = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words, runs of letters, digits and _."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def bit_rows(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fingerprints from the ones per bit, (n, 64), and the shingles per row."""
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle lists."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(a) + len(b) - shared) if shared else 0.0


class Items:
    """A block of the benchmark, ready to be looked up. Items without a word match nothing."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.shingles, by_size = [], [], defaultdict(list)
        self.lengths_of: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in rows:
            words = word_hashes(text)
            if len(words):
                k = min(SHINGLE, len(words))
                h = shingle_hashes(words, k)
                by_size[len(words)].append(len(self.ids))
                self.ids.append(item_id)
                self.shingles.append(h)
                for s in h.tolist():
                    self.lengths_of[k][s].add(len(words))
        self.lengths_of = {k: dict(v) for k, v in self.lengths_of.items()}
        self.known, self.filters = {}, {}
        for k, found in self.lengths_of.items():
            self.known[k] = np.array(sorted(found), np.uint64)
            self.filters[k] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[k][self.known[k] >> np.uint64(64 - _FILTER_BITS)] = True
        self.by_size = {}
        for size, at in by_size.items():
            fp = np.array([majority(bit_rows(self.shingles[i]).sum(0, dtype=np.int64)[None],
                                    np.array([len(self.shingles[i])]))[0] for i in at], np.uint64)
            octets = fp.view(np.uint8).reshape(-1, 8)
            tables = [_NEAR[:, octets[:, b]] for b in range(8)]  # byte value -> items met
            self.by_size[size] = (np.array(at), fp, tables)

    def candidates(self, fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        at, items, tables = self.by_size[size]
        octets = fp.view(np.uint8).reshape(-1, 8)
        met = tables[0][octets[:, 0]].copy()
        for b in range(1, 8):
            met |= tables[b][octets[:, b]]
        w, i = np.nonzero(met)
        close = np.bitwise_count(fp[w] ^ items[i]) <= RADIUS
        return w[close], at[i[close]]

    def matches(self, text: str | None, least: float = SIMILARITY, first: bool = False) -> list[tuple[int, int, float]]:
        """(item id, first word of the window, similarity): each item's best window.

        With ``first``, one match is enough.
        """
        words = word_hashes(text)
        best: dict[int, tuple[float, int]] = {}
        for k, known in self.known.items():
            h = shingle_hashes(words, k)
            hits = np.flatnonzero(self.filters[k][h >> np.uint64(64 - _FILTER_BITS)])
            place = np.minimum(np.searchsorted(known, h[hits]), len(known) - 1)
            hits = hits[known[place] == h[hits]]
            if not len(hits):
                continue
            starts_by_size = defaultdict(list)
            for p in hits.tolist():
                for size in self.lengths_of[k][int(h[p])]:
                    starts_by_size[size].append(p)
            for size, at in starts_by_size.items():
                span = min(size, len(words)) - k + 1  # shingles in a window
                low = np.maximum(np.array(at) - span + 1, 0)
                high = np.minimum(np.array(at), len(h) - span)
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]))
                for c in range(0, len(starts), WINDOWS):
                    s = starts[c:c + WINDOWS]
                    for w, i in zip(*self.candidates(window_fingerprints(h, s, span), size)):
                        a = int(s[w])
                        sim = similarity(h[a:a + span], self.shingles[i])
                        if sim >= least and sim > best.get(i, (0.0, 0))[0]:
                            best[i] = (sim, a)
                            if first:
                                return [(self.ids[i], a, sim)]
        return [(self.ids[i], a, sim) for i, (sim, a) in sorted(best.items())]


def window_fingerprints(h: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHash of the ``span`` shingles from each start on."""
    low, high = int(starts[0]), int(starts[-1]) + span
    out = []
    if high - low <= 4 * (len(starts) + span):
        total = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(bit_rows(h[low:high]), axis=0, out=total[1:])
        ones = total[starts - low + span] - total[starts - low]
        return majority(ones, np.full(len(starts), span))
    for s in starts.tolist():  # far apart: one by one
        out.append(bit_rows(h[s:s + span]).sum(0, dtype=np.int32))
    return majority(np.array(out), np.full(len(starts), span))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The benchmark in blocks of about ``block_words`` words, dealt by hash."""
    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    n = int(words) // block_words + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        got = dealt.filter(F.col("block") == k).select("item_id", "text").distinct().collect()
        yield Items(sorted(((r["item_id"], r["text"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, similarity: a row per document and item it holds.

    ``start_word`` is the first word of the most similar window, the earliest
    of equals. Null and empty texts, of documents or items, match nothing.
    Repeated document rows give repeated rows; identical items count once. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start_word long, similarity double"
    out = None
    for items in item_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                ids, rows = b.column(0), []
                for k, t in enumerate(b.column(1)):
                    rows += [(k, *m) for m in shared.value.matches(t.as_py(), least)]
                at, item, start, sim = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()),
                     pa.array(sim, pa.float64())], ["doc_id", "item_id", "start_word", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                clean = [not shared.value.matches(t.as_py(), least, first=True) for t in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
