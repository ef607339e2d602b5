"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of every order up to ``order``
and the uniform distribution,

    P(w | h) = sum_k lambda_k(b) * c(h_k w) / c(h_k) + lambda_0(b) / (V + 1),

with weights that depend on the bucket ``b`` of the longest context that was
seen: its length and its frequency (by powers of two). Orders whose context
was not seen have no weight there, so the mixture sums to one over the
vocabulary and one unknown word, whatever the history. The weights are learned by
expectation-maximisation on held-out counts: the training documents of one
fold are deleted from the counts and predicted from the rest.

Documents are dealt into blocks. A block asks for the corpus counts of its
different n-grams once, in sorted arrays cut by hash range; each range adds
up what all blocks sent it and answers every block; the block then looks its
own tokens up. What is shuffled is one entry per block and different n-gram,
so a word that makes up half the corpus is one entry a block. The learning
sees a histogram of bounded size: occurrences by bucket and by the estimates,
rounded to half a power of two.

N-grams are identified by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import residue, shuffles_dropped, staged

#: Bytes of text in a block of documents, and per range of n-gram hashes.
BLOCK_BYTES = 9 << 20
RANGE_BYTES = 9 << 20
FOLDS, HELD_OUT, EM_FOLD = 7, 2, 3
BUCKETS = 34
STEPS = 60
#: Steps of an estimate's rounding to a power of two.
STEP = 2
#: Rounded logarithm of an estimate of zero.
NONE = 255

_END, _START = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b" ")  # no word holds white space


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text); every text ends with the end token."""
    codes, parts, sizes = _Codes(), [], []
    codes[b"\n"] = 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        part = np.zeros(n + 1, np.int32)
        part[:n] = np.fromiter(map(codes.__getitem__, words), np.int32, n)
        parts.append(part)
        sizes.append(n + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return hashes[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)


def grams(h: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order, the hash of the n-gram that ends at each token; contexts start at the text's start."""
    out = [h]
    for k in range(1, order):
        context = np.empty_like(h)
        context[1:] = out[-1][:-1]
        context[first] = np.uint64((_START + k) & (1 << 64) - 1)
        g = (context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h
        g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(g ^ (g >> np.uint64(27)))
    return out


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all lowest bytes first, compressed; their size in 8 bytes ahead."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(packed: bytes, kind) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def sorted_planes(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)))


def ranges(x: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` hash ranges starts in a sorted array, and its end."""
    return np.searchsorted((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1).astype(np.uint64))


class Block:
    """The tokens of a block of documents, the same whenever it is read."""

    def __init__(self, table: pa.Table, order: int, asked: range | None = None):
        rows = sorted(zip(table["doc_id"].to_pylist(), table["r"].to_pylist(), table["text"].to_pylist()),
                      key=lambda x: (x[0] is None, x[0] or 0, x[2] or ""))
        self.ids, self.residues, texts = [list(c) for c in zip(*rows)]
        h, self.first = tokens(texts)
        del rows, texts
        self.sizes = np.diff(np.append(self.first, len(h)))
        self.known, self.at = [], []
        for k, g in enumerate(grams(h, self.first, asked.stop if asked else order)):
            known, at = np.unique(g, return_inverse=True) if asked is None or k in asked else (g[:0], g[:0])
            self.known.append(known)
            self.at.append(at.astype(np.int32))
        if asked is None:
            self.end = int(np.searchsorted(self.known[0], np.uint64(_END)))
            self.start_of_text = np.zeros(len(h), bool)
            self.start_of_text[self.first] = True

    def by_token(self, flags: list[bool]) -> np.ndarray:
        return np.repeat(np.array(flags), self.sizes)

    def contexts(self, counts: list[np.ndarray], k: int) -> np.ndarray:
        """Count of the context of each token's n-gram of order ``k`` + 1."""
        here = counts[k - 1][self.at[k - 1]]
        out = np.empty_like(here)
        out[1:] = here[:-1]
        out[self.start_of_text] = counts[0][self.end]  # as many starts as ends
        return out


def _requests(order: int, orders: range, n_ranges: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table, order, orders)
        train = b.by_token([r != HELD_OUT for r in b.residues])
        fold = b.by_token([r == EM_FOLD for r in b.residues])
        rows = []
        for k in orders:
            n = len(b.known[k])
            c = np.bincount(b.at[k], train, n).astype(np.uint32)
            f = np.bincount(b.at[k], fold, n).astype(np.uint32)
            cut = ranges(b.known[k], n_ranges)
            rows += [(table["block"][0].as_py(), k, r, sorted_planes(b.known[k][s:e]), planes(c[s:e]), planes(f[s:e]))
                     for r, (s, e) in enumerate(zip(cut, cut[1:])) if e > s]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), REQUEST.types)], schema=REQUEST)
    return run


REQUEST = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("r", pa.int32()),
                     ("h", pa.binary()), ("c", pa.binary()), ("f", pa.binary())])
REPLY = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("r", pa.int32()), ("c", pa.binary()), ("f", pa.binary()),
                   ("n", pa.int64()), ("n_fold", pa.int64()), ("types", pa.int64())])


def _reply(table: pa.Table) -> pa.Table:
    """Total counts of a hash range, for each block in the order it asked."""
    blocks = table["block"].to_pylist()
    asked = [np.cumsum(unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in table["h"]]
    known, at = np.unique(np.concatenate(asked), return_inverse=True)
    c = np.bincount(at, np.concatenate([unplanes(x.as_py(), np.uint32) for x in table["c"]]), len(known)).astype(np.uint64)
    f = np.bincount(at, np.concatenate([unplanes(x.as_py(), np.uint32) for x in table["f"]]), len(known)).astype(np.uint64)
    k, r = table["k"][0].as_py(), table["r"][0].as_py()
    rows, done = [], 0
    for block, a in zip(blocks, asked):
        mine = at[done:done + len(a)]
        done += len(a)
        # only blocks of the held-out fold need the fold's counts
        rows.append((block, k, r, planes(c[mine]), planes(f[mine]) if block < 0 else b"", None, None, None))
    if k == 0:
        rows.append((None, k, r, b"", b"", int(c.sum()), int(f.sum()), int((c > 0).sum())))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), REPLY.types)], schema=REPLY)


def _counts(replies: pa.Table, column: str, order: int) -> list[np.ndarray]:
    rows = sorted(zip(replies["k"].to_pylist(), replies["r"].to_pylist(), replies[column].to_pylist()), key=lambda x: x[:2])
    return [np.concatenate([unplanes(raw, np.uint64) for k, _, raw in rows if k == j]).astype(np.float64) for j in range(order)]


def bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """Of the contexts of one word, of two words, ...: 0 where none was seen, else by length and power of two of the longest seen."""
    out = np.zeros(len(contexts[0]), np.int64)
    for k, c in enumerate(contexts):
        out = np.where(c > 0, 1 + k * BUCKETS + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64).clip(0, BUCKETS - 1), out)
    return out


def _evidence(order: int, n: int, n_fold: int):
    """Occurrences in the held-out fold by bucket and rounded estimates."""
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(docs, order)
        c, f = _counts(replies, "c", order), _counts(replies, "f", order)
        rest = [x - y for x, y in zip(c, f)]
        code = np.zeros(len(b.at[0]), np.int64)
        contexts = [np.full(len(code), float(n - n_fold)), *[b.contexts(rest, k) for k in range(1, order)]]
        for k, context in enumerate(contexts):
            total = rest[k][b.at[k]]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where((total > 0) & (context > 0), total / context, 0)
                q = np.where(p > 0, np.minimum(np.round(-STEP * np.log2(p)), NONE - 1), NONE)
            code = code << 8 | q.astype(np.int64)
        code |= (bucket(contexts[1:]) if order > 1 else np.zeros(len(code), np.int64)) << 8 * order
        found, times = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(found), "n": pa.array(times.astype(np.int64))})
    return run


def learn(code: np.ndarray, times: np.ndarray, order: int, types: int, steps: int = STEPS) -> np.ndarray:
    """Weights (bucket, uniform and orders 1 to ``order``) by EM on the evidence.

    Every bucket starts from the weights of all buckets together, without the
    orders it cannot have seen; a bucket without evidence keeps them.
    """
    p = np.empty((len(code), order + 1))
    p[:, 0] = 1 / (types + 1)
    for k in range(order):
        q = code >> 8 * (order - 1 - k) & 255
        p[:, k + 1] = np.where(q == NONE, 0, 2.0 ** (-q / STEP))
    place = code >> 8 * order
    places = 1 + (order - 1) * BUCKETS
    # of orders 2 and up, those whose context is longer than the longest seen have no estimate
    length = (np.arange(places) + BUCKETS - 1) // BUCKETS
    seen = np.concatenate([np.ones((places, 2)), length[:, None] > np.arange(order - 1)[None, :]], 1)

    def em(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            share = weights[at] * p
            share *= (times / np.maximum(share.sum(1), 1e-300))[:, None]
            got = np.stack([np.bincount(at, share[:, k], len(weights)) for k in range(order + 1)], 1)
            total = got.sum(1, keepdims=True)
            weights = np.where(total > 0, got / np.maximum(total, 1e-300), weights)
        return weights

    if not len(code):
        return np.repeat([[1.0] + [0.0] * order] if not types else [[0.5, 0.5] + [0.0] * (order - 1)], places, 0)
    pooled = em(np.full((1, order + 1), 1 / (order + 1)), np.zeros(len(code), np.int64))
    start = np.maximum(pooled, 1e-6) * seen
    out = em(start / start.sum(1, keepdims=True), place)
    out[:, 0] = np.maximum(out[:, 0], 1e-6)  # nothing is impossible
    return out / out.sum(1, keepdims=True)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(order: int, n: int, types: int, weights: np.ndarray):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(docs, order)
        c = _counts(replies, "c", order)
        total = c[0][b.at[0]]
        base = np.log10((total + 1) / (n + types + 1))
        parts = [np.full(len(total), 1 / (types + 1)), total / max(n, 1)]
        contexts = [b.contexts(c, k) for k in range(1, order)]
        for k, context in enumerate(contexts, 1):
            parts.append(c[k][b.at[k]] / np.maximum(context, 1))
        w = weights[bucket(contexts) if contexts else np.zeros(len(total), np.int64)]
        p = sum(w[:, k] * x for k, x in enumerate(parts))
        return pa.table([
            pa.array(b.ids, pa.int64()), pa.array([r == HELD_OUT for r in b.residues]), pa.array(b.sizes),
            pa.array(np.add.reduceat((total > 0).astype(np.int64), b.first)), pa.array(np.full(len(b.ids), n)),
            pa.array(np.add.reduceat(base, b.first)), pa.array(np.add.reduceat(np.log10(p), b.first))], schema=SCORES)
    return run


def score(docs: DataFrame, order: int = 2, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Learns from rows whose crc32(doc_id) mod 7 is not 2; those with remainder 3
    are the fold the mixture is learned on. A null text is empty: one end
    token. Rows may repeat, and ids may repeat or be null; each row is counted
    and scored. An empty table gives an empty result; other columns are not
    read. Without training rows every token has probability 1.
    """
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], _ddl(SCORES))
    n_blocks, n_ranges = size // block_bytes + 1, size // range_bytes + 1
    r = residue(F.col("doc_id"), FOLDS)
    mixed = F.xxhash64("doc_id", "text")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", r.cast("int").alias("r")).withColumn(
        "block", F.when(F.col("r") == EM_FOLD, -1 - F.pmod(mixed, F.lit(n_blocks // 6 + 1)))
        .otherwise(F.pmod(mixed, F.lit(n_blocks))))
    parts = []
    with shuffles_dropped(docs.sparkSession):  # what these queries deal out is not read again
        for orders in (range(order - 1), range(order - 1, order)):  # the highest order apart: it asks for the most
            asked = src.groupBy("block").applyInArrow(_requests(order, orders, n_ranges), _ddl(REQUEST))
            if orders:
                parts.append(staged(asked.groupBy("k", "r").applyInArrow(_reply, _ddl(REPLY)), "lm-counts"))
        replies = reduce(DataFrame.unionByName, parts)
        n, n_fold, types = (int(x or 0) for x in replies.filter("block IS NULL").agg(
            F.sum("n"), F.sum("n_fold"), F.sum("types")).first())
        answers = replies.filter("block IS NOT NULL").select("block", "k", "r", "c", "f")
        seen = (src.filter(F.col("r") == EM_FOLD).groupBy("block")
                .cogroup(answers.filter("block < 0").groupBy("block"))
                .applyInArrow(_evidence(order, n, n_fold), "code long, n long")
                .groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow())  # bounded by the rounding
    weights = learn(seen["code"].to_numpy(), seen["n"].to_numpy(), order, types)
    return src.groupBy("block").cogroup(answers.select("block", "k", "r", "c").groupBy("block")).applyInArrow(
        _scores(order, n, types, weights), _ddl(SCORES))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
