"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words, their beginnings (3 to 7 letters, so that an
inflected insult is met again), each of these once more when it occurs at
least twice, and the binary order of the text's length. Terms are hashed. A
term enters the machine if it tells the classes apart by itself (chi-squared)
or if it is a word of a telling pair: one whose texts are toxic more often than
the texts of either word alone. Pairs are counted over all words of the sample
by products of tiles of its row-by-word matrix. The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so it learns pairs - an insult together with a group mention, a stem that is
telling in a short text and chance in a long one - that additive weights miss.

Labels are learned from a sample of at most ``FIT_ROWS`` labelled rows, those
with the smallest id hashes. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import residue, staged

#: Labelled rows the machine is fitted on at most.
FIT_ROWS = 20_000
#: Hash space of terms; factors of a term.
SPACE = 1 << 24
FACTORS = 8
#: Rows of the sample a term must occur in, and its chi-squared value, to enter by itself.
MIN_ROWS = 5
MIN_CHI2 = 20.0
#: How likely chance may make any pair of the sample tell; words of a tile of pairs.
PAIR_CHANCE = 1e-3
TILE = 2048
#: Rows of a tile whose bounds are computed at a time.
STRIP = 128
PREFIXES = (3, 4, 5, 6, 7)
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Distinct words whose terms a worker remembers.
CACHE = 300_000

_WORD = re.compile(r"\w+")


def term(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {value}".encode("utf-8", "surrogatepass")) % SPACE


def word_terms(word: str) -> list[int]:
    return [term("w", word)] + [term(f"p{k}", word[:k]) for k in PREFIXES if len(word) > k]


def twice(t: int) -> int:
    """The term that says ``t`` occurs at least twice."""
    return (t * 2654435761 + 97) % SPACE


def length_term(n: int) -> int:
    return term("n", str(n.bit_length()))


def all_terms(text: str | None) -> list[int]:
    """Every term of a text."""
    words = _WORD.findall((text or "").lower())
    counts: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for t in word_terms(w):
            counts[t] += n
    found = set(counts) | {twice(t) for t, n in counts.items() if n > 1}
    return sorted(found | {length_term(len(words))})


@dataclass
class Machine:
    slots: dict[int, int]      # term -> position
    w0: float
    w: np.ndarray              # (terms,)
    v: np.ndarray              # (terms, factors)

    def score(self, at: list[int]) -> float:
        v = self.v[at]
        s = v.sum(axis=0)
        y = self.w0 + self.w[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -50, 50))))


class Reader:
    """Finds the machine's terms in texts; remembers what it found for a word."""

    def __init__(self, machine: Machine):
        self.m, self.seen = machine, {}

    def _known(self, word: str) -> tuple[int, ...]:
        slots = self.m.slots
        known = tuple(t for t in word_terms(word) if t in slots or twice(t) in slots)
        if len(self.seen) >= CACHE:
            self.seen.clear()
        self.seen[word] = known
        return known

    def slots(self, text: str | None) -> list[int]:
        words = _WORD.findall((text or "").lower())
        counts: dict[int, int] = {}
        get, known = self.seen.get, self._known
        for w, n in Counter(words).items():
            terms = get(w)
            if terms is None:
                terms = known(w)
            for t in terms:
                counts[t] = counts.get(t, 0) + n
        slots = self.m.slots
        out = [slots[t] for t in counts if t in slots]
        out += [slots[twice(t)] for t, n in counts.items() if n > 1 and twice(t) in slots]
        t = length_term(len(words))
        return sorted({*out, slots[t]} if t in slots else set(out))


def fit(rows: list[tuple[int, list[int]]], terms: list[int], factors: int = FACTORS,
        steps: int = 300, rate: float = 0.1, factor_rate: float = 0.01, l2: float = 1e-3) -> Machine:
    """Fit the machine to (label, positions) rows by Adam on the whole sample.

    The factors move more slowly than the weights, so that a pair explains
    what its terms cannot explain alone: a term that tells by itself keeps its
    weight in texts without its usual company.
    """
    n = len(rows)
    y = np.array([r[0] for r in rows], np.float64)
    count = np.array([len(r[1]) for r in rows], np.int64)
    at = np.array([t for r in rows for t in r[1]], np.int64)
    row = np.repeat(np.arange(n), count)
    k = len(terms)
    rng = np.random.default_rng(7)
    par = {"w0": np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if n else 0.0]),
           "w": np.zeros(k), "v": rng.normal(0, 0.05, (k, factors))}
    m = {a: np.zeros_like(x) for a, x in par.items()}
    s = {a: np.zeros_like(x) for a, x in par.items()}

    some = np.flatnonzero(count)  # reduceat needs rows and terms that occur
    starts = (np.cumsum(count) - count)[some]
    by_term = np.argsort(at, kind="stable")
    met, first = np.unique(at[by_term], return_index=True)
    row_by_term = row[by_term]

    def sums(x, which, cuts, size):
        out = np.zeros((size, x.shape[1]))
        if len(cuts):
            out[which] = np.add.reduceat(x, cuts, axis=0)
        return out

    for step in range(1, steps + 1 if n and k else 1):
        w, v = par["w"], par["v"]
        total = sums(v[at], some, starts, n)
        z = par["w0"][0] + np.bincount(row, (w - 0.5 * (v * v).sum(1))[at], n) + 0.5 * (total ** 2).sum(1)
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        gw = np.bincount(at, err[row], k)
        gv = sums((err[:, None] * total)[row_by_term], met, first, k) - gw[:, None] * v
        grad = {"w0": np.array([err.sum()]), "w": gw + l2 / n * w, "v": gv + l2 * v}
        for a, g in grad.items():
            m[a] = 0.9 * m[a] + 0.1 * g
            s[a] = 0.999 * s[a] + 0.001 * g * g
            par[a] = par[a] - (factor_rate if a == "v" else rate) * (m[a] / (1 - 0.9 ** step)) / (np.sqrt(s[a] / (1 - 0.999 ** step)) + 1e-8)
    return Machine({t: i for i, t in enumerate(terms)}, float(par["w0"][0]), par["w"], par["v"])


def telling(both: np.ndarray, toxic: np.ndarray, expected: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Natural logarithm of how unlikely pairs are as toxic as they are by chance; 0 where not more toxic than expected.

    ``both``: texts with both words; ``toxic``: the toxic ones of them;
    ``expected``: toxic ones by the texts' lengths alone; ``lift``: how much
    more than so expected the texts of the more telling word are toxic.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.clip(expected / both * np.maximum(lift, 1.0), 1e-9, 1 - 1e-9)
        r = toxic / both
        gain = r * np.log(r / q) + np.where(r < 1, (1 - r) * np.log((1 - r) / (1 - q)), 0.0)
    return np.where((both > 0) & (r > q), both * gain, 0.0)


def strips(both: np.ndarray, toxic: np.ndarray, expected: np.ndarray, mine: np.ndarray, theirs: np.ndarray,
           limit: float) -> np.ndarray:
    """Which pairs of a tile tell, a strip of rows at a time, as the bound takes many times its input's memory."""
    out = np.zeros(both.shape, bool)
    for x in range(0, len(both), STRIP):
        s = slice(x, x + STRIP)
        out[s] = telling(both[s], toxic[s], expected[s], np.maximum(mine[s, None], theirs[None])) >= limit
    return out


def pair_words(found: DataFrame, n: int, pos: int) -> list[int]:
    """Words of all telling pairs of the sample (y, size, words).

    A pair tells if the binomial bound on its toxic texts, given the better of
    its two words and the lengths of its texts, is below ``PAIR_CHANCE`` over
    the number of pairs. A pair in fewer toxic texts than that needs cannot
    tell, so only words in as many are looked at; no other limit is set. A
    task multiplies one tile of ``TILE`` x ``TILE`` words over the bounded
    sample; pairs are never emitted.
    """
    lengths = {r["size"]: (r["a"] / r["c"]) for r in
               found.groupBy("size").agg(F.sum("y").alias("a"), F.count("*").alias("c")).collect()}  # at most 64 sizes
    if not lengths:
        return []
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("size"))
    words = (found.withColumn("e", rate).select("y", "e", F.explode("words").alias("t")).groupBy("t")
             .agg(F.sum("y").alias("a"), F.sum("e").alias("e")).filter(F.col("a") >= MIN_ROWS))
    known = sorted((r["t"], r["a"], r["e"]) for r in words.collect())  # words of the bounded sample
    limit = np.log(max(len(known), 2) ** 2 / 2 / PAIR_CHANCE)
    least = int(np.ceil(limit / np.log(n / pos)))
    known = [k for k in known if k[1] >= least]
    if len(known) < 2:
        return []
    spark = found.sparkSession
    place = spark.sparkContext.broadcast({t: i for i, (t, _, _) in enumerate(known)})
    terms = np.array([k[0] for k in known])
    lifts = np.array([a / e for _, a, e in known])
    tiles = -(-len(known) // TILE)

    def dealt(batches):
        for b in batches:
            ys, es, at, left, right = [], [], [], [], []
            for y, e, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                slots = np.array(sorted(place.value[w] for w in ws if w in place.value), np.int64)
                cuts = np.searchsorted(slots, np.arange(tiles + 1) * TILE)
                parts = [(slots[x:z] - i * TILE).astype(np.int16) for i, (x, z) in enumerate(zip(cuts, cuts[1:]))]
                for i, x in enumerate(parts):
                    for j in range(i, tiles) if len(x) else ():
                        if len(parts[j]):
                            ys.append(y), es.append(e), at.append(i * tiles + j), left.append(x), right.append(parts[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(es, pa.float64()), pa.array(at, pa.int32()),
                 pa.array(left, pa.list_(pa.int16())), pa.array(right, pa.list_(pa.int16()))], ["y", "e", "tile", "l", "r"])

    def product(rows):
        i, j = divmod(int(rows["tile"].iloc[0]), tiles)
        both, toxic, expected = (np.zeros((TILE, TILE), np.float32) for _ in range(3))
        rows = rows.sort_values("y")
        for y, part in rows.groupby("y"):
            for x in range(0, len(part), 1024):
                some = part.iloc[x:x + 1024]
                a, b = (np.zeros((len(some), TILE), np.float32) for _ in range(2))
                for k, (l, r) in enumerate(zip(some["l"], some["r"])):
                    a[k, l] = 1
                    b[k, r] = 1
                met = a.T @ b
                both += met
                if y:
                    toxic += met
                expected += (a * some["e"].to_numpy(np.float32)[:, None]).T @ b
        mine, theirs = (np.pad(lifts[k * TILE:(k + 1) * TILE], (0, TILE))[:TILE] for k in (i, j))
        tells = strips(both, toxic, expected, mine, theirs, limit) & (toxic >= least)
        if i == j:
            np.fill_diagonal(tells, False)
        hit = np.union1d(np.flatnonzero(tells.any(1)) + i * TILE, np.flatnonzero(tells.any(0)) + j * TILE)
        return pd.DataFrame({"t": terms[hit].astype(np.int32)})

    pairs = found.withColumn("e", rate).select("y", "e", "words").mapInArrow(
        dealt, "y int, e double, tile int, l array<smallint>, r array<smallint>")
    return sorted(r["t"] for r in pairs.groupBy("tile").applyInPandas(product, "t int").distinct().collect())


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Learn from labelled documents whose crc32(doc_id) mod 4 is not 2.

    Null labels and null texts are not learned from. Of an id that is
    repeated, every row may be in the sample. Without labelled rows the
    machine scores 0.5 throughout.
    """
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("lid"), "toxic")
             .filter(residue(F.col("lid"), 4) != 2))
    sample = known.orderBy(F.xxhash64("lid"), "lid", "toxic").limit(fit_rows)  # bounded, so it may be broadcast
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == sample["lid"]).filter("text IS NOT NULL")

    def terms_of(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            words = [_WORD.findall(t.lower()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([all_terms(t) for t in texts], pa.list_(pa.int32())),
                 pa.array([len(w).bit_length() for w in words], pa.int32()),
                 pa.array([sorted({term("w", x) for x in w}) for w in words], pa.list_(pa.int32()))],
                ["y", "terms", "size", "words"])

    spread = rows.select(F.col("toxic").cast("int").alias("y"), "text").repartition(
        docs.sparkSession.sparkContext.defaultParallelism * 2)
    found = staged(spread.mapInArrow(terms_of, "y int, terms array<int>, size int, words array<int>"), "toxic-terms")
    n, pos = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Machine({}, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    a, c = F.col("a").cast("double"), F.col("c").cast("double")  # rows with the term: toxic, all
    chi2 = n * F.pow(a * (n - pos) - (c - a) * pos, 2) / (c * (n - c) * float(pos) * float(n - pos))
    told = (found.select("y", F.explode("terms").alias("t")).groupBy("t")
            .agg(F.sum("y").alias("a"), F.count("*").alias("c")).filter(F.col("c") >= MIN_ROWS)
            .filter(F.col("c") < n)
            .withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "t"))
    best = [r["t"] for r in told.select("t").collect()]  # terms of the bounded sample
    paired = pair_words(found, n, pos) if 0 < pos < n else []
    lengths = [length_term(1 << k >> 1) for k in range(33)]
    terms = list(dict.fromkeys(best + paired + lengths))
    slots = F.array_intersect("terms", F.array(*[F.lit(t) for t in terms]))
    place = {t: i for i, t in enumerate(terms)}
    # at most fit_rows rows; sorted here, so the fit does not depend on the order they come in
    data = sorted((r["y"], [place[t] for t in r["s"]]) for r in found.select("y", slots.alias("s")).collect())
    return fit(data, terms)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null text is empty.

    Texts of any length are read whole; rows may repeat and each is scored.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(machine)  # terms of the bounded sample

    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            got = [model.value.score(reader.slots(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (residue(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(machine)
    names = docs.columns

    def run(batches):
        reader = Reader(model.value)
        for b in batches:
            clean = [model.value.score(reader.slots(t.as_py())) < threshold for t in b.column(names.index("text"))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
