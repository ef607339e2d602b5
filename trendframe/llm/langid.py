"""Language identification by sparse multinomial logistic regression.

A text is a vector of hashed character n-grams (1 to 3 letters of the
lower-cased text, where every run of other characters is one space), weighted
by term frequency times inverse document frequency and scaled to length one.
The weights are learned by follow-the-regularised-leader with an elastic net:
the L1 part leaves most of them at exactly zero. A temperature, fitted on
rows that took no part in the learning, calibrates the probabilities.

The model is fitted on a sample of at most ``FIT_ROWS`` rows, those with the
smallest id hashes. Prediction reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import residue

#: Rows the model is fitted on at most.
FIT_ROWS = 4_000
#: Hash space of n-grams.
BITS = 15
SPACE = 1 << BITS
#: Characters that are hashed at a time, so that very long texts need bounded memory.
BLOCK = 1 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    clean = f" {_OTHER.sub(' ', text.lower())} "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(SPACE, np.int64)
    for k in range(0, len(codes), BLOCK):
        c = codes[k:k + BLOCK + 2]
        n = min(BLOCK, len(codes) - k)  # n-grams that start in this block
        one = c * _MULT[0]
        two = one[:-1] ^ (c[1:] * _MULT[1])
        three = two[:-1] ^ (c[2:] * _MULT[2])
        for order, h in enumerate((one[:n], two[:n], three[:n])):
            h = (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D + 2 * order)
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=SPACE)
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text and how often each occurs."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray          # (SPACE,)
    w: np.ndarray            # (SPACE, langs), mostly zero
    bias: np.ndarray         # (langs,)
    temperature: float

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF of n-grams that occur ``n`` times, scaled to length one."""
        x = n * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.w[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngrams(text)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, epochs: int = 3,
         alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate FTRL-proximal with an elastic net."""
    z, n = np.zeros((SPACE, n_langs)), np.zeros((SPACE, n_langs))
    bias, total = np.zeros(n_langs), np.zeros(n_langs)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for (at, x), k in zip(rows, y):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            err = softmax(x @ w + bias)
            err[k] -= 1
            g = x[:, None] * err
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
            total += err * err
            bias -= 0.1 * err / (1 + np.sqrt(total))
    return weights(z, n), bias


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, g = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(found: list[tuple[np.ndarray, np.ndarray]], langs: list[str], calibrate: list[bool]) -> Model:
    """Fit to the n-grams of texts; rows marked ``calibrate`` only set the temperature."""
    names = sorted(set(langs))
    model = Model(names, np.ones(SPACE), np.zeros((SPACE, len(names))), np.zeros(len(names)), 1.0)
    if not names:
        return model
    place = {x: i for i, x in enumerate(names)}
    y = np.array([place[x] for x in langs])
    held = np.array(calibrate)
    seen = np.zeros(SPACE)
    for at, _ in found:
        seen[at] += 1
    model.idf = np.log((1 + len(found)) / (1 + seen)) + 1
    learn = [i for i in range(len(found)) if not held[i]] or list(range(len(found)))
    model.w, model.bias = ftrl([(found[i][0], model.vector(*found[i])) for i in learn], y[learn], len(names))
    rest = np.flatnonzero(held)
    if len(rest):
        model.temperature = temperature(np.array([model.logits(*found[i]) for i in rest]), y[rest])
    return model


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from documents with a lang whose crc32(doc_id) mod 4 is not 2.

    At most ``fit_rows`` rows take part, with their whole texts, of which the
    driver gets the hashed n-gram counts. A fifth of them only calibrates.
    Rows with a null text or lang are left out. Without any row left, every
    prediction is ``und``.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    known = (docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(residue(F.col("doc_id"), 4) != 2)
             .select(key.alias("k"), "lang", "text"))
    top = known.select("k").orderBy("k").limit(fit_rows).agg(F.max("k")).first()[0]

    def run(batches):
        for b in batches:
            keep = [(k, x, *ngrams(t)) for k, x, t in zip(*(c.to_pylist() for c in b.columns)) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in keep], pa.int64()), pa.array([r[1] for r in keep], pa.string()),
                 pa.array([r[2].astype("<u2").tobytes() for r in keep], pa.binary()),
                 pa.array([r[3].astype("<u4").tobytes() for r in keep], pa.binary())], ["k", "lang", "at", "n"])

    rows = []
    if top is not None:
        rows = (known.filter(F.col("k") <= top).mapInArrow(run, "k long, lang string, at binary, n binary")
                .limit(fit_rows).collect())
    rows = sorted(rows, key=lambda r: (r["k"], r["lang"], r["at"], r["n"]))
    found = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.int64)) for r in rows]
    return fit(found, [r["lang"] for r in rows], [r["k"] % 5 == 0 for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Only the text is an input. ``und`` with score 0 where the text is null or
    has no letter. Rows may repeat and ids may be null; an empty table gives
    an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPACE weights a language

    def run(batches):
        for b in batches:
            got = [shared.value.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (residue(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
