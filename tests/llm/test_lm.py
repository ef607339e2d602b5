"""Language-model scores against plain counting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trendframe.llm import lm, queries
from trendframe.llm.common import shipped


def frame(spark, data):
    return shipped(spark).createDataFrame(data, "doc_id long, text string, r int, block string, c string")


def rows():
    rng = random.Random(4)
    words = ["the"] * 8 + ["Cat", "cat", "É", "é", "dog.", "x"] + [f"w{k}" for k in range(40)]
    texts = [None, "", " \n ", "THE"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    return [(k, t, 1, "b", "c") for k, t in enumerate(texts)] + [(5, texts[5], 1, "b", "c")]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counting(spark, monkeypatch, order):
    data = rows()
    held = {}
    learn = lm.learn

    def spy(*args):
        held["weights"] = learn(*args)
        return held["weights"]

    monkeypatch.setattr(lm, "learn", spy)
    out = lm.score(frame(spark, data), order=order, block_bytes=2000, range_bytes=3000).collect()
    counts = [Counter() for _ in range(order)]
    for i, t, *_ in data:
        if crc(i) != 2:
            w = [" "] * (order - 1) + split(t)
            for k in range(order):
                for j in range(order - 1, len(w)):
                    counts[k][tuple(w[j - k:j + 1])] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    contexts = [Counter() for _ in range(order)]
    for k in range(1, order):
        for g, c in counts[k].items():
            contexts[k][g[:-1]] += c
    # whatever the history, the probabilities of all words and one unknown word sum to one
    histories = [tuple(rng) for rng in (["the", "cat"], ["w1", "the"], ["zz", "the"], ["the", "zz"], ["zz", "zz"], [" ", " "])]
    for h in histories:
        place = 0
        seen = [contexts[k][h[len(h) - k:]] for k in range(1, order)]
        for k, c in enumerate(seen):
            place = 1 + k * lm.BUCKETS + int(math.log2(c)) if c else place
        mass = 0.0
        for x in [*[g[0] for g in counts[0]], "never said"]:
            p = [1 / (v + 1), counts[0][(x,)] / n] + [counts[k][(*h[len(h) - k:], x)] / max(seen[k - 1], 1) for k in range(1, order)]
            mass += sum(a * b for a, b in zip(held["weights"][place], p))
        assert mass == pytest.approx(1, abs=1e-9)
    want = []
    for i, t, *_ in data:
        words, base, score = split(t), 0.0, 0.0
        w = [" "] * (order - 1) + words
        for j in range(order - 1, len(w)):
            base += math.log10((counts[0][(w[j],)] + 1) / (n + v + 1))
            p = [1 / (v + 1), counts[0][(w[j],)] / n]
            place = 0
            for k in range(1, order):
                c = contexts[k][tuple(w[j - k:j])]
                p.append(counts[k][tuple(w[j - k:j + 1])] / max(c, 1))
                place = 1 + (k - 1) * lm.BUCKETS + int(math.log2(c)) if c else place
            score += math.log10(sum(a * b for a, b in zip(held["weights"][place], p)))
        want.append((i, crc(i) == 2, len(words), sum(counts[0][(x,)] > 0 for x in words), n, base, score))
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out)
    assert [g[:5] for g in got] == [x[:5] for x in sorted(want)]
    assert np.allclose([g[5:] for g in got], [x[5:] for x in sorted(want)], rtol=1e-9)


def slow_em(place, times, p, places):
    """EM in plain loops: all places together first, then each from there."""
    def steps(weights, rows):
        for _ in range(lm.STEPS):
            got = [0.0] * len(weights)
            for k in rows:
                parts = [w * x for w, x in zip(weights, p[k])]
                for j, x in enumerate(parts):
                    got[j] += times[k] * x / sum(parts)
            weights = [x / sum(got) for x in got] if rows else weights
        return weights

    pooled = steps([1 / p.shape[1]] * p.shape[1], list(range(len(p))))
    out = []
    for b in range(places):
        start = [max(w, 1e-6) * (k < 2 or b > 0) for k, w in enumerate(pooled)]
        w = steps([x / sum(start) for x in start], [k for k in range(len(p)) if place[k] == b])
        w[0] = max(w[0], 1e-6)
        out.append([x / sum(w) for x in w])
    return np.array(out)


def test_weights_are_a_mixture_that_beats_equal_weights():
    rng = np.random.default_rng(0)
    q1, q2 = rng.integers(20, 60, 500), rng.integers(2, 30, 500)
    place = rng.integers(0, 5, 500)
    code = np.unique(place << 16 | q1 << 8 | np.where(place > 0, q2, lm.NONE))
    times = rng.integers(1, 9, len(code))
    w = lm.learn(code, times, 2, 1000)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 2] == 0
    q2 = code & 255
    p = np.stack([np.full(len(code), 1 / 1001), 2.0 ** (-(code >> 8 & 255) / lm.STEP), np.where(q2 == lm.NONE, 0, 2.0 ** (-q2 / lm.STEP))], 1)
    assert np.allclose(w[:5], slow_em(code >> 16, times, p, 5), atol=1e-9)
    keep = code >> 16 > 0
    gain = times * (np.log((w[code >> 16] * p).sum(1)) - np.log(p.mean(1)))
    assert gain[keep].sum() > 0


def test_empty_table_and_no_training_rows(spark):
    assert lm.score(frame(spark, [])).collect() == []
    only = next(k for k in range(50) if crc(k) == 2)
    out = lm.score(frame(spark, [(only, "a b", 1, "", "")])).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [
        (only, True, 3, 0, 0, 0.0, 0.0)]


def test_registered_query_uses_contexts_of_two_words(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a x b", "c x d"]) for _ in range(30)) for _ in range(300)]
    frame(spark, [(k, t, 1, "b", "c") for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    held = [r.score for r in queries.op1_lm_scoring(spark, str(tmp_path)).collect() if r.held_out]
    # each triple is one free choice of two; a context of one word also has to guess the word after x
    assert len(held) > 20 and np.mean(held) / 30 > -0.45


def test_counts_survive_packing():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.ones(3000, np.uint32), np.zeros(0, np.uint64)):
        assert (lm.unplanes(lm.planes(x), x.dtype) == x).all()


def test_null_ids_and_texts(spark):
    out = lm.score(frame(spark, [(None, "a a", 1, "", ""), (None, None, 1, "", ""), (3, "a", 1, "", "")])).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == [(-1, 1), (-1, 3), (3, 2)]
    assert all(math.isfinite(r.score) for r in out)
