"""Toxicity and language identification: held-out accuracy and edge cases."""

import random
import zlib

import numpy as np
import pytest

from trendframe.llm import langid, toxicity
from trendframe.llm.common import shipped


def docs(spark, data):
    return shipped(spark).createDataFrame(data, "doc_id long, text string, lang string, score double, predicted int")


@pytest.fixture(scope="module")
def toxic_rows():
    """Toxic only where an insult meets a group: neither alone tells."""
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(300)]
    out = []
    for k in range(1600):
        words = rng.choices(plain, k=rng.randint(5, 200))
        kind = rng.randrange(4)
        if kind & 1:
            words.insert(rng.randrange(len(words)), rng.choice(["trashy", "rotten"]))
        if kind & 2:
            words.insert(rng.randrange(len(words)), rng.choice(["people", "folk"]))
        out.append((k, " ".join(words), int(kind == 3)))
    return out


def test_machine_learns_pairs(spark, toxic_rows):
    table = docs(spark, [(k, t, "en", 0.0, 0) for k, t, _ in toxic_rows])
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in toxic_rows], "doc_id long, quality int, toxic int")
    machine = toxicity.train(table, labels)
    truth = {k: y for k, _, y in toxic_rows}
    held = [r for r in toxicity.score(table, machine).collect() if r.held_out]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert len(held) > 300 and right > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(table, machine).collect()}
    assert kept == {r.doc_id for r in toxicity.score(table, machine).collect() if not r.predicted}


@pytest.fixture(scope="module")
def weak_pair_rows():
    """A tenth toxic by a strong word; 40 rows for each of two pairs toxic only by words that are common elsewhere."""
    rng = random.Random(11)
    plain = [f"word{k}" for k in range(200)]
    pairs = [("river", "stone"), ("amber", "cloud")]
    out = []
    for k in range(8000):
        words = rng.choices(plain, k=rng.randint(5, 40))
        for pair in pairs:
            if rng.random() < 0.2:
                words.append(rng.choice(pair))
        y = int(rng.random() < 0.1)
        if y:
            words.append("vile")
        out.append([k, words, y, False])
    for k in rng.sample(range(8000), 80):
        out[k][1:] = [rng.choices(plain, k=rng.randint(5, 40)) + list(pairs[k % 2]), 1, True]
    return [(k, " ".join(w), y, p) for k, w, y, p in out]


def test_machine_learns_pairs_of_weak_words(spark, weak_pair_rows):
    """Each word of the pairs is below the limit for single terms; settings are those of production."""
    learn = [(set(t.split()), y) for k, t, y, _ in weak_pair_rows if zlib.crc32(str(k).encode()) % 4 != 2]
    n, pos = len(learn), sum(y for _, y in learn)
    for word in ("river", "stone", "amber", "cloud"):
        c, a = sum(word in w for w, _ in learn), sum(y for w, y in learn if word in w)
        assert n * (a * (n - pos) - (c - a) * pos) ** 2 / (c * (n - c) * pos * (n - pos)) < toxicity.MIN_CHI2
    table = docs(spark, [(k, t, "en", 0.0, 0) for k, t, _, _ in weak_pair_rows])
    labels = spark.createDataFrame([(k, 1, y) for k, _, y, _ in weak_pair_rows], "doc_id long, quality int, toxic int")
    machine = toxicity.train(table, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(table, machine).collect() if r.held_out}
    paired = [got[k] for k, _, _, p in weak_pair_rows if p and k in got]
    assert len(paired) >= 12 and np.mean(paired) >= 0.9
    clean = [got[k] for k, _, y, _ in weak_pair_rows if not y and k in got]
    assert np.mean(clean) < 0.01


def test_pair_words_equal_plain_counting(spark, monkeypatch):
    """Over several tiles, against a plain loop over all pairs of words."""
    monkeypatch.setattr(toxicity, "TILE", 4)
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        words = set(rng.sample(range(1, 14), rng.randint(0, 6)))
        rows.append((int({2, 9} <= words or {5, 6} <= words or rng.random() < 0.05), [], rng.randint(3, 4), sorted(words)))
    n, pos = len(rows), sum(r[0] for r in rows)
    share = {s: np.mean([r[0] for r in rows if r[2] == s]) for s in (3, 4)}
    ws = [w for w in range(1, 14) if sum(r[0] for r in rows if w in r[3]) >= toxicity.MIN_ROWS]
    limit = np.log(len(ws) ** 2 / 2 / toxicity.PAIR_CHANCE)
    lift = {w: sum(r[0] for r in rows if w in r[3]) / sum(share[r[2]] for r in rows if w in r[3]) for w in ws}
    want = set()
    for i in ws:
        for j in ws:
            inside = [r for r in rows if i in r[3] and j in r[3]]
            if i < j and inside:
                c, a = len(inside), sum(r[0] for r in inside)
                q = min(sum(share[r[2]] for r in inside) / c * max(lift[i], lift[j], 1), 1 - 1e-9)
                r = a / c
                gain = r * np.log(r / q) + ((1 - r) * np.log((1 - r) / (1 - q)) if r < 1 else 0) if r > q else 0
                if c * gain >= limit:
                    want |= {i, j}
    found = shipped(spark).createDataFrame(rows, "y int, terms array<int>, size int, words array<int>").repartition(3)
    assert set(toxicity.pair_words(found, n, pos)) == want >= {2, 9, 5, 6}
    empty = found.filter("y = 9")
    assert toxicity.pair_words(empty, n, pos) == []


def test_machine_is_fitted_on_20000_rows(spark, monkeypatch):
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a: seen.append(len(rows)) or fit(rows[:50], *a))
    table = docs(spark, [(k, f"word{k % 7}", "en", 0.0, 0) for k in range(28000)])
    labels = spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(28000)], "doc_id long, quality int, toxic int")
    toxicity.train(table, labels)
    assert seen == [20000]


def test_fit_steps_are_the_gradient_of_the_log_loss():
    """One step of Adam moves every parameter against the sign of its numeric gradient."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.5), sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist())) for _ in range(30)]
    start, after = (toxicity.fit(rows, list(range(6)), factors=2, steps=n, l2=0.0) for n in (0, 1))

    def loss(m):
        p = np.array([m.score(at) for _, at in rows])
        return -np.mean([np.log(q if y else 1 - q) for (y, _), q in zip(rows, p)])

    for a in ("w", "v"):
        x, moved = getattr(start, a), getattr(after, a) - getattr(start, a)
        for i in np.ndindex(x.shape):
            was, h = x[i], 1e-5
            x[i] = was + h
            up = loss(start)
            x[i] = was - h
            g = (up - loss(start)) / (2 * h)
            x[i] = was
            assert abs(g) < 1e-6 or np.sign(moved[i]) == -np.sign(g)


def test_reader_finds_what_fitting_saw():
    terms = {t: k for k, t in enumerate(toxicity.all_terms("Some some words, someone's words and é"))}
    machine = toxicity.Machine(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 2)))
    reader = toxicity.Reader(machine)
    for text in ("Some some words, someone's words and é", "words", "", None, "some other WORDS words"):
        want = sorted(terms[t] for t in toxicity.all_terms(text) if t in terms)
        assert reader.slots(text) == want


def test_machine_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine({}, 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    at = [0, 2, 5]
    y = 0.3 + m.w[at].sum() + sum(m.v[a] @ m.v[b] for a in at for b in at if a < b)
    assert np.isclose(m.score(at), 1 / (1 + np.exp(-y)))


def test_toxicity_without_labels_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, None, None, 0.0, 0), (None, "", None, 0.0, 0), (2, "x " * 50000, None, 0.0, 0)])
    out = toxicity.score(table, toxicity.train(table, none)).collect()
    assert [r.score for r in out] == [0.5] * 3
    null = spark.createDataFrame([(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs(spark, []), toxicity.train(table, null)).count() == 0


def test_language_of_held_out_texts(spark):
    rng = random.Random(7)
    syllables = {"aa": ["lo", "mi", "ra"], "bb": ["sch", "ung", "ver"], "cc": ["é", "eau", "qui"]}
    data = []
    for k in range(900):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(2, 30)))
        data.append((k, text.upper() if k % 5 == 0 else text, lang, 0.0, 0))
    data += [(1000, None, "aa", 0.0, 0), (1001, "12 !?", "bb", 0.0, 0), (1002, "", None, 0.0, 0), (1003, "lomira", None, 0.0, 0)]
    table = docs(spark, data)
    out = {r.doc_id: r for r in langid.predict(table, langid.train(table)).collect()}
    held = [d for d in data if out[d[0]].held_out and d[0] < 900]
    assert np.mean([out[i].lang_pred == x for i, _, x, *_ in held]) > 0.99
    assert np.mean([out[i].score for i, *_ in held]) > 0.9
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert out[1003].lang_pred == "aa"


def test_language_without_training_rows_and_long_texts(spark):
    table = docs(spark, [(1, "text", None, 0.0, 0)])
    assert [r.lang_pred for r in langid.predict(table, langid.train(table)).collect()] == ["und"]
    assert langid.predict(docs(spark, []), langid.train(docs(spark, []))).count() == 0


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Some läng text 123 with Ωords. " * 40
    want = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (langid.ngram_counts(text) == want).all()
    n = len(langid._OTHER.sub(" ", text.lower())) + 2
    assert want.sum() == n + (n - 1) + (n - 2)


def test_elastic_net_leaves_most_weights_at_zero():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 2000, 40)), None) for _ in range(200)]
    rows = [(at, np.full(len(at), len(at) ** -0.5)) for at, _ in rows]
    y = np.array([int((at < 300).sum() > 5) for at, _ in rows])
    w, _ = langid.ftrl(rows, y, 2, l1=0.5)
    assert 0 < (w != 0).any(1).sum() < 1500
