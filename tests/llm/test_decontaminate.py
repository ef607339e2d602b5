"""Benchmark decontamination against brute force over all windows."""

import random
from collections import Counter

import numpy as np

from trendframe.llm import decontaminate
from trendframe.llm.common import shipped

WORDS = [f"w{k}" for k in range(400)]


def docs(spark, data):
    return shipped(spark).createDataFrame(data, "doc_id long, text string, item_id string, similarity string")


def items(spark, data):
    return spark.createDataFrame(data, "item_id long, text string, doc_id string")


def slow(text, item):
    """Best similarity over all item-sized windows."""
    w, x = decontaminate._WORD.findall((text or "").lower()), decontaminate._WORD.findall((item or "").lower())
    if not x or not w:
        return 0.0
    k = min(5, len(x))
    goal = Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
    best = 0.0
    for s in range(max(len(w) - len(x), 0) + 1):
        win = w[s:s + len(x)]
        have = Counter(tuple(win[j:j + k]) for j in range(len(win) - k + 1))
        either = sum((have | goal).values())
        best = max(best, sum((have & goal).values()) / either if either else 0.0)
    return best


def fixture():
    rng = random.Random(12)
    bench = [" ".join(rng.choices(WORDS, k=rng.choice([3, 5, 9, 30, 60, 120]))) for _ in range(25)]
    bench += ["Repeat this " * 12, "same words same words same words same words", ""]
    texts = []
    for k in range(120):
        words = rng.choices(WORDS, k=rng.randint(0, 150))
        b = rng.choice(bench).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if b:
                b[rng.randrange(len(b))] = rng.choice(WORDS)
        cut = rng.randint(0, len(words))
        if k % 3:
            words[cut:cut] = b if k % 4 else b[:len(b) // 2]
        texts.append(rng.choice([" ", "\n", ", "]).join(words).upper() if k % 5 == 0 else " ".join(words))
    return texts + [bench[3], None, "", "repeat THIS " * 400], bench


def test_leaks_equal_brute_force(spark):
    texts, bench = fixture()
    out = decontaminate.leaks(docs(spark, [(k, t, "a", "b") for k, t in enumerate(texts)]),
                              items(spark, [(k, t, "c") for k, t in enumerate(bench)] + [(50, None, "c")]), block_words=400)
    got = {(r.doc_id, r.item_id): r.similarity for r in out.collect()}
    want = {(i, j): s for i, t in enumerate(texts) for j, b in enumerate(bench) if (s := slow(t, b)) >= 0.8}
    assert set(got) == set(want)
    assert all(np.isclose(got[k], want[k]) for k in want)
    kept = decontaminate.drop_contaminated(docs(spark, [(k, t, "a", "b") for k, t in enumerate(texts)]),
                                           items(spark, [(k, t, "c") for k, t in enumerate(bench)]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})
    assert kept.columns == ["doc_id", "text", "item_id", "similarity"]


def test_all_fingerprints_within_the_radius_are_found():
    rng = random.Random(2)
    block = decontaminate.Items([(k, " ".join(rng.choices(WORDS, k=20))) for k in range(60)])
    _, fps, _ = block.by_size[20]
    probes = []
    for f in fps.tolist():
        probes += [f ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 5, 15, 23, 24, 30)]
    probes = np.array(probes, np.uint64)
    w, i = block.candidates(probes, 20)
    near = np.bitwise_count(probes[:, None] ^ fps[None, :]) <= decontaminate.RADIUS
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_empty_tables_and_repeated_rows(spark):
    b = [(1, "one two three four five six", "")]
    assert decontaminate.leaks(docs(spark, []), items(spark, b)).count() == 0
    assert decontaminate.leaks(docs(spark, [(1, "one two three four five six", "", "")]), items(spark, [])).count() == 0
    twice = [(1, "x one two three four five six y", "", "")] * 2 + [(None, "one two three four five six", "", "")]
    out = decontaminate.leaks(docs(spark, twice), items(spark, b * 2)).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in out] == [(1, 1, 1.0)] * 2 + [(None, 1, 1.0)]
