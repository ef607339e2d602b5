"""Source divergence: pointer sort and audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trendframe.llm import divergence as D
from trendframe.llm.common import shipped

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows):
    n, df = Counter(), Counter()
    for text, lang, source in rows:
        terms = [t.translate(UP) for t in TERM.findall(text or "")]
        for t in terms:
            n[lang or "", source or "", t] += 1
        for t in set(terms):
            df[lang or "", source or "", t] += 1
    return {k: (n[k], df[k]) for k in n}


def slow(rows, least, top):
    counts, groups = slow_counts(rows), defaultdict(set)
    for _, lang, source in rows:
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        df, total = Counter(), Counter()
        for (g, _, t), (n, d) in counts.items():
            if g == lang:
                df[t] += d
                total[t] += n
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def shares(count):
            size = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 5) // (size + 5 * v) for t in kept}
        q = shares(lambda t: total[t])
        p = {s: shares(lambda t, s=s: counts.get((lang, s, t), (0, 0))[0]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if (lang, s, t) in counts and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def made(n=400, sources=7, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOPQ", "abcdefghijklmnopqr", "é", "Éa", "漢字" * 40,
             "漢字" * 40 + "x", "don't", "x1y", "a_b", "[z", "zz{", "ÀÉ", "q" * 200, "q" * 201]
    rows = []
    for _ in range(n):
        k = rng.choice([0, 1, 5, 60])
        text = rng.choice([" ", "\n", ". "]).join(rng.choices(words, weights=range(len(words), 0, -1), k=k))
        rows.append((text, rng.choice(["en", "en", "de", None]), f"s{int(sources * rng.random() ** 2)}"))
    return rows + [(None, "en", None), ("", None, None), ("alone here", "xx", "s0"), (None, "yy", "s0"), (None, "yy", "s1")] + rows[:9]


def frame(spark, rows):
    return shipped(spark).createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, p int")


@pytest.mark.parametrize("blocks", [None, (3, 2)])
def test_audit_equals_plain_counting(spark, blocks, monkeypatch):
    rows = made()
    if blocks:  # several tiles of terms and sources
        monkeypatch.setattr(D, "BLOCK_TERMS", blocks[0])
        monkeypatch.setattr(D, "BLOCK_SOURCES", blocks[1])
    got = D.audit(frame(spark, rows), least_docs=30, top=5)
    assert sorted(tuple(r) for r in got.collect()) == slow(rows, 30, 5)


def test_no_kept_term_and_empty_table(spark):
    rows = made(20)
    assert sorted(tuple(r) for r in D.audit(frame(spark, rows), 1000, 5).collect()) == slow(rows, 1000, 5)
    assert D.audit(frame(spark, [])).collect() == []


def test_very_long_text_is_one_document(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 1000)
    text = " ".join(f"w{k % 90} Ä{'b' * (k % 13)}" for k in range(3000)) + " " + "y" * 2500 + " end"
    b = pa.RecordBatch.from_pydict({"text": [text, "w b", "", text], "lang": ["en"] * 4, "source": ["a", "a", "b", "b"]})
    got = Counter(), Counter()
    for out in D.batch_counts(b):
        for r in out.to_pylist():
            got[0][r["lang"], r["source"], r["term"]] += r["n"]
            got[1][r["lang"], r["source"], r["term"]] += r["df"]
    want = slow_counts(list(zip(*b.to_pydict().values())))
    assert {k: (got[0][k], got[1][k]) for k in got[0]} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abAB é1", max_size=40), min_size=1, max_size=8))
def test_runs_are_equal_terms_in_order(texts):
    raw = [t.encode() for t in texts]
    docs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, length, doc = D.term_pointers(data, docs)
    low = np.concatenate([D.LOWER[data], np.zeros(8, np.uint8)])
    order, run = D.multikey_sort(low, start, length)
    terms = [low[s:s + n].tobytes() for s, n in zip(start, length)]
    assert [terms[k] for k in order] == sorted(terms)
    assert run.tolist() == [sorted(set(terms)).index(terms[k]) for k in order]
    want = [(i, t.translate(UP).encode()) for i, x in enumerate(texts) for t in TERM.findall(x)]
    assert sorted(zip(doc.tolist(), terms)) == sorted(want)
