"""Exact and SimHash deduplication against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from trendframe.llm import exact_dedup, simhash_dedup
from trendframe.llm.common import shipped

DOCS = "doc_id long, text string, lang string, keep_id string, id int, h string, row string, recipe string"


def table(spark, rows):
    return shipped(spark).createDataFrame([(i, t, "en", "x", 1, "h", "r", "q") for i, t in rows], DOCS)


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def corpus():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "élan", "É", "delta.", "x\ny", "Ω", "end!"]
    long = " ".join(rng.choice(words) for _ in range(4000))
    texts = [None, "", "A", "a", "É", "é", long, long.upper(), long.lower(), long + "!", "no mark " * 3000, "NO mark " * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(texts)] + [(500 + k, t) for k, t in enumerate(texts[::2])] + [(7, long.upper())]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_grouping_by_text(spark, weak):
    rows = corpus()
    kw = {"min_chunk": 16, "max_chunk": 64}
    if weak:  # nearly all chunks collide: identifiers must still tell them apart
        kw["chunk_hash"] = lambda c: F.length(c).cast("long") % 3
    out = exact_dedup.exact_dedup(table(spark, rows), **kw).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == expected(rows)
    kept = {}
    for r in out:
        kept.setdefault(r.text_sha256, []).append(r.kept and r.doc_id == r.keep_id)
    assert all(sum(k) == 1 for k in kept.values())


def test_chunks_join_to_the_text(spark):
    rows = [(k, t or "") for k, t in corpus()]
    df = table(spark, rows).select("text", F.array_join(exact_dedup.chunked(F.col("text"), 16, 64), "").alias("again"))
    assert all(r.text == r.again for r in df.collect())


def test_exact_keep_one_keeps_columns_and_one_row_of_a_group(spark):
    rows = corpus()
    out = exact_dedup.keep_one(table(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = [(r.doc_id, low(r.text)) for r in out.collect()]
    assert sorted(got) == sorted({(k, t) for k, t in ((max(i for i, x in rows if low(x) == low(t)), low(t)) for _, t in rows)})


def test_exact_dedup_empty_table_and_null_ids(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    out = exact_dedup.exact_dedup(table(spark, [(None, "a"), (None, "A"), (3, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in out) == [
        (-1, -1, 1, True), (-1, 3, 3, False), (-1, 3, 3, False), (3, 3, 3, True)]


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k:k + 3]).encode(), seed=42).intdigest() for k in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, radius):
    """Component of each (id, fingerprint) by plain search over all pairs."""
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    lows = {}
    for k, (i, _) in enumerate(pairs):
        lows[find(k)] = min(lows.get(find(k), i), i)
    return [lows[find(k)] for k in range(len(pairs))]


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 400))] for _ in range(30)]
    texts = [None, "", " \t ", "One", "one two", "ONE two"] + [" ".join(b) for b in base]
    for b in base:
        for _ in range(6):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.append("\n".join(c))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = simhash_dedup.simhash_components(table(spark, rows)).collect()
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {r.id: r.fp % (1 << 64) for r in out} == fps
    pairs = sorted(fps.items())
    assert [r.component_id for r in sorted(out, key=lambda r: r.id)] == slow_components(pairs, 3)
    kept = simhash_dedup.keep_one(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(slow_components(pairs, 3)))


def test_simhash_links_lose_no_chain_in_split_places(spark, monkeypatch):
    rng = random.Random(9)
    fps, x = set(), 0x0123456789ABCDEF
    for _ in range(300):  # one long chain, most of it in the same meeting places
        x ^= sum(1 << b for b in rng.sample(range(20), rng.randint(1, 3)))
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    monkeypatch.setattr(simhash_dedup, "TILE", 16)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    df = shipped(spark).createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df)).collect()}
    pairs = [(f, f % (1 << 64)) for (f,) in signed]
    assert [roots.get(f, f) for f, _ in pairs] == slow_components(pairs, 3)


def test_simhash_repeated_null_and_empty(spark):
    assert simhash_dedup.simhash_components(table(spark, [])).count() == 0
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, None), (8, "")]
    out = simhash_dedup.simhash_components(table(spark, rows)).collect()
    assert sorted((r.id or -1, r.component_id) for r in out) == [(-1, 4), (4, 4), (4, 4), (8, 8), (9, 8)]
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(table(spark, rows)).collect()) == [4, 8]
