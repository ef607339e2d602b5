"""Token ids, Huffman files and packing against the plain library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trendframe.llm import huffman, packing
from trendframe.llm.common import shipped
from trendframe.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ALPHABET = list("ab zZ'stnre1.,!\n\t  éßñ€Ωя  ​<|>") + ["don't", " the", "<|endoftext|>", "  ", " \n", "\r\n"]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_cached_ids_equal_the_library(text):
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def rows():
    rng = random.Random(1)
    words = ["the", "Lorem", "çok", "x", "ипсум", "it's", "42", "!?", "\n", "a" * 30]
    texts = [None, "", " ", "a"] + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 80, 700, 3000]))) for _ in range(60)]
    return [(rng.randrange(10 ** 9), t, "clash") for t in texts] + [(-5, "twice", "x"), (-5, "twice", "x"), (-5, "other", "y")]


def frame(spark, data):
    return shipped(spark).createDataFrame(data, "doc_id long, text string, ids string")


def test_round_trip_of_files(spark):
    data = rows()
    out = huffman.round_trip(frame(spark, data), PATH, segment=2000).orderBy("start").collect()
    want = sorted((i, zlib.crc32(np.array(ids(t) + [0], "<u4").tobytes()), len(ids(t)) + 1) for i, t, _ in data)
    assert sorted((r.doc_id, r.ids_crc32, r.n_tokens) for r in out) == want
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens


def test_round_trip_of_empty_table_and_null_id(spark):
    assert huffman.round_trip(frame(spark, []), PATH).count() == 0
    out = huffman.round_trip(frame(spark, [(None, "a b", ""), (3, None, "")]), PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in out] == [(None, 0, 3), (3, 3, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10 ** 6), min_size=0, max_size=80), st.integers(1, 12))
def test_code_lengths_are_a_prefix_code_within_the_limit(counts, limit):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts, limit)
    n = int((counts > 0).sum())
    assert ((lengths > 0) == (counts > 0)).all()
    if n > 1:
        assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) == 1
        assert lengths.max() <= max(limit, (n - 1).bit_length())


def test_code_lengths_without_a_tight_limit_are_huffman():
    import heapq
    rng = random.Random(2)
    counts = [rng.randint(1, 1000) for _ in range(60)]
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(np.array(counts), 40).astype(int) * counts).sum()) == total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=40), max_size=30), st.integers(1, 9))
def test_segments_round_trip(docs, block):
    flat = np.array([x for d in docs for x in d], np.int64)
    lengths = huffman.code_lengths(np.bincount(flat, minlength=1) if len(flat) else np.zeros(1, np.int64), 9)
    names = [None if k % 5 == 3 else k - 2 for k in range(len(docs))]
    blob = huffman.write_segment(names, [len(d) for d in docs], flat, lengths, huffman.codes(lengths), block)
    got, sizes, out = huffman.read_segment(blob, *huffman.decode_table(lengths))
    assert got == names and sizes.tolist() == [len(d) for d in docs] and out.tolist() == flat.tolist()


def test_pieces_and_packing(spark):
    data = rows()
    out = packing.pack_documents(frame(spark, data), PATH, size=128, group=20).collect()
    want = []
    for i, t, _ in data:
        x = np.array(ids(t) + [2], "<u4")
        first = len(x) % 128 or 128 if len(x) > 128 else len(x)
        for k, s in enumerate([0, *range(first, len(x), 128)]):
            part = x[s:first] if not k else x[s:s + 128]
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    place = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place.get(r.sequence_id, 0)
        place[r.sequence_id] = r.offset + r.length
    assert max(place.values()) <= 128
    assert len(place) <= 1.05 * -(-sum(place.values()) // 128) + 2


def test_packing_nulls_and_empty(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
    out = packing.pack_documents(frame(spark, [(None, None, ""), (None, None, "")]), PATH).collect()
    assert [(r.doc_id, r.piece, r.length) for r in out] == [(None, 0, 1)] * 2
    assert sorted(r.offset for r in out) == [0, 1]


@pytest.mark.parametrize("seed", range(5))
def test_bound_never_exceeds_the_best_packing(seed):
    from itertools import product
    rng = random.Random(seed)
    items = [rng.randint(1, 10) for _ in range(7)]
    best = min(len(set(a)) for a in product(range(7), repeat=7)
               if all(sum(x for x, b in zip(items, a) if b == k) <= 10 for k in set(a))) if seed < 2 else None
    lengths = np.array(items)
    bins, offsets, fill = packing.best_fit_decreasing(lengths, 10)
    assert packing.bin_bound(lengths, 10) <= (best or len(fill)) <= len(fill)
    for b in range(len(fill)):
        got = sorted((o, n) for o, n, k in zip(offsets.tolist(), items, bins.tolist()) if k == b)
        assert [o for o, _ in got] == [sum(n for _, n in got[:j]) for j in range(len(got))] and sum(n for _, n in got) <= 10
