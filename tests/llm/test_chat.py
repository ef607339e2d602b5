"""Chat formatting: exact round trip and digests."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from trendframe.llm import chat
from trendframe.llm.common import shipped

PARTS = ["#", "##", "###", "<", "</turn>", "</turn>\n", "### User: ", "\\", "é", "€", "\n", "a b", ":", "@", "🙂"]


def frame(spark, data):
    return shipped(spark).createDataFrame(data, "conv_id long, turn long, role string, text string, part string, loss int")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "User", "@", "a: b", "", "#\\"]),
                          st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), min_size=1, max_size=8))
def test_one_batch_round_trips(turns):
    t = pa.table({"conv_id": pa.array([1] * len(turns), pa.int64()), "part": pa.array([0] * len(turns), pa.int64()),
                  "role": [r for r, _ in turns], "text": [x for _, x in turns]})
    out = chat.formatted_rows(t)
    text = out.column(2)[0].as_py()
    assert chat.read_turns(text) == turns
    spans = out.column(3)[0].as_py()
    assert [chat.unescape(text[s["start"]:s["end"]]) for s in spans] == [x for r, x in turns if r == "assistant"]


def rows():
    rng = random.Random(8)
    out = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system"]),
                        rng.choice([None, ""] + ["".join(rng.choices(PARTS, k=30))] * 5), "x", 1))
    out += [(99, k, "assistant" if k % 2 else "user", f"turn {k} ###", "x", 1) for k in range(2500)]
    rng.shuffle(out)
    return out


def test_digests_equal_plain_reading(spark):
    data = rows()
    formatted = chat.format_chats(frame(spark, data))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(got) == {r[0] for r in data}
    assert formatted.filter("conv_id = 99").count() == 3  # long conversations come in parts
    for conv, r in got.items():
        turns = sorted((t, role, x or "") for c, t, role, x, *_ in data if c == conv)
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_null_empty_and_repeated_rows(spark):
    assert chat.digests(chat.format_chats(frame(spark, []))).collect() == []
    data = [(None, None, None, None, "", 0), (1, 0, "user", "a", "", 0), (1, 0, "user", "a", "", 0), (1, None, "user", "z", "", 0)]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(frame(spark, data))).collect()}
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nz\nuser\na\nuser\na\n").hexdigest()
