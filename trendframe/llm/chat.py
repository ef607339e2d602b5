"""Chat formatting by columnar byte assembly.

Turns become ``### Role: text</turn>`` lines. Inside texts and roles every
backslash, and the first character of every control string (``###`` and
``</turn>``), gets a backslash before it, so a reader can tell them apart and
undo it. A whole batch of turns is assembled at once: the lengths of headers,
escaped texts and footers give cumulative offsets, these give scatter indices,
and all bytes are copied into one preallocated Arrow buffer, whose offsets at
conversation starts make the output column without another copy. The same
offsets, counted in code points, are the loss mask.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
LOSS_ROLE = "assistant"
FOOTER = "</turn>\n"
#: Turn numbers in a part: a longer conversation becomes several rows, in order.
PART_TURNS = 1000

_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def header(role: str) -> str:
    """The mark before a turn; other roles than the fixed ones are written as @role."""
    name = ROLES.get(role)
    return f"### {name or '@' + _ESCAPE.sub(lambda m: chr(92) + m[0], role).replace(':', chr(92) + ':')}: "


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and where each row's start; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if offsets and offsets.size else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def escape_places(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes get a backslash before them; control strings lie within one row."""
    out = data == 92
    for control, n in ((b"###", 3), (b"</turn>", 7)):
        found = np.flatnonzero(data == control[0])
        found = found[found + n <= len(data)]
        for k in range(1, n):
            found = found[data[found + k] == control[k]]
        row = np.searchsorted(at, found, "right") - 1
        out[found[found + n <= at[row + 1]]] = True
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every segment, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: (buffer, row starts, text starts, text ends), in bytes."""
    data, at = bytes_and_offsets(texts)
    esc = escape_places(data, at)
    extra = np.concatenate([[0], np.cumsum(esc)])
    coded = pc.fill_null(roles, "").dictionary_encode()
    heads = [header(r.as_py()).encode() for r in coded.dictionary]
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    head_sizes = np.array([len(h) for h in heads], np.int64)
    head_at = np.cumsum(head_sizes) - head_sizes
    role = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    foot = np.frombuffer(FOOTER.encode(), np.uint8)
    sizes = np.diff(at)
    body = sizes + extra[at[1:]] - extra[at[:-1]]
    rows = np.concatenate([[0], np.cumsum(head_sizes[role] + body + len(foot))])
    starts = rows[:-1] + head_sizes[role]
    buffer = pa.allocate_buffer(int(rows[-1]))
    out = np.frombuffer(buffer, np.uint8)
    out[spread(rows[:-1], head_sizes[role])] = head_bytes[spread(head_at[role], head_sizes[role])]
    place = spread(starts - extra[at[:-1]], sizes) + extra[1:]  # of each text byte
    out[place] = data
    out[place[esc] - 1] = 92
    ends = starts + body
    out[spread(ends, np.full(len(ends), len(foot)))] = np.tile(foot, len(ends))
    return buffer, rows, starts, ends


SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.large_string()),
                    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DDL = "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>"


def formatted_rows(t: pa.Table) -> pa.RecordBatch:
    """Format turns that are sorted by conversation and part, whole parts only."""
    buffer, rows, starts, ends = assemble(t["role"].combine_chunks(), t["text"].combine_chunks())
    conv, part = (pc.fill_null(t[c].combine_chunks(), 0).to_numpy(zero_copy_only=False) for c in ("conv_id", "part"))
    null = t["conv_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(conv), bool)
    new[1:] = (conv[1:] != conv[:-1]) | (part[1:] != part[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(new)
    offsets = np.append(rows[:-1][first], rows[-1]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), buffer])
    # code points before each byte: all but continuation bytes
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)])
    own = np.cumsum(new) - 1
    base = chars[rows[:-1][first]][own]
    lossy = pc.fill_null(pc.equal(t["role"].combine_chunks(), LOSS_ROLE), False).to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays([pa.array((chars[starts] - base)[lossy]), pa.array((chars[ends] - base)[lossy])],
                                       ["start", "end"])
    count = np.bincount(own[lossy], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), spans)
    ids = pa.array(conv[first], pa.int64(), mask=null[first])
    return pa.RecordBatch.from_arrays([ids, pa.array(part[first], pa.int64()), text, loss], schema=SCHEMA)


def _whole_parts(batches, use):
    """Hand over runs of rows that end with a whole (conv_id, part)."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not len(t):
            continue
        keys = list(zip(t["conv_id"].to_pylist(), t["part"].to_pylist()))
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut:
            yield use(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and len(held):
        yield use(held)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss (spans of code points) for each conversation.

    Turns are ordered by turn, then role and text; a null turn comes first. A
    null text is empty, a null role is the empty role. Repeated rows are
    repeated turns, rows with a null conv_id are one conversation. A
    conversation with turn numbers of ``PART_TURNS`` and more has several
    parts, whose texts joined in order are its format, so no task holds an
    unbounded one. An empty table gives an empty result; other columns are not
    read.
    """
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn(
        "part", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).cast("long"))
    dealt = src.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.select("conv_id", "part", "role", "text").mapInArrow(
        lambda batches: _whole_parts(batches, formatted_rows), DDL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or part."""
    back = {v: k for k, v in ROLES.items()}
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        out.append((unescape(m[1][1:]) if m[1].startswith("@") else back[m[1]], unescape(m[2])))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets back, one row each.

    Parts stream through in order; a conversation of any length needs the
    memory of one part.
    """
    def run(batches):
        state = None

        def row(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for b in batches:
            done = []
            for conv, text, loss in zip(*(b.column(k).to_pylist() for k in range(3))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"]:span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield _digest_batch(done)
        if state is not None:
            yield _digest_batch([row(state)])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(run, DIGEST)


def _digest_batch(rows: list) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
