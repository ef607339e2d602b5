"""Token-id files in canonical length-limited Huffman code.

Code lengths come from the counts of ids over the whole corpus by
package-merge, so no code is longer than ``MAX_BITS``; codes are assigned in
canonical order, so the lengths alone describe the book. A file row is a
segment: a header, the documents' ids and lengths, one bit offset per block
of ``BLOCK`` ids, and the bit stream. Blocks decode independently; the
decoder steps all blocks of a segment at once through one table.

Segment layout, little-endian: ``THUF``, version u32, ids u64, documents u64,
block u32, bits u64; document ids i64, their null flags u8, lengths u64; block
offsets u32 or u64 by the size of the stream; the bit stream, most significant
bit first, padded with 8 zero bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, released, staged
from .tokens import encoder

MAX_BITS = 16
BLOCK = 512
#: Ids after which a segment is closed; it ends with a whole document.
SEGMENT = 1 << 20
#: Blocks of ids that are coded at a time.
RUN = 64
#: Words that a worker remembers the ids of.
CACHE = 700_000
MAGIC, VERSION = b"THUF", 1
_HEAD = struct.Struct("<4sIQQIQ")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of each symbol under the limit; 0 where the count is 0.

    Package-merge: ``max_bits`` times, pair up the cheapest items and merge
    the pairs with the symbols; the 2n-2 cheapest items of the last list tell
    how many codes use each level. The limit is raised where it could not
    hold all symbols.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    is_symbol, items = [], weight
    for level in range(max_bits):
        if level:
            pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
            merged = np.concatenate([weight, pairs])
            at = np.argsort(merged, kind="stable")
            items = merged[at]
            is_symbol.append(at < n)
        else:
            is_symbol.append(np.ones(n, bool))
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_symbol):
        symbols = int(flags[:take].sum())
        depth[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = depth
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical code of each symbol: shorter codes first, then by symbol."""
    out = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        step = np.int64(1) << (top - size)
        out[order] = ((np.cumsum(step) - step) >> (top - size)).astype(np.uint32)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Entry of every bit pattern of the longest length: symbol << 5 | length."""
    top = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entry = (order.astype(np.uint32) << np.uint32(5)) | lengths[order]
    table = np.zeros(1 << top, np.uint32)
    filled = np.repeat(entry, 1 << (top - lengths[order].astype(np.int64)))
    table[:len(filled)] = filled
    return table, top


def write_segment(doc_ids: list, sizes: list[int], ids: np.ndarray, lengths: np.ndarray, code: np.ndarray,
                  block: int = BLOCK) -> bytes:
    """Encode the documents' concatenated ids."""
    size = lengths[ids]
    bits = int(size.sum(dtype=np.int64))
    words = np.zeros((bits >> 6) + 2, np.uint64)
    offsets, done = [], 0
    for a in range(0, len(ids), RUN * block):       # runs short enough for a core's cache
        n = size[a:a + RUN * block].astype(np.int64)
        ends = np.cumsum(n) + done
        starts = ends - n
        offsets.append(starts[::block])
        word = starts >> 6
        room = 64 - (starts & 63)                   # bits left in the word
        c = code[ids[a:a + RUN * block]].astype(np.uint64)
        over = np.maximum(n - room, 0)              # bits that go on in the next word
        high = np.where(over > 0, c >> over.astype(np.uint64), c << np.maximum(room - n, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(high, first)
        cross = np.flatnonzero(over)
        words[word[cross] + 1] |= c[cross] << (64 - over[cross]).astype(np.uint64)
        done = int(ends[-1])
    stream = words.astype(">u8").tobytes()[:(bits + 7) // 8]
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    offsets = np.concatenate(offsets or [np.zeros(0, np.int64)]).astype("<u4" if bits < 1 << 32 else "<u8")
    return b"".join([_HEAD.pack(MAGIC, VERSION, len(ids), len(doc_ids), block, bits), known.tobytes(), null.tobytes(),
                     np.array(sizes, "<u8").tobytes(), offsets.tobytes(), stream, bytes(8)])


def read_segment(blob: bytes, table: np.ndarray, top: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, their lengths, all ids) of a segment."""
    magic, version, n, docs, block, bits = _HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id segment")
    at = _HEAD.size
    known = np.frombuffer(blob, "<i8", docs, at)
    null = np.frombuffer(blob, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(blob, "<u8", docs, at := at + docs).astype(np.int64)
    blocks = -(-n // block) if n else 0
    kind = np.dtype("<u4" if bits < 1 << 32 else "<u8")
    pos = np.frombuffer(blob, kind, blocks, at := at + 8 * docs).astype(np.int64)
    raw = np.frombuffer(blob, np.uint8, -1, at + kind.itemsize * blocks).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    ids = np.empty((block, blocks), np.uint32)
    last = len(window) - 1
    shift = 32 - top
    mask = (1 << top) - 1
    for k in range(min(block, n)):
        # the last block may be short: its lane runs on in the padding
        entry = table[(window[np.minimum(pos >> 3, last)] >> (shift - (pos & 7))) & mask]
        ids[k] = entry >> 5
        pos += entry & 31
    out = ids.T.reshape(-1)[:n]
    return [None if z else int(d) for d, z in zip(known, null)], sizes, out


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, two bytes an id if the vocabulary allows), and a hash of the ids as ``tie``.

    The last row of a task has no document but ``counts``, how often each id
    occurs in the task's documents (unsigned, eight bytes an id).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tie", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        enc = encoder(path, CACHE)
        kind = np.dtype("<u2" if enc.size <= 1 << 16 else "<u4")
        tail = int(end_id).to_bytes(4, "little")
        total = np.zeros(enc.size, np.int64)
        for b in batches:
            coded = [enc.encode(t.as_py() or "") + tail for t in b.column(1)]
            ids = np.frombuffer(b"".join(coded), "<u4").astype(kind)
            total += np.bincount(ids, minlength=enc.size)
            raw = ids.tobytes()
            ends = np.cumsum([len(c) // 4 * kind.itemsize for c in coded]).tolist()
            ids = [raw[a:z] for a, z in zip([0, *ends], ends)]
            tie = [xxhash.xxh64_intdigest(x) >> 1 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(tie, pa.int64()),
                                              pa.nulls(len(ids), pa.binary())], schema=schema)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                                              pa.array([total.tobytes()], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids binary, tie long, counts binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, from the tasks' counts."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for c in b.column(0):
                n = np.frombuffer(c.as_py(), np.int64)
                total = n.copy() if not len(total) else total + n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    return tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, end_id: int = 0, max_bits: int = MAX_BITS,
                segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Tokenise and write segments in ascending doc_id order; (segments, book).

    ``segments`` has one row per segment: part, first (ids of the part before
    it) and blob. ``book`` has the code length of each id.
    """
    tokens = token_table(docs, path, end_id)
    spark = docs.sparkSession
    ids = staged(tokens, "tokens")
    width = 2 if encoder(path).size <= 1 << 16 else 4
    rows = id_counts(ids).collect()  # at most the vocabulary
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    book = staged(spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int"), "book")
    shared = spark.sparkContext.broadcast(lengths)       # at most the vocabulary
    kind = "<u2" if width == 2 else "<u4"

    def run(batches):
        length = shared.value
        code = codes(length)
        part, first, doc_ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            sizes = [len(p) for p in parts]
            ids = np.concatenate(parts)
            blob = write_segment(doc_ids, sizes, ids, length, code)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([blob], pa.binary())], ["part", "first", "n", "blob"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(ids.as_py(), kind)
                if held and held + len(ids) > segment:
                    yield close()
                    first, doc_ids, parts, held = first + held, [], [], 0
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield close()

    n = max(1, min(100_000, input_bytes(ids) // (16 << 20) + 1))
    # a tie between repeated ids is broken by content, so equal ids need not share a task
    dealt = (ids.filter("counts IS NULL").select("doc_id", "ids", "tie").repartitionByRange(n, "doc_id", "tie")
             .sortWithinPartitions("doc_id", "tie").select("doc_id", "ids"))
    segments = staged(dealt.mapInArrow(run, "part int, first long, n long, blob binary"), "segments")
    released(ids)
    return segments, book


def read_files(segments: DataFrame, book: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    spark = segments.sparkSession
    rows = book.collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    # one number per part file: where it starts in the whole
    totals = segments.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, starts = 0, {}
    for r in totals:
        starts[r["part"]] = base
        base += r["n"]
    starts = spark.sparkContext.broadcast(starts)

    def run(batches):
        table, top = decode_table(shared.value)
        for b in batches:
            for part, first, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                doc_ids, sizes, ids = read_segment(blob.as_py(), table, top)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                start = ends - sizes
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(start.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + first + starts.value[part]),
                     pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "first", "blob").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 0, **kw) -> DataFrame:
    """Write the documents' ids and read them back: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and gives the end id alone. Null ids sort first;
    repeated ids keep all their rows, in the order of a hash of their ids. An
    empty table gives an empty result; other columns are not read.
    """
    return read_files(*write_files(docs, path, end_id, **kw))
