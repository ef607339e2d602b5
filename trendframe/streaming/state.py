"""Keyed state operators (T5, T7, T8) - streaming form and batch twin.

Streaming forms use Structured Streaming's own state: ``dropDuplicates`` for
first-seen, and ``transformWithState`` (RocksDB) for the bounded history and
the cooldown, through :mod:`trendframe.streaming.ordered`: typed state, event
time timers, rows in time order whatever order they arrive in. Batch twins
give the same rows for a whole table and are what the SQL oracle checks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import top_per_key
from .ordered import in_order


# ----------------------------------------------------------------------- T7

def first_seen(df: DataFrame, key: str, ts: str, delay: str | None = None) -> DataFrame:
    """Emit a key the first time it appears, and never again.

    Streaming: the set of keys is kept for good; with ``delay`` a key is
    forgotten once the watermark has passed it by that much, and may then be
    emitted again. Batch: the earliest row per key.
    """
    if df.isStreaming:
        return df.dropDuplicates([key]) if delay is None else df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return top_per_key(df, [key], [F.col(ts)], 1)


# ----------------------------------------------------------------------- T8

def passes(times: np.ndarray, gap: int) -> np.ndarray:
    """Indices that pass a cooldown of ``gap`` in sorted times; the first one passes."""
    out, k = [], 0
    while k < len(times):
        out.append(k)
        k = int(np.searchsorted(times, times[k] + gap, "left"))
    return np.array(out, np.int64)


def cooldown(df: DataFrame, key: str, ts: str, seconds: int = 600,
             tie: str | None = None) -> DataFrame:
    """T8 batch twin: pass a key's row when at least ``seconds`` have passed
    since the key's last *passed* row (the clock restarts only on a pass).

    After a gap of ``seconds`` the next row passes whatever came before, so a
    key's rows are cut there and its stretches are dealt out separately. Each
    is scanned in order with one timestamp of state, from pass to pass. Rows
    without a time are left out.
    """
    gap = seconds * 1_000_000
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = df.filter(F.col(ts).isNotNull()).withColumn("__t", micros)
    cut = cut.withColumn("__new", (F.coalesce(F.col("__t") - F.lag("__t").over(w), F.lit(gap)) >= gap).cast("int"))
    cut = cut.withColumn("__part", F.sum("__new").over(w))
    dealt = cut.repartition(F.col(key), F.col("__part")).sortWithinPartitions(key, "__part", *order)

    def run(batches):
        stretch, last = object(), None
        for b in batches:
            t = b.column(b.schema.get_field_index("__t")).to_numpy()
            keys = list(zip(b.column(b.schema.get_field_index(key)).to_pylist(),
                            b.column(b.schema.get_field_index("__part")).to_pylist()))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
            kept = []
            for a, z in zip(starts, starts[1:]):
                if keys[a] != stretch:
                    stretch, last = keys[a], None
                first = a if last is None else a + int(np.searchsorted(t[a:z], last + gap, "left"))
                found = first + passes(t[first:z], gap)
                if len(found):
                    last = t[found[-1]]
                    kept.append(found)
            rows = b.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            yield rows.select(names)

    names = df.columns
    return dealt.mapInArrow(run, df.schema)


class _CooldownStep:
    """Carries the last pass time of a key, in microseconds."""

    def __init__(self, names: Sequence[str], seconds: int):
        self.names, self.gap = list(names), seconds * 1_000_000

    def __call__(self, carried, rows):
        last = carried[0] if carried else None
        out = []
        for r in rows:
            if last is None or r["__us"] >= last + self.gap:
                last = r["__us"]
                out.append(Row(**{c: r[c] for c in self.names}))
        return (last,), out, (last + self.gap) // 1000 + 1


def cooldown_stream(df: DataFrame, key: str, ts: str, seconds: int = 600, delay: str = "1 hour",
                    tie: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """T8 streaming: the same rule with the last pass time held as keyed state.

    A key's rows are judged in time order once the watermark has passed them
    (:mod:`trendframe.streaming.ordered`), so the result is the batch twin's
    over the rows passed, however the stream is cut. Rows later than ``delay``
    are dropped; a key's last pass is forgotten when its cooldown is over.
    ``initial`` (``key, last``) has passes from before the stream.
    """
    if initial is not None:
        us = F.unix_micros(F.col("last").cast("timestamp"))
        initial = initial.select(key, us.alias("last"), F.floor((us + seconds * 1_000_000) / 1000 + 1).cast("long").alias("until_ms"))
    return in_order(df, key, [ts] + ([tie] if tie else []), delay, df.schema, T.StructType([T.StructField("last", T.LongType())]),
                    _CooldownStep(df.columns, seconds), initial)


# ----------------------------------------------------------------------- T5

class _HistoryStep:
    """Carries the last ``n`` values of each column."""

    def __init__(self, names, cols, n: int, keep_days: int):
        self.names, self.cols, self.n, self.keep_ms = list(names), list(cols), n, keep_days * 86_400_000

    def __call__(self, carried, rows):
        seen = [list(x) for x in carried] if carried else [[] for _ in self.cols]
        out = []
        for r in rows:
            out.append(Row(**{c: r[c] for c in self.names}, **{f"prior_{c}": list(h) for c, h in zip(self.cols, seen)}))
            seen = [(h + [None if r[c] is None else float(r[c])])[-self.n:] for c, h in zip(self.cols, seen)]
        return tuple(seen), out, rows[-1]["__us"] // 1000 + self.keep_ms


def history_stream(df: DataFrame, key: str, ts: str, cols: Sequence[str], n: int = 5,
                   keep_days: int = 30, delay: str = "1 hour", tie: str | None = None) -> DataFrame:
    """T5 streaming: per key, the previous ``n`` rows' values (oldest first)
    attached to each new row, from keyed state bounded to ``n`` entries.

    Output adds ``prior_<col>`` arrays; the batch twin is a window frame
    ``rowsBetween(-n, -1)`` (see :mod:`trendframe.operators.windows`). A key's
    rows are taken in time order once the watermark has passed them
    (:mod:`trendframe.streaming.ordered`). Rows later than ``delay`` are
    dropped; the history of a key that has been quiet for ``keep_days`` is
    forgotten.
    """
    arrays = T.ArrayType(T.DoubleType())
    out = T.StructType(list(df.schema.fields) + [T.StructField(f"prior_{c}", arrays) for c in cols])
    carried = T.StructType([T.StructField(f"h_{c}", arrays) for c in cols])
    return in_order(df, key, [ts] + ([tie] if tie else []), delay, out, carried, _HistoryStep(df.columns, cols, n, keep_days))
