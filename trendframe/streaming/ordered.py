"""Keyed processors that see a key's rows in time order, whatever order they arrive in.

Rows are held in state, by slots of time, until the watermark has passed their
slot; an event-time timer then hands the slots on one after the other. So a
key's rows are in memory one slot, or one chunk of arriving rows, at a time,
also for a key with most of the rows, and the result does not depend on how a
stream is cut into micro-batches. Rows of the last ``delay`` wait in state.

State is typed and kept apart by purpose: a map of pending slots, the value
that a step carries from slot to slot, and the time of the one timer set. The
carried value is forgotten once the watermark passes a time that the step
names. It can start from a batch table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..session import DEFAULTS
from ..shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Arriving rows of a key that are held before they are put into state.
CHUNK = 5000
#: Width of a slot in milliseconds.
SLOT_MS = 60_000


class InOrder(StatefulProcessor):
    """Runs ``step(carried, rows) -> (carried, out_rows, until_ms)`` slot by slot, rows sorted by ``order``.

    ``carried`` is a tuple of ``carried_schema`` or None; it is forgotten when
    the watermark passes ``until_ms``. ``order[0]`` is the event time.
    """

    def __init__(self, order, row_schema: T.StructType, carried_schema: T.StructType, step):
        self.order, self.row_schema, self.carried_schema, self.step = list(order), row_schema, carried_schema, step

    def init(self, handle) -> None:
        self.handle = handle
        # microseconds beside the row: timestamps in state are not needed for the order
        rows = T.ArrayType(T.StructType([T.StructField("us", T.LongType()), *self.row_schema.fields]))
        self.pending = handle.getMapState("pending", "slot long", T.StructType([T.StructField("rows", rows)]))
        self.carried = handle.getValueState("carried", self.carried_schema)
        self.due = handle.getValueState("due", "carried_until long, timer long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState
        self.carried.update(tuple(row[f] for f in self.carried_schema.fieldNames()))
        self._wake(row["until_ms"])
        self.due.update((row["until_ms"], row["until_ms"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, n, first = {}, 0, None
        for r in rows:
            slot = r["__us"] // (SLOT_MS * 1000)
            held.setdefault(slot, []).append((r["__us"], *(r[f] for f in self.row_schema.fieldNames())))
            n += 1
            if n >= CHUNK:
                first = self._hold(held, first)
                held, n = {}, 0
        first = self._hold(held, first)
        until, timer = self.due.get() if self.due.exists() else (None, None)
        at = (first + 1) * SLOT_MS
        if timer is None or at < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self._wake(at)
            self.due.update((until, at))
        return iter(())

    def _hold(self, held, first):
        for slot, rows in held.items():
            if self.pending.containsKey((slot,)):
                rows = [tuple(r) for r in self.pending.getValue((slot,))[0]] + rows
            self.pending.updateValue((slot,), (rows,))
            first = slot if first is None else min(first, slot)
        return first

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        slots = sorted(k[0] for k in self.pending.keys()) if self.pending.exists() else []
        ready = [s for s in slots if (s + 1) * SLOT_MS <= now]
        carried = self.carried.get() if self.carried.exists() else None
        until = self.due.get()[0] if self.due.exists() else None
        names = self.row_schema.fieldNames()
        for slot in ready:
            rows = [Row(__us=r[0], **dict(zip(names, r[1:]))) for r in (tuple(x) for x in self.pending.getValue((slot,))[0])]
            rows.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in ["__us", *self.order[1:]]))
            carried, out, until = self.step(carried, rows)
            yield from out
            self.pending.removeKey((slot,))
        if ready and carried is not None:
            self.carried.update(tuple(carried))
        if until is not None and until <= now:
            self.carried.clear()
            until = None
        rest = slots[len(ready):]
        at = min(x for x in [(rest[0] + 1) * SLOT_MS if rest else None, until] if x is not None) if rest or until is not None else None
        if at is None:
            self.due.clear()
        else:
            at = max(at, now + 1)
            self._wake(at)
            self.due.update((until, at))


def in_order(df: DataFrame, key: str, order, delay: str, out_schema: T.StructType, carried_schema: T.StructType, step,
             initial: DataFrame | None = None) -> DataFrame:
    """``step`` over each key's rows in the order of ``order`` (its first column is the event time).

    Rows without a time are left out; rows later than ``delay`` are dropped by
    the watermark. ``initial`` has the key, the carried fields and
    ``until_ms``, one row a key.
    """
    spark = df.sparkSession
    ship(spark)
    # typed state needs RocksDB; a running stream keeps the provider its checkpoint names
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, DEFAULTS[PROVIDER])
    ts = order[0]
    names = df.columns
    timed = df.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    processor = InOrder(order, T.StructType([df.schema[c] for c in names]), carried_schema, step)
    start = initial.groupBy(key) if initial is not None else None
    return timed.groupBy(key).transformWithState(processor, out_schema, "append", "eventTime", initialState=start)
