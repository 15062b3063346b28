"""Sliding velocity counts per customer, kept in a stream's state.

A customer's last day and a half of transactions lies in slices of five minutes, each
under its own key of the state. A batch reads and writes the slices that its
rows, and the ends of their ranges, fall into, and a short list of how many
each slice holds: what it costs follows the batch, not the customer's day.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from payguard.functions.velocity import DAY, HOUR

_MICROS = 1_000_000
#: Seconds by which a row may be late and still count exactly, and for which times are kept beyond a day.
LATENESS = 12 * HOUR
#: How long an idle customer's state is kept, with a margin of 100 s.
IDLE_MS = (DAY + LATENESS + 100) * 1000
#: Microseconds of a slice.
SLICE = 300 * _MICROS
_BINARY = T.BinaryType()
SLICE_KEY = T.StructType([T.StructField("slice", T.LongType())])
#: Times and transaction ids of a slice, by (time, id); slices that there are and their sizes, ascending, and the latest time. 64-bit integers.
SLICE_ROWS = T.StructType([T.StructField("times", _BINARY), T.StructField("ids", _BINARY)])
SIZES = T.StructType([T.StructField("slices", _BINARY), T.StructField("counts", _BINARY), T.StructField("last", T.LongType())])


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(bytes(data), np.int64)


class Day:
    """A customer's stored transactions during one batch; slices are read when they are needed, and written back if they have changed."""

    def __init__(self, slices, sizes) -> None:
        self.slices, self.sizes = slices, sizes
        found = sizes.get() if sizes.exists() else None
        self.known, self.counts = (_unpacked(found[0]).copy(), _unpacked(found[1]).copy()) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.last = int(found[2]) if found else None
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Times and ids of a slice."""
        if number not in self.held:
            there = number in self.known
            found = self.slices.getValue((number,)) if there else None
            self.held[number] = (_unpacked(found[0]), _unpacked(found[1])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return self.held[number]

    def until(self, us: np.ndarray) -> np.ndarray:
        """How many stored transactions are not later than each of the instants."""
        number = us // SLICE
        before = np.concatenate([[0], np.cumsum(self.counts)])[np.searchsorted(self.known, number)]
        out = before.astype(np.int64)
        for n in np.unique(number).tolist():
            here = number == n
            out[here] += np.searchsorted(self.rows(n)[0], us[here], side="right")
        return out

    def has(self, us: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the transactions are stored."""
        number, out = us // SLICE, np.zeros(len(us), np.bool_)
        for n in np.unique(number).tolist():
            here = number == n
            times, known = self.rows(n)
            pairs = set(zip(times.tolist(), known.tolist(), strict=True))
            out[here] = [x in pairs for x in zip(us[here].tolist(), ids[here].tolist(), strict=True)]
        return out

    def add(self, us: np.ndarray, ids: np.ndarray) -> None:
        """Store transactions, and forget slices that no range of a row that is late by LATENESS at most reaches."""
        if not len(us):
            return
        self.last = max(int(us.max()), self.last if self.last is not None else int(us.max()))
        number, sizes = us // SLICE, dict(zip(self.known.tolist(), self.counts.tolist(), strict=True))
        first = (self.last - (DAY + LATENESS) * _MICROS) // SLICE
        for n in np.unique(number).tolist():
            if n < first:
                continue
            here = number == n
            times, known = (np.concatenate([a, b]) for a, b in zip(self.rows(n), (us[here], ids[here]), strict=True))
            order = np.lexsort((known, times))
            self.held[n] = (times[order], known[order])
            self.slices.updateValue((n,), (times[order].tobytes(), known[order].tobytes()))
            sizes[n] = len(times)
        for n in [n for n in sizes if n < first]:
            self.slices.removeKey((n,))
            del sizes[n]
        kept = sorted(sizes)
        self.sizes.update((np.array(kept, np.int64).tobytes(), np.array([sizes[n] for n in kept], np.int64).tobytes(), self.last))


class VelocityProcessor(StatefulProcessor):
    """Adds velocity_1h, velocity_24h (the row included, by event time) and late to each row.

    Rows of a batch count in order of (time, txn_id), whatever pieces they
    arrive in, and leave in those pieces. A row older than the latest one of
    the batches before is counted among those before it and marked late; if it
    is late by more than LATENESS, its day's count may be too low. A
    transaction that comes again with the same time within the day is left
    out, in the same batch or a later one. An initial state, a day of history,
    stands in for what came before the stream.
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slices = handle.getMapState("slices", SLICE_KEY, SLICE_ROWS, ttlDurationMs=IDLE_MS)
        self.sizes = handle.getValueState("sizes", SIZES, ttlDurationMs=IDLE_MS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        us, ids = initialState["ts"].to_numpy(np.int64), initialState["txn_id"].to_numpy(np.int64)
        Day(self.slices, self.sizes).add(us, ids)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = list(rows)
        us, ids = (np.concatenate([p[c].to_numpy(np.int64) for p in pieces]) for c in ("us", "txn_id"))
        day = Day(self.slices, self.sizes)
        fresh = ~day.has(us, ids)
        order = np.lexsort((ids, us))
        again = np.zeros(len(us), np.bool_)
        again[order[1:]] = (us[order[1:]] == us[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
        fresh &= ~again
        new = np.sort(us[fresh])

        def counted(seconds: int) -> np.ndarray:
            start = us - seconds * _MICROS
            return day.until(us) - day.until(start) + np.searchsorted(new, us, side="right") - np.searchsorted(new, start, side="right")

        hour, whole = counted(HOUR), counted(DAY)
        late = us < day.last if day.last is not None else np.zeros(len(us), np.bool_)
        day.add(us[fresh], ids[fresh])
        at = 0
        for piece in pieces:
            here = slice(at, at + len(piece))
            out = piece.assign(velocity_1h=hour[here], velocity_24h=whole[here], late=late[here])[fresh[here]]
            at += len(piece)
            yield out[[*self.columns, "velocity_1h", "velocity_24h", "late"]]

    def close(self) -> None:
        pass


def with_velocity(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Streaming rows (customer_id, txn_id, created_at, ...) with their velocity. history: earlier rows that no batch of the stream has.

    Start the query inside state_settings().
    """
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("velocity_1h", T.LongType()), T.StructField("velocity_24h", T.LongType()), T.StructField("late", T.BooleanType())])
    keyed = rows.withColumn("us", F.unix_micros("created_at")).groupBy("customer_id")
    initial = initial_velocity_state(history) if history is not None else None
    return keyed.transformWithStateInPandas(VelocityProcessor(columns), schema, "append", "processingTime", initialState=initial)


def initial_velocity_state(history: DataFrame, as_of=None):
    """The day of earlier transactions before as_of (by default the latest one's time) by customer, as a stream's initial state. Without a txn_id none is known again."""
    ids = F.col("txn_id") if "txn_id" in history.columns else F.lit(-1)
    rows = history.filter("customer_id IS NOT NULL").select("customer_id", F.unix_micros("created_at").alias("ts"), ids.cast("bigint").alias("txn_id"))
    last = F.unix_micros(F.lit(as_of)) if as_of is not None else F.lit(rows.agg(F.max("ts")).first()[0])
    return rows.filter(F.col("ts") > last - F.lit(DAY * _MICROS)).groupBy("customer_id")


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Start stateful queries inside: RocksDB keeps large states outside the JVM's heap, and a
    query without new data runs no batch, which state with a lifetime would else ask for forever."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
