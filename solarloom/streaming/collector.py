"""The collector as a stateful stream (STR-01..04, SRC-02, AGG-01): samples to
integrated five-minute rows, whatever order they arrive in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as C

ROWS = "ts_utc long, energy_wh double, power_mean_w double, coverage double, sample_count long, peak_w double"
#: The state store that keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Least seconds of an entity's history that are one state.
BLOCK_S = 6 * 3600


def span_limit(watchdog_s: float) -> float:
    """Longest span between samples that is no gap."""
    return max(60.0, 2.5 * watchdog_s)


def repeated(t: np.ndarray, v: np.ndarray, every: float, since: float, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Samples with their values repeated ``every`` seconds until the next one,
    the last until ``until``; repeats before ``since`` are left out."""
    last = np.append(t[1:], max(until, t[-1])) if len(t) else t
    count = np.maximum(1, np.ceil((last - t) / every)).astype(np.int64)
    skip = np.clip(np.ceil((since - t) / every), 1, count).astype(np.int64) - 1
    many = count - skip
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    step = np.where(at > 0, at + np.repeat(skip, many), 0)
    return np.repeat(t, many) + step * every, np.repeat(v, many)


def windows(t: np.ndarray, v: np.ndarray, first: int, stop: int, gap: float, step: int = C.INTERVAL_S) -> pd.DataFrame:
    """Rows of the windows from ``first`` to before ``stop``: trapezoids
    between neighbouring values, cut at the windows' edges. ``v`` has NaN where
    a sample has no value."""
    n = max(0, (stop - first) // step)
    ws, span, top, count = np.zeros(n), np.zeros(n), np.full(n, -np.inf), np.zeros(n, np.int64)
    own = (t >= first) & (t < stop) & ~np.isnan(v)
    place = ((t[own] - first) // step).astype(np.int64)
    np.add.at(count, place, 1)
    np.maximum.at(top, place, v[own])
    t0, t1, v0, v1 = t[:-1], t[1:], v[:-1], v[1:]
    good = (t1 > t0) & (t1 - t0 <= gap) & ~np.isnan(v0) & ~np.isnan(v1) & (t1 > first) & (t0 < stop)
    t0, t1, v0, v1 = t0[good], t1[good], v0[good], v1[good]
    low = np.maximum((t0 - first) // step, 0).astype(np.int64)
    many = np.minimum((t1 - first) // step, n - 1).astype(np.int64) - low + 1
    w = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    t0, t1, v0, v1 = (np.repeat(x, many) for x in (t0, t1, v0, v1))
    a, b = np.maximum(t0, first + w * step), np.minimum(t1, first + (w + 1) * step)
    slope = (v1 - v0) / (t1 - t0)
    va, vb = v0 + slope * (a - t0), v0 + slope * (b - t0)
    some = b > a
    np.add.at(ws, w[some], ((va + vb) / 2 * (b - a))[some])
    np.add.at(span, w[some], (b - a)[some])
    np.maximum.at(top, w[some], np.maximum(va, vb)[some])
    held = span > 0
    out = pd.DataFrame({"ts_utc": first + np.arange(n) * step, "energy_wh": np.where(held, ws / 3600, np.nan), "power_mean_w": np.where(held, ws / np.where(held, span, 1), np.nan),
                        "coverage": np.minimum(1.0, span / step), "sample_count": count, "peak_w": np.where(held, top, np.nan)})
    out = out[held | (count > 0)]
    return out.astype({c: object for c in ("energy_wh", "power_mean_w", "peak_w")}).where(out.notna(), None)


def block_of(gap: float, step: int) -> int:
    """Seconds of a block: about six hours, whole windows, over two spans."""
    return step * max(1, math.ceil(max(BLOCK_S, 2 * gap + 1) / step))


class Collector(StatefulProcessor):
    """State of an entity's block: the samples that an open window may still
    need, one carry-in among them, and the end of the last window that was
    closed. A window is closed once the watermark says that no sample can come
    any more that is within a span of its end. Rows only leave in event-time
    order, so a closed window is never emitted again; with its last window a
    block goes. ``block`` None: an entity has one state without end."""

    def __init__(self, watchdog_s: float, repeat: bool, step: int, block: int | None = None):
        self.gap, self.repeat, self.watchdog_s, self.step, self.block = span_limit(watchdog_s), repeat, watchdog_s, step, block

    def init(self, handle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "t double, v double")
        self.closed = handle.getValueState("closed", "end long, timer long")

    def _bounds(self, key) -> tuple[float, float]:
        """The windows of a key begin at the first and before the second."""
        return (-math.inf, math.inf) if self.block is None else (key[1] * self.block, (key[1] + 1) * self.block)

    def _mark(self) -> tuple[int | None, int | None]:
        found = self.closed.get() if self.closed.exists() else (None, None)
        return found[0], found[1]

    def _wake(self, end: int | None, first: int, timer: int | None) -> None:
        """One timer: for the first window that is still open."""
        due = math.ceil((first + self.step + self.gap) * 1000)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.closed.update((end, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end, timer = self._mark()
        earliest = None
        for frame in rows:
            t, v = frame["ts_utc"].to_numpy(float), frame["value"].to_numpy(float)
            if end is not None:
                t, v = t[t >= end], v[t >= end]
            if len(t):
                self.samples.appendList([(float(x), None if math.isnan(y) else float(y)) for x, y in zip(t, v)])
                earliest = t.min() if earliest is None else min(earliest, t.min())
        if earliest is not None:
            first = int(earliest // self.step * self.step)
            if timer is not None:
                first = min(first, round(timer / 1000 - self.gap) - self.step)
            low, high = self._bounds(key)
            first = min(max(first, low), high - self.step)
            self._wake(end, first if end is None else max(first, end), timer)
        yield pd.DataFrame(columns=["entity_id", *self._columns()])

    @staticmethod
    def _columns() -> list[str]:
        return [c.split()[0] for c in ROWS.split(", ")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, timer = self._mark()
        now = timerValues.getCurrentWatermarkInMs() / 1000
        held = list(self.samples.get())
        t = np.array([x[0] for x in held], float)
        v = np.array([np.nan if x[1] is None else x[1] for x in held], float)
        by = np.lexsort((v, t))
        t, v = t[by], v[by]
        low, high = self._bounds(key)
        first = min(max(int(t[0] // self.step * self.step), low), high - self.step) if end is None else end
        stop = max(first, min(int((now - self.gap) // self.step * self.step), high))
        lasting = self.repeat and len(v) and not math.isnan(v[-1])
        dense = repeated(t, v, self.watchdog_s, first - self.watchdog_s, now if lasting else t[-1]) if self.repeat else (t, v)
        out = windows(*dense, first, stop, self.gap, self.step)
        out = out.assign(entity_id=key[0])[["entity_id", *self._columns()]]
        if stop >= high:
            self.samples.clear()
            self.closed.clear()
            yield out
            return
        keep = max(0, int(np.searchsorted(t, stop)) - 1)
        t, v = t[keep:], v[keep:]
        self.samples.put([(float(x), None if math.isnan(y) else float(y)) for x, y in zip(t, v)])
        # More to close: a repeated value goes on, a sample at or past the end
        # has its own window, an earlier one spans at most to its limit.
        more = lasting or (len(t) and (t[-1] >= stop or t[-1] + self.gap > stop))
        if more:
            self._wake(stop, stop, None)
        elif self.block is not None:
            self._wake(stop, high - self.step, None)
        else:
            self.closed.update((stop, None))
        yield out


def collect(samples: DataFrame, watchdog_s: float = C.WATCHDOG_S, repeat: bool = False, lateness: str = "10 minutes", step: int = C.INTERVAL_S) -> DataFrame:
    """A stream of ``samples`` (entity_id, ts, value) as the rows that
    ``integrate`` gives of the same samples (AGG-01): late ones within
    ``lateness`` go in by time, later ones are dropped. With ``repeat`` each
    value counts again every ``watchdog_s`` until the next sample (SRC-02),
    also when none comes, as long as the watermark moves on. Needs the RocksDB
    state store (``STORE``), which keeps the state in the checkpoint folder.

    State and timers are of an entity and a block of about six hours, so a long
    history that is read at once never lies in one task; a sample within a span
    of a block's edge is dealt to both sides. Only ``repeat`` keeps an entity
    in one state, since a value may go on for any time."""
    gap, block = span_limit(watchdog_s), None if repeat else block_of(span_limit(watchdog_s), step)
    keyed = samples.withWatermark("ts", lateness).select("entity_id", "ts", (F.unix_micros("ts") / 1e6).alias("ts_utc"), "value")
    at = [F.lit(0).cast("long")] if repeat else [F.floor((F.col("ts_utc") + far) / block).cast("long") for far in (-gap, 0.0, gap)]
    keyed = keyed.withColumn("block", F.explode(F.array_distinct(F.array(*at))))
    return keyed.groupBy("entity_id", "block").transformWithStateInPandas(
        statefulProcessor=Collector(watchdog_s, repeat, step, block), outputStructType=f"entity_id string, {ROWS}", outputMode="append", timeMode="EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what there is and give its rows so far, written as
    Parquet in ``path``; a later call with the same folders goes on."""
    spark: SparkSession = stream.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(stream.schema).parquet(path)
