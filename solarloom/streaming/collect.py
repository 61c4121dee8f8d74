"""Structured Streaming: five-minute windows and incremental folds (STR-*)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C


def windowed_means(samples: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Mean, last and count per entity and five minutes; rows later than the
    watermark are dropped (STR-01..03). ``samples``: entity_id, ts, value."""
    return samples.withWatermark("ts", lateness).groupBy(F.window("ts", "5 minutes"), "entity_id").agg(
        F.avg("value").alias("mean_value"), F.max_by("value", "ts").alias("last_value"), F.count("value").alias("n")).select("entity_id", F.unix_timestamp("window.start").alias("ts_utc"), "mean_value", "last_value", "n")


def paired_spans(samples: DataFrame) -> DataFrame:
    """Each sample with the one before it, carried across micro-batches in
    keyed state of one sample (STR-04): entity_id, t0, v0, t1, v1. A sample
    older than the carried one is not paired. ``ts_utc`` is in seconds."""

    def carry(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, v = state.get if state.exists else (None, None)
        frame = pd.concat(list(frames)).sort_values("ts_utc")
        out = []
        for t1, v1 in zip(frame["ts_utc"], frame["value"]):
            v1 = None if pd.isna(v1) else float(v1)
            if t is not None and t1 > t:
                out.append((key[0], t, v, t1, v1))
            if t is None or t1 > t:
                t, v = float(t1), v1
        state.update((t, v))
        yield pd.DataFrame(out, columns=["entity_id", "t0", "v0", "t1", "v1"])

    return samples.groupBy("entity_id").applyInPandasWithState(carry, "entity_id string, t0 double, v0 double, t1 double, v1 double", "t double, v double", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Idempotent sink (STR-06): each micro-batch writes a folder of its own
    with the row of highest ``order`` for each key, so a replay overwrites
    itself; readers take the newest batch per key."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
        last.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch_id")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def learn_window(cursor: int | None, now: int, max_hours: int = 48) -> tuple[int, int]:
    """Hours that the next learn cycle covers (STR-07)."""
    closed = now // C.HOUR_S * C.HOUR_S
    start = cursor if cursor is not None else closed - max_hours * C.HOUR_S
    return start, min(closed, start + max_hours * C.HOUR_S)


def due_intervals(done: int | None, now: float, kept_s: int = 600) -> list[int]:
    """Starts of the closed intervals to write at ``now``, after the one that is
    ``done``, as far back as samples are kept (STR-02). A mark that is not
    behind the interval just closed comes from a clock that was set back: then
    that interval alone is due (STR-05)."""
    step = C.INTERVAL_S
    closed = int(now - 1) // step * step - step
    if done is None or done >= closed:
        return [closed]
    return list(range(max(done, closed - kept_s) + step, closed + step, step))
