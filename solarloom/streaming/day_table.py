"""Keyed tables of days that streams upsert into (STR-06), and the learn cycle
as a consumer of their batches (STR-07, STR-08)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutations import upsert
from ..plans.lineage import folder

DAY_S = 86400


class DayTable:
    """Rows by key in folders ``day=D/batch=N``, one live folder a day.

    A batch merges its rows with those of the days it touches, writes each such
    day anew as its own version, and then leaves a mark. Versions count once
    their batch is marked, so a job that is killed at any moment leaves the
    table as it was, and the same batch run again writes the same folders. A
    marked batch is never applied again. Superseded versions are deleted after
    the mark, so there are as many folders as days, however many batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str, time: str = "ts_utc"):
        self.spark, self.path, self.keys, self.order, self.time = spark, path.rstrip("/"), keys, order, time
        self.schema = spark.createDataFrame([], schema).schema

    def _store(self, below: str = ""):
        return folder(self.spark, f"{self.path}{below}")

    def _names(self, below: str) -> list[str]:
        where, store = self._store(below)
        return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []

    def applied(self) -> int:
        """The last batch that counts, -1 before the first."""
        return max((int(n) for n in self._names("/_marks") if n.isdigit()), default=-1)

    def _versions(self, day: str) -> list[int]:
        return sorted(int(n[6:]) for n in self._names(f"/{day}") if n.startswith("batch="))

    def _live(self, days: list[str] | None = None) -> list[str]:
        """The folder that counts of each day (of the given ones)."""
        last, out = self.applied(), []
        for day in [n for n in self._names("") if n.startswith("day=")] if days is None else days:
            marked = [v for v in self._versions(day) if v <= last]
            if marked:
                out.append(f"{self.path}/{day}/batch={marked[-1]}")
        return out

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._live())

    def apply(self, batch: DataFrame, number: int, mark: bool = True) -> None:
        """Upsert a batch (SNK-01): the row of the highest ``order`` of a key
        wins. Only the folders of the days in the batch are read and written."""
        if number <= self.applied():
            return
        names = self.schema.names
        day = F.floor(F.col(self.time) / DAY_S).cast("long")
        batch = batch.select(*names)
        batch.persist()
        try:
            days = sorted(r[0] for r in batch.select(day.alias("d")).distinct().collect())
            have = self._rows(self._live([f"day={d}" for d in days]))
            merged = upsert(have, batch, self.keys, self.order).select(*names, day.alias("__day"))
            staged = f"{self.path}/_staged"
            merged.repartition(max(1, len(days)), "__day").write.mode("overwrite").partitionBy("__day").parquet(staged)
        finally:
            batch.unpersist()
        for d in days:
            new, store = self._store(f"/day={d}/batch={number}")
            store.delete(new, True)
            store.mkdirs(new.getParent())
            if not store.rename(self._store(f"/_staged/__day={d}")[0], new):
                raise OSError(f"could not publish day {d} of batch {number}")
        if mark:
            self.mark(number)

    def mark(self, number: int) -> None:
        """Let a batch count, then delete what it superseded."""
        where, store = self._store(f"/_marks/{number}")
        before = [int(n) for n in self._names("/_marks") if n.isdigit() and int(n) < number]
        store.create(where, True).close()
        for n in before:
            store.delete(self._store(f"/_marks/{n}")[0], False)
        for day in [n for n in self._names("") if n.startswith("day=")]:
            for old in [v for v in self._versions(day) if v <= number][:-1]:
                store.delete(self._store(f"/{day}/batch={old}")[0], True)


def feed(stream: DataFrame, table: DayTable, checkpoint: str, then: Callable[[int], None] | None = None):
    """Run the stream over what there is into ``table``; ``then(number)`` is
    called after each batch, once more after a restart if it was not done."""

    def write(batch: DataFrame, number: int) -> None:
        table.apply(batch, number)
        if then is not None:
            then(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Cursors:
    """The mark of each plant as a small table, a folder for each change of
    which the last complete one counts (SNK-12)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self) -> list[int]:
        where, store = folder(self.spark, self.path)
        names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit() and store.exists(folder(self.spark, f"{self.path}/{n}/_SUCCESS")[0]))

    def read(self) -> DataFrame:
        found = self._complete()
        if not found:
            return self.spark.createDataFrame([], "plant_id string, cursor long")
        return self.spark.read.schema("plant_id string, cursor long").parquet(f"{self.path}/{found[-1]}")

    def move(self, cursors: DataFrame) -> None:
        found = self._complete()
        number = found[-1] + 1 if found else 0
        cursors.select("plant_id", "cursor").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number}")
        for old in found[:-1]:
            where, store = folder(self.spark, f"{self.path}/{old}")
            store.delete(where, True)


def learner(tables: Callable[[], dict[str, DataFrame]], cursors: Cursors, publish: Callable[[dict[str, DataFrame], int], None], now: Callable[[], int], **how) -> Callable[[int], None]:
    """What ``feed`` calls after a batch to learn on: one cycle over the hours
    that closed since each plant's cursor, with its refit of the maps where a
    string has grown enough. The outputs are published before the cursor moves;
    keyed upserts make a repeated cycle harmless."""
    from ..plans.cycle import learn_cycle

    def then(number: int) -> None:
        out, moved = learn_cycle(tables(), now(), cursors.read(), **how)
        if out:
            publish(out, number)
            cursors.move(moved)

    return then
