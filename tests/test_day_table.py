"""Upserting streams: replays, kills, bounded folders, and learning on them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from solarloom.streaming.day_table import Cursors, DayTable, feed, learner
from test_cycle_plants import START, told, two_plants

SCHEMA = "string_id string, ts_utc long, seq long, v double"


def folders(path):
    return sorted(f"{d}/{b}" for d in os.listdir(path) if d.startswith("day=") for b in os.listdir(f"{path}/{d}") if b.startswith("batch="))


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_batches_replays_and_kills(spark, tmp_path):
    rnd, want = random.Random(4), {}
    table = DayTable(spark, str(tmp_path / "t"), SCHEMA, ["string_id", "ts_utc"], "seq")
    assert table.read().count() == 0 and table.applied() == -1
    for number in range(12):
        rows = [(rnd.choice("ab"), rnd.randrange(4) * 86400 + rnd.randrange(3) * 300, number * 100 + i, rnd.random()) for i in range(8)]
        batch = spark.createDataFrame(rows, SCHEMA)
        if number % 4 == 1:  # killed after its folders, before its mark
            before = content(table)
            table.apply(batch, number, mark=False)
            assert content(table) == before
        table.apply(batch, number)
        for r in rows:
            want[r[:2]] = max(want.get(r[:2], r), r, key=lambda x: x[2])
        assert content(table) == sorted(want.values())
        if number % 3 == 0:  # a replay of a batch that counts
            table.apply(spark.createDataFrame([("a", 0, 10**9, -1.0)], SCHEMA), number)
            assert content(table) == sorted(want.values())
    assert len(folders(tmp_path / "t")) == len({k[1] // 86400 for k in want}) and len([n for n in os.listdir(tmp_path / "t/_marks") if n.isdigit()]) == 1


def test_other_days_are_not_touched(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), SCHEMA, ["string_id", "ts_utc"], "seq")
    table.apply(spark.createDataFrame([("a", 10, 1, 1.0), ("a", 86410, 1, 1.0)], SCHEMA), 0)
    table.apply(spark.createDataFrame([("a", 86410, 2, 2.0)], SCHEMA), 1)
    assert folders(tmp_path / "t") == ["day=0/batch=0", "day=1/batch=1"]
    assert content(table) == [("a", 10, 1, 1.0), ("a", 86410, 2, 2.0)]


def test_a_stream_that_fails_goes_on(spark, tmp_path):
    source, done = str(tmp_path / "in"), []
    table = DayTable(spark, str(tmp_path / "t"), SCHEMA, ["string_id", "ts_utc"], "seq")
    for i in range(6):
        spark.createDataFrame([("a", 300 * (i % 3), i, float(i))], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    def fails(number):
        if number == 3 and 3 not in done:
            done.append(3)
            raise RuntimeError("killed")
        done.append(number)

    with pytest.raises(Exception, match="killed"):
        feed(stream(), table, str(tmp_path / "c"), fails)
    feed(stream(), table, str(tmp_path / "c"), fails)
    assert content(table) == [("a", 0, 3, 3.0), ("a", 300, 4, 4.0), ("a", 600, 5, 5.0)]
    assert sorted(set(done)) == [0, 1, 2, 3, 4, 5] and len(folders(tmp_path / "t")) == 1


def test_learning_on_a_stream(spark, tmp_path):
    """Rows arrive in two runs; after each batch a cycle learns the hours that
    closed. In the end effects and cursors are those of the same two cycles
    by hand."""
    from solarloom.plans.cycle import learn_cycle

    tables = two_plants(spark)
    for gone in ("state", "issues", "measured"):
        tables.pop(gone)
    five = tables["fivemin"].withColumn("seq", F.lit(1).cast("long")).cache()
    schema = ", ".join(f"{c} {t}" for c, t in five.dtypes)
    live = DayTable(spark, str(tmp_path / "fivemin"), schema, ["ts_utc", "string_id"], "seq")
    cursors = Cursors(spark, str(tmp_path / "cursors"))
    begin = spark.createDataFrame([("p", START), ("q", START)], "plant_id string, cursor long")
    cursors.move(begin)
    kept, clock = {"effects": tables["effects"], "shading": tables["shading"]}, [0]

    def publish(out, number):
        for name in kept:
            path = str(tmp_path / f"{name}-{number}-{clock[0]}")
            out[name].write.mode("overwrite").parquet(path)
            kept[name] = spark.read.parquet(path)

    then = learner(lambda: {**tables, **kept, "fivemin": live.read().drop("seq")}, cursors, publish, lambda: clock[0])
    hand, marks = dict(kept), begin
    for hour in (14, 28):
        clock[0] = START + 3600 * hour + 5
        rows = five.filter((F.col("ts_utc") >= START + 3600 * (0 if hour == 14 else 14)) & (F.col("ts_utc") < START + 3600 * hour))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), live, str(tmp_path / "check"), then)
        out, marks = learn_cycle({**tables, **hand}, clock[0], marks)
        hand = {name: out[name] for name in hand}
    assert {r.plant_id: r.cursor for r in cursors.read().collect()} == {r.plant_id: r.cursor for r in marks.collect()} == {p: START + 3600 * 28 for p in "pq"}
    got, want = told(kept), told(hand)
    for name in kept:
        assert len(got[name]) == len(want[name]) > 3
        for a, b in zip(got[name], want[name]):
            assert all(x == y or x == pytest.approx(y, abs=1e-6) for x, y in zip(a, b)), name
    assert len([n for n in os.listdir(tmp_path / "cursors") if n.isdigit()]) <= 2
