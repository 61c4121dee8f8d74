"""Core operators against plain Python and known values."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from solarloom.functions import physics as P
from solarloom.functions import predicates as R
from solarloom.operators import forecast as W
from solarloom.operators.aggregate import integrate, score_populations
from solarloom.operators.learning import ALPHA, running_effect
from solarloom.operators.publish import health_runs
from solarloom.sources.readers import curve_text, parse_curve
from solarloom.sources.scans import archive_chunks
from solarloom.streaming.collect import paired_spans, read_batches, upsert_batches, windowed_means


def test_sun_of_known_days(spark):
    """Hamburg: almanac times of both solstices, to four minutes."""
    rows = [(1718928000, 53.55, 10.0), (1734739200, 53.55, 10.0), (1718928000, 75.0, 10.0)]  # 2024-06-21, 2024-12-21
    got = P.run(spark.createDataFrame(rows, "day long, lat double, lon double"), P.DAYLIGHT).collect()
    hours = [[(x - r.day) / 3600 if x is not None else None for x in (r.sunrise_ts, r.noon_ts, r.sunset_ts)] for r in got]
    assert hours[0] == pytest.approx([2.84, 11.37, 19.89], abs=0.07) and hours[1] == pytest.approx([7.60, 11.31, 15.03], abs=0.07)
    assert hours[2][0] is None and hours[2][2] is None


def test_long_histories_are_folded_in_blocks(spark):
    rnd = random.Random(1)
    rows = [(t, "a" if t % 3 else "b", rnd.uniform(-1, 1), rnd.random()) for t in range(900)]
    df = spark.createDataFrame(rows, "ts long, k string, x double, w double")
    got = {r.ts: (r.ema, r.n_eff) for r in running_effect(df, ["k"], "x", "w", ["ts"], block_rows=70).collect()}
    state = {}
    for t, k, x, w in rows:
        v, n = state.get(k, (0.0, 0.0))
        a = min(1.0, ALPHA * w)
        state[k] = ((1 - a) * v + a * x, (1 - ALPHA) * n + w)
        assert got[t] == pytest.approx(state[k], abs=1e-12)


def test_spans_cross_midnight(spark):
    rows = [("e", 86400.0 * d + s, 600.0) for d in range(2) for s in range(0, 86400, 300)]
    got = integrate(spark.createDataFrame(rows, "entity_id string, ts_utc double, value double"), 300).agg(F.sum("energy_wh"), F.min("coverage")).first()
    assert got[0] == pytest.approx(600 * (2 * 86400 - 300) / 3600) and got[1] == 0.0


def test_runs_are_carried_over_days(spark):
    rnd = random.Random(2)
    rows = [(f"s{s}", d * 86400 + t * 20000, rnd.random() < 0.8) for s in range(2) for d in range(40) for t in range(4)]
    got = {(r.string_id, r.ts_utc): (r.run, r.report) for r in health_runs(spark.createDataFrame(rows, "string_id string, ts_utc long, bad boolean"), ["string_id"]).collect()}
    run = {}
    for s, t, bad in rows:
        run[s] = run.get(s, 0) + 1 if bad else 0
        assert got[s, t] == (run[s], bad and run[s] == 5)


def test_score_needs_three_days(spark):
    rows = [(d, 1.0, 2.0, d == 0) for d in range(3)]
    got = {r.population: r for r in score_populations(spark.createDataFrame(rows, "day int, predicted double, actual double, censored boolean"), 2.0).collect()}
    assert got["all"].wmape == 0.5 and got["all"].nmae == 0.5 and (got["uncensored"].wmape, got["uncensored"].days) == (None, 2)


def test_missing_hours_are_straight_lines(spark):
    """Steps within hours; over two missing ones a line by intervals."""
    plants = spark.createDataFrame([("p", 53.5, 10.0, 5.0, 3.5)], "plant_id string, lat double, lon double, altitude double, turbidity double")
    rows = [("p", 3600, 100.0, 10.0), ("p", 14400, 100.0, 40.0)]
    newest = spark.createDataFrame(rows, "plant_id string, ts_utc long, ghi_wm2 double, temp_c double").select("*", *[F.lit(None).cast("double").alias(c) for c in ("dni_wm2", "dhi_wm2", "wind_ms", "clouds_pct", "rain_mm")])
    got = {r.ts_utc: r for r in W.downscale(W.hourly_weather(W.hour_grid(plants, 0, 18000), newest)).collect()}
    assert [got[t].temp_c for t in (0, 3300, 3600, 6900, 14400, 17700)] == [10.0, 10.0, 10.0, 10.0, 40.0, 40.0]
    assert got[7200].temp_c == pytest.approx(10 + 30 / 25) and got[14100].temp_c == pytest.approx(40 - 30 / 25)
    assert {r.wind_ms for r in got.values()} == {1.0} and not got[0].covered and got[3600].covered


def test_fingerprint_and_curve_text(spark):
    r = spark.range(1).select(R.fingerprint(F.lit("sensor.a")).alias("a"), curve_text(parse_curve(F.lit("5:0.90, 10:0.935"))).alias("c")).first()
    assert r.a == zlib.crc32(b"sensor.a") and r.c == "5:0.9, 10:0.935"
    assert archive_chunks(0, 250 * 86400) == [(0, 120 * 86400), (120 * 86400, 240 * 86400), (240 * 86400, 250 * 86400)]


def test_streams(spark, tmp_path):
    """One file a micro-batch: rows of a window that is long closed are
    dropped, pairs carry over, the last row of a key wins."""
    for i, rows in enumerate(([("e", 0, 1.0), ("e", 100, 3.0)], [("e", 4000, 5.0)], [("e", 4100, 6.0)], [("e", 50, 9.0), ("e", 8000, 7.0)])):
        spark.createDataFrame(rows, "entity_id string, s long, value double").select("entity_id", F.timestamp_seconds("s").alias("ts"), F.col("s").cast("double").alias("ts_utc"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema

    def feed():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    for name, df in (("means", windowed_means(feed().select("entity_id", "ts", "value"))), ("pairs", paired_spans(feed().select("entity_id", "ts_utc", "value")))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    means = {r.ts_utc: (r.mean_value, r.n) for r in spark.table("means").collect()}
    assert means[0] == (2.0, 2) and means[3900] == (5.5, 2)
    assert {(r.t0, r.t1) for r in spark.table("pairs").collect()} == {(0.0, 100.0), (100.0, 4000.0), (4000.0, 4100.0), (4100.0, 8000.0)}
    upsert_batches(feed().select("entity_id", "ts_utc", "value"), f"{tmp_path}/out", f"{tmp_path}/ck", ["entity_id"], "ts_utc").awaitTermination(120)
    assert [r.value for r in read_batches(spark, f"{tmp_path}/out", ["entity_id"]).collect()] == [7.0]
