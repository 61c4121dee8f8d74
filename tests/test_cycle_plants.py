"""The learn cycle of two plants with cursors of their own, in the same jobs,
against one run for each."""

import random

import pytest
from pyspark.sql import functions as F

from solarloom.operators import forecast as W
from solarloom.plans.cycle import learn_cycle, learn_windows

START = 1718928000  # 2024-06-21
HOURS = 30


def test_windows_by_cursor(spark):
    plants = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "plant_id string")
    marks = spark.createDataFrame([("p", 36000), ("q", 3600 * 500), ("r", 0)], "plant_id string, cursor long")
    got = {r.plant_id: (r.start, r.end) for r in learn_windows(plants, marks, 3600 * 500 + 20, 48).collect()}
    assert got == {"p": (36000, 36000 + 48 * 3600), "r": (0, 48 * 3600), "s": (3600 * 452, 3600 * 500)}


def two_plants(spark):
    """Strings a and b of plant p, c of q, with effects, states and issues of
    both; b has a limit for an hour."""
    rnd = random.Random(11)
    plants = spark.createDataFrame([("p", 53.5, 10.0, 5.0, 3.5), ("q", 48.0, 11.0, 500.0, 3.0)], "plant_id string, lat double, lon double, altitude double, turbidity double")
    strings = spark.createDataFrame([(p, s, 0.9, -3.47, -0.0594, 3.0, -0.004, None) for p, s in (("p", "a"), ("p", "b"), ("q", "c"))], "plant_id string, string_id string, system_eff double, mount_a double, mount_b double, mount_dt double, temp_coeff double, max_power_w double")
    geometry = spark.createDataFrame([("a", 0, 180.0, 30.0, 1.8), ("b", 0, 90.0, 20.0, 1.0), ("c", 0, 200.0, 45.0, 2.0)], "string_id string, valid_from_ts_utc long, azimuth_deg double, tilt_deg double, kwp double")
    weather = spark.createDataFrame([(p, START + 3600 * h, rnd.uniform(300, 700) if 3 < h % 24 < 20 else 0.0, None, None, 20.0, 1.0, 50.0, 0.0) for p in "pq" for h in range(HOURS)], "plant_id string, ts_utc long, ghi_wm2 double, dni_wm2 double, dhi_wm2 double, temp_c double, wind_ms double, clouds_pct double, rain_mm double")
    power = W.string_power(W.downscale(W.hourly_weather(W.hour_grid(plants, START, START + 3600 * HOURS), weather)), strings, geometry)
    rows = [(r.ts_utc, r.plant_id, r.string_id, r.power_w * x / 12, r.power_w * x, 1.0, 10, r.power_w * x if r.string_id == "b" and r.ts_utc // 3600 % 24 == 12 else None, None, "measured")
            for r in power.select("ts_utc", "plant_id", "string_id", "power_w").collect() for x in [rnd.uniform(0.6, 0.95)]]
    fivemin = spark.createDataFrame(rows, "ts_utc long, plant_id string, string_id string, energy_wh double, power_mean_w double, coverage double, sample_count int, limit_commanded_w double, limit_binding boolean, value_kind string")
    tables = {"plants": plants, "strings": strings, "geometry": geometry, "weather": weather, "fivemin": fivemin}
    tables["effects"] = spark.createDataFrame([("p", "string", "a", 0.3, 2.0), ("q", "string", "c", -0.1, 4.0), ("q", "plant", "clear|midday", 0.1, 4.0)], "plant_id string, scope string, key string, value double, n_eff double")
    tables["shading"] = spark.createDataFrame([], "plant_id string, ts_utc long, string_id string, azimuth_deg double, elevation_deg double, ratio double, weight double, physics_w double, beam double")
    hours = [START + 3600 * h for h in range(HOURS)]
    tables["state"] = spark.createDataFrame([(p, t + 300, rnd.uniform(-900, 900), 200.0, 50.0) for p in "pq" for t in hours], "plant_id string, ts_utc long, grid_power_w double, house_load_w double, battery_soc_pct double")
    tables["issues"] = spark.createDataFrame([(p, t, t - 3600 * 5, 5, rnd.uniform(200, 500)) for p in "pq" for t in hours], "plant_id string, ts_utc long, issued_at_utc long, horizon_h int, ghi_wm2 double")
    tables["measured"] = spark.createDataFrame([(p, t, rnd.uniform(200, 500)) for p in "pq" for t in hours], "plant_id string, ts_utc long, ghi double")
    return tables


def told(out):
    return {name: sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr) for name, df in out.items()}


def test_two_plants_are_two_runs(spark):
    tables = two_plants(spark)
    now = START + 3600 * 28 + 40
    marks = {"p": START, "q": START + 3600 * 9}
    table = lambda which: spark.createDataFrame([(p, marks[p]) for p in which], "plant_id string, cursor long")
    both, cursors = learn_cycle(tables, now, table("pq"))
    assert {r.plant_id: r.cursor for r in cursors.collect()} == {p: START + 3600 * 28 for p in "pq"}
    both, alone = told(both), {}
    for p in "pq":
        mine = {n: df.filter(F.col("plant_id") == p) if "plant_id" in df.columns else df for n, df in tables.items()}
        for name, rows in told(learn_cycle(mine, now, table(p))[0]).items():
            alone[name] = sorted(alone.get(name, []) + rows, key=repr)
    assert both.keys() == alone.keys() == {"fivemin", "hourly", "plant_hourly", "bias", "exclusions", "effects", "shading", "cells"}
    for name in both:
        assert len(both[name]) == len(alone[name]) > (-1 if name == "exclusions" else 0), name
        for a, b in zip(both[name], alone[name]):
            assert all(x == y or x == pytest.approx(y, abs=1e-6) for x, y in zip(a, b)), name
    # a second cycle has nothing to do
    assert learn_cycle(tables, now, cursors)[0] == {}


def test_a_plant_that_waits_keeps_its_mark(spark):
    tables = two_plants(spark)
    now = START + 3600 * 6
    marks = spark.createDataFrame([("p", START), ("q", START + 3600 * 20)], "plant_id string, cursor long")
    out, cursors = learn_cycle(tables, now, marks)
    assert {r.plant_id: r.cursor for r in cursors.collect()} == {"p": START + 3600 * 6, "q": START + 3600 * 20}
    assert {r.plant_id for r in out["hourly"].collect()} == {"p"}
    effects = {(r.plant_id, r.scope, r.key): (r.value, r.n_eff) for r in out["effects"].collect()}
    assert effects["q", "string", "c"] == (-0.1, 4.0)
