"""The learn cycle, and learning that goes on from a stored state."""

import math
import random

import pytest
from pyspark.sql import functions as F

from solarloom.operators import forecast as W
from solarloom.operators.learning import ALPHA, running_effect
from solarloom.plans.cycle import learn_cycle

START = 1718928000  # 2024-06-21
HOURS = 24


def test_learning_goes_on_from_stored_state(spark):
    rnd = random.Random(3)
    rows = [(t, "ab"[t % 2], rnd.uniform(-1, 1), rnd.random()) for t in range(60)]
    schema = "ts long, k string, x double, w double"
    whole = {r.ts: (r.ema, r.n_eff) for r in running_effect(spark.createDataFrame(rows, schema), ["k"], "x", "w", ["ts"]).collect()}
    start = spark.createDataFrame([(rows[t][1], *whole[t]) for t in (28, 29)] + [("other", 1.0, 1.0)], "k string, value double, n_eff double")
    rest = running_effect(spark.createDataFrame(rows[30:], schema), ["k"], "x", "w", ["ts"], block_rows=7, start=start)
    for r in rest.collect():
        assert (r.ema, r.n_eff) == pytest.approx(whole[r.ts], abs=1e-12)


def test_learn_cycle(spark):
    """A string that gives four fifths of its physics, a limit that binds for
    an hour, and an effect of another string that stays."""
    plants = spark.createDataFrame([("p", 53.5, 10.0, 5.0, 3.5)], "plant_id string, lat double, lon double, altitude double, turbidity double")
    strings = spark.createDataFrame([("p", "s", 0.9, -3.47, -0.0594, 3.0, -0.004, None)], "plant_id string, string_id string, system_eff double, mount_a double, mount_b double, mount_dt double, temp_coeff double, max_power_w double")
    geometry = spark.createDataFrame([("s", 0, 180.0, 30.0, 1.8)], "string_id string, valid_from_ts_utc long, azimuth_deg double, tilt_deg double, kwp double")
    weather = spark.createDataFrame([("p", START + 3600 * h, 500.0 if 3 < h < 20 else 0.0, None, None, 20.0, 1.0, 50.0, 0.0) for h in range(HOURS)], "plant_id string, ts_utc long, ghi_wm2 double, dni_wm2 double, dhi_wm2 double, temp_c double, wind_ms double, clouds_pct double, rain_mm double")
    power = W.string_power(W.downscale(W.hourly_weather(W.hour_grid(plants, START, START + 3600 * HOURS), weather)), strings, geometry)
    watts = {r.ts_utc: r.power_w for r in power.select("ts_utc", "power_w").collect()}
    held = START + 12 * 3600
    fivemin = spark.createDataFrame(
        [(t, "p", "s", 0.8 * w / 12, 0.8 * w, 1.0, 10, 0.8 * w if held <= t < held + 3600 else None, None, "measured") for t, w in watts.items()],
        "ts_utc long, plant_id string, string_id string, energy_wh double, power_mean_w double, coverage double, sample_count int, limit_commanded_w double, limit_binding boolean, value_kind string")
    effects = spark.createDataFrame([("string", "s", 0.3, 2.0), ("string", "other", 0.1, 4.0)], "scope string, key string, value double, n_eff double")
    shading = spark.createDataFrame([], "ts_utc long, string_id string, azimuth_deg double, elevation_deg double, ratio double, weight double, physics_w double, beam double")
    tables = {"plants": plants, "strings": strings, "geometry": geometry, "weather": weather, "fivemin": fivemin, "effects": effects, "shading": shading}
    noon = START + 12 * 3600 - 3600
    tables["state"] = spark.createDataFrame([(noon, 1200.0, 600.0, 50.0), (START - 300, 9.0, 9.0, 9.0)], "ts_utc long, grid_power_w double, house_load_w double, battery_soc_pct double")
    tables["issues"] = spark.createDataFrame([(noon, noon - 3 * 3600, 3, 400.0)], "ts_utc long, issued_at_utc long, horizon_h int, ghi_wm2 double")
    tables["measured"] = spark.createDataFrame([(noon, 800.0)], "ts_utc long, ghi double")
    tables["bias"] = spark.createDataFrame([(11, "0-6h", 0.5, 1.0), (3, "48h+", 0.2, 2.0)], "hour_local int, bucket string, value double, n_eff double")
    tables["pairs"] = spark.createDataFrame([("g", "inverter", t, False, ["s"], 1000.0, 900.0, 1.0, None) for t in (noon, held, START - 300)],
                                            "scope_id string, stage string, ts_utc long, curtailable boolean, members array<string>, in_w double, out_w double, coverage double, censored int")
    tables["reference"] = spark.createDataFrame([("g", 2000.0, [(2.0, 0.9), (100.0, 0.9)])], "scope_id string, reference_w double, prior array<struct<load: double, eta: double>>")
    now = START + 3600 * HOURS + 10
    out, cursor = learn_cycle(tables, now, START)
    assert cursor == START + 3600 * HOURS and learn_cycle(tables, now, cursor) == ({}, cursor)
    kinds = {(r.value_kind, bool(r.limit_binding)): r.n for r in out["fivemin"].groupBy("value_kind", "limit_binding").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("lower_bound", True): 12, ("measured", False): len(watts) - 12}
    hours = {r.ts_utc: r for r in out["hourly"].collect()}
    assert hours[held].value_kind == "lower_bound" and len(hours) == HOURS
    learned = {(r.scope, r.key): (r.value, r.n_eff) for r in out["effects"].collect()}
    assert learned["string", "other"] == (0.1, 4.0)
    # the same by the plain loop: all lit hours but the held one say ln 0.8, weight 1
    energy = {}
    for t, w in watts.items():
        energy[t // 3600 * 3600] = energy.get(t // 3600 * 3600, 0.0) + w
    classes = {r.hour: (r.weather, r.part) for r in W.weather_hours(W.downscale(W.hourly_weather(W.hour_grid(plants, START, START + 3600 * HOURS), weather))).collect()}
    state = {("string", "s"): (0.3, 2.0)}

    def step(key, x):
        v, n = state.get(key, (0.0, 0.0))
        v, n = (1 - ALPHA) * v + ALPHA * x, (1 - ALPHA) * n + 1
        state[key] = (v, n)
        return x - max(-0.7, min(0.7, v * n / (n + 10)))

    lit = [h for h in sorted(energy) if energy[h] > 0 and h != held]
    for h in lit:
        sky, part = classes[h]
        step(("string_daypart", f"s|{part}"), step(("string", "s"), step(("plant", f"{sky}|{part}"), math.log(0.8))))
    assert len(lit) > 12 and set(learned) - {("string", "other")} == set(state)
    for key, want in state.items():
        assert learned[key] == pytest.approx(want, abs=1e-9)
    ratios = out["shading"].agg(F.min("ratio"), F.max("ratio"), F.count("*")).first()
    assert ratios[0] == pytest.approx(0.8) and ratios[1] == pytest.approx(0.8) and ratios[2] > 100
    assert out["cells"].count() > 0
    assert [(r.ts_utc, round(r.imported_kwh, 9)) for r in out["plant_hourly"].collect()] == [(noon, 0.1)]
    bias = {(r.hour_local, r.bucket): (r.value, r.n_eff) for r in out["bias"].collect()}
    assert bias[3, "48h+"] == (0.2, 2.0) and bias[11, "0-6h"] == pytest.approx(((1 - ALPHA) * 0.5 + ALPHA * math.log(2), (1 - ALPHA) + 1.0))
    assert {r.ts_utc: r.censored for r in out["pairs"].collect()} == {noon: 0, held: 1, START - 300: None}
    # a pair without a verdict is not clean, nor is a censored one
    assert [(r.scope_id, r.bucket, r.n) for r in out["curves"].collect()] == [("g", 50, 1)]
