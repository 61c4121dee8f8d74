"""Literal vectors of single operators."""

import pytest
from pyspark.sql import functions as F

from solarloom.functions import physics as P
from solarloom.functions import predicates as R
from solarloom.operators.aggregate import fold_hourly, integrate, merge_series
from solarloom.operators.learning import ALPHA, learn_effects
from solarloom.operators.mutations import flag_curtailment, upsert_keeping
from solarloom.sources.readers import parse_curve, parse_forecast
from solarloom.streaming.collect import due_intervals, learn_window

B = 1_700_000_100


def integral(spark, samples, watchdog):
    df = spark.createDataFrame([("e", float(B + t), v) for t, v in samples], "entity_id string, ts_utc double, value double")
    r = integrate(df, watchdog).filter(f"ts_utc = {B}").first()
    return (r.energy_wh, r.power_mean_w, r.coverage, r.sample_count) if r else None


def test_integrate(spark):
    assert integral(spark, [(t, 600.0) for t in range(0, 301, 30)], 30) == (50.0, 600.0, 1.0, 10)
    assert integral(spark, [(0, 0.0), (300, 600.0)], 300) == (25.0, 300.0, 1.0, 1)
    assert integral(spark, [(0, 600.0), (150, None), (300, 600.0)], 30) == (None, None, 0.0, 1)
    assert integral(spark, [(t, 600.0) for t in range(0, 151, 30)], 30) == (25.0, 600.0, 0.5, 6)
    assert integral(spark, [(0, 600.0), (300, 600.0)], 30) == (None, None, 0.0, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("m, li, p, want", [(600, 1796, 640, False), (1760, 1796, 2400, True), (1760, 1796, 1800, False), (5, 0, 800, True), (600, None, 640, None), (600, 1796, None, None)])
def test_binding(spark, m, li, p, want):
    assert one(spark, R.is_binding(*[F.lit(x).cast("double") for x in (m, li, p)])) is want


def test_rules(spark):
    assert one(spark, R.quality(F.lit(1.0), F.lit(-9.0))) == "exact"
    assert one(spark, R.combine_verdicts(F.lit(False), F.lit(None).cast("boolean"))) is False
    assert one(spark, R.closed_interval(F.lit(B + 299))) == B - 300
    assert one(spark, R.nearest_load(F.lit(62.5))) == 50
    curve = F.array(*[F.struct(F.lit(a).alias("load"), F.lit(b).alias("eta")) for a, b in ((5.0, .90), (10.0, .93), (50.0, .96), (100.0, .95))])
    assert [round(one(spark, R.curve_at(curve, F.lit(x))), 6) for x in (30.0, 1.0, 140.0)] == [0.945, 0.90, 0.95]
    assert [round(one(spark, R.savings(F.lit(m), F.lit(10.0), F.lit(7.0), 0.32, 0.08)), 2) for m in ("net_metering", "self_consumption", "feed_in")] == [3.20, 1.52, 0.80]
    assert one(spark, parse_curve(F.lit("5:0.90, 10:x"))) is None


def test_fold_and_merge(spark):
    df = spark.createDataFrame([("s", 3600 + 300 * i, 100.0, 1.0, 1500.0 if not i else None, not i, "lower_bound" if not i else "measured") for i in range(12)], "string_id string, ts_utc long, energy_wh double, coverage double, limit_commanded_w double, limit_binding boolean, value_kind string")
    r = fold_hourly(df).first()
    assert (round(r.energy_kwh, 6), r.value_kind, round(r.curtailed_fraction, 6), r.limit_mean_w) == (1.2, "lower_bound", round(1 / 12, 6), 1500.0)
    a, b = (spark.createDataFrame(x, "ts_utc long, value double") for x in ([(0, 1.0), (3600, 2.0)], [(0, .5), (3600, .25)]))
    assert sorted(map(tuple, merge_series(a, b).collect())) == [(0, 1.5), (3600, 2.25)]


def test_learning_matches_the_sequential_loop(spark):
    import random

    random.seed(3)
    obs = [(h, f"s{s}", random.choice("ab"), random.choice("xy"), random.uniform(-1, 1), random.random()) for h in range(60) for s in (1, 2)]
    got = {(r.scope, r.key): (r.value, r.n_eff) for r in learn_effects(spark.createDataFrame(obs, "hour long, string_id string, weather string, part string, residual double, weight double")).collect()}
    state = {}

    def update(key, x, w):
        v, n = state.get(key, (0.0, 0.0))
        n = (1 - ALPHA) * n + w
        a = min(1.0, ALPHA * w)
        v = (1 - a) * v + a * x
        state[key] = (v, n)
        return max(-.7, min(.7, v * n / (n + 10))) if n > 0 else 0.0

    for _, s, we, pa, x, w in obs:
        x -= update(("plant", f"{we}|{pa}"), x, w)
        x -= update(("string", s), x, w)
        update(("string_daypart", f"{s}|{pa}"), x, w)
    assert got.keys() == state.keys()
    assert all(got[k] == pytest.approx(state[k], abs=1e-12) for k in got)


def test_flags_and_sources(spark):
    rows = spark.createDataFrame([(0, "s", None, "measured"), (300, "s", True, "lower_bound"), (600, "s", None, "reconstructed")], "ts_utc long, string_id string, limit_binding boolean, value_kind string")
    verdict = spark.createDataFrame([(0, "s", True), (300, "s", False), (600, "s", True)], "ts_utc long, string_id string, limit_binding boolean")
    assert [r.value_kind for r in flag_curtailment(rows, verdict).orderBy("ts_utc").collect()] == ["lower_bound", "measured", "reconstructed"]
    old = spark.createDataFrame([(1, 5, 1)], "k int, v int, censored int")
    new = spark.createDataFrame([(1, 6, 0), (2, 7, 0)], "k int, v int, censored int")
    assert sorted(map(tuple, upsert_keeping(old, new, ["k"], "censored").collect())) == [(1, 6, 1), (2, 7, 0)]
    pay = spark.createDataFrame([('{"hourly": {"time": [90000, 93600], "shortwave_radiation": [5.0]}}', 0, "w")], "payload string, issued_at_utc long, source string")
    assert [(r.ts_utc, r.horizon_h, r.ghi_wm2) for r in parse_forecast(pay).orderBy("ts_utc").collect()] == [(86400, 24, 5.0), (90000, 25, None)]
    assert learn_window(None, 100 * 3600 + 5) == (52 * 3600, 100 * 3600)


def test_physics_invariants(spark):
    noon = 1742472000 - 10 * 240  # spring equinox, about solar noon at 10 degrees east
    df = spark.sql(f"select cast({noon} + 450 as double) ts, 50D lat, 10D lon, 100D altitude, 3.5D turbidity, 600D ghi, cast(null as double) dni, cast(null as double) dhi, 15D temp_c, 1.5D wind_ms, 30D tilt, 180D azimuth, 1.8D kwp, -0.004D temp_coeff, 0.9D system_eff, 1D shade, -3.47D mount_a, -0.0594D mount_b, 3D mount_dt")
    r = P.run(df).first()
    assert abs(r.elevation - 40) < 1 and abs(r.sun_az - 180) < 3
    assert abs(r.dhi_used + r.dni_used * r.cz - r.ghi) < 1e-6
    assert 0 < r.power_w < 1800 and r.cs_ghi > 500


def test_due_intervals():
    now = 3000.5
    assert due_intervals(None, 3001.5) == [2700] and due_intervals(None, now) == [2400]
    assert due_intervals(2400, 3001.5) == [2700]
    assert due_intervals(1800, 3001.5) == [2400, 2700] and due_intervals(0, 3001.5) == [2400, 2700]
    assert due_intervals(9000, 3001.5) == [2700] and due_intervals(2700, 3001.5) == [2700]
