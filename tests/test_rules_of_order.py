"""Rows without a sequence or time, windows of days, and the sky models."""

import datetime
import math

import pytest

from solarloom.constants import PEREZ, PEREZ_BINS
from solarloom.functions import physics as P
from solarloom.operators.aggregate import score_windows
from solarloom.operators.joins import newest_issue
from solarloom.operators.mutations import compact_issues, upsert


def test_a_row_without_a_sequence_is_kept(spark):
    schema = "k string, seq long, v double"
    old, new = spark.createDataFrame([("a", None, 1.0), ("b", None, 2.0)], schema), spark.createDataFrame([("b", 3, 5.0)], schema)
    assert {r.k: (r.seq, r.v) for r in upsert(old, new, ["k"], "seq").collect()} == {"a": (None, 1.0), "b": (3, 5.0)}
    issues = spark.createDataFrame([("s", None, 4.0)], "k string, issued_at_utc long, v double")
    assert [r.v for r in newest_issue(issues, ["k"]).collect()] == [4.0]


def test_a_row_without_a_time_is_not_compacted(spark):
    log = spark.createDataFrame([(None, "s", 1, 1.0), (0, "s", 1, 2.0), (0, "s", 2, 3.0)], "ts_utc long, string_id string, issued_at_utc long, v double")
    assert sorted((r.ts_utc is None, r.v) for r in compact_issues(log, 10**9, ["ts_utc", "string_id"]).collect()) == [(False, 3.0), (True, 1.0)]


def test_score_windows(spark):
    """Ten days before, one of them long ago, one in the future."""
    today = datetime.date(2024, 4, 2)  # a 23-hour day lies in the window
    rows = [(today - datetime.timedelta(days=i), 2.0 + i, 1.0, i % 3 == 0) for i in (-1, 0, 1, 2, 3, 5, 7, 8, 29, 30, 31)] * 2
    got = {(r.window_days, r.population): r for r in score_windows(spark.createDataFrame(rows, "day date, predicted double, actual double, censored boolean"), today, (2, 7, 30), 4.0).collect()}
    assert len(got) == 6
    for (days, population), r in got.items():
        mine = [x for x in rows if 1 <= (today - x[0]).days <= days and (population == "all" or not x[3])]
        by = {d: [x for x in mine if x[0] == d] for d in {x[0] for x in mine}}
        assert (r.n, r.days) == (len(mine), len(by))
        if len(by) < 3:
            assert r.wmape is None and r.mae is None and r.daily_bias is None
        else:
            off = {d: sum(x[1] - x[2] for x in v) for d, v in by.items()}
            assert r.wmape == pytest.approx(sum(map(abs, off.values())) / sum(x[2] for x in mine))
            assert r.mae == pytest.approx(sum(abs(x[1] - x[2]) for x in mine) / len(mine)) and r.nmae == pytest.approx(r.mae / 4)
            assert r.daily_bias == pytest.approx(sum(off.values()) / len(off)) and r.bias == pytest.approx(sum(x[1] - x[2] for x in mine) / len(mine))
    none = score_windows(spark.createDataFrame([], "day date, predicted double, actual double, censored boolean"), today, (7,), 4.0).collect()
    assert [(r.n, r.days, r.wmape) for r in none] == [(0, 0, None)] * 2


def by_formula(dhi, dni, elevation, tilt, cos_aoi, airmass, e0):
    z = math.radians(90 - elevation)
    epsilon = ((dhi + dni) / dhi + 1.041 * z**3) / (1 + 1.041 * z**3)
    f = PEREZ[sum(epsilon >= b for b in PEREZ_BINS)]
    delta = dhi * airmass / e0
    f1, f2 = max(0.0, f[0] + f[1] * delta + f[2] * z), f[3] + f[4] * delta + f[5] * z
    slope = math.radians(tilt)
    return max(0.0, dhi * ((1 - f1) * (1 + math.cos(slope)) / 2 + f1 * max(0.0, cos_aoi) / max(math.sin(math.radians(elevation)), math.cos(math.radians(85))) + f2 * math.sin(slope)))


def test_perez_sky(spark):
    rows = [(1718971200.0 + 3600 * h, 53.5, 10.0, alt, 3.5, g, None if h % 4 == 3 else 0.9 * (g - dhi), dhi, 20.0, 1.0, tilt, 150.0, 1.8, -0.004, 0.9, 1.0, -3.47, -0.0594, 3.0, ok)
            for h in range(-6, 8) for alt in (0.0, 800.0) for g, dhi in ((500.0, 480.0), (600.0, 200.0), (700.0, 90.0), (300.0, 0.0)) for tilt in (0.0, 35.0, 90.0) for ok in (True, False)]
    names = "ts lat lon altitude turbidity ghi dni dhi temp_c wind_ms tilt azimuth kwp temp_coeff system_eff shade mount_a mount_b mount_dt"
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()) + ", components_ok boolean")
    light = P.run(df, P.SUN + P.CLEARSKY + P.COMPONENTS)
    perez, other = (P.run(light, P.plane(m)).collect() for m in ("perez", "haydavies"))
    seen = 0
    for a, b in zip(perez, other):
        if not a.components_ok:
            assert a.poa_sky == pytest.approx(b.poa_sky)
        elif a.elevation > 1 and a.dhi_used > 0:
            seen += 1
            assert a.poa_sky == pytest.approx(by_formula(a.dhi_used, a.dni_used, a.elevation, a.tilt, a.cos_aoi, a.airmass * math.exp(a.altitude / 8434.5), a.e0), rel=1e-9)
            if a.tilt == 0 and a.elevation > 5:
                assert a.poa_sky == pytest.approx(a.dhi_used)
        else:
            assert a.poa_sky is not None and a.poa_sky >= 0
    assert seen > 100 and {sum(r.epsilon >= b for b in PEREZ_BINS) for r in perez if r.epsilon} >= {0, 2, 4}


def test_unknown_sky_models_are_errors():
    with pytest.raises(ValueError, match="perez"):
        P.plane("perez-driesse")
