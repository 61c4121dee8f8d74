"""Queries over all of their rows, and the branches their tables rarely take."""

import math

import pytest

import solarloom.publish_queries  # noqa: F401  (registers its queries)
from solarloom.operators.joins import sky_lookup
from solarloom.operators.publish import bias_observations, plant_power
from solarloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_bias_is_learned_from_all_strings(spark):
    for name in ("cmp08_bias_observations_whole", "cmp08_learn_bias"):
        assert {r.string_id for r in QUERIES[name](spark, DATA).select("string_id").distinct().collect()} == {"s1", "s2", "s3"}


def test_truth_of_each_string(spark):
    """Hour 0 is measured; hour 3600 has only a near issue of s1."""
    rows = [(0, "s1", -7200, 2, 100.0), (0, "s2", -7200, 2, 50.0), (3600, "s1", 0, 1, 200.0), (3600, "s1", -36000, 11, 100.0), (3600, "s2", -36000, 11, 400.0)]
    issues = spark.createDataFrame(rows, "ts_utc long, string_id string, issued_at_utc long, horizon_h int, ghi_wm2 double")
    got = bias_observations(issues, spark.createDataFrame([(0, 80.0)], "ts_utc long, ghi double"), ("string_id",)).collect()
    assert sorted((r.ts_utc, r.string_id, r.horizon_h, r.truth) for r in got) == [(0, "s1", 2, 80.0), (0, "s2", 2, 80.0), (3600, "s1", 11, 200.0)]


def test_plant_power_needs_every_string(spark):
    rows = [(t, f"s{i}", None if (t, i) == (300, 3) else float(i)) for t in (0, 300) for i in (1, 2, 3)]
    got = plant_power(spark.createDataFrame(rows, "ts_utc long, string_id string, power_mean_w double"), 3)
    assert {r.ts_utc: r.power_w for r in got.collect()} == {0: 6.0, 300: None}


def test_lookup_falls_back(spark):
    """A cell of its own, neighbours across north, and neither."""
    cells = spark.createDataFrame([("s", 35, 3, -0.2, 10.0), ("s", 1, 3, -0.5, 30.0)], "string_id string, az_bin int, el_bin int, value double, n double")
    asked = spark.createDataFrame([("s", 35, 3), ("s", 0, 3), ("s", 10, 3), ("t", 0, 3)], "string_id string, az_bin int, el_bin int")
    got = {(r.string_id, r.az_bin): r.factor for r in sky_lookup(asked, cells).collect()}
    assert got == {("s", 35): pytest.approx(math.exp(-0.2)), ("s", 0): pytest.approx(math.exp(-(0.2 * 10 + 0.5 * 30) / 40)), ("s", 10): 1.0, ("t", 0): 1.0}
