"""Curves in one pass over the pairs, held against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from solarloom import constants as C
from solarloom import view_queries
from solarloom.functions.predicates import nearest_load
from solarloom.operators.learning import fit_curves
from solarloom.queries import QUERIES

NOW = 1_009_756_800
PRIOR = "array(named_struct('load', 2D, 'eta', 0.86D), named_struct('load', 100D, 'eta', 0.95D))"


def test_buckets(spark):
    loads = [0.0, 3.5, 3.6, 7.5, 15.0, 15.1, 27.5, 42.5, 62.5, 87.5, 87.6, 400.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in loads], "x double").select(nearest_load("x")).collect()]
    assert got == [min(C.LOAD_BUCKETS, key=lambda b: (abs(b - x), b)) for x in loads]


def some_pairs():
    rnd = random.Random(4)
    out = [(rnd.choice(["a", "b"]), NOW - rnd.randrange(10**7), rnd.uniform(1, 1500), rnd.uniform(0.2, 1.1), rnd.choice([0.5, 1.0]), rnd.choice([0, 0, 0, 1, None])) for _ in range(800)]
    out = [(s, t, i, i * eta, c, z) for s, t, i, eta, c, z in out]
    # the highest load of a has no clean pair in its bucket; c has none at all
    return out + [("a", NOW, 2500.0, 2400.0, 1.0, 0), ("c", NOW, 500.0, 10.0, 1.0, 0)]


def test_mean_and_variance(spark):
    rows = some_pairs()
    ref = spark.createDataFrame([("a",), ("b",), ("c",)], "scope_id string").select("scope_id", F.lit(1000.0).alias("reference_w"), F.expr(PRIOR).alias("prior"))
    got = {(r.scope_id, r.bucket): r for r in fit_curves(spark.createDataFrame(rows, "scope_id string, ts_utc long, in_w double, out_w double, coverage double, censored int"), ref, NOW).collect()}
    bins, top = {}, {}
    for s, t, i, o, c, z in rows:
        load, eta = i / 10, o / i
        if z == 0 and load >= 1:
            top[s] = max(top.get(s, 0), load)
            if o < 980 and 0.3 < eta <= 1.05:
                bins.setdefault((s, min(C.LOAD_BUCKETS, key=lambda b: (abs(b - load), b))), []).append((c * 0.5 ** ((NOW - t) / 86400 / C.CURVE_RECENCY_DAYS), eta))
    assert got.keys() == bins.keys() and {s for s, _ in bins} == {"a", "b"}
    for k, pairs in bins.items():
        n = sum(w for w, _ in pairs)
        mean = sum(w * e for w, e in pairs) / n
        assert (got[k].n, got[k].n_eff, got[k].measured, got[k].variance, got[k].max_load) == pytest.approx((len(pairs), n, mean, sum(w * (e - mean) ** 2 for w, e in pairs) / n, top[k[0]]))


@pytest.mark.parametrize("name", ["sta02_stored_curves", "cmp14_reachable", "agg21_fit_curves"])
def test_pairs_are_read_once(spark, monkeypatch, name):
    """However often the stored rows are read, the pairs are scanned once."""
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(frame.num_rows)
            yield frame

    pairs = spark.createDataFrame([("g0", NOW - 60 * i, 100.0 + 11 * i, 90.0 + 10 * i, 1.0, 0) for i in range(40)], "scope_id string, ts_utc long, in_w double, out_w double, coverage double, censored int").mapInArrow(counted, "scope_id string, ts_utc long, in_w double, out_w double, coverage double, censored int")
    monkeypatch.setattr(view_queries.D, "conversion", lambda spark, d: pairs)
    assert QUERIES[name](spark, "").collect()
    assert read.value == 40
