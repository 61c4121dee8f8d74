"""The block scan of ordered learning against the plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solarloom.operators import learning as L
from solarloom.operators.learning import ALPHA, composed, learn_effects, running_effect


def shrunk(v, n):
    return 0.0 if n <= 0 else max(-0.7, min(0.7, v * n / (n + 10)))


def by_loop(rows, state=None):
    """Of rows (plant, hour, string, weather, part, residual, weight)."""
    state = dict(state or {})
    for plant, hour, string, weather, part, x, w in sorted(rows, key=lambda r: (r[1], r[0], r[2], r[5], r[6])):
        for scope, key in (("plant", f"{weather}|{part}"), ("string", string), ("string_daypart", f"{string}|{part}")):
            v, n = state.get((plant, scope, key), (0.0, 0.0))
            a = min(1.0, ALPHA * w)
            v, n = (1 - a) * v + a * x, (1 - ALPHA) * n + w
            state[plant, scope, key] = (v, n)
            x -= shrunk(v, n)
    return state


def some_rows(seed, count, plants=("p", "q")):
    rnd = random.Random(seed)
    # Nine rows of ten are of one hour.
    return [(rnd.choice(plants), 500 if rnd.random() < 0.9 else rnd.randrange(1000), rnd.choice("abc"), rnd.choice(["clear", "rain"]), rnd.choice(["morning", "midday"]), rnd.gauss(0, 1), rnd.choice([0.0, 0.5, 1.0, 30.0])) for _ in range(count)]


SCHEMA = "plant_id string, hour long, string_id string, weather string, part string, residual double, weight double"


def learned(df):
    return {(r.plant_id, r.scope, r.key): (r.value, r.n_eff) for r in df.collect()}


def test_composed_maps():
    rnd = np.random.default_rng(2)
    segment = np.sort(rnd.integers(0, 5, 300))
    scale, shift = rnd.choice([0.0, 0.3, 1.0], 300), rnd.normal(size=300)
    a, b = composed(segment, scale, shift)
    for s in range(5):
        x = y = 0.7
        for i in np.flatnonzero(segment == s):
            x = scale[i] * x + shift[i]
            assert x == pytest.approx(a[i] * y + b[i], abs=1e-12)
    long = composed(np.zeros(200_000, int), np.full(200_000, 0.5), np.ones(200_000))
    assert np.isfinite(long).all() and long[1][-1] == pytest.approx(2.0)
    assert [len(x) for x in composed(np.zeros(0, int), np.zeros(0), np.zeros(0))] == [0, 0]


def test_effects_of_two_plants(spark):
    rows, more = some_rows(1, 400), [(*r[:1], r[1] + 2000, *r[2:]) for r in some_rows(2, 150)]
    first = learn_effects(spark.createDataFrame(rows, SCHEMA))
    want = by_loop(rows)
    got = learned(first)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    then = learned(learn_effects(spark.createDataFrame(more, SCHEMA), first))
    want = by_loop(more, want)
    assert all(then[k] == pytest.approx(want[k], abs=1e-9) for k in then)
    alone = learn_effects(spark.createDataFrame([r for r in rows if r[0] == "p"], SCHEMA).drop("plant_id"))
    assert {("p", r.scope, r.key): (r.value, r.n_eff) for r in alone.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in got.items() if k[0] == "p"}


def test_a_burst_is_split(spark, monkeypatch):
    """No block gets much more than its share where one hour has most rows."""
    rows = some_rows(3, 6000, ("p",))
    seen = []
    whole = L.Cuts.__call__

    def watched(self, df):
        out = whole(self, df)
        if "__block" in df.columns:
            seen.append(out.groupBy("__block").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first())
        return out

    monkeypatch.setattr(L.Cuts, "__call__", watched)
    df = spark.createDataFrame(rows, SCHEMA)
    order = ["hour", "string_id", "residual", "weight"]
    small = running_effect(df, ["weather"], "residual", "weight", order, block_rows=500)
    got = {tuple(r[:7]): (r.ema, r.n_eff) for r in small.collect()}
    assert seen[0][1] >= 11 and seen[0][0] <= 1000
    state = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[5], r[6])):
        v, n = state.get(r[3], (0.0, 0.0))
        a = min(1.0, ALPHA * r[6])
        state[r[3]] = ((1 - a) * v + a * r[5], (1 - ALPHA) * n + r[6])
        assert got[r] == pytest.approx(state[r[3]], abs=1e-9)


def test_nothing_to_learn(spark):
    assert learn_effects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_are_dealt_once(spark, monkeypatch):
    """Rows are written as they came and once by blocks, whatever the layers;
    many blocks learn what the loop learns, from stored effects too."""
    rows, more = some_rows(5, 3000), [(*r[:1], r[1] + 2000, *r[2:]) for r in some_rows(6, 900)]
    wrote = []
    whole = L.Cuts.__call__

    def watched(self, df):
        out = whole(self, df)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(L.Cuts, "__call__", watched)
    first = learn_effects(spark.createDataFrame(rows, SCHEMA), block_rows=100)
    want = by_loop(rows)
    got = learned(first)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert wrote.count(3000) == 2 and max(n for n in wrote if n != 3000) < 1500
    then = learned(learn_effects(spark.createDataFrame(more, SCHEMA), first, block_rows=100))
    want = by_loop(more, want)
    assert all(then[k] == pytest.approx(want[k], abs=1e-9) for k in then)
