"""The stateful collector against batch integration, in any arrival order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solarloom.operators.aggregate import integrate
from solarloom.sources.readers import densify
from solarloom.streaming.collector import collect, repeated, run_available, windows

START = 1_700_000_100
SCHEMA = "entity_id string, ts_utc double, value double"


def plain(df):
    return {(r.entity_id, r.ts_utc): (r.energy_wh, r.power_mean_w, r.coverage, r.sample_count, r.peak_w) for r in df.collect()}


def close(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b))


def some_samples(seed, hours=3):
    """Samples of three entities, with gaps, nulls and crossed windows."""
    rnd, out = random.Random(seed), []
    for e in "abc":
        t = START + rnd.random() * 100
        while t < START + hours * 3600:
            out.append((e, round(t, 3), None if rnd.random() < 0.08 else rnd.uniform(0, 900)))
            t += rnd.choice([5, 30, 30, 60, 70, 74, 76, 310, 900]) * rnd.uniform(0.5, 1.0) + 0.001
    return sorted(out, key=lambda r: r[1])


def stream_of(spark, folder, batches, **options):
    """The rows after each batch of samples, one file and micro-batch each."""
    source, out, check = f"{folder}/in", f"{folder}/out", f"{folder}/check"
    seen = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("ts_utc") * 1_000_000).cast("long"))).drop("ts_utc").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("entity_id string, value double, ts timestamp").parquet(source)
        seen.append(plain(run_available(collect(stream, **options), out, check)))
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_are_those_of_the_batch(spark, tmp_path, seed):
    """Samples shuffled over six minutes arrive in three runs of the stream,
    each of which goes on from the state of the one before."""
    rnd, rows = random.Random(seed), some_samples(seed)
    shuffled = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 360))
    third = len(rows) // 3
    end = START + 3 * 3600 + 4000
    batches = [shuffled[:third], shuffled[third : 2 * third], shuffled[2 * third :] + [("end", float(end), 1.0)]]
    seen = stream_of(spark, tmp_path, batches)
    want = {k: v for k, v in plain(integrate(spark.createDataFrame(rows, SCHEMA))).items()}
    assert seen[2].keys() == want.keys() and all(close(seen[2][k], want[k]) for k in want)
    # what was out is never changed, and the last run still closed windows
    assert all(close(seen[2][k], v) for s in seen[:2] for k, v in s.items()) and len(seen[0]) < len(seen[1]) < len(seen[2])


def test_late_samples(spark, tmp_path):
    first = [("a", float(START + s), 100.0) for s in range(0, 1800, 50)]
    late = [("a", START + 1500.5, 900.0), ("a", START + 10.5, 5000.0)]  # within ten minutes, and not
    last = [("a", float(START + 9000), None)]
    seen = stream_of(spark, tmp_path, [first, late, last])[-1]
    want = plain(integrate(spark.createDataFrame(first + late[:1], SCHEMA)))
    assert seen.keys() == want.keys() and all(close(seen[k], want[k]) for k in want)


def test_repeated_values_come_from_timers(spark, tmp_path):
    """An entity that falls silent goes on with its last value; one that ends
    in a null does not. The same as the batch with repeats up to the end."""
    rows = some_samples(5, 1) + [("d", START + 20.0, 50.0), ("e", START + 7.0, 10.0), ("e", START + 900.0, None)]
    end = START + 4 * 3600
    seen = stream_of(spark, tmp_path, [rows, [("z", float(end), None)], [("z", end + 2000.0, None)]], repeat=True)
    stretched = rows + [(e, float(end + 2000), None) for e in "abcd"]
    want = plain(integrate(densify(spark.createDataFrame(stretched, SCHEMA))))
    sure = end + 2000 - 600 - 75 - 300
    want = {k: v for k, v in want.items() if k[1] <= sure - 300}
    got = {k: v for k, v in seen[-1].items() if k[1] <= sure - 300}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    assert sum(k[0] == "d" for k in got) > 40 and max(k[1] for k in got if k[0] == "e") < START + 1200
    assert seen[1].keys() - seen[0].keys() and seen[2].keys() - seen[1].keys()


def test_repeats_are_those_of_the_batch(spark):
    rows = [r for r in some_samples(7, 1) if r[0] == "a"]
    t, v = repeated(np.array([r[1] for r in rows]), np.array([np.nan if r[2] is None else r[2] for r in rows]), 30.0, rows[0][1], rows[-1][1])
    want = sorted(r.ts_utc for r in densify(spark.createDataFrame(rows, SCHEMA)).collect())
    assert t.tolist() == pytest.approx(want)
    some = repeated(np.array([0.0, 1000.0]), np.array([1.0, 2.0]), 30.0, 700.0, 1060.0)
    assert some[0].tolist() == [0.0, *range(720, 1000, 30), 1000.0, 1030.0] and some[1].tolist() == [1.0] * 11 + [2.0] * 2


def test_windows_of_nothing():
    none = np.zeros(0)
    assert len(windows(none, none, 0, 900, 75.0)) == 0 and len(windows(none, none, 0, 0, 75.0)) == 0


def test_a_long_history_is_dealt_in_blocks(spark, tmp_path, monkeypatch):
    """Two days read at once: no state holds much more than six hours of an
    entity, and the rows are those of the batch across all edges."""
    from solarloom.streaming import collector

    rows = some_samples(9, 48)
    seen = str(tmp_path / "held")

    class Watched(collector.Collector):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            t = [x[0] for x in self.samples.get()]
            with open(f"{seen}-{'-'.join(map(str, key))}", "w") as f:
                f.write(str(max(t) - min(t)))
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    monkeypatch.setattr(collector, "Collector", Watched)
    got = stream_of(spark, tmp_path, [rows, [("end", START + 72 * 3600.0, 1.0)]])[-1]
    want = plain(integrate(spark.createDataFrame(rows, SCHEMA)))
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    spans = [float(f.read_text()) for f in tmp_path.glob("held-*")]
    assert len(spans) >= 24 and max(spans) <= 6 * 3600 + 150
