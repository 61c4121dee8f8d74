"""Sky maps against plain loops: evidence by weight, halves, envelopes, plants."""

import math
import random
from collections import defaultdict

import pytest

from solarloom.operators.aggregate import weighted_quantile
from solarloom.operators.joins import sky_lookup
from solarloom.operators.shading import absolute_fit, joint_fit

KEYS = "plant_id string, string_id string, ts_utc long, az_bin int, el_bin int, half int, logr double, w double, beam double, physics_w double"


def quantile(pairs, q):
    pairs, run = sorted(pairs), 0.0
    total = sum(w for _, w in pairs)
    for v, w in pairs:
        run += w
        if run >= total * q:
            return v
    return pairs[-1][0]


def halves(samples, q, most):
    """{half: (value, n)} of samples (half, ts, value, weight) if they differ."""
    out = {}
    for h in (0, 1):
        mine = [s for s in samples if s[0] == h]
        if len({s[1] // 86400 for s in mine}) < 10 or sum(s[3] for s in mine) < 4:
            return {}
        out[h] = (min(quantile([s[2:] for s in mine], q), most), sum(s[3] for s in mine))
    return out if abs(out[0][0] - out[1][0]) >= 0.18 else {}


def absolute(rows):
    """{(string, cell, half): (cell, n, reference)}."""
    by, out = defaultdict(list), {}
    for r in rows:
        by[r[1], r[3:5]].append((r[5], r[2], r[6], r[7]))
    for string in {k[0] for k in by}:
        cells = {}
        for (s, c), samples in by.items():
            if s == string and sum(x[3] for x in samples) >= 4:
                cells[c, None] = (quantile([x[2:] for x in samples], 0.8), sum(x[3] for x in samples))
                cells |= {(c, h): v for h, v in halves(samples, 0.8, math.inf).items()}
        pooled = [v for (_, h), v in cells.items() if h is None]
        level = min(quantile(pooled, 0.9), 0.0) if pooled else 0.0
        out |= {(string, *k): (*v, level) for k, v in cells.items()}
    return out


def blended(shade, beam):
    return math.log(max(1 - beam * (1 - math.exp(shade)), 0.05))


def joint(rows):
    """{(string, cell, half): (cell, n, raw, level)} of one plant's rows."""
    met = defaultdict(set)
    for r in rows:
        met[r[2]].add(r[1])
    mine = [r for r in rows if sum(len(x) > 1 and r[1] in x for x in met.values()) >= 50]
    strings = {r[1] for r in mine}
    if len(strings) < 2:
        return {}, set()
    epochs = defaultdict(list)
    for r in mine:
        epochs[r[2]].append(r)
    level = {s: sum(r[6] * r[7] for r in mine if r[1] == s) / sum(r[7] for r in mine if r[1] == s) for s in strings}
    shade, beam = {}, lambda r: 0.5 if r[8] is None else r[8]
    for _ in range(3):
        sums = {}
        for t, m in epochs.items():
            if len({r[1] for r in m}) > 1:
                pull = [r[7] * (r[9] if all(x[9] is not None for x in m) else 1.0) for r in m]
                sums[t] = (sum(p * (r[6] - level[r[1]] - blended(shade.get((r[1], r[3:5]), (0.0,))[0], beam(r))) for p, r in zip(pull, m)), sum(pull))
        centre = sum(a for a, _ in sums.values()) / sum(b for _, b in sums.values())
        tau = {t: a / b - centre for t, (a, b) in sums.items()}
        for s in strings:
            own = [r for r in mine if r[1] == s and r[2] in tau]
            level[s] = sum(r[7] * (r[6] - tau[r[2]] - blended(shade.get((s, r[3:5]), (0.0,))[0], beam(r))) for r in own) / sum(r[7] for r in own)

        def left():
            out = defaultdict(list)
            for r in mine:
                if r[2] in tau and r[7] * beam(r) > 0:
                    x = 1 - (1 - math.exp(r[6] - level[r[1]] - tau[r[2]])) / max(1.0 if r[8] is None else r[8], 1e-6)
                    out[r[1], r[3:5]].append((r[5], r[2], math.log(min(max(x, 0.05), 1.0)), r[7] * beam(r)))
            return out

        cells = {k: (quantile([x[2:] for x in v], 0.5), sum(x[3] for x in v)) for k, v in left().items() if sum(x[3] for x in v) >= 4}
        shade = {}
        for s in {k[0] for k in cells}:
            zero = quantile([v for k, v in cells.items() if k[0] == s], 0.9)
            level[s] += zero
            shade |= {k: (min(v - zero, 0.0), n) for k, (v, n) in cells.items() if k[0] == s}
    out = {}
    for k, v in shade.items():
        seen = [(r[5], r[6], r[7]) for r in mine if (r[1], r[3:5]) == k]
        out[*k, None] = (*v, quantile([x[1:] for x in seen], 0.8), level[k[0]])
        out |= {(*k, h): (*x, quantile([y[1:] for y in seen if y[0] == h], 0.8), level[k[0]]) for h, x in halves(left()[k], 0.5, 0.0).items()}
    return out, strings


def a_plant(plant, seed, strings="abc", days=60):
    """Days in both halves of the year; string a has a shadow that one half
    alone sees, string e meets no other."""
    rnd, rows = random.Random(seed), []
    for day in range(days):
        half = day % 2
        for s in strings:
            for i in range(4):
                shadow = -0.7 if s == "a" and i == 1 and half else -0.3 if s == "b" and i == 2 else 0.0
                beam = rnd.choice([None, 1.0, rnd.random()])
                rows.append((plant, s, day * 86400 + i * 300, 18 + i, 6, half, shadow + rnd.gauss(0, 0.03) + 0.1 * math.sin(day), rnd.uniform(0.4, 1.0), beam, rnd.choice([None, 500.0, 900.0])))
        rows.append((plant, "e", day * 86400 + 7000, 20, 7, half, (-0.5 if half else -0.1) + rnd.gauss(0, 0.02), rnd.uniform(0.4, 1.0), None, None))
    return rows


def test_joint_map_of_three_plants_at_once(spark):
    """Two plants whose strings meet, and one with a single string."""
    rows = a_plant("p", 1) + a_plant("q", 2, "ab", 56) + a_plant("r", 3, "a")
    got = {(r.plant_id, r.string_id, (r.az_bin, r.el_bin), r.half): r for r in joint_fit(spark.createDataFrame(rows, KEYS)).collect()}
    want = {}
    for plant in "pqr":
        mine = [r for r in rows if r[0] == plant]
        fitted, strings = joint(mine)
        want |= {(plant, *k): ("differential", c, n, 0.0, raw, level) for k, (c, n, raw, level) in fitted.items()}
        want |= {(plant, *k): ("absolute", c, n, level, c, level) for k, (c, n, level) in absolute([r for r in mine if r[1] not in strings]).items()}
    assert got.keys() == want.keys()
    for k, (method, *numbers) in want.items():
        r = got[k]
        assert r.method == method and [r.cell, r.n, r.reference, r.raw, r.level] == pytest.approx(numbers, abs=1e-9), k
        assert r.value == pytest.approx(max(math.log(0.05), min(0.0, r.cell * r.n / (r.n + 6) - r.reference)), abs=1e-12)
    kinds = {(k[0], k[1], k[3] is None): v[0] for k, v in want.items()}
    assert kinds["p", "a", False] == "differential" and kinds["p", "e", False] == "absolute" and kinds["r", "a", True] == "absolute"


def test_evidence_is_weight(spark):
    """One cell by hand: five rows of weight 0.9 are 4.5, not 5."""
    rows = [("a", 10, 4, x, 0.9) for x in (-0.8, -0.6, -0.5, -0.4, -0.3)] + [("a", 11, 4, -0.2, 2.0)] * 30
    out = {r.az_bin: r for r in absolute_fit(spark.createDataFrame(rows, "string_id string, az_bin int, el_bin int, logr double, w double")).collect()}
    # 0.8 * 4.5 = 3.6 is reached at the fourth row; the reference is the other cell's.
    assert out[10].raw == -0.4 and out[10].n == pytest.approx(4.5) and out[10].level == -0.2
    assert out[10].value == pytest.approx(min(0.0, -0.4 * 4.5 / 10.5 + 0.2)) and out[11].value == pytest.approx(-0.2 * 60 / 66 + 0.2 if -0.2 * 60 / 66 + 0.2 < 0 else 0.0)


def test_neighbours_are_a_cell_of_their_mean_weight(spark):
    cells = spark.createDataFrame([("a", 35, 4, -0.9, 4.0, -0.1, -0.26), ("a", 1, 5, -0.6, 12.0, -0.1, -0.3)], "string_id string, az_bin int, el_bin int, cell double, n double, reference double, value double")
    ask = spark.createDataFrame([("a", 0, 4), ("a", 35, 4), ("a", 20, 4), ("b", 0, 4)], "string_id string, az_bin int, el_bin int")
    got = {(r.string_id, r.az_bin): r.factor for r in sky_lookup(ask, cells).collect()}
    mean = (-0.9 * 4 - 0.6 * 12) / 16
    assert got == {("a", 0): pytest.approx(math.exp(mean * 8 / 14 + 0.1)), ("a", 35): pytest.approx(math.exp(-0.26)), ("a", 20): 1.0, ("b", 0): 1.0}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.8, 1.0])
def test_weighted_quantile(spark, q):
    """Ties, zero weights, a group of half the rows, one value, tiny steps."""
    rnd = random.Random(9)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), -0.5, 0.25]), float(rnd.randrange(4))) for _ in range(2000)]
    rows += [(f"g{i % 40}", rnd.choice([-1.0, 0.0, 0.001, rnd.gauss(-1, 2)]), rnd.choice([0.0, 0.5, 2.0])) for i in range(1500)]
    rows += [("zero", x, 0.0) for x in (3.0, 1.0, 2.0)] + [("one", -0.0, 1.0), ("close", 1e-9, 1.0), ("close", 2e-9, 1.0), ("close", 3e-9, 1.0)]
    by = defaultdict(list)
    for k, v, w in rows:
        by[k].append((v, w))
    got = {r.k: (r.quantile, r.total, r.n) for r in weighted_quantile(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", q).collect()}
    assert got == {k: (quantile(v, q), sum(w for _, w in v), len(v)) for k, v in by.items()}
