"""The joint fit against a plain loop over all rows."""

import math
import random

import pytest

from solarloom.operators.shading import joint_fit

KEYS = "ts_utc long, string_id string, az_bin int, el_bin int, logr double, w double, beam double, physics_w double"


def quantile(pairs, q):
    pairs, run = sorted(pairs), 0.0
    total = sum(w for _, w in pairs)
    for v, w in pairs:
        run += w
        if run >= total * q:
            return v
    return pairs[-1][0]


def absolute(rows):
    cells = {}
    for _, _, a, e, x, w, _, _ in rows:
        cells.setdefault((a, e), []).append((x, w))
    cells = {k: (quantile(v, 0.8), sum(w for _, w in v)) for k, v in cells.items() if sum(w for _, w in v) >= 4}
    level = min(quantile(list(cells.values()), 0.9), 0.0) if cells else 0.0
    return {k: (min(v - level, 0.0), n, level, "absolute") for k, (v, n) in cells.items()}


def brute(rows):
    rows = [r for r in rows if r[5] > 0]
    strings = {r[1] for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r[0], set()).add(r[1])
    joint = {s for s in strings if sum(len(x) >= 2 and s in x for x in by.values()) >= 50}
    if len(joint) < 2:
        joint = set()
    mine = [r for r in rows if r[1] in joint]
    epochs = {}
    for r in mine:
        epochs.setdefault(r[0], []).append(r)
    level = {s: sum(r[4] * r[5] for r in mine if r[1] == s) / sum(r[5] for r in mine if r[1] == s) for s in joint}
    shade, out = {}, {}

    def cast(r):
        return math.log(max(1 - (0.5 if r[6] is None else r[6]) * (1 - math.exp(shade.get(r[1:4], (0.0,))[0])), 0.05))

    for _ in range(3):
        sums = {}
        for t, m in epochs.items():
            if len({r[1] for r in m}) >= 2:
                watts = all(r[7] is not None for r in m)
                pull = [r[5] * (r[7] if watts else 1.0) for r in m]
                if sum(pull) > 0:
                    sums[t] = (sum(p * (r[4] - level[r[1]] - cast(r)) for p, r in zip(pull, m)), sum(pull))
        centre = sum(a for a, _ in sums.values()) / sum(b for _, b in sums.values()) if sums else 0.0
        tau = {t: a / b - centre for t, (a, b) in sums.items()}
        tied = [r for r in mine if r[0] in tau]
        for s in {r[1] for r in tied}:
            level[s] = sum(r[5] * (r[4] - tau[r[0]] - cast(r)) for r in tied if r[1] == s) / sum(r[5] for r in tied if r[1] == s)
        cells = {}
        for r in tied:
            w = r[5] * (0.5 if r[6] is None else r[6])
            if w > 0:
                x = 1 - (1 - math.exp(r[4] - level[r[1]] - tau[r[0]])) / max(1.0 if r[6] is None else r[6], 1e-6)
                cells.setdefault(r[1:4], []).append((math.log(min(max(x, 0.05), 1.0)), w))
        cells = {k: (quantile(v, 0.5), sum(w for _, w in v)) for k, v in cells.items() if sum(w for _, w in v) >= 4}
        shade = {}
        for s in {k[0] for k in cells}:
            own = {k: v for k, v in cells.items() if k[0] == s}
            zero = quantile(list(own.values()), 0.9)
            level[s] += zero
            shade |= {k: (min(v - zero, 0.0), n) for k, (v, n) in own.items()}
    out = {k: (*v, level[k[0]], "differential") for k, v in shade.items()}
    for s in strings - joint:
        out |= {(s, *k): v for k, v in absolute([r for r in rows if r[1] == s]).items()}
    return out


def check(spark, rows):
    got = {(r.string_id, r.az_bin, r.el_bin): (r.shade, r.n, r.level, r.method) for r in joint_fit(spark.createDataFrame(rows, KEYS)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
    return want


def plant(extra):
    """Strings a, b and c, of which c has thin cells; d shares few epochs with
    the others, and some epochs only with one string that stays."""
    rnd = random.Random(7)
    rows = []
    for t in range(160):
        for s in "abc":
            if rnd.random() < 0.85:
                cell = (t % 5, 2) if s != "c" or t % 4 else (10 + t % 24, 3)
                shadow = -0.6 if s == "a" and t % 5 == 1 else 0.0
                rows.append((t, s, *cell, shadow + 0.3 * math.sin(t) + rnd.gauss(0, 0.05) + "abc".index(s) * 0.1, rnd.uniform(0.6, 1.0), *extra(rnd)))
    for t in (*range(20), *range(1000, 1040)):
        rows.append((t, "d", t % 3, 1, rnd.gauss(-0.5, 0.3), rnd.uniform(0.6, 1.0), *extra(rnd)))
        if t >= 1000:
            rows.append((t, "a", t % 3, 1, rnd.gauss(-0.5, 0.3), rnd.uniform(0.6, 1.0), *extra(rnd)))
    return rows


@pytest.mark.parametrize("d_epochs", [30, 60])
def test_thin_cells_and_a_solo_string(spark, d_epochs):
    rows = [r for r in plant(lambda r: (None, None)) if r[1] != "d" or r[0] < 1000 + d_epochs - 20]
    rows.append((1, "a", 1, 2, 0.5, 0.0, None, None))
    want = check(spark, rows)
    kinds = {k[0]: v[3] for k, v in want.items()}
    assert kinds["a"] == "differential" and kinds["d"] == ("absolute" if d_epochs < 50 else "differential")
    assert not any(k[0] == "c" and k[2] == 3 for k in want)


def test_beam_and_watts(spark):
    rows = plant(lambda r: (r.choice([None, r.uniform(-0.1, 1)]), r.uniform(1, 900) if r.random() < 0.9 else None))
    check(spark, [(*r[:6], None if r[6] is None else max(0.0, r[6]), r[7]) for r in rows])


def test_absolute_where_no_two_strings_meet(spark):
    rows = [(t * 2 + (s == "b"), s, t % 3, 1, -0.1 * (t % 4), 0.7 + t / 331, None, None) for t in range(60) for s in "ab"]
    assert {v[3] for v in check(spark, rows).values()} == {"absolute"}
    assert joint_fit(spark.createDataFrame([], KEYS)).count() == 0


def test_tasks_follow_rows(spark, monkeypatch):
    """Quantiles of the fit are dealt to as many tasks as rows ask for, and
    give what they give undealt."""
    from solarloom.operators import shading

    rows = plant(lambda r: (None, None))
    seen = []
    made = shading.weighted_quantile

    def watched(*args, parts=None, **named):
        seen.append((args[2], parts))
        return made(*args, parts=parts, **named)

    monkeypatch.setattr(shading, "TASK_ROWS", 100)
    monkeypatch.setattr(shading, "weighted_quantile", watched)
    check(spark, rows)
    assert {p for v, p in seen if v == "left"} == {-(-sum(r[1] != "d" for r in rows) // 100)} or {p for v, p in seen if v == "left"} == {-(-len(rows) // 100)}
