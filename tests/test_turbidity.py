"""Turbidity by cell and month against the rule written out."""

import datetime
import math

import pytest

from solarloom.operators.turbidity import site_turbidity

VALUES = [3.0, 3.2, 3.5, 3.9, 4.3, 4.6, 4.8, 4.4, 3.9, 3.4, 3.1, 2.9]


def by_rule(day):
    """Between the middles of months, in days from the first of January."""
    def days_of(year, month):
        return ((datetime.date(year + month // 12, month % 12 + 1, 1)) - datetime.date(year, month, 1)).days

    lengths = [31] + [days_of(day.year, m) for m in range(1, 13)] + [31]
    middles, start = [], -lengths[0]
    for n in lengths:
        middles.append(start + n / 2)
        start += n
    values = [VALUES[-1], *VALUES, VALUES[0]]
    at = day.timetuple().tm_yday
    i = max(j for j in range(14) if middles[j] <= at)
    return values[i] + (values[i + 1] - values[i]) * (at - middles[i]) / (middles[i + 1] - middles[i])


def test_grid_and_fallback(spark):
    # The middle of row 437 is 90 - 437.5 / 12 degrees.
    lat, lon = 90 - 437.5 / 12, -180 + 2280.5 / 12
    grid = spark.createDataFrame([(437, 2280, m + 1, v) for m, v in enumerate(VALUES)] + [(0, 0, 1, 9.0)], "row int, col int, month int, value double")
    days = [datetime.date(y, 1, 1) + datetime.timedelta(days=i) for y in (2023, 2024) for i in range(0, 365, 4)] + [datetime.date(2024, 12, 31), datetime.date(2024, 2, 29)]
    rows = [("in", lat + 0.03, lon - 0.03, d) for d in days] + [("out", -33.0, 20.0, d) for d in days] + [("edge", 90.0, -180.0, datetime.date(2024, 1, 20))]
    got = {(r.site, r.day): (r.turbidity, r.gridded) for r in site_turbidity(spark.createDataFrame(rows, "site string, lat double, lon double, day date"), grid).collect()}
    assert len(got) == len(rows)
    for d in days:
        assert got["in", d] == (pytest.approx(by_rule(d)), True)
        want = 3.5 - 0.33 + 0.8 * math.cos(2 * math.pi * (d.timetuple().tm_yday - 17.5) / 365)
        assert got["out", d] == (pytest.approx(want), False)
    assert got["edge", datetime.date(2024, 1, 20)][1] is False  # February is not there
