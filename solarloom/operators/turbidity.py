"""Linke turbidity by site and season from a gridded climatology (PHY-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import turbidity as climatology

#: Cells to a degree, rows and columns of the grid; row 0 is the northernmost.
PER_DEGREE, ROWS, COLUMNS = 12, 2160, 4320


def grid_cell(lat, lon) -> tuple[Column, Column]:
    """Row and column of the cell whose middle is nearest."""
    half = 0.5 / PER_DEGREE
    row = F.rint((90 - half - F.col(lat)) * PER_DEGREE)
    column = F.rint((F.col(lon) + 180 - half) * PER_DEGREE)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(n - 1), x)).cast("int") for x, n in ((row, ROWS), (column, COLUMNS)))


def between_months(day) -> tuple[Column, Column, Column]:
    """The months (1 to 12) whose middles are around a date, and how far from
    the first to the second it is."""
    date = F.col(day)
    first = F.trunc(date, "month")
    own, before, after = (F.dayofmonth(F.last_day(F.add_months(first, m))) for m in (0, -1, 1))
    at, month = F.dayofmonth(date), F.month(date)
    late = at >= own / 2
    share = F.when(late, (at - own / 2) / (own / 2 + after / 2)).otherwise((at + before / 2) / (before / 2 + own / 2))
    return F.when(late, month).otherwise(F.when(month == 1, 12).otherwise(month - 1)), F.when(late, F.when(month == 12, 1).otherwise(month + 1)).otherwise(month), share


def site_turbidity(site_days: DataFrame, grid: DataFrame) -> DataFrame:
    """``site_days`` (lat, lon, day as a date) with ``turbidity`` and whether
    it is ``gridded``. ``grid`` has row, col, month, value; values are of the
    middles of their months and run in straight lines between them. Where
    either month is not in the grid, latitude and season give the value. Two
    equi-joins of the distinct cells and days, so the grid is read by key."""
    names = site_days.columns
    row, col = grid_cell("lat", "lon")
    low, high, share = between_months("day")
    rows = site_days.withColumn("__row", row).withColumn("__col", col).withColumn("__a", low).withColumn("__b", high).withColumn("__share", share)
    for month in "ab":
        g = grid.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("month").alias(f"__{month}"), F.col("value").alias(f"__v{month}"))
        rows = rows.join(g, ["__row", "__col", f"__{month}"], "left")
    found = F.col("__va") + (F.col("__vb") - F.col("__va")) * F.col("__share")
    rows = rows.withColumn("__doy", F.dayofyear("day"))
    return rows.select(*names, F.coalesce(found, F.expr(climatology("lat", "__doy"))).alias("turbidity"), found.isNotNull().alias("gridded"))
