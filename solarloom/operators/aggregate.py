"""Integration of irregular samples and the folds over time (AGG-*)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.predicates import floor_to


def integrate(samples: DataFrame, watchdog_s: float = C.WATCHDOG_S, entity: str = "entity_id", step: int = C.INTERVAL_S) -> DataFrame:
    """Trapezoids between neighbouring non-null samples, cut at the interval
    edges (AGG-01). Spans over max(60, 2.5 * watchdog) seconds are gaps, and
    a null sample breaks its span. One shuffle on (entity, day) for the
    pairing, one on (entity, interval) with partial sums, so a long history is
    never sorted in one task; a sample that the next day may still be paired
    with is dealt to both days. Per (entity, ts_utc): energy_wh, power_mean_w,
    coverage, sample_count, peak_w."""
    gap = max(60.0, 2.5 * watchdog_s)
    day_s = 86400 * math.ceil(gap / 86400)
    own, last = (F.floor(t / day_s) for t in (F.col("ts_utc"), F.col("ts_utc") + gap))
    dealt = samples.select(entity, "ts_utc", "value", own.alias("own"), F.explode(F.when(last > own, F.array(own, last)).otherwise(F.array(own))).alias("day"))
    by = Window.partitionBy(entity, "day").orderBy("ts_utc")
    pairs = dealt.select(entity, F.col("ts_utc").alias("t1"), F.col("value").alias("v1"), F.lag("ts_utc").over(by).alias("t0"), F.lag("value").over(by).alias("v0"), "own", "day").filter("own = day")
    spans = pairs.filter("v0 is not null and v1 is not null and t1 > t0").filter(F.col("t1") - F.col("t0") <= gap)
    first, last = floor_to("t0", step), floor_to("t1", step)
    pieces = spans.select("*", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("w"))
    a, b = F.greatest("t0", F.col("w").cast("double")), F.least("t1", (F.col("w") + step).cast("double"))
    slope = (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))
    pieces = pieces.select(entity, "w", a.alias("a"), b.alias("b"), (F.col("v0") + slope * (a - F.col("t0"))).alias("va"), (F.col("v0") + slope * (b - F.col("t0"))).alias("vb")).filter("b > a")
    areas = pieces.select(entity, F.col("w").alias("ts_utc"), ((F.col("va") + F.col("vb")) / 2 * (F.col("b") - F.col("a"))).alias("area"), (F.col("b") - F.col("a")).alias("span"), F.greatest("va", "vb").alias("top"), F.lit(0).alias("n"))
    points = samples.filter("value is not null").select(entity, floor_to("ts_utc", step).alias("ts_utc"), F.lit(None).cast("double").alias("area"), F.lit(None).cast("double").alias("span"), F.col("value").alias("top"), F.lit(1).alias("n"))
    got = areas.unionByName(points).groupBy(entity, "ts_utc").agg(F.sum("area").alias("ws"), F.sum("span").alias("span"), F.max("top").alias("top"), F.sum("n").alias("sample_count"))
    held = F.col("span") > 0
    return got.select(entity, "ts_utc", F.when(held, F.col("ws") / 3600).alias("energy_wh"), F.when(held, F.col("ws") / F.col("span")).alias("power_mean_w"),
                      F.when(held, F.least(F.lit(1.0), F.col("span") / step)).otherwise(0.0).alias("coverage"), "sample_count", F.when(held, F.col("top")).alias("peak_w"))


def mean_and_last(samples: DataFrame, entity: str = "entity_id", step: int = C.INTERVAL_S) -> DataFrame:
    """Mean and last valid value in each interval (AGG-02, AGG-03)."""
    return samples.filter("value is not null").groupBy(entity, floor_to("ts_utc", step).alias("w")).agg(
        F.avg("value").alias("mean_value"), F.max_by("value", "ts_utc").alias("last_value")).withColumnRenamed("w", "ts_utc")


def fold_hourly(fivemin: DataFrame) -> DataFrame:
    """Five-minute rows to hours (AGG-04): missing energy adds nothing, the
    weakest kind wins, the curtailed fraction is over known verdicts."""
    return fivemin.groupBy("string_id", floor_to("ts_utc", C.HOUR_S).alias("hour")).agg(
        (F.coalesce(F.sum("energy_wh"), F.lit(0.0)) / 1000).alias("energy_kwh"),
        F.least(F.lit(1.0), F.sum("coverage") / 12).alias("coverage"),
        F.coalesce(F.avg(F.col("limit_binding").cast("int")), F.lit(0.0)).alias("curtailed_fraction"),
        F.min("limit_commanded_w").alias("limit_min_w"), F.max("limit_commanded_w").alias("limit_max_w"), F.avg("limit_commanded_w").alias("limit_mean_w"),
        F.when(F.bool_or(F.col("value_kind") == "lower_bound"), "lower_bound").when(F.bool_or(F.col("value_kind") == "reconstructed"), "reconstructed").otherwise("measured").alias("value_kind"),
        F.count("*").alias("rows_seen")).withColumnRenamed("hour", "ts_utc")


def fold_plant(state: DataFrame) -> DataFrame:
    """Grid import and export apart, house load, mean charge (AGG-06), of each
    plant where there is a plant_id. Sums are exact decimals, divided once, so
    that no order of summing shows."""
    grid = F.col("grid_power_w")

    def kwh(watts):
        return F.sum(watts.cast("decimal(20,6)")).cast("double") * (C.INTERVAL_S / 3600.0 / 1000.0)

    return state.groupBy(*[c for c in ("plant_id",) if c in state.columns], floor_to("ts_utc", C.HOUR_S).alias("hour")).agg(
        kwh(F.when(grid > 0, grid).otherwise(0.0)).alias("imported_kwh"), kwh(F.when(grid < 0, -grid).otherwise(0.0)).alias("exported_kwh"),
        kwh(F.coalesce("house_load_w", F.lit(0.0))).alias("house_kwh"), F.avg("battery_soc_pct").alias("battery_soc_pct")).withColumnRenamed("hour", "ts_utc")


def energy_between(hourly: DataFrame, fivemin: DataFrame, start: int, end: int) -> DataFrame:
    """Two-tier total per string (AGG-07): whole hours from the hourly table
    where it has them, the ragged ends and missing hours from raw rows."""
    first, last = -(-start // 3600) * 3600, end // 3600 * 3600
    whole = hourly.filter((F.col("ts_utc") >= first) & (F.col("ts_utc") < last))
    raw = fivemin.filter((F.col("ts_utc") >= start) & (F.col("ts_utc") < end)).withColumn("hour", floor_to("ts_utc", 3600))
    have = whole.select("string_id", F.col("ts_utc").alias("hour")).distinct()
    rest = raw.join(have, ["string_id", "hour"], "left_anti").select("string_id", (F.col("energy_wh") / 1000).alias("kwh"))
    return whole.select("string_id", F.col("energy_kwh").alias("kwh")).unionByName(rest).groupBy("string_id").agg(F.sum("kwh").alias("energy_kwh"))


def interval_stats(fivemin: DataFrame) -> DataFrame:
    """Coverage, samples and curtailment of each string (AGG-09)."""
    return fivemin.groupBy("string_id").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 3).alias("coverage_mean"), F.round(F.avg("sample_count"), 1).alias("samples_mean"),
                                            F.avg(F.col("limit_binding").cast("int")).alias("curtailed_fraction"), *[F.count_if(F.col("value_kind") == k).alias(f"n_{k}") for k in ("measured", "lower_bound", "reconstructed")])


def merge_series(*series: DataFrame) -> DataFrame:
    """Sum by time over what is present (AGG-12)."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return out.groupBy("ts_utc").agg(F.round(F.sum("value"), 4).alias("value"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float, grain: int = 256, parts: int | None = None) -> DataFrame:
    """First value, in order, whose running weight reaches q of the total, else
    the last (AGG-17); with the total weight and the count of rows.

    Selection by a histogram, so that no task sorts a whole group: equal values
    are summed before the shuffle, values fall into bins of 1/``grain``, the
    running weight of the bins (some thousands a group) finds the bin where the
    share is reached, and only inside of bins are values sorted. So the largest
    task holds the different values of one bin, whatever group has most rows.
    NULL and NaN values are left out. Where most values differ, summing equal
    ones first only fills a table of them in each task: with ``parts`` rows are
    dealt by bin to as many tasks at once, for both the sums and the order."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(weight).isNotNull())
    rows = rows.select(*by, F.floor(F.col(value) * grain).alias("__bin"), F.col(value).alias("__v"), F.col(weight).alias("__w"))
    if parts is not None:
        rows = rows.repartition(parts, *by, "__bin")
    rows = rows.groupBy(*by, "__bin", "__v").agg(F.sum("__w").alias("__w"), F.count("*").alias("__n"))
    inside = Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__cum", F.sum("__w").over(inside))
    bins = rows.groupBy(*by, "__bin").agg(F.sum("__w").alias("__w"), F.sum("__n").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    bins = bins.select(*by, "__bin", F.sum("__w").over(upto).alias("__upto"), (F.sum("__w").over(upto) - F.col("__w")).alias("__before"), F.sum("__w").over(whole).alias("__all"), F.sum("__n").over(whole).alias("__count"))
    # The first bin that reaches the share; by rounding it may be the last.
    reached = F.struct((F.col("__upto") < q * F.col("__all")).alias("short"), F.when(F.col("__upto") < q * F.col("__all"), -F.col("__bin")).otherwise(F.col("__bin")).alias("at"))
    pick = bins.groupBy(*by).agg(F.min_by(F.struct("__bin", "__before", "__all", "__count"), reached).alias("p")).select(*by, "p.*")
    found = rows.select(*by, "__bin", "__v", "__cum").join(pick, [*by, "__bin"])
    return found.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("__before") + F.col("__cum") >= q * F.col("__all"), F.col("__v"))), F.max("__v")).alias("quantile"), F.max("__all").alias("total"), F.max("__count").alias("n"))


def score(pairs: DataFrame, plant_kwp: float, by: str = "day") -> DataFrame:
    """Forecast metrics (AGG-19) of rows (day, predicted, actual): WMAPE over
    days, normalised and plain MAE and bias over rows."""
    daily = pairs.groupBy(by).agg(F.sum("predicted").alias("p"), F.sum("actual").alias("a"), F.sum(F.abs(F.col("predicted") - F.col("actual"))).alias("e"), F.sum(F.col("predicted") - F.col("actual")).alias("s"), F.count("*").alias("n"))
    total = daily.agg(F.sum(F.abs(F.col("p") - F.col("a"))).alias("de"), F.sum("a").alias("da"), F.sum("e").alias("e"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("days"), F.avg(F.col("p") - F.col("a")).alias("daily_bias"))
    return total.select(F.when(F.col("da") > 0, F.col("de") / F.col("da")).alias("wmape"), (F.col("e") / F.col("n") / plant_kwp).alias("nmae"), (F.col("e") / F.col("n")).alias("mae"), (F.col("s") / F.col("n")).alias("bias"), "daily_bias", "n", "days")


def score_populations(pairs: DataFrame, plant_kwp: float) -> DataFrame:
    """Forecast metrics (AGG-19, CMP-12) of rows (day, predicted, actual,
    censored), over the uncensored ones and over all, in one pass. Under three
    days there are none, only the counts."""
    each = pairs.select("*", F.explode(F.when(F.col("censored"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("uncensored")))).alias("population"))
    miss = F.col("predicted") - F.col("actual")
    daily = each.groupBy("population", "day").agg(F.sum("predicted").alias("p"), F.sum("actual").alias("a"), F.sum(F.abs(miss)).alias("e"), F.sum(miss).alias("s"), F.count("*").alias("n"))
    total = daily.groupBy("population").agg(F.sum(F.abs(F.col("p") - F.col("a"))).alias("de"), F.sum("a").alias("da"), F.sum("e").alias("e"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("days"), F.avg(F.col("p") - F.col("a")).alias("daily_bias"))
    enough = F.col("days") >= C.SCORE_DAYS
    shown = {"wmape": F.when(F.col("da") > 0, F.col("de") / F.col("da")), "nmae": F.col("e") / F.col("n") / plant_kwp, "mae": F.col("e") / F.col("n"), "bias": F.col("s") / F.col("n"), "daily_bias": F.col("daily_bias")}
    return total.select("population", *[F.when(enough, c).alias(k) for k, c in shown.items()], "n", "days")


def score_windows(pairs: DataFrame, today, windows: tuple[int, ...], plant_kwp: float) -> DataFrame:
    """``score_populations`` over the last complete local days before ``today``
    (a date column or value), for several numbers of days at once (MET-08,
    MET-09): each day is summed once and its sums feed every window that it is
    in, whether it has 23, 24 or 25 hours. ``pairs`` has day (date), predicted,
    actual, censored. All windows and populations are there, with nulls below
    three days and counts of 0 where there is nothing."""
    miss = F.col("predicted") - F.col("actual")
    daily = pairs.groupBy("day", "censored").agg(F.sum("predicted").alias("p"), F.sum("actual").alias("a"), F.sum(F.abs(miss)).alias("e"), F.sum(miss).alias("s"), F.count("*").alias("n"))
    back = F.datediff(F.lit(today), F.col("day"))
    spans = F.array(*[F.lit(w) for w in windows])
    populations = F.when(F.col("censored"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("uncensored")))
    each = daily.select("day", "p", "a", "e", "s", "n", F.explode(populations).alias("population"), F.filter(spans, lambda w: (back >= 1) & (back <= w)).alias("in"))
    each = each.select("*", F.explode("in").alias("window_days")).groupBy("window_days", "population", "day").agg(*[F.sum(c).alias(c) for c in "paesn"])
    total = each.groupBy("window_days", "population").agg(F.sum(F.abs(F.col("p") - F.col("a"))).alias("de"), F.sum("a").alias("da"), F.sum("e").alias("e"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("days"), F.avg(F.col("p") - F.col("a")).alias("daily_bias"))
    shown = {"wmape": F.when(F.col("da") > 0, F.col("de") / F.col("da")), "nmae": F.col("e") / F.col("n") / plant_kwp, "mae": F.col("e") / F.col("n"), "bias": F.col("s") / F.col("n"), "daily_bias": F.col("daily_bias")}
    grid = pairs.sparkSession.createDataFrame([(w, p) for w in windows for p in ("all", "uncensored")], "window_days int, population string")
    out = grid.join(total, ["window_days", "population"], "left").withColumn("days", F.coalesce("days", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("window_days", "population", *[F.when(F.col("days") >= C.SCORE_DAYS, c).alias(k) for k, c in shown.items()], "n", "days")


def last_before(samples: DataFrame, end: int, entity: str = "entity_id") -> DataFrame:
    """Last valid value before ``end``, however old (AGG-03)."""
    return samples.filter(F.col("value").isNotNull() & (F.col("ts_utc") < end)).groupBy(entity).agg(F.max_by("value", "ts_utc").alias("last_value"))


def counts_by(rows: DataFrame, key: str, expected: DataFrame, usable=None) -> DataFrame:
    """Rows and usable rows of each expected key, zero where there are none
    (AGG-11). ``expected`` is the small configured dimension."""
    flag = F.lit(True) if usable is None else usable
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(flag).alias("usable"), F.min("ts_utc").alias("first_ts_utc"))
    return expected.select(key).join(got, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("usable", F.lit(0)).alias("usable"), "first_ts_utc")
