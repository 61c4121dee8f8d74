"""From issues and measurements to what is published: nowcast, outlook, hour
classes, day sums, group verdicts, bias observations, backfill and health
(CMP-*, MET-*). Every step is one aggregate or window on its own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import predicates as R


def grid_between(hourly: DataFrame, state: DataFrame, start: int, end: int) -> DataFrame:
    """Two-tier import and export of the plant (AGG-08): whole hours from the
    hourly table, ragged ends and missing hours from the five-minute rows."""
    first, last = -(-start // 3600) * 3600, end // 3600 * 3600
    whole = hourly.filter((F.col("ts_utc") >= first) & (F.col("ts_utc") < last)).select("ts_utc", "imported_kwh", "exported_kwh")
    raw = state.filter((F.col("ts_utc") >= start) & (F.col("ts_utc") < end)).withColumn("hour", R.floor_to("ts_utc", 3600))
    rest = raw.join(whole.select(F.col("ts_utc").alias("hour")).distinct(), "hour", "left_anti")
    grid, kwh = F.col("grid_power_w"), C.INTERVAL_S / 3600.0 / 1000.0
    rest = rest.select("ts_utc", F.when(grid > 0, grid * kwh).otherwise(0.0).alias("imported_kwh"), F.when(grid < 0, -grid * kwh).otherwise(0.0).alias("exported_kwh"))
    return whole.unionByName(rest).agg(F.sum("imported_kwh").alias("imported_kwh"), F.sum("exported_kwh").alias("exported_kwh"))


def peak_hour(hours: DataFrame, by: list[str]) -> DataFrame:
    """The hour of most energy, the first on ties (AGG-24)."""
    return hours.groupBy(*by).agg(F.max_by("ts_utc", F.struct("value", -F.col("ts_utc"))).alias("peak_ts_utc"), F.max("value").alias("peak_kwh"))


def outlook(newest: DataFrame, by: list[str]) -> DataFrame:
    """Highest rain probability, mean cloud cover, summed rain (AGG-10)."""
    return newest.groupBy(*by).agg(F.round(F.max("rain_probability_pct"), 1).alias("rain_probability_pct"), F.round(F.avg("clouds_pct"), 1).alias("clouds_pct"), F.round(F.sum("rain_mm"), 2).alias("rain_mm"))


def classify_hours(conditions: DataFrame) -> DataFrame:
    """Weather class and daypart of each hour (AGG-15); the clearness index
    counts only above 20 W/m2 of clear sky. ``noon_ts`` is solar noon."""
    hours = conditions.groupBy("hour").agg(F.avg("ghi").alias("ghi"), F.avg("cs_ghi").alias("cs"), F.max("rain_mm").alias("rain"), F.avg("clouds_pct").alias("clouds"), F.max("noon_ts").alias("noon"))
    kc = F.when(F.col("cs") > 20, F.col("ghi") / F.col("cs"))
    return hours.select("hour", R.weather_class("rain", kc, "clouds").alias("weather"), R.daypart((F.col("hour") + 1800 - F.col("noon")) / 3600).alias("part"))


def sky_state(rows: DataFrame, by: list[str], source=None, learning=None, window_s: int = 900) -> DataFrame:
    """Clearness, restlessness and the reason there is none, of each window of
    ``measured``, ``forecast`` and ``clearsky`` (AGG-22, CMP-02, FLT-19). Without
    a ``source`` or with ``learning`` off (boolean columns, constant in a window)
    there is none; a window that ends (``end``, with ``ts_utc`` of the rows)
    more than ``window_s`` after its last measurement is stale."""
    m, f, c = F.col("measured"), F.col("forecast"), F.col("clearsky")
    usable = (c > 50) & (m >= 0)
    compared = usable & (f > 5)
    inside = compared & (m / f > 0.05) & (m / f < 5)
    got = rows.groupBy(*by).agg(
        F.count("measured").alias("seen"), F.count_if(c > 50).alias("lit"), F.count_if(usable).alias("intervals"), F.median(F.when(usable, m / c)).alias("kt"),
        F.count_if(compared).alias("compared"), F.count_if(inside).alias("inside"), F.stddev_pop(F.when(inside, F.log(m / f))).alias("spread"),
        F.min("measured").alias("low"), F.max("measured").alias("high"),
        F.bool_and(F.lit(True) if source is None else source).alias("source"), F.bool_and(F.lit(True) if learning is None else learning).alias("learning"),
        (F.max(F.when(m.isNotNull(), F.col("ts_utc"))) < F.max("end") - window_s if "end" in rows.columns else F.lit(False)).alias("stale"))
    reason = (F.when(~F.col("source"), "no_source").when(~F.col("learning"), "learning_off").when(F.col("seen") == 0, "no_measurement").when(F.col("stale"), "stale").when((F.col("seen") >= 3) & (F.col("high") > 50) & (F.col("low") == F.col("high")), "frozen")
              .when(F.col("lit") < 3, "too_dark").when(F.col("intervals") < 3, "thin").when(F.col("kt") <= 0, "too_dark").otherwise(""))
    spread = F.when((F.col("compared") >= 3) & (F.col("inside") >= 3), F.col("spread"))
    got = got.withColumn("reason", reason).withColumn("spread", F.when(F.col("reason") == "", spread))
    ok = F.col("reason") == ""
    return got.select(*by, F.when(ok, F.least(F.col("kt"), F.lit(1.1))).alias("kt"), "spread", "intervals", F.when(ok, F.when(F.col("spread") <= 0.143, 4200.0).otherwise(1860.0)).alias("halflife_s"), "reason")


def apply_nowcast(conditions: DataFrame) -> DataFrame:
    """Blend the measured clearness into coming, covered intervals (CMP-03).
    Touched rows lose dni and dhi, which the power chain derives anew; all
    others stay bit for bit. Needs ghi, cs_ghi, dni, dhi, covered, horizon_s,
    kt, spread and n_eff."""
    weight = F.when(F.col("covered"), R.persistence_weight("horizon_s", "spread", "n_eff")).otherwise(0.0)
    out = conditions.withColumn("nowcast_weight", weight).withColumn("ghi", R.blend("nowcast_weight", "kt", "cs_ghi", "ghi"))
    untouched = F.col("nowcast_weight") <= 0
    return out.withColumn("dni", F.when(untouched, F.col("dni"))).withColumn("dhi", F.when(untouched, F.col("dhi")))


def unshaded(power, applied, nameplate, cap=None):
    """Power before shading, within nameplate and tracker cap (CMP-04)."""
    free = F.coalesce(F.try_divide(R._c(power), R._c(applied)), R._c(power))
    return F.least(free, R._c(nameplate), *([R._c(cap)] if cap is not None else []))


def log_rows(forecast: DataFrame, issued_at: str = "issued_at_utc") -> DataFrame:
    """Rows to log (SNK-15): issue floored to the hour, later hours only."""
    out = forecast.withColumn(issued_at, R.floor_to(issued_at, 3600))
    return out.filter(F.col("ts_utc") > F.col(issued_at)).withColumn("potential_kwh", F.round("potential_kwh", 5))


def group_binding(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Group verdicts (JON-08, CMP-06): sums only where every member has power
    and potential, the limit of the last member that has one. ``members`` has
    group_id, string_id and pos, and is small."""
    want = members.groupBy("group_id").agg(F.count("*").alias("want"))
    both = F.col("power_mean_w").isNotNull() & F.col("physics_w").isNotNull()
    got = rows.join(members, "string_id").groupBy("group_id", "ts_utc").agg(
        F.count_if(both).alias("have"), F.sum("power_mean_w").alias("measured_w"), F.sum("physics_w").alias("physics_w"),
        F.max_by("limit_commanded_w", F.when(F.col("limit_commanded_w").isNotNull(), F.col("pos"))).alias("limit_w")).join(want, "group_id")
    whole = F.col("have") == F.col("want")
    got = got.select("group_id", "ts_utc", *[F.when(whole, F.col(c)).alias(c) for c in ("measured_w", "physics_w", "limit_w")])
    return got.withColumn("binding", R.is_binding("measured_w", "limit_w", "physics_w"))


def plant_power(rows: DataFrame, strings: int) -> DataFrame:
    """Sum over all strings, NULL while one is missing (CMP-25)."""
    return rows.groupBy("ts_utc").agg(F.when(F.count("power_mean_w") == strings, F.sum("power_mean_w")).alias("power_w"))


def bias_observations(issues: DataFrame, measured: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What each issue got wrong (CMP-08): truth is the measured hour, else the
    newest issue within two hours of it; dark hours, analyses and an issue that
    is its own truth don't count. ``by``: further keys of the issues, each
    with a newest issue of its own."""
    near = issues.groupBy("ts_utc", *by).agg(F.max_by("ghi_wm2", F.when((F.col("horizon_h") <= 2) & F.col("ghi_wm2").isNotNull(), F.col("issued_at_utc"))).alias("near"))
    there = ["ts_utc", *[c for c in by if c in measured.columns]]
    truth = near.join(measured.select(*there, F.col("ghi").alias("measured")), there, "left").select("ts_utc", *by, F.coalesce("measured", "near").alias("truth")).filter("truth > 5")
    rows = issues.filter("ghi_wm2 is not null and horizon_h >= 0").join(truth, ["ts_utc", *by]).filter("not (horizon_h <= 2 and truth = ghi_wm2) and ghi_wm2 > 5")
    rows = rows.filter((F.col("truth") / F.col("ghi_wm2")).between(C.RATIO_LOW, C.RATIO_HIGH)).withColumn("residual", F.log(F.col("truth") / F.col("ghi_wm2")))
    return rows.select("ts_utc", *by, "issued_at_utc", "horizon_h", R.horizon_bucket("horizon_h").alias("bucket"), "truth", "ghi_wm2", "residual", R.bias_weight("truth").alias("weight"))


def implausible_hours(rows: DataFrame, kwp: float, least: float = 0.8 * 12) -> DataFrame:
    """Hours whose energy no sky could give (CMP-07), judged where enough of
    their twelve intervals have a ceiling."""
    hours = rows.groupBy(R.floor_to("ts_utc", 3600).alias("hour")).agg(F.countDistinct("ts_utc").alias("n"), F.avg("ceiling_w").alias("ceiling"), F.sum("energy_wh").alias("actual"))
    return hours.filter(F.col("n") >= least).filter(R.exceeds_ceiling("actual", "ceiling", R.judgement_floor(F.lit(kwp)))).select("hour", "ceiling", "actual")


def backfill_rows(history: DataFrame) -> DataFrame:
    """Shading observations from hourly history (CMP-16, FLT-17): needs hour,
    string_id, actual_w, expected_w, nameplate_w, azimuth_deg, elevation_deg."""
    ratio = F.col("actual_w") / F.col("expected_w")
    fit = history.filter("elevation_deg >= 8 and actual_w >= 0").filter(F.col("expected_w") >= F.greatest(F.lit(25.0), 0.02 * F.col("nameplate_w"))).filter(ratio.between(0.02, 2.5))
    return fit.select((F.col("hour") + 1801).alias("ts_utc"), "string_id", "azimuth_deg", "elevation_deg", ratio.alias("ratio"), F.lit(0.35).alias("weight"), F.col("expected_w").alias("physics_w"))


def health_runs(updates: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """Consecutive bad updates and the report on the one that reaches
    ``limit``, armed again by a good one (CMP-21, WIN-09, STR-09). Runs are
    counted within days, and what each day leaves open is carried on over the
    few rows of day totals, so no task sorts a whole history."""
    day = F.floor(F.col("ts_utc") / 86400)
    rows = updates.withColumn("__day", day)
    bad, good = F.when(F.col("bad"), 1).otherwise(0), F.when(F.col("bad"), 0).otherwise(1)
    order = Window.partitionBy(*by, "__day").orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__island", F.sum(good).over(order))
    rows = rows.withColumn("__run", F.sum(bad).over(Window.partitionBy(*by, "__day", "__island").orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy(*by, "__day").agg(F.max("__island").alias("goods"), F.max_by("__run", "ts_utc").alias("open"))
    over = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("__piece", F.sum(F.when(F.col("goods") > 0, 1).otherwise(0)).over(over))
    piece = Window.partitionBy(*by, "__piece").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("__held", F.sum("open").over(piece))
    days = days.select(*by, "__day", F.lag("__held", 1, 0).over(Window.partitionBy(*by).orderBy("__day")).alias("__carried"))
    run = F.when(F.col("bad") & (F.col("__island") == 0), F.col("__run") + F.col("__carried")).otherwise(F.col("__run"))
    out = rows.join(days, [*by, "__day"]).withColumn("run", run)
    return out.withColumn("report", F.col("bad") & (F.col("run") == limit)).select(*updates.columns, "run", "report")


def day_sums(newest: DataFrame, now: int, by: list[str]) -> DataFrame:
    """Published sums at ``now`` (MET-01..04, MET-19): today without hours is
    0, tomorrow is NULL; the started hour counts as remaining."""
    day, hour = now // 86400 * 86400, now // 3600 * 3600

    def total(start, end):
        return F.sum(F.when((F.col("ts_utc") >= start) & (F.col("ts_utc") < end), F.col("potential_kwh")))

    return newest.filter((F.col("ts_utc") >= day) & (F.col("ts_utc") < day + 3 * 86400)).groupBy(*by).agg(
        F.coalesce(total(day, day + 86400), F.lit(0.0)).alias("today"), total(day + 86400, day + 2 * 86400).alias("tomorrow"), total(day + 2 * 86400, day + 3 * 86400).alias("day_after"),
        F.coalesce(total(hour, day + 86400), F.lit(0.0)).alias("remaining"), total(hour + 3600, hour + 7200).alias("next_hour"), (total(hour, hour + 3600) * 1000).alias("now_w"))


def period_share(start, end, weights: list[float]):
    """Share of a typical year from ``start`` to ``end``, both included
    (SCL-26); 0 if they are swapped. Stays in the row: no shuffle."""
    shares = F.array(*[F.lit(w / sum(weights)) for w in weights])
    days = F.aggregate(F.sequence(R._c(start), F.greatest(R._c(start), R._c(end)), F.expr("interval 1 day")), F.lit(0.0), lambda a, d: a + F.get(shares, F.month(d) - 1) / F.dayofmonth(F.last_day(d)))
    return F.when(R._c(end) < R._c(start), 0.0).otherwise(days)
