"""Published views over forecasts, energies and maps (CMP-22..24, MET-05..22):
each is a filter and an aggregate on its own keys; local days come from the
calendar. Nothing here collects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import predicates as R


def _between(value: str, start, end):
    return F.sum(F.when((F.col("ts_utc") >= start) & (F.col("ts_utc") < end), F.col(value)))


def local_day_sums(newest: DataFrame, now: int, tz: str, by: list[str], null_uncovered: bool = True) -> DataFrame:
    """Sums of the local day, the next and the one after, what remains with the
    started hour, and the next hour (MET-01..04, MET-19). A plant's uncovered
    tomorrow is NULL, a string's 0 (``null_uncovered`` False)."""
    rows = newest.withColumn("__now", F.lit(now).cast("long"))
    (d0, d1), (_, d2), (_, d3) = (R.day_bounds("__now", tz, k) for k in range(3))
    hour = F.lit(now // C.HOUR_S * C.HOUR_S)
    later = (lambda x: x) if null_uncovered else (lambda x: F.coalesce(x, F.lit(0.0)))
    return rows.groupBy(*by).agg(
        F.coalesce(_between("potential_kwh", d0, d1), F.lit(0.0)).alias("today"), later(_between("potential_kwh", d1, d2)).alias("tomorrow"), later(_between("potential_kwh", d2, d3)).alias("day_after"),
        F.coalesce(_between("potential_kwh", hour, d1), F.lit(0.0)).alias("remaining"), _between("potential_kwh", hour + 3600, hour + 7200).alias("next_hour"), (_between("potential_kwh", hour, hour + 3600) * 1000).alias("now_w"))


def peak_today(newest: DataFrame, now: int, tz: str, by: list[str]) -> DataFrame:
    """The first best hour of the local day and its energy (MET-05, AGG-24)."""
    rows = newest.withColumn("__now", F.lit(now).cast("long"))
    start, end = R.day_bounds("__now", tz)
    hours = rows.filter((F.col("ts_utc") >= start) & (F.col("ts_utc") < end)).groupBy(*by, "ts_utc").agg(F.sum("potential_kwh").alias("kwh"))
    best = hours.groupBy(*by).agg(F.max_by("ts_utc", F.struct("kwh", -F.col("ts_utc"))).alias("peak_ts_utc"), F.max("kwh").alias("peak_kwh"))
    return best.withColumn("peak_kwh", F.coalesce("peak_kwh", F.lit(0.0)))


def deviation_by_day(hours: DataFrame, tz: str) -> DataFrame:
    """Per local day, how far the forecast of 18:00 the evening before was off
    in percent (MET-07); NULL where nothing was produced or forecast. ``hours``
    has ts_utc, forecast_kwh and energy_kwh."""
    days = hours.groupBy(R.local_day("ts_utc", tz).alias("day")).agg(F.sum("forecast_kwh").alias("forecast_kwh"), F.sum("energy_kwh").alias("produced_kwh"))
    off = (F.col("forecast_kwh") - F.col("produced_kwh")) / F.col("produced_kwh") * 100
    return days.withColumn("deviation_pct", F.when((F.col("produced_kwh") > 0) & (F.col("forecast_kwh") != 0), off))


def savings_windows(hourly: DataFrame, grid: DataFrame, windows: DataFrame, modes: DataFrame) -> DataFrame:
    """Yield, export and money of each window and tariff (MET-10). ``windows``
    (name, start, end) and ``modes`` (mode, price, feed_in) are small; the
    hours are totalled once by window before tariffs come in."""
    def totals(rows, value, name):
        fits = (F.col("ts_utc") >= F.col("start")) & (F.col("ts_utc") < F.col("end"))
        return rows.join(F.broadcast(windows), fits).groupBy("name").agg(F.sum(value).alias(name))

    out = windows.join(totals(hourly, "energy_kwh", "yield_kwh"), "name", "left").join(totals(grid, "exported_kwh", "export_kwh"), "name", "left")
    tariffs = F.broadcast(modes.groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("mode", "price", "feed_in")).alias("t")))
    out = out.withColumn("one", F.lit(1)).join(tariffs, "one").select("name", F.coalesce("yield_kwh", F.lit(0.0)).alias("yield_kwh"), "export_kwh", F.explode("t").alias("t"))
    return out.select("name", "t.mode", "yield_kwh", "export_kwh", R.savings("t.mode", "yield_kwh", "export_kwh", F.col("t.price"), F.col("t.feed_in")).alias("saved"))


def model_summary(effects: DataFrame) -> DataFrame:
    """Factor and evidence of every effect; an interaction only once it counts
    (MET-13)."""
    gate = 0.7 / (1 - 0.5 ** (1 / C.EMA_HALF_LIFE))
    shown = effects.filter((F.col("scope") != "string_daypart") | (F.col("n_eff") >= gate))
    return shown.select("scope", "key", F.round(F.exp(R.shrunk("value", "n_eff")), 4).alias("factor"), F.round("n_eff", 2).alias("n_eff"))


def observations_seen(effects: DataFrame) -> DataFrame:
    """Evidence of the plant's buckets (MET-13)."""
    return effects.filter("scope = 'plant'").agg(F.round(F.coalesce(F.sum("n_eff"), F.lit(0.0)), 2).alias("observations"))


def irradiance_now(hours: DataFrame) -> DataFrame:
    """Forecast and measured hour against the clear sky (MET-14): the index only
    above 5 W/m2 of it. Needs forecast_wm2, measured_wm2, clearsky_wm2."""
    f, m, c = F.col("forecast_wm2"), F.col("measured_wm2"), F.col("clearsky_wm2")
    return hours.withColumn("clearsky_index", F.when(c > 5, F.coalesce(m, f) / c)).withColumn("error_wm2", f - m).withColumn("truth", F.when(m.isNotNull(), "measured").otherwise("forecast"))


def string_details(strings_at: DataFrame, fivemin: DataFrame, daylight: DataFrame) -> DataFrame:
    """Geometry in force and interval statistics within daylight (MET-15).
    ``daylight`` has string_id, start, end."""
    from .aggregate import interval_stats

    rows = fivemin.join(F.broadcast(daylight), "string_id").filter("ts_utc >= start and ts_utc < end").drop("start", "end")
    return strings_at.join(interval_stats(rows), "string_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def collector_health(fivemin: DataFrame) -> DataFrame:
    """Mean coverage of each string's last interval in percent (MET-16)."""
    last = fivemin.groupBy("string_id").agg(F.max_by("coverage", "ts_utc").alias("coverage"))
    return last.agg((F.avg("coverage") * 100).alias("health_pct"), F.count("*").alias("strings"))


def sky_grid(cells: DataFrame, seasonal: DataFrame | None = None) -> DataFrame:
    """Exported grid (MET-17, SRT-03): the middle of each cell, loss in percent,
    raw ratio, evidence and season; pooled cells first. ``seasonal`` has a row
    (half, cell, value, n) for each half of a split cell."""
    def shown(rows, season, raw, order):
        return rows.select("string_id", ((F.col("az_bin") + 0.5) * C.AZ_BIN).alias("azimuth"), ((F.col("el_bin") + 0.5) * C.EL_BIN).alias("elevation"), ((1 - F.exp("value")) * 100).alias("loss_pct"), F.exp(raw).alias("raw_ratio"), F.col("n").cast("double").alias("n"), season.alias("season"), F.lit(order).alias("place"))

    out = shown(cells, F.lit("all"), F.col("raw"), 0)
    if seasonal is not None:
        out = out.unionByName(shown(seasonal, F.when(F.col("half") == 0, "ascending").otherwise("descending"), F.col("cell"), 1))
    return out.orderBy("place", "string_id", "azimuth", "elevation", "season")


def shading_now(factors: DataFrame) -> DataFrame:
    """Loss of every string where the sun stands, NULL below 3 degrees (MET-18).
    Needs string_id, elevation, factor."""
    return factors.withColumn("loss_pct", F.when(F.col("elevation") >= C.NIGHT_ELEVATION, (1 - F.col("factor")) * 100))


def group_series(newest: DataFrame, members: DataFrame) -> DataFrame:
    """Hourly sums of each group's members (MET-20, AGG-12)."""
    return newest.join(F.broadcast(members), "string_id").groupBy("group_id", "ts_utc").agg(F.round(F.sum(F.round("potential_kwh", 4)), 4).alias("kwh"))


def convert_group(series: DataFrame, groups: DataFrame) -> DataFrame:
    """Hourly DC sums of groups through their output path (CMP-13): direct is
    the curve at the mean load, clipped at the inverter; storage is tracker
    and charge efficiency; none gives nothing. ``groups`` has group_id,
    output_path, rated_ac_w, curve, mppt_eff, charge_eff and is small."""
    rows = series.join(F.broadcast(groups), "group_id")
    rated = F.col("rated_ac_w") / 1000
    direct = F.least(F.col("kwh") * R.curve_at("curve", F.col("kwh") / rated * 100), rated)
    out = F.when(F.col("output_path") == "direct", direct).when(F.col("output_path") == "storage", F.col("kwh") * F.col("mppt_eff") * F.col("charge_eff"))
    return rows.select("group_id", "ts_utc", "output_path", "kwh", out.alias("out_kwh"))


def group_sums(series: DataFrame, now: int, tz: str, value: str = "kwh") -> DataFrame:
    """Today, tomorrow and what remains of a group from ``now`` on, without the
    started hour (MET-20, MET-21)."""
    rows = series.withColumn("__now", F.lit(now).cast("long"))
    (d0, d1), (_, d2) = (R.day_bounds("__now", tz, k) for k in range(2))
    return rows.groupBy("group_id").agg(F.coalesce(_between(value, d0, d1), F.lit(0.0)).alias("today"), F.coalesce(_between(value, d1, d2), F.lit(0.0)).alias("tomorrow"), F.coalesce(_between(value, F.lit(now), d1), F.lit(0.0)).alias("remaining"))


def plant_ac(converted: DataFrame, strings: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Hourly AC of all direct groups, and whether strings or storage are left
    out of it (MET-22)."""
    hours = converted.filter("output_path = 'direct'").groupBy("ts_utc").agg(F.sum("out_kwh").alias("ac_kwh"))
    lists = path_lists(strings, groups, members).groupBy(F.lit(1).alias("one")).agg((F.count_if(F.col("path") != "direct") > 0).alias("partial"))
    return hours.withColumn("one", F.lit(1)).join(F.broadcast(lists), "one").drop("one")


def path_lists(strings: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """The output path of every string; one of no group has none (SET-06)."""
    path = members.join(F.broadcast(groups.select("group_id", "output_path")), "group_id").select("string_id", "output_path")
    return strings.select("string_id").join(path, "string_id", "left").select("string_id", F.coalesce("output_path", F.lit("none")).alias("path"))


def forecast_attribute(forecast: DataFrame, tz: str, by: list[str]) -> DataFrame:
    """Per key and local day the hours as JSON, in order of time (SNK-16): a
    day has at most 25."""
    each = F.struct("ts_utc", F.struct(R.iso_time("ts_utc", tz).alias("datetime"), F.round("potential_kwh", 4).alias("potential_kwh"), F.round("unshaded_kwh", 4).alias("unshaded_kwh")).alias("v"))
    days = forecast.groupBy(*by, R.local_day("ts_utc", tz).alias("day")).agg(F.array_sort(F.collect_list(each)).alias("hours"))
    return days.select(*by, "day", F.to_json(F.transform("hours", lambda h: h["v"])).alias("hours"))


def tracked_entities(rows: DataFrame) -> DataFrame:
    """Distinct entities in order of their first place (SET-05)."""
    first = rows.filter("entity_id is not null and entity_id <> ''").groupBy("entity_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("pos")))


def learn_summary(stats: DataFrame) -> DataFrame:
    """One line on what a learn cycle did (CMP-22). ``stats`` has
    hours_materialised, observations_used, skipped (map of reasons) and the
    counts shading, bias, censored, rejected."""
    skipped = F.coalesce(F.aggregate(F.map_values("skipped"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("skipped")), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")
    parts = [F.concat(F.col("hours_materialised").cast("string"), F.lit(" hourly rows folded")), F.concat(F.col("observations_used").cast("string"), F.lit(" observations learned")),
             F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" skipped ("), reasons, F.lit(")")))]
    parts += [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}"))) for c, label in (("shading", "shading"), ("bias", "irradiance bias"), ("censored", "censored"), ("rejected", "irradiance hours rejected"))]
    return stats.withColumn("summary", F.when(F.coalesce("hours_materialised", F.lit(0)) == 0, "nothing new to fold").otherwise(F.concat_ws(", ", *parts)))


def outlook_of(newest: DataFrame, now: int, tz: str, after: int = 1) -> DataFrame:
    """Weather of a whole local day, tomorrow by default (MET-12); one row,
    all NULL without hours."""
    rows = newest.withColumn("__now", F.lit(now).cast("long"))
    start, end = R.day_bounds("__now", tz, after)
    day = rows.filter((F.col("ts_utc") >= start) & (F.col("ts_utc") < end))
    return day.agg(F.round(F.max("rain_probability_pct"), 1).alias("rain_probability_pct"), F.round(F.avg("clouds_pct"), 1).alias("clouds_pct"), F.round(F.sum("rain_mm"), 2).alias("rain_mm"))
