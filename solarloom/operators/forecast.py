"""The forecast plan and the learn cycle (CMP-01, 05, 09, 10, 26, PHY-16): one
lazy plan from weather issues to hourly potentials. The sun is computed once
for each plant and interval, strings come in by an equi-join on the plant, and
all that is joined to the intervals is keyed by plant, hour or sky cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import physics as P
from ..functions import predicates as R
from .joins import geometry_asof, sky_lookup
from .mutations import ranked

#: Step values and what an hour without any of them gets.
STEPS = {"temp_c": 20.0, "wind_ms": 1.0, "clouds_pct": None, "rain_mm": 0.0}
SLOTS = C.HOUR_S // C.INTERVAL_S
WH = C.INTERVAL_S / C.HOUR_S


def latest_rows(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per target hour, the last written (SET-07)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked(seq)).alias("r")).select(*keys, "r.*")


def without_hours(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows outside of the rejected hours (SET-03)."""
    keyed = rows.withColumn("__hour", R.floor_to("ts_utc", C.HOUR_S))
    return keyed.join(rejected.select(F.col("hour").alias("__hour")).distinct(), "__hour", "left_anti").select(*rows.columns)


def hour_grid(plants: DataFrame, start: int, end: int) -> DataFrame:
    """(plant_id, hour, site columns): every hour of [start, end)."""
    hours = F.sequence(F.lit(start // C.HOUR_S * C.HOUR_S).cast("long"), F.lit(end - 1).cast("long"), F.lit(C.HOUR_S).cast("long"))
    return plants.select("*", F.explode(hours).alias("hour"))


def hourly_weather(hours: DataFrame, newest: DataFrame) -> DataFrame:
    """The grid with its newest weather (JON-10). Temperature and the like are
    steps of their hour; over hours that the source lacks they run in a
    straight line, by intervals, from the last interval before to the first
    after, and level beyond both ends (WIN-04): the columns end in _a and _b
    (values before and after), _at (intervals since the last one before) and
    _of (intervals between)."""
    out = hours.join(newest.withColumnRenamed("ts_utc", "hour"), ["plant_id", "hour"], "left")
    back = Window.partitionBy("plant_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("plant_id").orderBy("hour").rowsBetween(0, Window.unboundedFollowing)
    for c in STEPS:
        has = F.when(F.col(c).isNotNull(), F.struct(F.col("hour").alias("h"), F.col(c).alias("v")))
        a, b = F.last(has, ignorenulls=True).over(back), F.first(has, ignorenulls=True).over(ahead)
        out = out.withColumn(f"{c}_l", a).withColumn(f"{c}_r", b)
    return out


def _stepped(column: str, default):
    """The value of an interval between its hour's neighbours."""
    left, right = F.col(f"{column}_l"), F.col(f"{column}_r")
    at = (F.col("hour") - left["h"]) / C.HOUR_S * SLOTS + F.col("slot") - (SLOTS - 1)
    of = (right["h"] - left["h"]) / C.HOUR_S * SLOTS - (SLOTS - 1)
    line = left["v"] + (right["v"] - left["v"]) * at / of
    value = F.when(left["h"] == F.col("hour"), left["v"]).when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(line)
    return F.coalesce(value, F.lit(default).cast("double"))


def downscale(hourly: DataFrame, bias: DataFrame | None = None, issued_at: int | None = None, tz: str = "UTC") -> DataFrame:
    """Hours to five-minute intervals that keep each hour's ratio to its clear
    sky (PHY-16, WIN-03): the hour's clear-sky mean is over the intervals that
    are there. ``bias`` (hour_local, bucket, factor) scales all components by
    local hour and lead (SCL-09). An hour without irradiance is not covered."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    rows = hourly.select("*", F.explode(slots).alias("slot"))
    rows = rows.withColumn("ts_utc", F.col("hour") + F.col("slot") * C.INTERVAL_S).withColumn("ts", (F.col("ts_utc") + C.INTERVAL_S / 2).cast("double"))
    rows = P.run(rows, P.SUN + P.CLEARSKY)
    if bias is None:
        rows = rows.withColumn("bias_factor", F.lit(1.0))
    else:
        lead = F.greatest(F.lit(0.0), (F.col("hour") - F.lit(issued_at)) / C.HOUR_S)
        factors = bias.select(F.col("hour_local").alias("__h"), F.col("bucket").alias("__b"), F.col("factor").alias("__f"))
        rows = rows.join(F.broadcast(factors), (F.col("__h") == R.local_hour("hour", tz)) & (F.col("__b") == R.horizon_bucket(lead)), "left")
        rows = rows.withColumn("bias_factor", F.coalesce("__f", F.lit(1.0))).drop("__h", "__b", "__f")
    hour = Window.partitionBy("plant_id", "hour")
    for c in ("ghi", "dni", "dhi"):
        mean, forecast = F.avg(f"cs_{c}").over(hour), F.col(f"{c}_wm2") * F.col("bias_factor")
        shaped = F.when(mean > C.SHAPE_FLOOR, forecast / mean * F.col(f"cs_{c}")).otherwise(forecast)
        rows = rows.withColumn(c, F.greatest(F.coalesce(shaped, F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("covered", F.col("ghi_wm2").isNotNull())
    for c, default in STEPS.items():
        rows = rows.withColumn(c, _stepped(c, default))
    return rows.drop("ghi_wm2", "dni_wm2", "dhi_wm2", *[f"{c}_{x}" for c in STEPS for x in "lr"])


def actual_conditions(conditions: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured irradiance in place of the forecast's where there is any
    (JON-09, CMP-05). As soon as one interval of a plant's window has some, the
    components of the whole window are derived anew."""
    seen = measured.select("plant_id", "ts_utc", F.col("ghi").alias("__m"))
    rows = conditions.join(seen, ["plant_id", "ts_utc"], "left")
    touched = rows.filter("__m is not null").select("plant_id").distinct().withColumn("__any", F.lit(True))
    rows = rows.join(touched, "plant_id", "left").withColumn("ghi", F.coalesce("__m", "ghi"))
    return rows.withColumn("dni", F.when(F.col("__any").isNull(), F.col("dni"))).withColumn("dhi", F.when(F.col("__any").isNull(), F.col("dhi"))).drop("__m", "__any")


def trailing(rows: DataFrame, now: int, seconds: int = 900) -> DataFrame:
    """Rows of the quarter hour before ``now`` (WIN-07)."""
    return rows.filter((F.col("ts_utc") >= now - seconds) & (F.col("ts_utc") < now))


def weather_hours(conditions: DataFrame) -> DataFrame:
    """Class and part of the day of each plant's hour, its irradiance-weighted
    bias factor (1 in the dark) and whether any interval is covered (AGG-15,
    AGG-16)."""
    noon = P.run(conditions.select("plant_id", "hour", "lat", "lon").distinct().withColumn("day", R.floor_to(F.col("hour") + 1800, 86400)), P.DAYLIGHT)
    hours = conditions.groupBy("plant_id", "hour").agg(
        F.avg("ghi").alias("g"), F.avg("cs_ghi").alias("cs"), F.max("rain_mm").alias("rain"), F.avg("clouds_pct").alias("clouds"),
        F.coalesce(F.try_divide(F.sum(F.col("ghi") * F.col("bias_factor")), F.sum("ghi")), F.lit(1.0)).alias("bias_factor"), F.bool_or("covered").alias("covered"))
    kc = F.when(F.col("cs") > 20, F.col("g") / F.col("cs"))
    hours = hours.join(noon.select("plant_id", "hour", "noon_ts"), ["plant_id", "hour"])
    return hours.select("plant_id", "hour", R.weather_class("rain", kc, "clouds").alias("weather"), R.daypart((F.col("hour") + 1800 - F.col("noon_ts")) / 3600).alias("part"), "bias_factor", "covered")


def string_power(conditions: DataFrame, strings: DataFrame, geometry: DataFrame, cells: DataFrame | None = None, model: str = "haydavies") -> DataFrame:
    """Power of every string and interval by the whole chain (PHY-13), with the
    geometry of its hour (JON-01), shaded by the sky map if ``cells`` are
    given (their ``method`` says whether direct light alone is shaded), and
    unshaded, both within nameplate and tracker cap (CMP-04). ``strings`` has
    plant_id, string_id, system_eff, mount_a, mount_b, mount_dt, temp_coeff and
    max_power_w. Strings without geometry are left out. The perez ``model``
    holds for plants all of whose intervals have plausible components."""
    hours = conditions.select("plant_id", "hour").distinct().join(strings.select("plant_id", "string_id"), "plant_id")
    segment = geometry_asof(hours.withColumnRenamed("hour", "ts_utc"), geometry).filter("azimuth_deg is not null").select(
        "plant_id", "string_id", F.col("ts_utc").alias("hour"), F.col("azimuth_deg").alias("azimuth"), F.col("tilt_deg").alias("tilt"), "kwp")
    rows = conditions.join(segment, ["plant_id", "hour"]).join(strings, ["plant_id", "string_id"])
    if cells is None:
        rows = rows.withColumn("shade", F.lit(1.0)).withColumn("beam_scope", F.lit(True))
    else:
        az, el = R.sky_bins("sun_az", "elevation")
        rows = sky_lookup(rows.withColumn("az_bin", az).withColumn("el_bin", el).withColumn("half", R.half_year("ts_utc")), cells).drop("half").withColumnRenamed("factor", "shade")
        who = [c for c in ("plant_id", "string_id") if c in cells.columns]
        method = cells.groupBy(*who).agg((F.max("method") == "differential").alias("beam_scope"))
        rows = rows.join(method, who, "left").withColumn("beam_scope", F.coalesce("beam_scope", F.lit(False)))
    if model == "perez":
        sound = P.run(conditions, P.COMPONENTS).groupBy("plant_id").agg(F.every("plausible").alias("components_ok"))
        rows = rows.join(sound, "plant_id")
    rows = P.run(rows, P.COMPONENTS + P.plane(model, "column") + P.POWER)
    bare = F.least(F.when(F.col("shading_applied") > 0, F.col("power_w") / F.col("shading_applied")).otherwise(F.col("power_w")), F.col("kwp") * 1000)
    rows = rows.withColumn("unshaded_w", F.least(bare, F.coalesce("max_power_w", bare)))
    return rows.withColumn("uncapped_w", F.col("power_w")).withColumn("power_w", F.least(F.col("power_w"), F.coalesce("max_power_w", F.col("power_w"))))


def fold_energy(rows: DataFrame, keys: list[str], watts: dict[str, str]) -> DataFrame:
    """Interval powers to hourly energies (AGG-13): {power column: name}."""
    return rows.groupBy(*keys).agg(*[(F.sum(w) * WH / 1000).alias(n) for w, n in watts.items()])


def corrected(hours: DataFrame, effects: DataFrame) -> DataFrame:
    """Adds ``correction`` from the three layers of ``effects`` (scope, key,
    value, n_eff) (SCL-07)."""
    def layer(scope, name):
        return effects.filter(F.col("scope") == scope).select(F.col("key").alias(f"__{name}"), F.struct("value", "n_eff").alias(name))

    rows = hours.withColumn("__p", F.concat_ws("|", "weather", "part")).withColumn("__s", F.col("string_id")).withColumn("__d", F.concat_ws("|", "string_id", "part"))
    for scope, key in (("plant", "p"), ("string", "s"), ("string_daypart", "d")):
        rows = rows.join(layer(scope, f"{key}_effect").withColumnRenamed(f"__{key}_effect", f"__{key}"), f"__{key}", "left")
    return rows.withColumn("correction", R.correction("p_effect", "s_effect", "d_effect")).drop("__p", "__s", "__d", "p_effect", "s_effect", "d_effect")


def evaluate(conditions: DataFrame, strings: DataFrame, geometry: DataFrame, cells: DataFrame | None = None, effects: DataFrame | None = None) -> DataFrame:
    """Hourly forecast of every string (CMP-01): hours without any covered
    interval are absent, not zero."""
    power = string_power(conditions, strings, geometry, cells)
    hours = fold_energy(power, ["plant_id", "string_id", "hour"], {"power_w": "physics_kwh", "unshaded_w": "unshaded_kwh"})
    hours = hours.join(weather_hours(conditions).filter("covered").drop("covered"), ["plant_id", "hour"])
    learned = effects is not None
    hours = corrected(hours, effects) if learned else hours.withColumn("correction", F.lit(1.0))
    lit = F.col("physics_kwh") > 0
    factor = F.when(lit, F.col("correction")).otherwise(1.0)
    return hours.select(
        "plant_id", F.col("hour").alias("ts_utc"), "string_id", (F.col("physics_kwh") * factor).alias("potential_kwh"), "physics_kwh", (F.col("unshaded_kwh") * factor).alias("unshaded_kwh"),
        "weather", "part", F.when(lit & F.lit(learned), "physics+learned").otherwise("physics").alias("method"), factor.alias("correction"), "bias_factor",
        F.when(F.col("unshaded_kwh") > 0, F.col("physics_kwh") / F.col("unshaded_kwh")).otherwise(1.0).alias("shading_factor"))


def energy_chain(forecast: DataFrame) -> DataFrame:
    """Physics times shading times model is the potential; the bias of the
    source is inside of the physics already (CMP-26)."""
    bare = F.when(F.col("correction") != 0, F.col("unshaded_kwh") / F.col("correction")).otherwise(0.0)
    return forecast.select("plant_id", "ts_utc", "string_id", F.col("bias_factor").alias("source_bias"), bare.alias("physics_kwh"), F.col("shading_factor").alias("shading"), F.col("correction").alias("model"), "potential_kwh")


def materialise_hours(fivemin: DataFrame, plants: DataFrame) -> DataFrame:
    """Hours with the quality that the sun at their middle gives (AGG-05).
    Hours without rows are not written. ``fivemin`` has plant_id."""
    from .aggregate import fold_hourly

    owner = fivemin.groupBy("string_id").agg(F.first("plant_id").alias("plant_id"))
    hours = fold_hourly(fivemin).join(owner, "string_id")
    sun = P.run(hours.select("plant_id", "ts_utc").distinct().join(plants, "plant_id").withColumn("ts", (F.col("ts_utc") + 1800).cast("double")), P.SUN + P.APPARENT)
    judged = hours.join(sun.select("plant_id", "ts_utc", "apparent_elevation"), ["plant_id", "ts_utc"])
    return judged.withColumn("quality", R.quality("coverage", "apparent_elevation")).drop("apparent_elevation")


def plant_hourly_actual(fivemin: DataFrame) -> DataFrame:
    """Energy of clean measured intervals by hour and string (AGG-14)."""
    from ..sources.readers import clean_measurements

    return fold_energy(clean_measurements(fivemin).withColumn("hour", R.floor_to("ts_utc", C.HOUR_S)), ["string_id", "hour"], {"power_mean_w": "actual_kwh"})


def learning_hours(actual: DataFrame, physics: DataFrame, classes: DataFrame) -> DataFrame:
    """Hourly actuals with the physics of their hour and string (JON-11), their
    class, and the first reason against learning from them, else NULL (FLT-13,
    FLT-14); residual and weight where there is none. The weight of the kind
    counts twice, once in the quality and once in the observation, as observed
    in what this replaces."""
    rows = actual.join(physics.select("ts_utc", "string_id", "physics_kwh"), ["ts_utc", "string_id"], "left").join(classes, [k for k in ("plant_id", "ts_utc") if k in classes.columns], "left")
    rows = rows.withColumn("weather", F.coalesce("weather", F.lit("partly_cloudy"))).withColumn("part", F.coalesce("part", F.lit("midday")))
    weight = R.assess("coverage", F.lit(90.0), "value_kind")["weight"]
    first = R.skip_reason("physics_kwh", "quality", "energy_kwh", "coverage", "value_kind")
    reason = F.coalesce(first, R.decline_reason(weight, "physics_kwh", "energy_kwh", "value_kind"))
    rows = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return rows.withColumn("residual", F.when(good, F.log(F.col("energy_kwh") / F.col("physics_kwh")))).withColumn("weight", F.when(good, weight * R.kind_weight("value_kind")))


def exclusions(hours: DataFrame) -> DataFrame:
    """Hours of too little coverage, as they are logged (FLT-14)."""
    return hours.filter("reason = 'low_coverage'").select("ts_utc", "string_id", "reason", F.concat(F.lit("coverage="), F.format_number("coverage", 2)).alias("detail"))


def collect_shading(fivemin: DataFrame, power: DataFrame) -> DataFrame:
    """Shading observations of the map (CMP-10): measured over unshaded physics
    where the value is a free measurement of a well covered interval with the
    sun 8 degrees up (FLT-16)."""
    free = fivemin.filter("power_mean_w is not null and value_kind = 'measured' and coverage >= 0.8 and not coalesce(limit_binding, false)")
    sky = power.filter("elevation >= 8 and power_w > 0").select("ts_utc", "string_id", F.col("sun_az").alias("azimuth_deg"), F.col("elevation").alias("elevation_deg"), F.col("power_w").alias("physics_w"), F.col("beam_share").alias("beam"))
    ratio = F.col("power_mean_w") / F.col("physics_w")
    return free.join(sky, ["ts_utc", "string_id"]).filter(ratio.between(0.0, C.RATIO_HIGH)).select("ts_utc", "string_id", "azimuth_deg", "elevation_deg", ratio.alias("ratio"), F.col("coverage").alias("weight"), "physics_w", "beam")


def history_conditions(history: DataFrame, irradiance: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly history with its irradiance, which it needs, and temperature and
    wind, which have defaults (JON-12)."""
    out = history.join(irradiance, "ts_utc").join(weather, "ts_utc", "left")
    return out.withColumn("temp_c", F.coalesce("temp_c", F.lit(15.0))).withColumn("wind_ms", F.coalesce("wind_ms", F.lit(1.5)))


def monthly_share(plants: DataFrame, strings: DataFrame, year_start: int = 1735689600) -> DataFrame:
    """Share of each month in a clear year's energy on the strings' planes,
    weighted by their nameplates (AGG-20). ``strings`` has plant_id, string_id,
    azimuth, tilt, kwp."""
    hours = hour_grid(plants, year_start, year_start + 8760 * C.HOUR_S).withColumn("ts", (F.col("hour") + 1800).cast("double"))
    sun = P.run(hours, P.SUN + P.CLEARSKY).withColumn("ghi", F.col("cs_ghi")).withColumn("dni", F.col("cs_dni")).withColumn("dhi", F.col("cs_dhi")).withColumn("shade", F.lit(1.0))
    rows = P.run(sun.join(strings, "plant_id"), P.COMPONENTS + P.plane("haydavies"))
    month = F.month(R.local_time("hour", "UTC"))
    each = rows.groupBy("plant_id", "string_id", "kwp", month.alias("month")).agg(F.sum("poa").alias("poa"))
    share = F.col("poa") / F.sum("poa").over(Window.partitionBy("plant_id", "string_id"))
    plant = each.withColumn("share", share).groupBy("plant_id", "month").agg(F.sum(F.col("share") * F.col("kwp")).alias("w"))
    return plant.select("plant_id", "month", (F.col("w") / F.sum("w").over(Window.partitionBy("plant_id"))).alias("share"))


def total_kwp(strings: DataFrame, geometry: DataFrame, now: int) -> DataFrame:
    """Nameplate of each plant by the segments at ``now`` (AGG-23)."""
    at = geometry_asof(strings.select("plant_id", "string_id", F.lit(now).cast("long").alias("ts_utc")), geometry)
    return at.groupBy("plant_id").agg(F.round(F.sum("kwp"), 3).alias("kwp"))
