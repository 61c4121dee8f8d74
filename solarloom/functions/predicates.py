"""Scalar rules as column expressions: quality, censoring, learning gates,
bins, curves and tariffs. NULL means unknown and is never zero; verdicts are
nullable booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def floor_to(ts, step: int) -> Column:
    """Mathematical floor to a multiple of ``step`` (SCL-01)."""
    return (F.floor(_c(ts) / step) * step).cast("long")


def closed_interval(ts) -> Column:
    """The interval that a flush at ``ts`` closes (SCL-02)."""
    return (F.floor((_c(ts) - 1) / C.INTERVAL_S) * C.INTERVAL_S - C.INTERVAL_S).cast("long")


def numeric(text) -> Column:
    """Number of a state text; unavailable, unknown, empty: NULL (SRC-03)."""
    value = F.trim(_c(text))
    return F.when(F.lower(value).isin("", "unavailable", "unknown", "none"), None).otherwise(value.try_cast("double"))


def kind_for(verdict) -> Column:
    """FLT-10."""
    return F.when(_c(verdict), "lower_bound").otherwise("measured")


def fully_curtailed(verdict) -> Column:
    """Aggregate: all known verdicts are TRUE; none known: FALSE (FLT-10)."""
    return F.coalesce(F.bool_and(_c(verdict)), F.lit(False))


def curtailed_fraction(verdict) -> Column:
    """Aggregate: share of the known verdicts; none known: 0 (FLT-10)."""
    return F.coalesce(F.avg(_c(verdict).cast("int")), F.lit(0.0))


def skip_reason(physics_kwh, quality_, energy_kwh, coverage, kind) -> Column:
    """Why an hour is not learned from before its observation is even built,
    first match, else NULL (FLT-14). Quality for learning is judged as if the
    sun were up."""
    p, q = _c(physics_kwh), _c(quality_)
    return (F.when(p.isNull(), "no_physics_row").when(p <= 0, F.when(q == "night", "night").otherwise("zero_physics_in_daylight"))
            .when(q == "night", "night").when(_c(energy_kwh).isNull(), "no_energy")
            .when(~assess(coverage, F.lit(90.0), kind)["usable"], "low_coverage"))


def to_unit(value, unit, quantity: str) -> Column:
    """Value in the canonical unit of its quantity; an unknown symbol passes
    the value through (SCL-22)."""
    v, symbol = _c(value), F.lower(F.trim(_c(unit)))
    if quantity == "temperature":
        symbol = F.trim(F.regexp_replace(symbol, "°|deg", ""))
        return F.when(symbol.isin("f", "fahrenheit"), (v - 32.0) * 5.0 / 9.0).when(symbol.isin("k", "kelvin"), v - 273.15).otherwise(v)
    factor = F.lit(1.0)
    for name, f in C.UNITS[quantity].items():
        factor = F.when(symbol == name, f).otherwise(factor)
    return v * factor


def limit_watts(value, in_percent, max_ac) -> Column:
    """A live limit in watts, given in percent or as it is (SCL-23)."""
    return F.when(_c(in_percent), _c(value) / 100 * _c(max_ac)).otherwise(_c(value))


def charger_limit(limit, power, state) -> Column:
    """While the charger holds back, its power is a limit too (SCL-24)."""
    holds = F.coalesce(charger_limits(state), F.lit(False)) & (_c(power) > 0)
    return F.when(holds, F.least(_c(limit), _c(power))).otherwise(_c(limit))


def clamp_daylight(start, end, sunrise, sunset) -> list[Column]:
    """A window within daylight, perhaps empty; no sunrise or sunset: as it is
    (SCL-29)."""
    known = _c(sunrise).isNotNull() & _c(sunset).isNotNull()
    return [F.when(known, F.greatest(_c(start), _c(sunrise).cast("long"))).otherwise(_c(start)), F.when(known, F.least(_c(end), _c(sunset).cast("long"))).otherwise(_c(end))]


def local_time(ts, tz: str) -> Column:
    """Wall clock of an instant; independent of the session's zone."""
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(ts).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def local_instant(day, hour: int, tz: str) -> Column:
    """Epoch seconds of a local hour of a date."""
    wall = _c(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.convert_timezone(F.lit(tz), F.lit("UTC"), wall))


def local_hour(ts, tz: str) -> Column:
    """SCL-09."""
    return F.hour(local_time(ts, tz))


def local_day(ts, tz: str) -> Column:
    return local_time(ts, tz).cast("date")


def day_bounds(ts, tz: str, after: int = 0) -> list[Column]:
    """Start and end of the local day, ``after`` days on; days of 23 or 25
    hours come from the calendar (SCL-30)."""
    day = F.date_add(local_day(ts, tz), after)
    return [local_instant(day, 0, tz), local_instant(F.date_add(day, 1), 0, tz)]


def day_ahead_cutoff(ts, tz: str) -> Column:
    """18:00 of the local day before (SCL-30)."""
    return local_instant(F.date_sub(local_day(ts, tz), 1), C.DAY_AHEAD_HOUR, tz)


def fingerprint(entity) -> Column:
    """SCL-31."""
    return F.crc32(_c(entity))


def iso_time(ts, tz: str) -> Column:
    """SCL-32: local ISO form to the second, with its offset."""
    wall = local_time(ts, tz)
    offset = (F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), wall) - _c(ts)).cast("long")
    sign = F.when(offset < 0, "-").otherwise("+")
    hours, minutes = F.floor(F.abs(offset) / 3600), F.floor(F.abs(offset) % 3600 / 60)
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))


def quality(coverage, elevation) -> Column:
    """exact, night, partial or missing, in this order (FLT-01)."""
    return (F.when(_c(coverage) >= C.COVERAGE_EXACT, "exact").when(_c(elevation) < C.NIGHT_ELEVATION, "night")
            .when(_c(coverage) >= C.COVERAGE_PARTIAL, "partial").otherwise("missing"))


def availability(value, elevation) -> Column:
    """ok, night or missing (FLT-02)."""
    return F.when(_c(value).isNotNull(), "ok").when(_c(elevation) < C.NIGHT_ELEVATION, "night").otherwise("missing")


def learn_weight(quality_, coverage) -> Column:
    """FLT-03."""
    return (F.when(_c(quality_).isin("exact", "night"), 1.0).when(_c(quality_) == "partial", F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(coverage)))).otherwise(0.0))


def kind_weight(kind) -> Column:
    """FLT-04."""
    return F.when(_c(kind) == "lower_bound", C.LOWER_BOUND_WEIGHT).when(_c(kind) == "reconstructed", C.RECONSTRUCTED_WEIGHT).otherwise(1.0)


def assess(coverage, elevation, kind) -> Column:
    """Quality, weight and usability as one struct (FLT-05)."""
    q = quality(coverage, elevation)
    w = learn_weight(q, coverage) * kind_weight(kind)
    return F.struct(q.alias("quality"), w.alias("weight"), (q.isin("exact", "partial") & (w > 0)).alias("usable"))


def is_binding(measured, limit, physics) -> Column:
    """Whether a limit held the string back; unknown inputs: NULL (FLT-06)."""
    m, li, p = _c(measured), _c(limit), _c(physics)
    return (F.when(li.isNull() | m.isNull(), None).when(li <= 0, True).when(p.isNull(), None)
            .otherwise((m >= C.BINDING_AT * li) & (p > C.BINDING_PHYSICS * li)))


def full_battery(measured, physics, soc, limit) -> Column:
    """FLT-07."""
    m, p, s, li = _c(measured), _c(physics), _c(soc), _c(limit)
    return F.when(m.isNull() | p.isNull() | s.isNull() | li.isNull(), None).when(s < li, False).otherwise(p > C.BATTERY_MARGIN * m)


def combine_verdicts(*flags) -> Column:
    """Any TRUE, else any FALSE, else NULL (FLT-08): unlike OR, FALSE with
    NULL is FALSE."""
    return F.greatest(*[_c(f).cast("int") for f in flags]).cast("boolean")


def charger_limits(state) -> Column:
    """FLT-09; states outside of the known ones: NULL."""
    s = F.lower(F.trim(_c(state)))
    return F.when(s.isin(C.CHARGER_LIMITING), True).when(s.isin(C.CHARGER_FREE), False)


def exceeds_ceiling(actual, ceiling, floor) -> Column:
    """FLT-11."""
    a, c = _c(actual), _c(ceiling)
    return F.when(a <= _c(floor), False).when(c <= 0, True).otherwise(a > C.CEILING_MARGIN * c)


def judgement_floor(kwp) -> Column:
    """FLT-12."""
    return F.greatest(F.lit(30.0), 0.02 * _c(kwp) * 1000)


def decline_reason(weight, physics, measured, kind) -> Column:
    """First reason not to learn from an observation, else NULL (FLT-13)."""
    w, p, m = _c(weight), _c(physics), _c(measured)
    return (F.when(w <= 0, "no_weight").when(p <= 0, "no_physics").when(m <= 0, "no_production")
            .when(~(m / p).between(C.RATIO_LOW, C.RATIO_HIGH), "ratio_out_of_range")
            .when((_c(kind) == "lower_bound") & (p >= m), "censored_and_consistent"))


def weather_class(rain, kc, clouds) -> Column:
    """SCL-03."""
    k, c = _c(kc), _c(clouds)
    return (F.when(_c(rain) >= 0.2, "rain").when(k >= 0.75, "clear").when(k >= 0.40, "partly_cloudy").when(k.isNotNull(), "overcast")
            .when(c < 25, "clear").when(c < 75, "partly_cloudy").when(c.isNotNull(), "overcast").otherwise("partly_cloudy"))


def daypart(hours_from_noon) -> Column:
    """SCL-04."""
    return F.when(_c(hours_from_noon) < -2, "morning").when(_c(hours_from_noon) <= 2, "midday").otherwise("afternoon")


def horizon_bucket(hours) -> Column:
    """SCL-05."""
    h = _c(hours)
    return F.when(h < 6, "0-6h").when(h < 24, "6-24h").when(h < 48, "24-48h").otherwise("48h+")


def shrunk(value, n) -> Column:
    """SCL-06."""
    raw = _c(value) * _c(n) / (_c(n) + C.SHRINK_K)
    held = F.greatest(F.lit(-C.EFFECT_CLAMP), F.least(F.lit(C.EFFECT_CLAMP), raw))
    return F.when(_c(n) <= 0, 0.0).when(raw.isNotNull(), held)


def correction(plant, string, daypart_) -> Column:
    """Factor of the three layers; the third counts from 0.7 / alpha
    observations on (SCL-07). Each layer is a struct (value, n_eff)."""
    alpha = 1 - 0.5 ** (1 / C.EMA_HALF_LIFE)
    parts = [F.coalesce(shrunk(x["value"], x["n_eff"]), F.lit(0.0)) for x in map(_c, (plant, string))]
    third = F.when(_c(daypart_)["n_eff"] >= 0.7 / alpha, shrunk(_c(daypart_)["value"], _c(daypart_)["n_eff"])).otherwise(0.0)
    return F.exp(F.greatest(F.lit(-C.TOTAL_CLAMP), F.least(F.lit(C.TOTAL_CLAMP), parts[0] + parts[1] + third)))


def bias_weight(ghi) -> Column:
    """SCL-08."""
    return F.when(_c(ghi) <= 0, 0.0).otherwise(F.least(_c(ghi), F.lit(600.0)) / 600.0)


def sky_bins(azimuth, elevation) -> list[Column]:
    """SCL-10."""
    return [F.floor(F.pmod(_c(azimuth), F.lit(360)) / C.AZ_BIN).cast("int"), F.floor(_c(elevation) / C.EL_BIN).cast("int")]


def half_year(ts) -> Column:
    """0 while days get longer, 1 after (SCL-11)."""
    day = F.expr("dayofyear(date_add(date'1970-01-01', cast(floor({0} / 86400) as int)))".format(ts))
    return F.when((day >= 355) | (day < 172), 0).otherwise(1)


def recency(age_days, half_life: float) -> Column:
    """SCL-12."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), _c(age_days)) / half_life)


def nearest_load(load_pct) -> Column:
    """Nearest bucket, the lower on ties (SCL-16)."""
    out = F.lit(C.LOAD_BUCKETS[0])
    for low, high in zip(C.LOAD_BUCKETS, C.LOAD_BUCKETS[1:]):
        out = F.when(_c(load_pct) > (low + high) / 2, high).otherwise(out)
    return out


def curve_at(curve, load_pct) -> Column:
    """Piecewise-linear efficiency, clamped at both ends (SCL-15). ``curve``
    is an array of (load, eta) in order of load."""
    c, x = _c(curve), _c(load_pct)
    below = F.element_at(F.filter(c, lambda p: p["load"] <= x), -1)
    above = F.get(F.filter(c, lambda p: p["load"] > x), F.lit(0))
    size = F.size(F.filter(c, lambda p: p["load"] <= x))
    lower = F.when(size > 0, below)
    return (F.when(size == 0, c[0]["eta"]).when(above.isNull(), lower["eta"])
            .otherwise(lower["eta"] + (above["eta"] - lower["eta"]) * (x - lower["load"]) / (above["load"] - lower["load"])))


def persistence_weight(horizon_s, spread, n) -> Column:
    """SCL-17 and SCL-18."""
    half = F.when(_c(spread) <= 0.143, 4200.0).otherwise(1860.0)
    trust = _c(n) / (_c(n) + 3.0)
    h = _c(horizon_s)
    return F.when((h <= 0) | (h >= 7200), 0.0).otherwise(trust * F.pow(F.lit(0.5), h / half))


def blend(weight, kt, clearsky, forecast) -> Column:
    """SCL-19; a weight of zero leaves the forecast bit for bit."""
    w = _c(weight)
    mixed = w * _c(kt) * _c(clearsky) + (1 - w) * _c(forecast)
    return F.when(w > 0, F.greatest(F.lit(0.0), F.least(mixed, 1.1 * _c(clearsky)))).otherwise(_c(forecast))


def cloud_ghi(clearsky, clouds_pct) -> Column:
    """Kasten-Czeplak (SCL-20)."""
    return F.coalesce(_c(clearsky) * (1 - 0.75 * F.pow(_c(clouds_pct) / 100, F.lit(3.4))), _c(clearsky))


def lux_to_ghi(lux) -> Column:
    """SCL-21."""
    return F.greatest(F.lit(0.0), _c(lux) / 120.0)


def effective_limit(live, live_configured, fixed) -> Column:
    """min(live, fixed); NULL when a configured live limit can't be read
    (SCL-23)."""
    return F.when(_c(live_configured) & _c(live).isNull(), None).otherwise(F.least(_c(live), _c(fixed)))


def savings(mode, yield_kwh, export_kwh, price, feed_in) -> Column:
    """Value under net metering, self consumption or feed in (SCL-25)."""
    y = _c(yield_kwh)
    out = F.greatest(F.lit(0.0), F.least(F.coalesce(_c(export_kwh), F.lit(0.0)), y))
    return (F.when(_c(mode) == "net_metering", y * _c(price)).when(_c(mode) == "self_consumption", (y - out) * _c(price) + out * _c(feed_in)).otherwise(y * _c(feed_in)))


def annual(value, share) -> Column:
    """SCL-27."""
    return F.when(_c(share) >= C.ANNUAL_SHARE, _c(value) / _c(share))


def amortisation_months(investment, saved, annual_value) -> Column:
    """Months to pay back the rest; over 1200: NULL (SCL-28)."""
    months = F.greatest(F.lit(0.0), _c(investment) - _c(saved)) / _c(annual_value) * 12
    return F.when((_c(annual_value) > 0) & (months <= C.AMORTISATION_MONTHS), months)


def amortisation(investment, saved, annual_value, today) -> Column:
    """Progress in percent, months to go and the day it is paid back
    (SCL-28)."""
    months = amortisation_months(investment, saved, annual_value)
    progress = F.when(_c(investment) > 0, F.least(F.lit(100.0), _c(saved) / _c(investment) * 100))
    return F.struct(progress.alias("progress_pct"), months.alias("months"), F.date_add(_c(today), F.floor(months * 30.44).cast("int")).alias("target"))
