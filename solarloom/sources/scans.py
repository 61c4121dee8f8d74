"""Scans of the stored tables (SRC-10..19): predicates on plain columns, so that
they reach the Parquet reader; order only where the output has one (SRT-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _within(rows: DataFrame, start: int, end: int) -> DataFrame:
    return rows.filter((F.col("ts_utc") >= start) & (F.col("ts_utc") < end))


def string_range(fivemin: DataFrame, string_id: str, start: int, end: int) -> DataFrame:
    """SRC-10."""
    return _within(fivemin, start, end).filter(F.col("string_id") == string_id).orderBy("ts_utc")


def hourly_range(hourly: DataFrame, start: int, end: int, string_id: str | None = None) -> DataFrame:
    """SRC-12."""
    rows = _within(hourly, start, end)
    return rows if string_id is None else rows.filter(F.col("string_id") == string_id)


def weather_range(weather: DataFrame, start: int, end: int) -> DataFrame:
    """SRC-13."""
    return _within(weather, start, end)


def issues_to_verify(issues: DataFrame, start: int, end: int, source: str, max_horizon: int = 72) -> DataFrame:
    """Issues of one source up to a lead, by time and lead (SRC-14)."""
    return _within(issues, start, end).filter((F.col("source") == source) & (F.col("horizon_h") <= max_horizon)).orderBy("ts_utc", "horizon_h", "issued_at_utc")


def battery_charge(state: DataFrame, start: int, end: int) -> DataFrame:
    """SRC-15."""
    return _within(state, start, end).filter("battery_soc_pct is not null").select("ts_utc", "battery_soc_pct")


def training_pairs(pairs: DataFrame, scope_id: str | None = None, uncensored_only: bool = True) -> DataFrame:
    """SRC-16: an unjudged pair counts as censored."""
    rows = pairs.filter("in_w > 0 and out_w >= 0")
    rows = rows.filter("coalesce(censored, 1) = 0") if uncensored_only else rows
    return rows if scope_id is None else rows.filter(F.col("scope_id") == scope_id)


def observations_to_fit(obs: DataFrame) -> DataFrame:
    """SRC-18: one scan for all strings, the string stays a column."""
    return obs.select("string_id", "ts_utc", "azimuth_deg", "elevation_deg", "ratio", "weight", *[c for c in ("physics_w", "beam") if c in obs.columns])


def effects_of(effects: DataFrame, scope: str) -> DataFrame:
    """SRC-19."""
    return effects.filter(F.col("scope") == scope).select("key", "value", "n_eff")


def bias_of(biases: DataFrame, source: str) -> DataFrame:
    """SRC-19."""
    return biases.filter(F.col("source") == source).select("hour_local", "horizon_bkt", "log_factor", "n_eff")


def archive_chunks(start: int, end: int, days: int = 120) -> list[tuple[int, int]]:
    """Spans of one archive request each (SRC-07)."""
    step = days * 86400
    return [(a, min(a + step, end)) for a in range(start, end, step)]
