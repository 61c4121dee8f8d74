"""Sources outside of the tables: forecast payloads, long-term statistics,
curve files, watchdog densification (SRC-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.predicates import cloud_ghi

#: Payload variable and column.
VARIABLES = {"shortwave_radiation": "ghi_wm2", "direct_normal_irradiance": "dni_wm2", "diffuse_radiation": "dhi_wm2", "temperature_2m": "temp_c", "cloud_cover": "clouds_pct",
             "wind_speed_10m": "wind_ms", "relative_humidity_2m": "humidity_pct", "precipitation": "rain_mm", "precipitation_probability": "rain_probability_pct", "surface_pressure": "pressure_hpa"}


def parse_forecast(payloads: DataFrame) -> DataFrame:
    """Columnar payloads (payload JSON text, issued_at_utc, source) to rows
    (SRC-04): labels mark interval ends, so times move back an hour; missing
    or short arrays give NULL."""
    arrays = ", ".join(f"{v}: ARRAY<DOUBLE>" for v in VARIABLES)
    parsed = payloads.withColumn("h", F.from_json("payload", f"STRUCT<hourly: STRUCT<time: ARRAY<BIGINT>, {arrays}>>")["hourly"])
    rows = parsed.select("issued_at_utc", "source", "h", F.posexplode("h.time").alias("i", "label"))
    ts = F.col("label") + C.LABEL_SHIFT_S
    return rows.select("issued_at_utc", ts.alias("ts_utc"), "source", F.bround((ts - F.col("issued_at_utc")) / 3600).cast("int").alias("horizon_h"), *[F.get(F.col(f"h.{v}"), F.col("i")).alias(c) for v, c in VARIABLES.items()])


def request_parameters(lat: float, lon: float, start: str | None = None, end: str | None = None) -> dict:
    """Query parameters of a forecast, or with dates of an archive, request
    (SRC-05)."""
    out = {"latitude": lat, "longitude": lon, "hourly": ",".join(VARIABLES), "timeformat": "unixtime", "timezone": "UTC", "wind_speed_unit": "ms"}
    return out | ({"start_date": start, "end_date": end} if start else {"forecast_days": 4, "past_days": 1})


def rows_from_clouds(entity_rows: DataFrame, clearsky: DataFrame) -> DataFrame:
    """Cloud cover to irradiance through the clear sky of its hour (SRC-06)."""
    return entity_rows.join(clearsky, "ts_utc").withColumn("ghi_wm2", cloud_ghi("cs_ghi", "clouds_pct")).drop("cs_ghi")


def statistics_hours(rows: DataFrame) -> DataFrame:
    """Long-term statistics (start in seconds or milliseconds, mean, seq) to
    one value per hour, the last written winning (SRC-08, SRC-07)."""
    start = F.when(F.col("start") > 1e11, F.col("start") / 1000).otherwise(F.col("start"))
    return rows.filter("mean is not null").groupBy((F.floor(start / 3600) * 3600).cast("long").alias("ts_utc")).agg(F.max_by("mean", "seq").alias("value"))


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Curve files; those that break a rule are absent (SRC-09): two points or
    more, loads within 0..150 and rising, efficiencies in (0.5, 1]."""
    raw = spark.read.schema("model STRING, points ARRAY<STRUCT<load: DOUBLE, eta: DOUBLE>>").json(path, multiLine=True)
    p = F.col("points")
    rising = F.forall(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a["load"] < b["load"]), lambda x: x)
    return raw.filter((F.size(p) >= 2) & F.forall(p, lambda x: x["load"].between(0, 150) & (x["eta"] > 0.5) & (x["eta"] <= 1))).filter(rising)


def parse_curve(text):
    """``"5:0.90, 10:0.935"`` to points; any bad pair gives NULL (PRJ-01)."""
    parts = F.transform(F.split(text, ","), lambda x: F.struct(F.split(x, ":")[0].try_cast("double").alias("load"), F.get(F.split(x, ":"), F.lit(1)).try_cast("double").alias("eta")))
    return F.when(F.forall(parts, lambda p: p["load"].isNotNull() & p["eta"].isNotNull()), parts)


def curve_text(points):
    """Points to the text that ``parse_curve`` reads, without trailing zeros
    (PRJ-01)."""
    def short(x):
        return F.regexp_replace(x.cast("string"), r"\.0$", "")

    return F.array_join(F.transform(points, lambda p: F.concat(short(p["load"]), F.lit(":"), short(p["eta"]))), ", ")


def densify(samples: DataFrame, watchdog_s: int = C.WATCHDOG_S, entity: str = "entity_id") -> DataFrame:
    """Repeat each value every ``watchdog_s`` until the next sample (SRC-02)."""
    by = Window.partitionBy(entity).orderBy("ts_utc")
    nxt = F.lead("ts_utc").over(by)
    return samples.withColumn("__n", F.coalesce(nxt, F.col("ts_utc"))).select(entity, F.explode(F.expr(f"transform(sequence(0L, cast(greatest(ceil((__n - ts_utc) / {watchdog_s}) - 1, 0) as long)), i -> ts_utc + i * {watchdog_s})")).alias("ts_utc"), "value")


def clean_measurements(fivemin: DataFrame) -> DataFrame:
    """SRC-11."""
    return fivemin.filter("power_mean_w is not null and value_kind = 'measured' and coverage >= 0.8 and not coalesce(limit_binding, false)")
