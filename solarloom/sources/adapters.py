"""The driver's tables seen as plant data: one formula per view, the same in
the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str):
    """Microseconds since the epoch, whether or not the column has a zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


def samples(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 3 + 1).cast("string")).alias("entity_id"), (micros(e, "ts") / 1e6).alias("ts_utc"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def fivemin(spark, sf_dir) -> DataFrame:
    """Integrated samples with a limit and a verdict from fixed formulas."""
    from ..operators.aggregate import integrate

    got = integrate(samples(spark, sf_dir), 300)
    slot = (F.col("ts_utc") / 300).cast("long")
    return got.select(F.col("entity_id").alias("string_id"), "ts_utc", "energy_wh", "power_mean_w", "coverage", "sample_count",
                      F.when(slot % 5 == 0, 40.0 + slot % 7).alias("limit_commanded_w"), F.when(slot % 11 != 0, slot % 5 == 0).alias("limit_binding"),
                      F.when(slot % 13 == 0, "reconstructed").when(slot % 5 == 0, "lower_bound").otherwise("measured").alias("value_kind"))


def props(df: DataFrame):
    return F.get_json_object("props", "$.k").cast("int")


def forecast_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    hour = (F.floor(micros(e, "ts") / 3600000000) * 3600).cast("long")
    return e.select("event_id", hour.alias("issued_at_utc"), (hour + (props(e) % 72) * 3600).alias("ts_utc"), F.concat(F.lit("s"), (F.col("user_id") % 3 + 1).cast("string")).alias("string_id"), (F.col("value") / 100).alias("potential_kwh"), (props(e) % 72).cast("int").alias("horizon_h"))


def plant_state(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    k = props(e)
    return e.select("event_id", (F.floor(micros(e, "ts") / 300000000) * 300).cast("long").alias("ts_utc"), k.cast("double").alias("battery_soc_pct"), (F.col("value") * 10 - 1000).alias("grid_power_w"), F.when(k % 7 != 0, F.col("value")).alias("house_load_w"))


def shading_obs(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("string_id"), ((micros(x, "l_shipdate") / 1000000).cast("long") + F.col("l_linenumber") * 300).alias("ts_utc"),
                    (F.col("l_partkey") % 360).cast("double").alias("azimuth_deg"), (F.col("l_orderkey") % 65).cast("double").alias("elevation_deg"), (F.col("l_quantity") / 25).alias("ratio"), (1 - F.col("l_discount")).alias("weight"))


def conversion(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("g"), (F.col("l_suppkey") % 5).cast("string")).alias("scope_id"), F.lit("inverter").alias("stage"), ((micros(x, "l_shipdate") / 1000000).cast("long")).alias("ts_utc"),
                    (F.col("l_extendedprice") / 10).alias("in_w"), (F.col("l_extendedprice") / 10 * (1 - F.col("l_discount") - F.col("l_tax"))).alias("out_w"), F.lit(1.0).alias("coverage"), F.when(F.col("l_linenumber") % 4 != 0, 0).alias("censored"))


def geometry(spark) -> DataFrame:
    rows = [("s1", 1704500000, 180.0, 30.0, 1.8), ("s1", 1705300000, 175.0, 35.0, 1.8), ("s2", 1704100000, 180.0, 60.0, 1.0), ("s3", 1704200000, 110.0, 27.0, 0.95), ("s3", 1705000000, 112.0, 27.0, 0.95), ("s3", 1706000000, 115.0, 28.0, 0.9)]
    return spark.createDataFrame(rows, "string_id string, valid_from_ts_utc long, azimuth_deg double, tilt_deg double, kwp double")


def part_geometry(spark, sf_dir) -> DataFrame:
    """Parts as geometry segments of up to 500 strings."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("t"), (F.col("p_partkey") % 500).cast("string")).alias("string_id"), (F.col("p_partkey") * 1000).alias("valid_from_ts_utc"), (F.col("p_partkey") % 360).cast("double").alias("azimuth_deg"), F.col("p_size").cast("double").alias("tilt_deg"), (F.floor("p_retailprice") / 1000).alias("kwp"))


#: The same in SQL, as a CTE ``pg``.
PART_GEOMETRY = "pg AS (SELECT 't' || CAST(p_partkey % 500 AS VARCHAR) AS string_id, p_partkey * 1000 AS valid_from_ts_utc, CAST(p_partkey % 360 AS DOUBLE) AS azimuth_deg, CAST(p_size AS DOUBLE) AS tilt_deg, floor(p_retailprice) / 1000 AS kwp FROM part)"
