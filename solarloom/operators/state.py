"""What outlives a run: effects, biases, curves and cursors as tall tables
(STA-01..05, SNK-06, SNK-12, CMP-15, CMP-27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as C
from ..functions import predicates as R
from .learning import held_to_prior


def merge_scope(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win, all other old rows stay (SNK-06)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def set_cursor(cursors: DataFrame, name: str, ts_utc: int) -> DataFrame:
    """The control table with one mark moved (SNK-12)."""
    new = cursors.sparkSession.createDataFrame([(name, ts_utc)], "name string, ts_utc long")
    return merge_scope(cursors, new, ["name"])


def effect_rows(effects: DataFrame, at: int) -> DataFrame:
    """Effects (scope, parts array, value, n_eff) to stored rows (STA-01)."""
    return effects.select("scope", F.array_join("parts", "|").alias("key"), "value", "n_eff", F.lit(at).cast("long").alias("updated_at"))


def effects_from_rows(rows: DataFrame) -> DataFrame:
    """Stored rows to effects; keys of a wrong number of parts are dropped
    (STA-01)."""
    parts = F.split("key", r"\|")
    want = F.when(F.col("scope") == "string", 1).otherwise(2)
    return rows.select("scope", parts.alias("parts"), "value", "n_eff").filter(F.size("parts") == want)


def curve_rows(bins: DataFrame) -> DataFrame:
    """Fitted curves to stored rows ``scope|stage|load`` (STA-02): what was
    measured, not what it was held to, and the highest load under its reserved
    key. ``bins`` has scope_id, stage, bucket, measured, n_eff, max_load."""
    key = F.concat_ws("|", "scope_id", "stage")
    points = bins.filter("n_eff > 0 and measured is not null").select(F.concat_ws("|", key, F.col("bucket").cast("string")).alias("key"), F.col("measured").alias("value"), "n_eff")
    top = bins.groupBy("scope_id", "stage").agg(F.max("max_load").alias("m")).filter("m > 0")
    return points.unionByName(top.select(F.concat_ws("|", key, F.lit(str(C.MAX_LOAD_KEY))).alias("key"), F.col("m").alias("value"), F.lit(0.0).alias("n_eff")))


def curves_from_rows(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Stored points held anew to the priors in force (STA-02): unknown scopes
    are dropped, configured ones always have every bucket. ``priors`` has
    scope_id, stage, prior and is small."""
    parts = F.split("key", r"\|")
    stored = rows.select(parts[0].alias("scope_id"), parts[1].alias("stage"), parts[2].try_cast("int").alias("bucket"), F.col("value").alias("measured"), "n_eff").filter("bucket is not null")
    keys = ["scope_id", "stage"]
    grid = priors.select(*keys, "prior", F.explode(F.array(*map(F.lit, C.LOAD_BUCKETS))).alias("bucket"))
    out = grid.join(stored.filter(F.col("bucket") != C.MAX_LOAD_KEY), [*keys, "bucket"], "left").withColumn("base", R.curve_at("prior", F.col("bucket").cast("double")))
    top = stored.filter(F.col("bucket") == C.MAX_LOAD_KEY).groupBy(*keys).agg(F.max("measured").alias("max_load"))
    seen = stored.filter(F.col("bucket") != C.MAX_LOAD_KEY).groupBy(*keys).agg(F.max("bucket").cast("double").alias("highest"))
    out = out.join(top, keys, "left").join(seen, keys, "left")
    eta = F.coalesce(held_to_prior("measured", "n_eff", "base"), F.col("base"))
    n = F.coalesce("n_eff", F.lit(0.0))
    return out.select(*keys, "bucket", eta.alias("eta"), n.alias("n_eff"), F.col("base").alias("prior_eta"), (n >= C.CURVE_MIN_SAMPLES).alias("learned"), F.coalesce("max_load", "highest", F.lit(0.0)).alias("max_load"))


def reachable(curves: DataFrame) -> DataFrame:
    """Buckets that a plant's highest load comes near, and the share of them
    that is learned (CMP-14)."""
    def nearest(load):
        return R.nearest_load(load)

    rows = curves.withColumn("within", F.col("bucket") <= nearest(F.col("max_load")))
    return rows.groupBy("scope_id", "stage").agg(F.count_if("within").alias("reachable"), F.count_if(F.col("within") & F.col("learned")).alias("learned"), F.try_divide(F.count_if(F.col("within") & F.col("learned")), F.count_if("within")).alias("coverage"))


def changed_sources(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Scopes whose entity is another than when their pairs were written, by
    fingerprint; new ones count as unchanged (CMP-15, SCL-31)."""
    prints = now.select("scope_id", R.fingerprint("entity_id").cast("double").alias("print"))
    return prints.join(stored.select("scope_id", F.col("value").alias("was")), "scope_id").filter("print <> was").select("scope_id")


def drop_scopes(pairs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Pairs without those of changed scopes (CMP-15)."""
    return pairs.join(F.broadcast(scopes), "scope_id", "left_anti")


def may_save(effects: DataFrame, learning_on: bool) -> DataFrame:
    """Nothing is saved while learning is off (STA-03)."""
    return effects if learning_on else effects.limit(0)


def seed_geometry(geometry: DataFrame, strings: DataFrame) -> DataFrame:
    """Strings without history get their configured plane from time 0 on
    (STA-04). ``strings`` has string_id, azimuth_deg, tilt_deg, kwp."""
    new = strings.join(geometry.select("string_id").distinct(), "string_id", "left_anti")
    return geometry.unionByName(new.select("string_id", F.lit(0).cast("long").alias("valid_from_ts_utc"), "azimuth_deg", "tilt_deg", "kwp"))


def migrate(rows: DataFrame, schema: str) -> DataFrame:
    """An older table in the present schema (STA-05): missing columns are NULL,
    known ones are cast, unknown ones stay behind them; nothing is dropped."""
    want = StructType.fromDDL(schema)
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], *[c for c in rows.columns if c not in want.names])


def forget_legacy_beam(obs: DataFrame, version: int) -> DataFrame:
    """Observations written before version 5 lose their beam share (STA-05)."""
    return obs.withColumn("beam", F.lit(None).cast("double")) if version < 5 else obs


def conversion_pairs(strings: DataFrame, outputs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Measured pairs across a conversion stage (CMP-27): a tracker against its
    string, an inverter against all of its strings, none of which may be
    missing. ``strings`` (ts_utc, string_id, power_mean_w, coverage), ``outputs``
    (ts_utc, scope_id, out_w, out_coverage), ``scopes`` (scope_id, stage,
    members, curtailable), which is small. Coverage is that of the thinnest
    side; pairs without input are not usable (FLT-15)."""
    each = scopes.select("scope_id", "stage", "curtailable", "members", F.size("members").alias("want"), F.explode("members").alias("string_id"))
    rows = strings.filter("power_mean_w is not null").join(F.broadcast(each), "string_id")
    sums = rows.groupBy("scope_id", "stage", "ts_utc").agg(F.first("members").alias("members"), F.first("curtailable").alias("curtailable"), F.first("want").alias("want"), F.count("*").alias("have"), F.sum("power_mean_w").alias("in_w"), F.min("coverage").alias("in_coverage"))
    out = sums.filter("have = want").join(outputs, ["scope_id", "ts_utc"]).filter("in_w > 0 and out_w >= 0")
    return out.select("ts_utc", "scope_id", "stage", "in_w", "out_w", F.least("in_coverage", "out_coverage").alias("coverage"), "members", "curtailable")


def reset(effects: DataFrame, scope: str | None = None, prefix: str | None = None) -> DataFrame:
    """Effects without all, a scope, or the keys of a prefix (SNK-11)."""
    if prefix is not None:
        return effects.filter(~F.col("key").startswith(prefix))
    return effects.filter(F.col("scope") != scope) if scope is not None else effects.limit(0)


def compact_tables(tables: dict[str, DataFrame], now: int) -> dict[str, DataFrame]:
    """The tiers without a rule of their own (SNK-13): measured weather and
    exclusions go after 90 days, conversion pairs after 730, and no forecast
    outlives those."""
    days = {"weather_actual_5min": C.RAW_DAYS, "exclusions": C.RAW_DAYS, "conversion_5min": C.SHADING_DAYS, "weather_forecast": C.SHADING_DAYS, "forecast_log": C.SHADING_DAYS}
    return {name: df.filter(F.col("ts_utc") >= now - days[name] * 86400) if name in days else df for name, df in tables.items()}
