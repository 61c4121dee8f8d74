"""As-of, membership and neighbour joins (JON-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .mutations import ranked


def geometry_asof(hours: DataFrame, geometry: DataFrame) -> DataFrame:
    """Latest segment that began by the hour, else the earliest one (JON-01).
    The dimension's intervals are closed with ``lead``; the join is an
    equi-join on the string with a range filter."""
    by = Window.partitionBy("string_id").orderBy("valid_from_ts_utc")
    segments = geometry.withColumn("__to", F.lead("valid_from_ts_utc").over(by)).withColumn("__from", F.when(F.row_number().over(by) > 1, F.col("valid_from_ts_utc")))
    g = segments.withColumnRenamed("string_id", "__s")
    fits = (F.col("string_id") == F.col("__s")) & (F.col("__from").isNull() | (F.col("ts_utc") >= F.col("__from"))) & (F.col("__to").isNull() | (F.col("ts_utc") < F.col("__to")))
    return hours.join(g, fits, "left").drop("__s", "__from", "__to")


def newest_issue(forecasts: DataFrame, keys: list[str], issued: str = "issued_at_utc") -> DataFrame:
    """The newest issue per key as a partial aggregate (JON-02, WIN-08)."""
    rest = [c for c in forecasts.columns if c not in keys]
    return forecasts.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked(issued)).alias("r")).select(*keys, "r.*")


def closest_issue(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Least absolute horizon, then the newest issue (JON-05)."""
    rest = [c for c in forecasts.columns if c not in keys]
    return forecasts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.abs("horizon_h"), -F.col("issued_at_utc"))).alias("r")).select(*keys, "r.*")


def forecast_asof(hourly: DataFrame, log: DataFrame, lead_s: int | None = None, cutoff: str | None = None) -> DataFrame:
    """Each hour with the newest forecast issued ``lead_s`` before it or by
    its ``cutoff`` column, else NULL (JON-03, JON-04)."""
    names = hourly.columns
    latest = F.col("ts_utc") - lead_s if cutoff is None else F.col(cutoff)
    left = hourly.withColumn("__until", latest)
    right = log.select("ts_utc", "string_id", F.col("issued_at_utc").alias("__i"), F.col("potential_kwh").alias("__p"))
    fits = left.join(right, ["ts_utc", "string_id"]).filter("__i <= __until").groupBy("ts_utc", "string_id").agg(F.max_by("__p", "__i").alias("forecast_kwh"))
    return hourly.join(fits, ["ts_utc", "string_id"], "left").select(*names, "forecast_kwh")


def censor_pairs(pairs: DataFrame, fivemin: DataFrame) -> DataFrame:
    """Verdict of conversion pairs from their members' rows (JON-07): a
    missing member, a value not measured or a limit that may bind censors."""
    each = pairs.select("scope_id", "stage", "ts_utc", "curtailable", F.size("members").alias("want"), F.explode("members").alias("string_id"))
    rows = each.join(fivemin.select("string_id", "ts_utc", "value_kind", "limit_binding", "limit_commanded_w", F.lit(True).alias("seen")), ["string_id", "ts_utc"], "left")
    flag = F.when(F.col("seen").isNull(), None).when(F.col("value_kind") != "measured", 1).when(F.col("limit_binding"), 1).when(
        F.col("limit_binding").isNull() & (F.col("curtailable") | F.col("limit_commanded_w").isNotNull()), 1).otherwise(0)
    return rows.groupBy("scope_id", "stage", "ts_utc").agg(F.when(F.count("seen") < F.max("want"), 1).otherwise(F.max(flag)).alias("censored"))


def peers(rows: DataFrame) -> DataFrame:
    """Reconstruction of held-back strings from free peers at the same time
    (JON-16): the median of measured/physics if they agree within 0.35."""
    free = rows.filter("limit_binding = false and physics_w > 0 and power_mean_w > 0").select("ts_utc", F.col("string_id").alias("peer"), (F.col("power_mean_w") / F.col("physics_w")).alias("ratio"))
    held = rows.filter("limit_binding = true and physics_w > 0")
    seen = held.join(free, "ts_utc").filter("peer <> string_id").groupBy("ts_utc", "string_id", "physics_w").agg(F.median("ratio").alias("ratio"), (F.max("ratio") - F.min("ratio")).alias("spread"), F.count("*").alias("n_peers"))
    return seen.filter("n_peers = 1 or spread <= 0.35").select("ts_utc", "string_id", (F.col("physics_w") * F.col("ratio")).alias("reconstructed_w"), "n_peers")


def sky_lookup(queries: DataFrame, cells: DataFrame, seasonal: DataFrame | None = None) -> DataFrame:
    """Factor at (string_id, az_bin, el_bin): the cell of the half year
    (``half`` of the query) where ``seasonal`` (string_id, az_bin, el_bin, half,
    value) has one, else the cell, else its eight neighbours, else 1 (JON-14,
    JON-15). Neighbours give their mean by weight, as a cell of their mean
    weight; of cells that come without ``cell`` and ``reference``, the mean of
    their values. Azimuth wraps at 36 bins; every step is an equi-join. ``plant_id``
    is part of the key where the cells have it. ``cells`` may hold the halves
    too, as the joint map does."""
    from .shading import log_factor

    if "half" in cells.columns:
        if "half" in queries.columns and seasonal is None:
            seasonal = cells.filter("half is not null")
        cells = cells.filter("half is null")
    who = [c for c in ("plant_id", "string_id") if c in cells.columns]
    keys = [*who, "az_bin", "el_bin"]
    near = F.array(*[F.struct(F.lit(a).alias("da"), F.lit(e).alias("de")) for a in (-1, 0, 1) for e in (-1, 0, 1) if (a, e) != (0, 0)])
    want = queries.select(*keys).distinct()
    around = want.select("*", F.explode(near).alias("d")).select(*keys, F.pmod(F.col("az_bin") + F.col("d.da"), F.lit(36)).alias("__a"), (F.col("el_bin") + F.col("d.de")).alias("__e"))
    drawn = {"cell", "reference"} <= set(cells.columns)
    c = cells.select(*who, F.col("az_bin").alias("__a"), F.col("el_bin").alias("__e"), "n", *(["cell", "reference"] if drawn else [F.col("value").alias("cell")]))
    level = F.sum(F.col("cell") * F.col("n")) / F.sum("n")
    mean = around.join(c, [*who, "__a", "__e"]).groupBy(*keys).agg((log_factor(level, F.avg("n"), F.max("reference")) if drawn else level).alias("near"))
    out = queries.join(cells.select(*keys, F.col("value").alias("own")), keys, "left").join(mean, keys, "left")
    if seasonal is not None:
        out = out.join(seasonal.select(*keys, "half", F.col("value").alias("season")), [*keys, "half"], "left")
    found = F.coalesce(*(["season"] if seasonal is not None else []), "own", "near", F.lit(0.0))
    return out.withColumn("factor", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.exp(found)))).drop("own", "near", "season")
