"""The learn cycle as one driver function: a few bounded stages over the hours
of each plant since its last cycle, each written where the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import predicates as R
from ..operators import aggregate as A
from ..operators import forecast as W
from ..operators import joins as J
from ..operators import learning as L
from ..operators import mutations as M
from ..operators import publish as P
from ..operators import shading as S
from ..operators.state import merge_scope
from .lineage import Cuts


def learn_windows(plants: DataFrame, cursors: DataFrame | None, now: int, max_hours: int = 48) -> DataFrame:
    """(plant_id, start, end): the closed hours after each plant's cursor, at
    most ``max_hours``; a plant without a cursor begins that far back (STR-07).
    Plants without a closed hour are absent."""
    closed = now // C.HOUR_S * C.HOUR_S
    cold = F.lit(closed - max_hours * C.HOUR_S).cast("long")
    rows = plants.select("plant_id").distinct()
    if cursors is None:
        rows = rows.withColumn("start", cold)
    else:
        rows = rows.join(cursors.select("plant_id", "cursor"), "plant_id", "left").select("plant_id", F.coalesce(F.col("cursor").cast("long"), cold).alias("start"))
    end = F.least(F.lit(closed).cast("long"), F.col("start") + max_hours * C.HOUR_S)
    return rows.withColumn("end", end).filter(F.col("end") > F.col("start"))


def learn_cycle(tables: dict[str, DataFrame], now: int, cursor: int | DataFrame | None = None, max_hours: int = 48, tz: str = "UTC") -> tuple[dict[str, DataFrame], int | DataFrame]:
    """Learn from the closed hours after the cursor (CMP-11): the tables that
    change, and the new cursor. With no closed hour since, nothing changes.

    ``cursor`` is a table (plant_id, cursor) with a mark for each plant, so
    that each learns from its own hours, all in the same jobs; the marks of
    plants without a closed hour stay. One number, or None, is the mark of
    all, and tables without a plant_id are then those of the one plant there
    is; otherwise every table has it but geometry, whose strings have one plant
    each. Effects, bias and maps are learned for each plant apart where the
    tables ``effects`` and ``bias`` have plant_id.

    ``tables`` has plants, strings, geometry, weather (one row per plant and
    hour), fivemin (with plant_id), effects and shading. Where there are also
    ``state``, ``issues`` and ``measured``, ``pairs`` and ``reference``, or
    ``cells``, the plant is folded, the bias of the issues learned (from
    ``bias`` on), the pairs judged and curves fitted, and physics shaded.

    Verdicts come first, since kinds feed the fold and the pairs; effects are
    learned on shaded physics, the map on unshaded. Only the windows' rows of
    fivemin, hours and plant hours are returned, to be upserted; effects, bias
    and shading come back whole, curves only when fitted, cells when a plant's
    were (with those that other plants had)."""
    cut = Cuts()
    marks = cursor
    if not isinstance(cursor, DataFrame):
        marks = None if cursor is None else tables["plants"].select("plant_id", F.lit(cursor).alias("cursor"))
    spans = cut(learn_windows(tables["plants"], marks, now, max_hours))
    found = spans.agg(F.min("start"), F.max("end"), F.count("*")).first()
    if not found[2]:
        cut.drop()
        return {}, cursor if cursor is not None else now // C.HOUR_S * C.HOUR_S - max_hours * C.HOUR_S
    out: dict[str, DataFrame] = {}

    def each(df, on="ts_utc"):
        """Rows in their plant's window, and all others."""
        if "plant_id" in df.columns:
            inside = df.join(spans, "plant_id", "left").withColumn("__in", F.coalesce((F.col(on) >= F.col("start")) & (F.col(on) < F.col("end")), F.lit(False))).drop("start", "end")
        elif isinstance(cursor, DataFrame):
            raise ValueError("with a cursor for each plant every table needs plant_id")
        else:
            inside = df.withColumn("__in", (F.col(on) >= found[0]) & (F.col(on) < found[1]))
        return inside.filter("__in").select(*df.columns), inside.filter("not __in").select(*df.columns)

    def done(name, df):
        """A table to return: written, and read by later stages."""
        out[name] = cut(df)
        cut.made.remove(out[name])
        return out[name]

    active = tables["plants"].join(spans, "plant_id")
    hours = active.select("*", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(C.HOUR_S).cast("long"))).alias("hour")).drop("start", "end")
    at = cut(W.downscale(W.hourly_weather(hours, each(tables["weather"])[0])))
    power = cut(W.string_power(at, tables["strings"], tables["geometry"], tables.get("cells")))

    rows = each(tables["fivemin"])[0]
    physics = power.select("ts_utc", "string_id", F.col("power_w").alias("physics_w"))
    judged = rows.filter("limit_commanded_w is not null").join(physics, ["ts_utc", "string_id"], "left")
    verdicts = judged.select("ts_utc", "string_id", R.is_binding("power_mean_w", "limit_commanded_w", "physics_w").alias("limit_binding"))
    rows = done("fivemin", M.flag_curtailment(rows, verdicts))
    hourly = done("hourly", W.materialise_hours(rows, tables["plants"]))
    if "state" in tables:
        done("plant_hourly", A.fold_plant(each(tables["state"])[0]))
    if "pairs" in tables:
        keys = ["scope_id", "stage", "ts_utc"]
        fresh, kept = each(tables["pairs"])
        fresh = fresh.drop("censored")
        censored = fresh.join(J.censor_pairs(fresh, rows), keys, "left")
        pairs = done("pairs", kept.unionByName(censored.select(*kept.columns)))
        done("curves", L.fit_curves(pairs, tables["reference"], now))
    if "issues" in tables:
        who = [c for c in ("plant_id",) if c in tables["issues"].columns]
        by, order = [*who, "hour_local", "bucket"], ["ts_utc", "horizon_h"]
        seen = P.bias_observations(each(tables["issues"])[0], each(tables["measured"])[0], tuple(who)).withColumn("hour_local", R.local_hour("ts_utc", tz))
        ran = L.running_effect(cut(seen), by, "residual", "weight", order, start=tables.get("bias"))
        last = F.struct(*order)
        learned = ran.groupBy(*by).agg(F.max_by("ema", last).alias("value"), F.max_by("n_eff", last).alias("n_eff"))
        done("bias", merge_scope(tables["bias"], learned, by) if "bias" in tables else learned)

    energy = W.fold_energy(power, ["plant_id", "string_id", "hour"], {"power_w": "physics_kwh"}).withColumnRenamed("hour", "ts_utc")
    classes = W.weather_hours(at).select("plant_id", F.col("hour").alias("ts_utc"), "weather", "part")
    told = cut(W.learning_hours(hourly, energy, classes))
    done("exclusions", W.exclusions(told))
    apart = ["plant_id"] if "plant_id" in tables["effects"].columns else []
    obs = told.filter("reason is null").select(*apart, F.col("ts_utc").alias("hour"), "string_id", "weather", "part", "residual", "weight")
    done("effects", merge_scope(tables["effects"], L.learn_effects(obs, tables["effects"]), [*apart, "scope", "key"]))

    bare = power if "cells" not in tables else W.string_power(at, tables["strings"], tables["geometry"])
    added = W.collect_shading(rows, bare)
    if "plant_id" in tables["shading"].columns:
        added = added.join(tables["strings"].select("plant_id", "string_id"), "string_id")
    shading = done("shading", M.insert_missing(tables["shading"], added.select(*tables["shading"].columns), ["ts_utc", "string_id"]))
    cells = _refitted(tables, shading, now, cut)
    if cells is not None:
        done("cells", cells)
    if not isinstance(cursor, DataFrame):
        cut.drop()
        return out, found[1]
    moved = spans.select("plant_id", F.col("end").alias("cursor"))
    return out, cut.keep(merge_scope(cursor.select("plant_id", F.col("cursor").cast("long").alias("cursor")), moved, ["plant_id"]))


def _refitted(tables: dict[str, DataFrame], shading: DataFrame, now: int, cut: Cuts) -> DataFrame | None:
    """Maps of the plants with a string that is due (CMP-20), and the maps
    that other plants had; None where no string is due."""
    def owned(df):
        return df if "plant_id" in df.columns else df.join(tables["strings"].select("plant_id", "string_id"), "string_id")

    have, had = owned(shading), owned(tables["shading"])
    counts, before = (df.groupBy("plant_id", "string_id").agg(F.count("*").alias("n")) for df in (have, had))
    due = cut(S.refit_due(counts, before).filter("due").select("plant_id").distinct())
    if not due.limit(1).count():
        return None
    fitted = S.joint_fit(S.observations(have.join(due, "plant_id", "left_semi"), now))
    old = tables.get("cells")
    if old is None or "plant_id" not in old.columns:
        return fitted
    return old.join(due, "plant_id", "left_anti").unionByName(fitted, allowMissingColumns=True)
