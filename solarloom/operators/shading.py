"""Sky maps of shading: absolute and joint fits, seasonal split, report.

A map has a row for each cell of a string's sky (``half`` NULL) and, where the
halves of the year differ, one for each half: ``cell``, the log of what the
string gives there, ``n``, the weight behind it, ``reference``, the level it is
measured against (0 in a differential map), ``shade`` = what the cell lacks to
the reference, ``value`` = the log of the factor to apply, drawn towards parity
while the weight is small, and ``raw``, the log of the measured envelope."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.predicates import half_year, recency, sky_bins
from ..plans.lineage import Cuts
from .aggregate import weighted_quantile

CELL = ["az_bin", "el_bin"]
#: Rows of the joint fit that one task sorts, about.
TASK_ROWS = 250_000


def observations(obs: DataFrame, now: int) -> DataFrame:
    """Usable rows (FLT-16) with their cell, season half, log ratio and aged
    weight; plant_id, beam and physics_w stay where there are any."""
    az, el = sky_bins("azimuth_deg", "elevation_deg")
    good = obs.filter((F.col("elevation_deg") >= 8) & (F.col("ratio") > 0) & (F.col("ratio") <= C.RATIO_HIGH))
    return good.select("ts_utc", *owner(obs), az.alias("az_bin"), el.alias("el_bin"), half_year("ts_utc").alias("half"), F.log("ratio").alias("logr"),
                       (F.col("weight") * recency((F.lit(now) - F.col("ts_utc")) / 86400, C.SKY_RECENCY_DAYS)).alias("w"),
                       *[c for c in ("beam", "physics_w") if c in obs.columns])


def owner(rows: DataFrame) -> list[str]:
    """What a map belongs to: a string, of a plant where that is told."""
    return [c for c in ("plant_id", "string_id") if c in rows.columns]


def log_factor(cell: Column, n: Column, reference: Column) -> Column:
    """The factor of a cell of weight ``n``, in logs and within its bounds."""
    return F.greatest(F.lit(math.log(C.SHADE_LOW)), F.least(F.lit(0.0), cell * n / (n + C.CELL_K) - reference))


def _absolute_cells(rows: DataFrame) -> DataFrame:
    who = owner(rows)
    cell = weighted_quantile(rows, [*who, *CELL], "logr", "w", C.CELL_QUANTILE).filter(F.col("total") >= C.CELL_WEIGHT)
    cell = cell.select(*who, *CELL, F.col("quantile").alias("cell"), F.col("total").alias("n"))
    level = weighted_quantile(cell, who, "cell", "n", C.REFERENCE_QUANTILE).select(*who, F.least("quantile", F.lit(0.0)).alias("level"))
    return cell.join(level, who)


def absolute_fit(rows: DataFrame) -> DataFrame:
    """Cells of each string (CMP-17): the 0.80 weighted quantile of a cell of
    enough weight, measured against the 0.90 quantile of all its cells by
    weight (at most parity)."""
    cell = _absolute_cells(rows)
    return cell.select(*owner(rows), *CELL, log_factor(F.col("cell"), F.col("n"), F.col("level")).alias("value"), "n", F.col("cell").alias("raw"), "level", F.col("cell").alias("cell"), F.col("level").alias("reference"))


def _halves(rows: DataFrame, value: str, weight: str, q: float, most: float | None = None, parts: int | None = None) -> DataFrame:
    """(owner, cell, half, cell value, n) of the cells whose two halves have
    ten days and enough weight each and differ."""
    keys = [*owner(rows), *CELL]
    each = weighted_quantile(rows, [*keys, "half"], value, weight, q, parts=parts).filter(F.col("total") >= C.CELL_WEIGHT)
    quantile = F.col("quantile") if most is None else F.least("quantile", F.lit(most))
    days = rows.groupBy(*keys, "half").agg(F.countDistinct(F.floor(F.col("ts_utc") / 86400)).alias("days"))
    each = each.join(days, [*keys, "half"]).filter(F.col("days") >= C.SEASON_DAYS).select(*keys, "half", quantile.alias("cell"), F.col("total").alias("n"))
    apart = each.groupBy(*keys).agg((F.max("cell") - F.min("cell")).alias("apart"), F.count("*").alias("sides")).filter((F.col("sides") == 2) & (F.col("apart") >= C.SEASON_DELTA))
    return each.join(apart.select(*keys), keys, "left_semi")


def seasonal_cells(rows: DataFrame) -> DataFrame:
    """Cells whose two half years differ (CMP-19): ten days each and a
    difference of 0.18 or more between their quantiles."""
    keys = [*owner(rows), *CELL]
    side = {0: "rising", 1: "falling"}
    return _halves(rows, "logr", "w", C.CELL_QUANTILE).groupBy(*keys).agg(
        *[F.max(F.when(F.col("half") == h, F.col("cell"))).alias(s) for h, s in side.items()], *[F.max(F.when(F.col("half") == h, F.col("n"))).alias(f"{s}_n") for h, s in side.items()])


def by_half(seasonal: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (owner, cell, half, value) of ``seasonal_cells``, measured against
    the reference of their string's ``cells``."""
    who = owner(cells)
    reference = cells.groupBy(*who).agg(F.max("reference").alias("reference"))
    each = seasonal.select(*who, *CELL, F.inline(F.array(*[F.struct(F.lit(h).alias("half"), F.col(s).alias("cell"), F.col(f"{s}_n").alias("n")) for h, s in ((0, "rising"), (1, "falling"))])))
    return each.join(reference, who).withColumn("value", log_factor(F.col("cell"), F.col("n"), F.col("reference")))


def worst_sectors(cells: DataFrame, k: int = 12) -> DataFrame:
    """The k most shaded cells of each string (SRT-02)."""
    order = Window.partitionBy(*owner(cells)).orderBy(F.col("value"), *CELL)
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("loss_pct", (1 - F.exp("value")) * 100)


def joint_fit(rows: DataFrame, rounds: int = 3) -> DataFrame:
    """Differential fit of strings seen together (ITR-03, CMP-18), of all
    plants at once: rounds of a common moment per plant and epoch, a level per
    string and a shade per cell. Every step is a grouped aggregate keyed by
    plant; the rounds are few and fixed, and each cuts the lineage. A cell
    without a shade counts as unshaded.

    Strings that share fewer than 50 epochs with others of their plant, and
    all strings of a plant where fewer than two are left, get their absolute
    map. Rows of the map as told above with ``level`` (log; of the reference
    cells in an absolute map) and ``method``. The seasonal split of a
    differential cell is on what the last round leaves, its ``raw`` is the
    0.80 quantile of the measured ratios, by half where it is split. Without
    ``plant_id`` all strings are of one plant. Without ``beam`` a row counts as
    half beam; ``physics_w`` weighs an epoch where all of its rows have it."""
    cut, named = Cuts(), "plant_id" in rows.columns
    who = ["plant_id", "string_id"]
    keys = [*who, *CELL]
    if not named:
        rows = rows.withColumn("plant_id", F.lit(""))
    for c in ("beam", "physics_w"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    if "half" not in rows.columns:
        rows = rows.withColumn("half", half_year("ts_utc"))
    known = F.col("beam").isNotNull() & ~F.isnan("beam") & (F.abs("beam") < float("inf"))
    rows = cut(rows.filter("w > 0").select("ts_utc", *keys, "half", "logr", "w", "physics_w", F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "beam"))).alias("known")))
    rows = rows.withColumn("beam", F.coalesce("known", F.lit(C.LEGACY_BEAM)))
    epoch = ["plant_id", "ts_utc"]
    shared = rows.groupBy(*epoch).agg(F.countDistinct("string_id").alias("c")).filter("c >= 2").select(*epoch)
    enough = rows.join(shared, epoch).groupBy(*who).agg(F.countDistinct("ts_utc").alias("e")).filter(F.col("e") >= C.JOINT_EPOCHS).select(*who)
    siblings = enough.groupBy("plant_id").agg(F.count("*").alias("c")).filter("c >= 2").select("plant_id")
    enough = cut(enough.join(siblings, "plant_id"))
    solo = _absolute(rows.join(enough, who, "left_anti"))
    if not enough.limit(1).count():
        return _named(cut.keep(solo), named)
    mine = cut(rows.join(enough, who, "left_semi"))
    # What is left of a ratio differs from row to row, so tasks are as many as
    # rows ask for; by bytes, which compress well, they would be few and large.
    parts = -(-mine.count() // TASK_ROWS)
    level = cut(mine.groupBy(*who).agg((F.sum(F.col("logr") * F.col("w")) / F.sum("w")).alias("level")))
    epochs = mine.groupBy(*epoch).agg(F.countDistinct("string_id").alias("c"), F.bool_and(F.col("physics_w").isNotNull()).alias("watts")).filter("c >= 2").drop("c")
    pull = F.col("w") * F.when(F.col("watts"), F.col("physics_w")).otherwise(1.0)
    seen = cut(mine.join(epochs, epoch).withColumn("pull", F.when(pull > 0, pull)).drop("watts", "physics_w"))
    shade = None
    for _ in range(rounds):
        now = seen.join(level, who)
        now = now.withColumn("shade", F.lit(0.0)) if shade is None else now.join(shade, keys, "left")
        now = now.withColumn("cast", _blended(F.coalesce("shade", F.lit(0.0)), F.col("beam"))).drop("shade")
        moment = cut(now.groupBy(*epoch).agg(F.sum(F.col("pull") * (F.col("logr") - F.col("level") - F.col("cast"))).alias("num"), F.sum("pull").alias("den")).filter("den > 0"))
        centre = moment.groupBy("plant_id").agg((F.sum("num") / F.sum("den")).alias("centre"))
        tau = moment.join(centre, "plant_id").select(*epoch, (F.col("num") / F.col("den") - F.col("centre")).alias("tau"))
        tied = cut(now.drop("level").join(tau, epoch))
        fresh = tied.groupBy(*who).agg((F.sum(F.col("w") * (F.col("logr") - F.col("cast") - F.col("tau"))) / F.sum("w")).alias("fresh"))
        # A string without a tied epoch keeps its level.
        level = level.join(fresh, who, "left").select(*who, F.coalesce("fresh", "level").alias("level"))
        left = _left(tied, level)
        cell = weighted_quantile(left, keys, "left", "lit", 0.5, parts=parts).filter(F.col("total") >= C.CELL_WEIGHT)
        cell = cut(cell.select(*keys, F.col("quantile").alias("q"), F.col("total").alias("n")))
        zero = weighted_quantile(cell, who, "q", "n", C.REFERENCE_QUANTILE).select(*who, F.col("quantile").alias("zero"))
        level = cut(level.join(zero, who, "left").select(*who, (F.col("level") + F.coalesce("zero", F.lit(0.0))).alias("level")))
        fixed = cut(cell.join(zero, who).select(*keys, F.least(F.col("q") - F.col("zero"), F.lit(0.0)).alias("shade"), "n"))
        shade = fixed.drop("n")
    left = _left(tied, level).join(shade.select(*keys), keys, "left_semi")
    split = cut(_halves(cut(left), "left", "lit", 0.5, most=0.0, parts=parts))
    shown = mine.join(shade.select(*keys), keys, "left_semi")

    def envelope(rows, by):
        return weighted_quantile(rows, by, "logr", "w", C.CELL_QUANTILE, parts=parts).select(*by, F.col("quantile").alias("raw"))

    pooled = fixed.withColumnRenamed("shade", "cell").join(envelope(shown, keys), keys).withColumn("half", F.lit(None).cast("int"))
    sides = [*keys, "half"]
    seasonal = split.join(envelope(shown.join(split.select(*sides), sides, "left_semi"), sides), sides)
    joint = pooled.unionByName(seasonal).join(level, who).select(
        *keys, "half", "cell", "n", F.lit(0.0).alias("reference"), F.col("cell").alias("shade"), log_factor(F.col("cell"), F.col("n"), F.lit(0.0)).alias("value"), "raw", "level", F.lit("differential").alias("method"))
    return _named(cut.keep(joint.unionByName(solo)), named)


def _named(cells: DataFrame, named: bool) -> DataFrame:
    return cells if named else cells.drop("plant_id")


def _left(tied: DataFrame, level: DataFrame) -> DataFrame:
    """What level and moment leave, as a clear day's shade, and its weight."""
    left = tied.join(level, ["plant_id", "string_id"]).withColumn("left", _clear_day(F.col("logr") - F.col("level") - F.col("tau"), F.coalesce("known", F.lit(1.0))))
    return left.withColumn("lit", F.col("w") * F.col("beam")).filter("lit > 0").select("plant_id", "string_id", *CELL, "half", "ts_utc", "left", "lit")


def _absolute(rows: DataFrame) -> DataFrame:
    """The absolute map, pooled and split, in the form of the joint one."""
    pooled = absolute_fit(rows)
    who = owner(rows)
    halves = by_half(seasonal_cells(rows), pooled).select(*who, *CELL, "half", "cell", "n", "reference", "value")
    both = pooled.select(*who, *CELL, F.lit(None).cast("int").alias("half"), "cell", "n", "reference", "value").unionByName(halves)
    return both.select(*who, *CELL, "half", "cell", "n", "reference", F.least(F.col("cell") - F.col("reference"), F.lit(0.0)).alias("shade"), "value", F.col("cell").alias("raw"), F.col("reference").alias("level"), F.lit("absolute").alias("method"))


def _blended(shade, beam):
    """A clear-day shade at partial beam, in log space."""
    return F.log(F.greatest(1 - beam * (1 - F.exp(shade)), F.lit(C.SHADE_LOW)))


def _clear_day(left, beam):
    """The clear-day shade that what is left at partial beam implies."""
    return F.log(F.greatest(F.least(1 - (1 - F.exp(left)) / F.greatest(beam, F.lit(1e-6)), F.lit(1.0)), F.lit(C.SHADE_LOW)))


def refit_due(counts: DataFrame, before: DataFrame) -> DataFrame:
    """Strings grown by a tenth and 24 rows since the last fit (CMP-20)."""
    who = owner(counts)
    b = before.select(*who, F.col("n").alias("was"))
    return counts.join(b, who, "left").withColumn("was", F.coalesce("was", F.lit(0))).withColumn("due", (F.col("n") >= 1.10 * F.col("was")) & (F.col("n") - F.col("was") >= 24))
