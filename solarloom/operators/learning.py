"""Ordered learning of log ratios (ITR-01, AGG-18) and efficiency curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.predicates import curve_at, nearest_load, recency
from ..plans.lineage import Cuts

ALPHA = 1 - 0.5 ** (1 / C.EMA_HALF_LIFE)


def composed(segment: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's map x -> scale * x + shift after all earlier ones of its
    segment (equal neighbours), by doubling: a logarithmic number of array
    steps, and products that only shrink, so that none overflows."""
    scale, shift = scale.astype(float), shift.astype(float)
    far = int(np.diff(np.flatnonzero(np.diff(segment, prepend=segment[:1] - 1, append=segment[-1:] + 1))).max(initial=0)) if len(segment) else 0
    step = 1
    while step < far:
        joined = np.flatnonzero(segment[step:] == segment[:-step])
        late, soon = joined + step, joined
        moved, drawn = scale[late] * shift[soon] + shift[late], scale[late] * scale[soon]
        shift[late], scale[late] = moved, drawn
        step *= 2
    return scale, shift


def running_effect(rows: DataFrame, by: list[str], value: str, weight: str, order: list[str], block_rows: int = 50_000, start: DataFrame | None = None) -> DataFrame:
    """``rows`` with the decayed mean (value, n_eff) of their bucket after each
    row, in ``order`` (WIN-05). A step is affine in (value, n_eff): rows are
    dealt by ranges of the whole order, with bounds that Spark samples so that
    each block has about ``block_rows`` rows however unevenly they lie in time;
    each block folds to one map for each of its buckets, the few maps of a
    bucket are chained, and each block is replayed from the states it begins
    with. So a task holds about a block's rows, whatever bucket or moment has
    most of them. ``rows`` is read several times: give it cut. ``start``
    (``by``, value, n_eff) is what buckets had learned before; others begin at
    zero."""
    kinds = dict(rows.dtypes)
    cut = Cuts()
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = cut(rows.repartitionByRange(blocks, *order).withColumn("__block", F.spark_partition_id().cast("long")))
    head = "__block long, " + ", ".join(f"`{k}` {kinds[k]}" for k in by)
    maps = f"{head}, scale double, shift double, keep double, add double"

    def scanned(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[np.ndarray]]:
        """The rows by bucket and order, their bucket's number, and the maps of
        value and n_eff up to each."""
        frame = frame.assign(__at=frame.groupby(by, dropna=False, sort=False).ngroup()).sort_values(["__at", *order], kind="stable")
        segment, w = frame.pop("__at").to_numpy(), frame[weight].to_numpy(float)
        a = np.minimum(1.0, ALPHA * w)
        return frame, segment, [*composed(segment, 1 - a, a * frame[value].to_numpy(float)), *composed(segment, np.full(len(w), 1 - ALPHA), w)]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame, segment, found = scanned(frame)
        last = np.append(segment[1:] != segment[:-1], True)
        return frame.loc[last, ["__block", *by]].assign(**{c: x[last] for c, x in zip(("scale", "shift", "keep", "add"), found)})

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        """The states that a bucket's blocks begin with."""
        frame = frame.sort_values("__block")
        one = np.zeros(len(frame), np.int64)
        out = frame[["__block", *by]].copy()
        for begin, scale, shift in (("__v", "scale", "shift"), ("__n", "keep", "add")):
            first = float(frame[f"{begin}0"].iloc[0])
            a, b = composed(one, frame[scale].to_numpy(), frame[shift].to_numpy())
            out[begin] = np.append(first, (a * first + b)[:-1])
        return out

    def replay(frame: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        frame, segment, (scale, shift, keep, add) = scanned(frame)
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        states = frame.iloc[first][by].merge(begin, on=by, how="left")[["__v", "__n"]].to_numpy()[np.cumsum(np.diff(segment, prepend=-1) != 0) - 1]
        v, n = scale * states[:, 0] + shift, keep * states[:, 1] + add
        shrunk = np.where(n > 0, np.clip(v * n / np.where(n > 0, n + C.SHRINK_K, 1.0), -C.EFFECT_CLAMP, C.EFFECT_CLAMP), 0.0)
        return frame.drop(columns="__block").assign(ema=v, n_eff=n, ema_shrunk=shrunk)

    folded = dealt.groupBy("__block").applyInPandas(fold, maps)
    if start is None:
        folded = folded.withColumn("__v0", F.lit(0.0)).withColumn("__n0", F.lit(0.0))
    else:
        had = start.select(*by, F.col("value").alias("__v0"), F.col("n_eff").alias("__n0"))
        folded = folded.join(had, by, "left").fillna(0.0, ["__v0", "__n0"])
    begin = folded.groupBy(*by).applyInPandas(chain, f"{head}, __v double, __n double")
    schema = f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, ema double, n_eff double, ema_shrunk double"
    return cut.keep(dealt.groupBy("__block").cogroup(begin.groupBy("__block")).applyInPandas(replay, schema))


LAYERS = {"plant": ["weather", "part"], "string": ["string_id"], "string_daypart": ["string_id", "part"]}


def _running(frame: pd.DataFrame, by: list[str], value: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of rows in order: their places by bucket, the buckets' numbers there,
    and the maps of value and n_eff up to each."""
    number = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    at = np.argsort(number, kind="stable")
    segment, a = number[at], np.minimum(1.0, ALPHA * w[at])
    return at, segment, [*composed(segment, 1 - a, a * value[at]), *composed(segment, np.full(len(at), 1 - ALPHA), w[at])]


def _left_by(frame: pd.DataFrame, by: list[str], value: np.ndarray, w: np.ndarray, begin: pd.DataFrame) -> np.ndarray:
    """What the effect of a layer, from the states that its buckets begin with,
    leaves of each value."""
    at, segment, (scale, shift, keep, add) = _running(frame, by, value, w)
    heads = np.flatnonzero(np.diff(segment, prepend=-1))
    had = frame.iloc[at[heads]][by].merge(begin, on=by, how="left")[["__v", "__n"]].to_numpy(float)[segment]
    v, n = scale * had[:, 0] + shift, keep * had[:, 1] + add
    out = value.copy()
    out[at] -= np.where(n > 0, np.clip(v * n / np.where(n > 0, n + C.SHRINK_K, 1.0), -C.EFFECT_CLAMP, C.EFFECT_CLAMP), 0.0)
    return out


def learn_effects(obs: DataFrame, stored: DataFrame | None = None, block_rows: int = 50_000) -> DataFrame:
    """Three keyed scans in place of one global loop (ITR-01): the plant layer
    sees the residual, the string layer what that leaves, the third layer what
    both leave. ``obs`` has hour, string_id, weather, part, residual, weight,
    and plant_id where it is of several plants, which then learn apart.
    Gives (plant_id, scope, key, value, n_eff) after the last row of each
    bucket; ``stored``, of the same form, is what earlier hours taught.

    The layers share one order, so rows are dealt to blocks once (see
    ``running_effect``) and never written again: the pass of a layer works out
    what the layers before it leave from the states that its block begins
    with, and only gives a map for each of its buckets. The end of a bucket's
    chain is its effect."""
    who = ["plant_id"] if "plant_id" in obs.columns else []
    order = ["hour", *who, "string_id", "residual", "weight", "weather", "part"]  # those after string_id settle ties alone
    kinds, cut = dict(obs.dtypes), Cuts()

    def start(scope, by):
        names = by[len(who):]
        parts = [F.col("key")] if len(names) == 1 else [F.regexp_extract("key", r"^(.*)\|([^|]*)$", i) for i in (1, 2)]
        return stored.filter(F.col("scope") == scope).select(*who, *[c.alias(k) for c, k in zip(parts, names)], F.col("value").alias("__v0"), F.col("n_eff").alias("__n0"))

    def layer(number: int, by: list[str]):
        before = [[*who, *names] for names in list(LAYERS.values())[:number]]

        def fold(frame: pd.DataFrame, begin: pd.DataFrame | None) -> pd.DataFrame:
            if not len(frame):
                return pd.DataFrame(columns=["__block", *by, "scale", "shift", "keep", "add"])
            frame = frame.sort_values(order, kind="stable")
            left, w = frame["residual"].to_numpy(float), frame["weight"].to_numpy(float)
            for i, earlier in enumerate(before):
                left = _left_by(frame, earlier, left, w, begin.loc[begin["__layer"] == i, [*earlier, "__v", "__n"]])
            at, segment, found = _running(frame, by, left, w)
            last = np.append(segment[1:] != segment[:-1], True)
            return frame.iloc[at[last]][["__block", *by]].assign(**{c: x[last] for c, x in zip(("scale", "shift", "keep", "add"), found)})

        def alone(frame: pd.DataFrame) -> pd.DataFrame:
            return fold(frame, None)

        def chain(frame: pd.DataFrame) -> pd.DataFrame:
            """The states that a bucket's blocks begin with, and its last as
            that of block -1."""
            frame = frame.sort_values("__block")
            one = np.zeros(len(frame), np.int64)
            out = pd.concat([frame[["__block", *by]], frame[["__block", *by]].iloc[-1:].assign(__block=-1)])
            for begin, scale, shift in (("__v", "scale", "shift"), ("__n", "keep", "add")):
                first = float(frame[f"{begin}0"].iloc[0])
                a, b = composed(one, frame[scale].to_numpy(), frame[shift].to_numpy())
                out[begin] = np.append(first, a * first + b)
            return out

        return alone if number == 0 else fold, chain

    rows = cut(obs.select(*order))
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = cut(rows.repartitionByRange(blocks, *order).withColumn("__block", F.spark_partition_id().cast("long")))
    states, out = None, None
    for number, (scope, names) in enumerate(LAYERS.items()):
        by = [*who, *names]
        head = "__block long, " + ", ".join(f"`{k}` {kinds[k]}" for k in by)
        fold, chain = layer(number, by)
        maps, grouped = f"{head}, scale double, shift double, keep double, add double", dealt.groupBy("__block")
        folded = grouped.applyInPandas(fold, maps) if states is None else grouped.cogroup(states.groupBy("__block")).applyInPandas(fold, maps)
        if stored is None:
            folded = folded.withColumn("__v0", F.lit(0.0)).withColumn("__n0", F.lit(0.0))
        else:
            folded = folded.join(start(scope, by), by, "left").fillna(0.0, ["__v0", "__n0"])
        chained = cut(folded.groupBy(*by).applyInPandas(chain, f"{head}, __v double, __n double"))
        begin = chained.filter("__block >= 0").select("__block", F.lit(number).alias("__layer"), *who, *[(F.col(k) if k in names else F.lit(None).cast(kinds[k])).alias(k) for k in ("weather", "part", "string_id")], "__v", "__n")
        states = begin if states is None else states.unionByName(begin)
        ends = chained.filter("__block = -1").select(*who, F.lit(scope).alias("scope"), F.concat_ws("|", *names).alias("key"), F.col("__v").alias("value"), F.col("__n").alias("n_eff"))
        out = ends if out is None else out.unionByName(ends)
    return cut.keep(out)


def fit_curves(pairs: DataFrame, reference: DataFrame, now: int) -> DataFrame:
    """Efficiency per scope and load bucket (CMP-14, AGG-21): weighted mean and
    population variance of the clean pairs (FLT-18), shrunk to the prior at 50
    observations and held within five points of it; and the highest load seen
    before the pairs are cleaned. ``reference`` has scope_id, reference_w,
    prior (array of load, eta). One pass over the pairs: the variance is taken
    about a value inside the range of clean pairs, so that little cancels; all
    that is left after it is a row for each bucket."""
    keys = ["scope_id", "bucket"]
    p = pairs.filter("in_w > 0 and out_w >= 0 and coverage > 0 and coalesce(censored, 1) = 0").join(reference, "scope_id")
    p = p.withColumn("load", F.col("in_w") / F.col("reference_w") * 100).withColumn("eta", F.col("out_w") / F.col("in_w")).filter("load >= 1")
    p = p.select(*keys[:1], "load", "eta", nearest_load("load").alias("bucket"), "prior", F.expr("out_w < 0.98 * reference_w and eta > 0.3 and eta <= 1.05").alias("clean"),
                 (F.col("coverage") * recency((F.lit(now) - F.col("ts_utc")) / 86400, C.CURVE_RECENCY_DAYS)).alias("weight"))
    p = p.withColumn("w", F.when(F.col("clean"), F.col("weight"))).withColumn("away", F.col("eta") - 0.95)
    bins = p.groupBy(*keys).agg(F.max("load").alias("top"), F.count_if("clean").alias("n"), F.sum("w").alias("n_eff"), F.sum(F.col("w") * F.col("eta")).alias("sum"),
                                F.sum(F.col("w") * F.col("away")).alias("first"), F.sum(F.col("w") * F.col("away") * F.col("away")).alias("second"), F.first("prior").alias("prior"))
    bins = bins.withColumn("max_load", F.max("top").over(Window.partitionBy("scope_id"))).filter("n > 0").withColumn("base", curve_at("prior", "bucket"))
    mean = F.col("first") / F.col("n_eff")
    bins = bins.withColumn("measured", F.col("sum") / F.col("n_eff")).withColumn("variance", F.greatest(F.lit(0.0), F.col("second") / F.col("n_eff") - mean * mean))
    return bins.select(*keys, "n", "n_eff", "measured", "variance", held_to_prior("measured", "n_eff", "base").alias("eta"), "max_load")


def held_to_prior(measured, n_eff, base):
    """A bucket's efficiency: between the prior and what was measured, by the
    evidence, within the cap, at most 1."""
    m, n, b = F.col(measured), F.col(n_eff), F.col(base)
    mixed = b + (m - b) * n / (n + C.CURVE_MIN_SAMPLES)
    return F.when(mixed.isNotNull(), F.greatest(b - C.CURVE_CAP, F.least(F.least(b + C.CURVE_CAP, F.lit(1.0)), mixed)))


def looks_derived(bins: DataFrame) -> DataFrame:
    """Scopes whose efficiency is flat over a wide load range (FLT-20)."""
    usable = bins.filter("n_eff >= 5").groupBy("scope_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.min_by("measured", "bucket").alias("elo"), F.max_by("measured", "bucket").alias("ehi"))
    return usable.select("scope_id", ((F.col("hi") >= 4 * F.col("lo")) & (F.abs(F.col("ehi") - F.col("elo")) < 0.015)).alias("derived"))
