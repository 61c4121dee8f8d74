"""Queries of publishing, mutation and scalar operators over the adapter
views, each with its ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import predicates as R
from .operators import aggregate as A
from .operators import joins as J
from .operators import learning as L
from .operators import mutations as M
from .operators import publish as P
from .queries import END, INTEGRATED, LOG, PLANT, SKY_NOW, START, _latest, query, rounded, running_sql, sql_rounded
from .plans.lineage import materialize
from .sources import adapters as D

AT = 1706265000
ORDERS = "o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, o_totalprice FROM orders)"


def slot():
    """Number of the five-minute interval."""
    return F.floor(F.col("ts_utc") / 300).cast("long")


@query("agg08_grid_between", sql_rounded("imported_kwh* exported_kwh*", f"""WITH {PLANT}, hr AS (SELECT ts_utc // 3600 * 3600 AS ts_utc, sum(greatest(grid, 0)) / 12000 AS i, sum(greatest(-grid, 0)) / 12000 AS e FROM pl WHERE ts_utc // 3600 % 3 <> 0 GROUP BY ALL),
wh AS (SELECT * FROM hr WHERE ts_utc >= {-(-START // 3600) * 3600} AND ts_utc < {END // 3600 * 3600}),
x AS (SELECT i, e FROM wh UNION ALL SELECT greatest(grid, 0) / 12000, greatest(-grid, 0) / 12000 FROM pl WHERE ts_utc >= {START} AND ts_utc < {END} AND ts_utc // 3600 * 3600 NOT IN (SELECT ts_utc FROM wh)),
g AS (SELECT sum(i) AS imported_kwh, sum(e) AS exported_kwh FROM x) SELECT {{cols}} FROM g"""))
def _(spark, d):
    state = D.plant_state(spark, d)
    hours = A.fold_plant(state.filter(F.floor(F.col("ts_utc") / 3600) % 3 != 0))
    return rounded(P.grid_between(hours, state, START, END))


@query("agg12_merge_series", f"WITH {INTEGRATED} SELECT ts_utc, round(sum(energy_kwh), 4) + 0.0 AS value FROM hr GROUP BY ALL")
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("string_id", "ts_utc", F.col("energy_kwh").alias("value"))
    return A.merge_series(*[hours.filter(F.col("string_id") == s).drop("string_id") for s in ("s1", "s2", "s3")])


@query("agg24_peak_hour", sql_rounded("string_id day peak_ts_utc peak_kwh*", f"WITH {INTEGRATED}, g AS (SELECT string_id, ts_utc // 86400 AS day, ts_utc AS peak_ts_utc, energy_kwh AS peak_kwh FROM hr QUALIFY row_number() OVER (PARTITION BY string_id, ts_utc // 86400 ORDER BY energy_kwh DESC, ts_utc) = 1) SELECT {{cols}} FROM g"))
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("string_id", R.floor_to("ts_utc", 86400).alias("day"), "ts_utc", F.col("energy_kwh").alias("value"))
    return rounded(P.peak_hour(hours.withColumn("day", (F.col("day") / 86400).cast("long")), ["string_id", "day"]))


@query("agg10_outlook", f"WITH {LOG}, nw AS (SELECT ts_utc // 86400 AS day, CAST(horizon_h AS DOUBLE) AS r, potential_kwh AS c FROM latest QUALIFY row_number() OVER (PARTITION BY ts_utc, string_id ORDER BY issued_at_utc DESC) = 1) SELECT day, max(r) AS rain_probability_pct, round(avg(c), 1) + 0.0 AS clouds_pct, round(sum(c), 2) + 0.0 AS rain_mm FROM nw GROUP BY ALL")
def _(spark, d):
    newest = J.newest_issue(_latest(spark, d), ["ts_utc", "string_id"])
    return P.outlook(newest.select((R.floor_to("ts_utc", 86400) / 86400).cast("long").alias("day"), F.col("horizon_h").cast("double").alias("rain_probability_pct"), F.col("potential_kwh").alias("clouds_pct"), F.col("potential_kwh").alias("rain_mm")), ["day"])


@query("agg15_classify_hours", f"WITH {INTEGRATED}, h AS (SELECT ts_utc // 3600 * 3600 AS hour, avg(power_mean_w * 5) AS g, avg(CAST(ts_utc // 300 % 500 AS DOUBLE)) AS cs, max(ts_utc // 300 % 7 * 0.04) AS rain, avg(ts_utc // 300 % 100) AS clouds FROM fm GROUP BY ALL), k AS (SELECT *, CASE WHEN cs > 20 THEN g / cs END AS kc FROM h) SELECT hour, CASE WHEN rain >= 0.2 THEN 'rain' WHEN kc >= 0.75 THEN 'clear' WHEN kc >= 0.4 THEN 'partly_cloudy' WHEN kc IS NOT NULL THEN 'overcast' WHEN clouds < 25 THEN 'clear' WHEN clouds < 75 THEN 'partly_cloudy' WHEN clouds IS NOT NULL THEN 'overcast' ELSE 'partly_cloudy' END AS weather, CASE WHEN hour % 86400 + 1800 - 43200 < -7200 THEN 'morning' WHEN hour % 86400 + 1800 - 43200 <= 7200 THEN 'midday' ELSE 'afternoon' END AS part FROM k")
def _(spark, d):
    f = D.fivemin(spark, d)
    return P.classify_hours(f.select(R.floor_to("ts_utc", 3600).alias("hour"), (F.col("power_mean_w") * 5).alias("ghi"), (slot() % 500).cast("double").alias("cs_ghi"), (slot() % 7 * 0.04).alias("rain_mm"), (slot() % 100).alias("clouds_pct"), (R.floor_to("ts_utc", 86400) + 43200).alias("noon_ts")))


@query("cmp02_sky_state", f"""WITH {INTEGRATED}, w AS (SELECT string_id, ts_utc // 7200 AS win, power_mean_w * 5 AS m, 30.0 + ts_utc // 300 % 400 AS c, (30.0 + ts_utc // 300 % 400) * 0.7 AS f FROM fm),
g AS (SELECT string_id, win, count(m) AS seen, count(*) FILTER (c > 50) AS lit, count(*) FILTER (c > 50 AND m >= 0) AS intervals, median(m / c) FILTER (c > 50 AND m >= 0) AS kt, count(*) FILTER (c > 50 AND m >= 0 AND f > 5) AS fo, count(*) FILTER (c > 50 AND m >= 0 AND f > 5 AND m / f > 0.05 AND m / f < 5) AS ins, stddev_pop(ln(m / f)) FILTER (c > 50 AND m > 0 AND f > 5 AND m / f > 0.05 AND m / f < 5) AS sd, min(m) AS lo, max(m) AS hi FROM w GROUP BY ALL),
r AS (SELECT *, CASE WHEN seen = 0 THEN 'no_measurement' WHEN seen >= 3 AND hi > 50 AND lo = hi THEN 'frozen' WHEN lit < 3 THEN 'too_dark' WHEN intervals < 3 THEN 'thin' WHEN kt <= 0 THEN 'too_dark' ELSE '' END AS reason FROM g),
s AS (SELECT *, CASE WHEN reason = '' AND fo >= 3 AND ins >= 3 THEN sd END AS spread FROM r)
SELECT string_id, win, round(CASE WHEN reason = '' THEN least(kt, 1.1) END, 6) + 0.0 AS kt, round(spread, 6) + 0.0 AS spread, intervals, CASE WHEN reason = '' THEN CASE WHEN spread <= 0.143 THEN 4200.0 ELSE 1860.0 END END AS halflife_s, reason FROM s""")
def _(spark, d):
    f, c = D.fivemin(spark, d), (30.0 + slot() % 400)
    return rounded(P.sky_state(f.select("string_id", F.floor(F.col("ts_utc") / 7200).alias("win"), (F.col("power_mean_w") * 5).alias("measured"), c.alias("clearsky"), (c * 0.7).alias("forecast")), ["string_id", "win"]))


CONDITIONS = "cd AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 20 AS DOUBLE) AS ghi, 200.0 + l_partkey % 800 AS cs, l_orderkey % 200 * 60 - 600 AS h, l_linenumber % 5 <> 0 AS covered, 0.8 AS kt, l_suppkey % 3 * 0.1 AS spread FROM lineitem), nc AS (SELECT *, CASE WHEN NOT covered OR h <= 0 OR h >= 7200 THEN 0.0 ELSE 6.0 / 9.0 * pow(0.5, h / CASE WHEN spread <= 0.143 THEN 4200.0 ELSE 1860.0 END) END AS w FROM cd)"


@query("cmp03_apply_nowcast", f"WITH {CONDITIONS} SELECT l_orderkey, l_linenumber, l_partkey, round(w, 6) + 0.0 AS nowcast_weight, round(CASE WHEN w > 0 THEN greatest(0.0, least(w * kt * cs + (1 - w) * ghi, 1.1 * cs)) ELSE ghi END, 6) + 0.0 AS ghi, round(CASE WHEN w <= 0 THEN ghi * 0.5 END, 6) + 0.0 AS dhi FROM nc")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    ghi = (F.col("l_quantity") * 20).cast("double")
    rows = x.select("l_orderkey", "l_linenumber", "l_partkey", ghi.alias("ghi"), (200.0 + F.col("l_partkey") % 800).alias("cs_ghi"), (ghi * 0.6).alias("dni"), (ghi * 0.5).alias("dhi"), (F.col("l_linenumber") % 5 != 0).alias("covered"),
                    (F.col("l_orderkey") % 200 * 60 - 600).alias("horizon_s"), F.lit(0.8).alias("kt"), (F.col("l_suppkey") % 3 * 0.1).alias("spread"), F.lit(6.0).alias("n_eff"))
    return rounded(P.apply_nowcast(rows).select("l_orderkey", "l_linenumber", "l_partkey", "nowcast_weight", "ghi", "dhi"))


@query("cmp04_unshaded", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(CASE WHEN l_discount = 0 THEN p ELSE p / (l_discount * 10) END, 1800, 1500), 6) + 0.0 AS unshaded_w FROM (SELECT *, CAST(l_quantity * 30 AS DOUBLE) AS p FROM lineitem)")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", P.unshaded((F.col("l_quantity") * 30).cast("double"), F.col("l_discount") * 10, 1800.0, 1500.0).alias("unshaded_w")))


@query("cmp06_group_binding", f"""WITH {INTEGRATED}, m(group_id, string_id, pos) AS (VALUES ('g1', 's1', 0), ('g1', 's2', 1), ('g2', 's3', 0)), wn AS (SELECT group_id, count(*) AS want FROM m GROUP BY ALL),
x AS (SELECT m.*, ts_utc, power_mean_w AS p, power_mean_w * 1.2 AS q, limit_commanded_w AS li FROM fm JOIN m USING (string_id)),
g AS (SELECT group_id, ts_utc, count(p) AS have, sum(p) AS p, sum(q) AS q, arg_max(li, pos) FILTER (li IS NOT NULL) AS li FROM x GROUP BY ALL),
v AS (SELECT group_id, ts_utc, CASE WHEN have = want THEN p END AS measured_w, CASE WHEN have = want THEN q END AS physics_w, CASE WHEN have = want THEN li END AS limit_w FROM g JOIN wn USING (group_id))
SELECT group_id, ts_utc, round(measured_w, 6) + 0.0 AS measured_w, round(physics_w, 6) + 0.0 AS physics_w, round(limit_w, 6) + 0.0 AS limit_w, CASE WHEN limit_w IS NULL OR measured_w IS NULL THEN NULL WHEN limit_w <= 0 THEN true ELSE measured_w >= 0.97 * limit_w AND physics_w > 1.05 * limit_w END AS binding FROM v""")
def _(spark, d):
    members = spark.createDataFrame([("g1", "s1", 0), ("g1", "s2", 1), ("g2", "s3", 0)], "group_id string, string_id string, pos int")
    return rounded(P.group_binding(D.fivemin(spark, d).withColumn("physics_w", F.col("power_mean_w") * 1.2), members))


WHOLE_ISSUES = f"{LOG}, iss AS (SELECT ts_utc, string_id, issued_at_utc, horizon_h, potential_kwh * 10 AS g FROM latest), ms AS (SELECT ts_utc // 3600 * 3600 AS ts_utc, avg(value) * 5 AS m FROM (SELECT epoch_us(ts) // 1000000 AS ts_utc, value FROM events WHERE event_type = 'click') GROUP BY ALL), tr AS (SELECT ts_utc, string_id, coalesce(any_value(m), arg_max(g, issued_at_utc) FILTER (horizon_h <= 2)) AS truth FROM iss LEFT JOIN ms USING (ts_utc) GROUP BY ALL)"


def _whole_issues(spark, d):
    """Of all strings, each with its own newest issue, and of all clicks."""
    issues = _latest(spark, d).select("ts_utc", "string_id", "issued_at_utc", "horizon_h", (F.col("potential_kwh") * 10).alias("ghi_wm2"))
    e = D.table(spark, d, "events").filter("event_type = 'click'")
    measured = e.select(R.floor_to(D.micros(e, "ts") / 1000000, 3600).alias("ts_utc"), "value").groupBy("ts_utc").agg((F.avg("value") * 5).alias("ghi"))
    return P.bias_observations(issues, measured, ("string_id",))


BIAS_SQL = f"WITH {WHOLE_ISSUES} SELECT ts_utc, string_id, issued_at_utc, horizon_h, CASE WHEN horizon_h < 6 THEN '0-6h' WHEN horizon_h < 24 THEN '6-24h' WHEN horizon_h < 48 THEN '24-48h' ELSE '48h+' END AS bucket, round(truth, 6) + 0.0 AS truth, round(g, 6) + 0.0 AS ghi_wm2, round(ln(truth / g), 6) + 0.0 AS residual, round(least(truth, 600.0) / 600.0, 6) + 0.0 AS weight FROM iss JOIN tr USING (ts_utc, string_id) WHERE truth > 5 AND g > 5 AND horizon_h >= 0 AND NOT (horizon_h <= 2 AND truth = g) AND truth / g BETWEEN 0.05 AND 5"
# Both names run over all strings and clicks.
for _name in ("cmp08_bias_observations", "cmp08_bias_observations_whole"):
    query(_name, BIAS_SQL)(lambda spark, d: rounded(_whole_issues(spark, d)))


BIAS_SEEN = f"bs AS (SELECT ts_utc, string_id, ts_utc // 3600 % 24 AS hour_local, horizon_h, CASE WHEN horizon_h < 6 THEN '0-6h' WHEN horizon_h < 24 THEN '6-24h' WHEN horizon_h < 48 THEN '24-48h' ELSE '48h+' END AS bucket, ln(truth / g) AS residual, least(truth, 600.0) / 600.0 AS weight FROM iss JOIN tr USING (ts_utc, string_id) {BIAS_SQL[BIAS_SQL.index('WHERE truth > 5'):]})"


@query("cmp08_learn_bias", f"WITH RECURSIVE {WHOLE_ISSUES}, {BIAS_SEEN}, {running_sql('lb', 'bs', 'string_id, hour_local, bucket', 'residual', 'ts_utc, horizon_h')} SELECT string_id, CAST(hour_local AS INT) AS hour_local, bucket, round(arg_max(v, rn), 6) + 0.0 AS value, round(arg_max(n, rn), 6) + 0.0 AS n_eff FROM lb GROUP BY ALL")
def _(spark, d):
    rows = _whole_issues(spark, d).withColumn("hour_local", (F.floor(F.col("ts_utc") / 3600) % 24).cast("int"))
    keys = ["string_id", "hour_local", "bucket"]
    return rounded(L.running_effect(materialize(rows), keys, "residual", "weight", ["ts_utc", "horizon_h"]).groupBy(*keys).agg(F.max_by("ema", F.struct("ts_utc", "horizon_h")).alias("value"), F.max_by("n_eff", F.struct("ts_utc", "horizon_h")).alias("n_eff")))


@query("cmp07_implausible_hours", f"WITH {INTEGRATED}, g AS (SELECT ts_utc // 3600 * 3600 AS hour, count(DISTINCT ts_utc) AS n, avg(5.0 + ts_utc // 300 % 60) AS ceiling, sum(energy_wh) AS actual FROM fm GROUP BY ALL) SELECT hour, round(ceiling, 6) + 0.0 AS ceiling, round(actual, 6) + 0.0 AS actual FROM g WHERE n >= 4 AND actual > 30 AND actual > 1.15 * ceiling")
def _(spark, d):
    return rounded(P.implausible_hours(D.fivemin(spark, d).withColumn("ceiling_w", 5.0 + slot() % 60), 1.0, 4))


@query("cmp16_backfill", "SELECT l_orderkey * 3600 + 1801 AS ts_utc, 's' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS string_id, CAST(l_partkey % 360 AS DOUBLE) AS azimuth_deg, CAST(l_orderkey % 65 AS DOUBLE) AS elevation_deg, round(l_quantity / 18, 6) + 0.0 AS ratio, CAST(0.35 AS DOUBLE) AS weight, round(l_extendedprice / 20, 6) + 0.0 AS physics_w FROM lineitem WHERE l_orderkey % 65 >= 8 AND l_extendedprice / 20 >= 200 AND (l_extendedprice / 20 * (l_quantity / 18)) / (l_extendedprice / 20) BETWEEN 0.02 AND 2.5")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    e = F.col("l_extendedprice") / 20
    return rounded(P.backfill_rows(x.select((F.col("l_orderkey") * 3600).alias("hour"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("string_id"), e.alias("expected_w"), (e * (F.col("l_quantity") / 18)).alias("actual_w"), F.lit(10000.0).alias("nameplate_w"), (F.col("l_partkey") % 360).cast("double").alias("azimuth_deg"), (F.col("l_orderkey") % 65).cast("double").alias("elevation_deg"))))


@query("cmp21_health_runs", f"WITH {INTEGRATED}, u AS (SELECT string_id, ts_utc, coverage < 0.4 AS bad FROM fm), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY string_id ORDER BY ts_utc ROWS UNBOUNDED PRECEDING) AS island FROM u), r AS (SELECT *, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY string_id, island ORDER BY ts_utc ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM i) SELECT string_id, ts_utc, bad, run, bad AND run = 5 AS report FROM r")
def _(spark, d):
    return P.health_runs(D.fivemin(spark, d).select("string_id", "ts_utc", (F.col("coverage") < 0.4).alias("bad")), ["string_id"])


PLANT_POWER = f"WITH {INTEGRATED} SELECT ts_utc, round(CASE WHEN count(power_mean_w) = 3 THEN sum(power_mean_w) END, 6) + 0.0 AS power_w FROM fm GROUP BY ALL"
# Both names run over all strings.
for _name in ("cmp25_plant_power", "cmp25_plant_power_whole"):
    query(_name, PLANT_POWER)(lambda spark, d: rounded(P.plant_power(D.fivemin(spark, d), 3)))


_DAY, _HOUR = AT // 86400 * 86400, AT // 3600 * 3600


def _sum(start, end):
    return f"sum(potential_kwh) FILTER (ts_utc >= {start} AND ts_utc < {end})"


@query("met01_day_sums", sql_rounded("string_id today* tomorrow* day_after* remaining* next_hour* now_w*", f"WITH {LOG}, nw AS (SELECT * FROM latest WHERE ts_utc >= {_DAY} AND ts_utc < {_DAY + 259200} QUALIFY row_number() OVER (PARTITION BY ts_utc, string_id ORDER BY issued_at_utc DESC) = 1), g AS (SELECT string_id, coalesce({_sum(_DAY, _DAY + 86400)}, 0) AS today, {_sum(_DAY + 86400, _DAY + 172800)} AS tomorrow, {_sum(_DAY + 172800, _DAY + 259200)} AS day_after, coalesce({_sum(_HOUR, _DAY + 86400)}, 0) AS remaining, {_sum(_HOUR + 3600, _HOUR + 7200)} AS next_hour, {_sum(_HOUR, _HOUR + 3600)} * 1000 AS now_w FROM nw GROUP BY ALL) SELECT {{cols}} FROM g"))
def _(spark, d):
    return rounded(P.day_sums(J.newest_issue(_latest(spark, d), ["ts_utc", "string_id"]), AT, ["string_id"]))


@query("snk15_forecast_log", f"WITH {LOG} SELECT issued_at_utc, ts_utc, string_id, round(potential_kwh, 5) + 0.0 AS potential_kwh FROM latest WHERE ts_utc > issued_at_utc")
def _(spark, d):
    return P.log_rows(_latest(spark, d).withColumn("issued_at_utc", F.col("issued_at_utc") + 600)).select("issued_at_utc", "ts_utc", "string_id", "potential_kwh")


@query("snk03_upsert_keeping", f"WITH {INTEGRATED}, o AS (SELECT string_id, ts_utc, ts_utc // 300 % 4 AS censored FROM fm WHERE ts_utc // 300 % 2 = 0), n AS (SELECT string_id, ts_utc, 9 AS censored FROM fm WHERE ts_utc // 300 % 3 = 0) SELECT string_id, ts_utc, coalesce(o.censored, n.censored) AS censored FROM o FULL JOIN n USING (string_id, ts_utc)")
def _(spark, d):
    f = D.fivemin(spark, d).select("string_id", "ts_utc")
    return M.upsert_keeping(f.filter(slot() % 2 == 0).withColumn("censored", slot() % 4), f.filter(slot() % 3 == 0).withColumn("censored", F.lit(9).cast("long")), ["string_id", "ts_utc"], "censored")


@query("snk04_insert_missing", f"WITH {INTEGRATED} SELECT string_id, ts_utc, CASE WHEN ts_utc // 300 % 2 = 0 THEN 'old' ELSE 'new' END AS why FROM fm WHERE ts_utc // 300 % 2 = 0 OR ts_utc // 300 % 3 = 0")
def _(spark, d):
    f = D.fivemin(spark, d).select("string_id", "ts_utc")
    return M.insert_missing(f.filter(slot() % 2 == 0).withColumn("why", F.lit("old")), f.filter(slot() % 3 == 0).withColumn("why", F.lit("new")), ["string_id", "ts_utc"])


@query("snk09_flag_curtailment", f"WITH {INTEGRATED}, v AS (SELECT string_id, ts_utc, CASE WHEN ts_utc // 300 % 7 <> 0 THEN ts_utc // 300 % 2 = 0 END AS b FROM fm WHERE ts_utc // 300 % 3 = 0) SELECT string_id, ts_utc, CASE WHEN v.ts_utc IS NULL THEN limit_binding ELSE b END AS limit_binding, CASE WHEN v.ts_utc IS NULL OR value_kind = 'reconstructed' THEN value_kind WHEN b THEN 'lower_bound' WHEN NOT b AND value_kind = 'lower_bound' THEN 'measured' ELSE value_kind END AS value_kind FROM fm LEFT JOIN v USING (string_id, ts_utc)")
def _(spark, d):
    f = D.fivemin(spark, d)
    v = f.filter(slot() % 3 == 0).select("string_id", "ts_utc", F.when(slot() % 7 != 0, slot() % 2 == 0).alias("limit_binding"))
    return M.flag_curtailment(f, v).select("string_id", "ts_utc", "limit_binding", "value_kind")


@query("snk13_compact_raw", f"WITH {INTEGRATED} SELECT string_id, ts_utc FROM fm WHERE NOT (ts_utc < {AT - 10 * 86400} AND ts_utc // 3600 % 2 = 0)")
def _(spark, d):
    f = D.fivemin(spark, d)
    return M.compact_raw(f, A.fold_hourly(f).filter(F.floor(F.col("ts_utc") / 3600) % 2 == 0), AT, 10).select("string_id", "ts_utc")


@query("snk13_thin_shading", f"SELECT string_id, ts_utc, count(*) AS n FROM (SELECT 's' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS string_id, epoch_us(l_shipdate) // 1000000 + l_linenumber * 300 AS ts_utc FROM lineitem) WHERE ts_utc >= {SKY_NOW - 730 * 86400} AND (ts_utc >= {SKY_NOW - 120 * 86400} OR ts_utc % 300 <> 0 OR ts_utc // 300 % 4 = 0) GROUP BY ALL")
def _(spark, d):
    return M.thin_shading(D.shading_obs(spark, d), SKY_NOW).groupBy("string_id", "ts_utc").agg(F.count("*").alias("n"))


@query("jon16_peers", f"WITH {INTEGRATED}, x AS (SELECT string_id, ts_utc, power_mean_w AS p, 40.0 + ts_utc // 300 % 30 AS q FROM fm), s AS (SELECT a.ts_utc, a.string_id, a.q, median(b.p / b.q) AS ratio, max(b.p / b.q) - min(b.p / b.q) AS spread, count(*) AS n_peers FROM x a JOIN x b ON a.ts_utc = b.ts_utc AND b.string_id <> 's1' WHERE a.string_id = 's1' AND b.p > 0 GROUP BY ALL) SELECT ts_utc, string_id, round(q * ratio, 6) + 0.0 AS reconstructed_w, n_peers FROM s WHERE n_peers = 1 OR spread <= 0.35")
def _(spark, d):
    f = D.fivemin(spark, d)
    return rounded(J.peers(f.withColumn("limit_binding", F.col("string_id") == "s1").withColumn("physics_w", 40.0 + slot() % 30)))


@query("flt13_decline_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN w <= 0 THEN 'no_weight' WHEN p <= 0 THEN 'no_physics' WHEN m <= 0 THEN 'no_production' WHEN m / p < 0.05 OR m / p > 5 THEN 'ratio_out_of_range' WHEN k = 'lower_bound' AND p >= m THEN 'censored_and_consistent' END AS reason FROM (SELECT l_discount AS w, l_partkey % 9 * 20.0 AS p, CAST(l_quantity * (l_linenumber - 1) AS DOUBLE) AS m, CASE WHEN l_suppkey % 2 = 0 THEN 'lower_bound' ELSE 'measured' END AS k FROM lineitem)) GROUP BY ALL")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    kind = F.when(F.col("l_suppkey") % 2 == 0, "lower_bound").otherwise("measured")
    return x.select(R.decline_reason("l_discount", F.col("l_partkey") % 9 * 20.0, (F.col("l_quantity") * (F.col("l_linenumber") - 1)).cast("double"), kind).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("cmp13_convert", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(dc * CASE WHEN x <= 10 THEN 0.86 + 0.07 * (x - 2) / 8 WHEN x <= 50 THEN 0.93 + 0.03 * (x - 10) / 40 ELSE 0.96 - 0.01 * (x - 50) / 50 END, 900), 6) + 0.0 AS ac_w, round(dc * 0.97 * 0.96, 6) + 0.0 AS charge_w, list_extract(['2', '5', '10', '20', '35', '50', '75', '100'], 1 + len(list_filter([3.5, 7.5, 15, 27.5, 42.5, 62.5, 87.5], lambda b: b < x))) AS bucket FROM (SELECT *, CAST(l_quantity * 20 AS DOUBLE) AS dc, CAST(l_quantity * 2 AS DOUBLE) AS x FROM lineitem)")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    dc, load = (F.col("l_quantity") * 20).cast("double"), (F.col("l_quantity") * 2).cast("double")
    curve = F.array(*[F.struct(F.lit(a).alias("load"), F.lit(b).alias("eta")) for a, b in ((2.0, 0.86), (10.0, 0.93), (50.0, 0.96), (100.0, 0.95))])
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", F.least(dc * R.curve_at(curve, load), F.lit(900.0)).alias("ac_w"), (dc * 0.97 * 0.96).alias("charge_w"), R.nearest_load(load).cast("string").alias("bucket")))


MONTHS = [2.0, 4.0, 8.0, 11.0, 13.0, 14.0, 14.0, 12.0, 9.0, 6.0, 3.0, 2.0]


@query("scl26_period_share", f"WITH {ORDERS}, dy AS (SELECT o_orderkey, unnest(generate_series(a, a + CAST(o_custkey % 60 AS INT), INTERVAL 1 DAY)) AS t FROM o), g AS (SELECT o_orderkey, sum([{', '.join(str(m) for m in MONTHS)}][month(t)] / {sum(MONTHS)} / day(last_day(t))) AS share FROM dy GROUP BY ALL) SELECT o_orderkey, round(share, 6) + 0.0 AS share FROM g")
def _(spark, d):
    o = D.table(spark, d, "orders")
    start = F.col("o_orderdate").cast("date")
    return rounded(o.select("o_orderkey", P.period_share(start, F.date_add(start, (F.col("o_custkey") % 60).cast("int")), MONTHS).alias("share")))


@query("scl28_amortisation", "SELECT o_orderkey, round(CASE WHEN y > 0 AND m <= 1200 THEN m END, 6) + 0.0 AS months FROM (SELECT o_orderkey, y, greatest(0.0, 90000.0 - o_totalprice) / y * 12 AS m FROM (SELECT *, CAST(o_custkey % 50 * 40 AS DOUBLE) AS y FROM orders))")
def _(spark, d):
    o = D.table(spark, d, "orders")
    return rounded(o.select("o_orderkey", R.amortisation_months(F.lit(90000.0), "o_totalprice", (F.col("o_custkey") % 50 * 40).cast("double")).alias("months")))
