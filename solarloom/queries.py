"""Queries of the plant-analytics operators over the adapter views, each with
its ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import constants as C
from .functions import physics as P
from .functions import predicates as R
from .operators import aggregate as A
from .operators import joins as J
from .operators import learning as L
from .operators import mutations as M
from .operators import shading as S
from .sources import adapters as D

QUERIES, SQL = {}, {}
NOW = 1706659200
#: The shading and conversion views end with 2001.
SKY_NOW = 1009756800

# Adapter views as SQL.
SAMPLES = "SELECT 's' || CAST(user_id % 3 + 1 AS VARCHAR) AS entity_id, epoch_us(ts) / 1e6 AS ts_utc, CASE WHEN event_type <> 'error' THEN value END AS value FROM events"
INTEGRATED = f"""
smp AS ({SAMPLES}),
pr AS (SELECT entity_id, ts_utc AS t1, value AS v1, lag(ts_utc) OVER w AS t0, lag(value) OVER w AS v0 FROM smp WINDOW w AS (PARTITION BY entity_id ORDER BY ts_utc)),
sp AS (SELECT * FROM pr WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND t1 > t0 AND t1 - t0 <= 750),
pc AS (SELECT *, unnest(generate_series(CAST(floor(t0 / 300) AS BIGINT) * 300, CAST(floor(t1 / 300) AS BIGINT) * 300, 300)) AS w FROM sp),
cut AS (SELECT *, greatest(t0, CAST(w AS DOUBLE)) AS a, least(t1, CAST(w + 300 AS DOUBLE)) AS b FROM pc),
ar AS (SELECT entity_id, w AS ts_utc, a, b, v0 + (v1 - v0) / (t1 - t0) * (a - t0) AS va, v0 + (v1 - v0) / (t1 - t0) * (b - t0) AS vb FROM cut WHERE b > a),
al AS (SELECT entity_id, ts_utc, (va + vb) / 2 * (b - a) AS area, b - a AS span, greatest(va, vb) AS top, 0 AS n FROM ar
  UNION ALL SELECT entity_id, CAST(floor(ts_utc / 300) AS BIGINT) * 300, NULL, NULL, value, 1 FROM smp WHERE value IS NOT NULL),
gr AS (SELECT entity_id, ts_utc, sum(area) AS ws, sum(span) AS span, max(top) AS top, CAST(sum(n) AS BIGINT) AS sample_count FROM al GROUP BY ALL),
integ AS (SELECT entity_id, ts_utc, CASE WHEN span > 0 THEN ws / 3600 END AS energy_wh, CASE WHEN span > 0 THEN ws / span END AS power_mean_w, CASE WHEN span > 0 THEN least(1.0, span / 300) ELSE 0.0 END AS coverage, sample_count, CASE WHEN span > 0 THEN top END AS peak_w FROM gr),
fm AS (SELECT entity_id AS string_id, ts_utc, energy_wh, power_mean_w, coverage, sample_count,
  CASE WHEN ts_utc // 300 % 5 = 0 THEN 40.0 + ts_utc // 300 % 7 END AS limit_commanded_w, CASE WHEN ts_utc // 300 % 11 <> 0 THEN ts_utc // 300 % 5 = 0 END AS limit_binding,
  CASE WHEN ts_utc // 300 % 13 = 0 THEN 'reconstructed' WHEN ts_utc // 300 % 5 = 0 THEN 'lower_bound' ELSE 'measured' END AS value_kind FROM integ),
hr AS (SELECT string_id, ts_utc // 3600 * 3600 AS ts_utc, coalesce(sum(energy_wh), 0) / 1000 AS energy_kwh, least(1.0, sum(coverage) / 12) AS coverage, coalesce(avg(CAST(limit_binding AS INT)), 0) AS curtailed_fraction,
  min(limit_commanded_w) AS limit_min_w, max(limit_commanded_w) AS limit_max_w, avg(limit_commanded_w) AS limit_mean_w,
  CASE WHEN bool_or(value_kind = 'lower_bound') THEN 'lower_bound' WHEN bool_or(value_kind = 'reconstructed') THEN 'reconstructed' ELSE 'measured' END AS value_kind, count(*) AS rows_seen FROM fm GROUP BY ALL)"""
LOG = """
lg AS (SELECT event_id, epoch_us(ts) // 3600000000 * 3600 AS issued_at_utc, epoch_us(ts) // 3600000000 * 3600 + CAST(props->>'$.k' AS INT) % 72 * 3600 AS ts_utc, 's' || CAST(user_id % 3 + 1 AS VARCHAR) AS string_id, value / 100 AS potential_kwh, CAST(props->>'$.k' AS INT) % 72 AS horizon_h FROM events WHERE event_type = 'view'),
latest AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY issued_at_utc, ts_utc, string_id ORDER BY event_id DESC) = 1)"""
SKY = f"""
ob AS (SELECT 's' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS string_id, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) + l_linenumber * 300 AS ts_utc, CAST(l_partkey % 360 AS DOUBLE) AS az, CAST(l_orderkey % 65 AS DOUBLE) AS el, l_quantity / 25 AS ratio, 1 - l_discount AS weight FROM lineitem),
rw AS (SELECT string_id, ts_utc, CAST(floor(az / 10) AS INT) AS az_bin, CAST(floor(el / 5) AS INT) AS el_bin, CASE WHEN dayofyear(make_timestamp(ts_utc * 1000000)) >= 355 OR dayofyear(make_timestamp(ts_utc * 1000000)) < 172 THEN 0 ELSE 1 END AS half, ln(ratio) AS logr, weight * pow(0.5, greatest(0.0, ({SKY_NOW} - ts_utc) / 86400.0) / 730.0) AS w FROM ob WHERE el >= 8 AND ratio > 0 AND ratio <= 5),
cq AS (SELECT *, sum(w) OVER (PARTITION BY string_id, az_bin, el_bin ORDER BY logr, w ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY string_id, az_bin, el_bin) AS tot FROM rw),
cell AS (SELECT string_id, az_bin, el_bin, coalesce(min(logr) FILTER (cum >= 0.8 * tot), max(logr)) AS q, max(tot) AS n FROM cq GROUP BY ALL HAVING max(tot) >= {{least}}),
lv AS (SELECT string_id, least(coalesce(min(q) FILTER (cum >= 0.9 * tot), max(q)), 0.0) AS level FROM (SELECT string_id, q, sum(n) OVER (PARTITION BY string_id ORDER BY q, n ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY string_id) AS tot FROM cell) GROUP BY ALL),
fit AS (SELECT c.string_id, az_bin, el_bin, greatest(ln(0.05), least(0.0, q * n / (n + 6.0) - level)) AS value, n, q AS raw, level FROM cell c JOIN lv USING (string_id))""".replace("{least}", "4.0")


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Share that an observation of weight 1 has in the decayed mean.
STEP = 1 - 0.5 ** (1 / C.EMA_HALF_LIFE)


def running_sql(out: str, src: str, by: str, x: str, order: str) -> str:
    """CTEs that end in ``out``: the rows of ``src`` with the decayed mean v of
    ``x`` by ``weight``, n and the shrunk s, after each row of ``by``. Blocks of
    300 rows by a closed form, so that no power overflows; a recursion over the
    blocks. Needs WITH RECURSIVE."""
    inside = f"(PARTITION BY {by}, blk ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    return f"""{out}1 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS rn FROM {src}),
{out}2 AS (SELECT *, rn // 300 AS blk, rn % 300 + 1 AS k, {STEP!r} * weight AS a FROM {out}1),
{out}3 AS (SELECT *, sum(ln(1 - a)) OVER {inside} AS lg, pow({1 - STEP}, k) AS nk FROM {out}2),
{out}4 AS (SELECT *, exp(lg) * sum(a * {x} * exp(-lg)) OVER {inside} AS vi, nk * sum(weight / nk) OVER {inside} AS ni FROM {out}3),
{out}5 AS (SELECT {by}, blk, arg_max(exp(lg), rn) AS scale, arg_max(vi, rn) AS shift, arg_max(nk, rn) AS keep, arg_max(ni, rn) AS more FROM {out}4 GROUP BY ALL),
{out}6 AS (SELECT {by}, CAST(0 AS BIGINT) AS blk, CAST(0 AS DOUBLE) AS v0, CAST(0 AS DOUBLE) AS n0 FROM {out}5 WHERE blk = 0 UNION ALL SELECT {", ".join(f"e.{b.strip()}" for b in by.split(","))}, e.blk + 1, scale * v0 + shift, keep * n0 + more FROM {out}6 p JOIN {out}5 e USING ({by}, blk)),
{out}7 AS (SELECT t.*, exp(lg) * v0 + vi AS v, nk * n0 + ni AS n FROM {out}4 t JOIN {out}6 USING ({by}, blk)),
{out} AS (SELECT *, CASE WHEN n <= 0 THEN 0.0 ELSE greatest(-{C.EFFECT_CLAMP}, least({C.EFFECT_CLAMP}, v * n / (n + {C.SHRINK_K}))) END AS s FROM {out}7)"""


def effects_sql(with_: str, obs: str) -> str:
    """SQL of the learned effects of ``obs`` (hour, string_id, weather, part,
    residual, weight), a CTE of ``with_``."""
    order, keep = "hour, string_id, residual, weight", "hour, string_id, weather, part, residual, weight"
    layers = [running_sql("one", obs, "weather, part", "residual", order),
              f"r1 AS (SELECT {keep}, residual - s AS rest FROM one)", running_sql("two", "r1", "string_id", "rest", order),
              f"r2 AS (SELECT {keep}, rest - s AS rest FROM two)", running_sql("three", "r2", "string_id, part", "rest", order)]
    ends = [f"SELECT '{scope}' AS scope, {key} AS key, round(arg_max(v, rn), 5) + 0.0 AS value, round(arg_max(n, rn), 5) + 0.0 AS n_eff FROM {t} GROUP BY ALL"
            for scope, key, t in (("plant", "weather || '|' || part", "one"), ("string", "string_id", "two"), ("string_daypart", "string_id || '|' || part", "three"))]
    return f"WITH RECURSIVE {with_}, {', '.join(layers)} {' UNION ALL '.join(ends)}"


def rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(columns: str, body: str, digits=6) -> str:
    """Columns with a trailing * are doubles to round."""
    return body.replace("{cols}", ", ".join(f"round({c[:-1]}, {digits}) + 0.0 AS {c[:-1]}" if c.endswith("*") else c for c in columns.split()))


@query("agg01_integrate", sql_rounded("entity_id ts_utc energy_wh* power_mean_w* coverage* sample_count peak_w*", f"WITH {INTEGRATED} SELECT {{cols}} FROM integ"))
def _(spark, d):
    return rounded(A.integrate(D.samples(spark, d), 300))


@query("agg02_mean_last", sql_rounded("entity_id ts_utc mean_value* last_value*", f"WITH smp AS ({SAMPLES}), g AS (SELECT entity_id, CAST(floor(ts_utc / 300) AS BIGINT) * 300 AS ts_utc, avg(value) AS mean_value, arg_max(value, ts_utc) AS last_value FROM smp WHERE value IS NOT NULL GROUP BY ALL) SELECT {{cols}} FROM g"))
def _(spark, d):
    return rounded(A.mean_and_last(D.samples(spark, d)))


@query("agg04_fold_hourly", sql_rounded("string_id ts_utc energy_kwh* coverage* curtailed_fraction* limit_min_w* limit_max_w* limit_mean_w* value_kind rows_seen", f"WITH {INTEGRATED} SELECT {{cols}} FROM hr"))
def _(spark, d):
    return rounded(A.fold_hourly(D.fivemin(spark, d)))


PLANT = "pl AS (SELECT epoch_us(ts) // 300000000 * 300 AS ts_utc, event_id, CAST(CAST(props->>'$.k' AS INT) AS DOUBLE) AS soc, value * 10 - 1000 AS grid, CASE WHEN CAST(props->>'$.k' AS INT) % 7 <> 0 THEN value END AS load FROM events WHERE event_type = 'purchase')"


KWH = "CAST(sum(CAST({} AS DECIMAL(20, 6))) AS DOUBLE) * (300 / 3600.0 / 1000.0)"


# Nine digits: sums of cents times 5/6 end in exact ties at six.
@query("agg06_fold_plant", sql_rounded("ts_utc imported_kwh* exported_kwh* house_kwh* battery_soc_pct*", f"WITH {PLANT}, g AS (SELECT ts_utc // 3600 * 3600 AS ts_utc, {KWH.format('CASE WHEN grid > 0 THEN grid ELSE 0 END')} AS imported_kwh, {KWH.format('CASE WHEN grid < 0 THEN -grid ELSE 0 END')} AS exported_kwh, {KWH.format('coalesce(load, 0)')} AS house_kwh, avg(soc) AS battery_soc_pct FROM pl GROUP BY ALL) SELECT {{cols}} FROM g", 9))
def _(spark, d):
    return rounded(A.fold_plant(D.plant_state(spark, d)), 9)


START, END = 1704500123, 1705700456


@query("agg07_energy_between", sql_rounded("string_id energy_kwh*", f"""WITH {INTEGRATED},
wh AS (SELECT * FROM hr WHERE ts_utc >= {-(-START // 3600) * 3600} AND ts_utc < {END // 3600 * 3600} AND string_id <> 's2'),
x AS (SELECT string_id, energy_kwh AS k FROM wh UNION ALL SELECT string_id, energy_wh / 1000 FROM fm WHERE ts_utc >= {START} AND ts_utc < {END} AND (string_id, ts_utc // 3600 * 3600) NOT IN (SELECT string_id, ts_utc FROM wh)),
g AS (SELECT string_id, sum(k) AS energy_kwh FROM x GROUP BY ALL) SELECT {{cols}} FROM g"""))
def _(spark, d):
    five = D.fivemin(spark, d)
    return rounded(A.energy_between(A.fold_hourly(five).filter("string_id <> 's2'"), five, START, END))


@query("agg09_interval_stats", f"WITH {INTEGRATED} SELECT string_id, count(*) AS n, round(avg(coverage), 3) AS coverage_mean, round(avg(sample_count), 1) AS samples_mean, round(avg(CAST(limit_binding AS INT)), 6) AS curtailed_fraction, count(*) FILTER (value_kind = 'measured') AS n_measured, count(*) FILTER (value_kind = 'lower_bound') AS n_lower_bound, count(*) FILTER (value_kind = 'reconstructed') AS n_reconstructed FROM fm GROUP BY ALL")
def _(spark, d):
    return A.interval_stats(D.fivemin(spark, d)).withColumn("curtailed_fraction", F.round("curtailed_fraction", 6))


@query("flt01_assess", f"WITH {INTEGRATED}, q AS (SELECT string_id, ts_utc, coverage, value_kind, CASE WHEN coverage >= 0.95 THEN 'exact' WHEN ts_utc // 3600 % 24 - 5.0 < 3 THEN 'night' WHEN coverage >= 0.8 THEN 'partial' ELSE 'missing' END AS quality FROM hr), w AS (SELECT *, CASE WHEN quality IN ('exact', 'night') THEN 1.0 WHEN quality = 'partial' THEN greatest(0.0, least(1.0, coverage)) ELSE 0.0 END * CASE value_kind WHEN 'lower_bound' THEN 0.5 WHEN 'reconstructed' THEN 0.35 ELSE 1.0 END AS weight FROM q) SELECT string_id, ts_utc, quality, round(weight, 6) AS weight, quality IN ('exact', 'partial') AND weight > 0 AS usable FROM w")
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).withColumn("elevation", F.floor(F.col("ts_utc") / 3600) % 24 - 5.0)
    return hours.select("string_id", "ts_utc", R.assess("coverage", "elevation", "value_kind").alias("a")).select("string_id", "ts_utc", "a.quality", F.round("a.weight", 6).alias("weight"), "a.usable")


@query("flt06_binding", f"WITH {INTEGRATED}, b AS (SELECT *, power_mean_w * (1 + ts_utc // 300 % 3 * 0.1) AS physics FROM fm), v AS (SELECT string_id, ts_utc, CASE WHEN limit_commanded_w IS NULL OR power_mean_w IS NULL THEN NULL WHEN limit_commanded_w <= 0 THEN true WHEN physics IS NULL THEN NULL ELSE power_mean_w >= 0.97 * limit_commanded_w AND physics > 1.05 * limit_commanded_w END AS binding, CASE WHEN power_mean_w IS NULL OR physics IS NULL THEN NULL WHEN ts_utc // 300 % 101 < 98 THEN false ELSE physics > 1.10 * power_mean_w END AS battery FROM b) SELECT *, CASE WHEN binding OR battery THEN true WHEN NOT binding OR NOT battery THEN false END AS verdict FROM v")
def _(spark, d):
    f = D.fivemin(spark, d)
    slot = F.floor(F.col("ts_utc") / 300)
    f = f.withColumn("physics", F.col("power_mean_w") * (1 + slot % 3 * 0.1))
    out = f.select("string_id", "ts_utc", R.is_binding("power_mean_w", "limit_commanded_w", "physics").alias("binding"), R.full_battery("power_mean_w", "physics", slot % 101, F.lit(98)).alias("battery"))
    return out.withColumn("verdict", R.combine_verdicts("binding", "battery"))


@query("jon01_geometry_asof", f"WITH {INTEGRATED}, ge(string_id, vf, az, tilt, kwp) AS (VALUES ('s1', 1704500000, 180.0, 30.0, 1.8), ('s1', 1705300000, 175.0, 35.0, 1.8), ('s2', 1704100000, 180.0, 60.0, 1.0), ('s3', 1704200000, 110.0, 27.0, 0.95), ('s3', 1705000000, 112.0, 27.0, 0.95), ('s3', 1706000000, 115.0, 28.0, 0.9)), m AS (SELECT h.string_id, h.ts_utc, coalesce(max(vf) FILTER (vf <= h.ts_utc), min(vf)) AS vf FROM hr h JOIN ge g USING (string_id) GROUP BY ALL) SELECT m.string_id, m.ts_utc, CAST(m.vf AS BIGINT) AS valid_from_ts_utc, CAST(az AS DOUBLE) AS azimuth_deg, CAST(tilt AS DOUBLE) AS tilt_deg FROM m JOIN ge g ON g.string_id = m.string_id AND g.vf = m.vf")
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("string_id", "ts_utc")
    return J.geometry_asof(hours, D.geometry(spark)).drop("kwp")


def _latest(spark, d):
    return M.upsert(D.forecast_log(spark, d), D.forecast_log(spark, d).limit(0), ["issued_at_utc", "ts_utc", "string_id"], "event_id")


@query("snk01_upsert", f"WITH {LOG} SELECT * FROM latest")
def _(spark, d):
    return _latest(spark, d)


@query("jon02_newest_issue", f"WITH {LOG} SELECT ts_utc, string_id, issued_at_utc, potential_kwh FROM latest QUALIFY row_number() OVER (PARTITION BY ts_utc, string_id ORDER BY issued_at_utc DESC) = 1")
def _(spark, d):
    return J.newest_issue(_latest(spark, d), ["ts_utc", "string_id"]).select("ts_utc", "string_id", "issued_at_utc", "potential_kwh")


@query("jon05_closest_issue", f"WITH {LOG} SELECT ts_utc, string_id, issued_at_utc, horizon_h FROM latest QUALIFY row_number() OVER (PARTITION BY ts_utc, string_id ORDER BY abs(horizon_h), issued_at_utc DESC) = 1")
def _(spark, d):
    return J.closest_issue(_latest(spark, d), ["ts_utc", "string_id"]).select("ts_utc", "string_id", "issued_at_utc", "horizon_h")


ASOF = "SELECT h.ts_utc, h.string_id, arg_max(l.potential_kwh, l.issued_at_utc) AS forecast_kwh, any_value(h.energy_kwh) AS energy_kwh FROM hr h LEFT JOIN latest l ON l.ts_utc = h.ts_utc AND l.string_id = h.string_id AND l.issued_at_utc <= {until} GROUP BY ALL"


@query("jon03_forecast_asof", f"WITH {INTEGRATED}, {LOG}, g AS ({ASOF.format(until='h.ts_utc - 7200')}) SELECT ts_utc, string_id, forecast_kwh FROM g")
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id")
    return J.forecast_asof(hours, _latest(spark, d), 7200)


@query("jon04_forecast_dayahead", f"WITH {INTEGRATED}, {LOG}, g AS ({ASOF.format(until='h.ts_utc // 86400 * 86400 - 21600')}) SELECT ts_utc, string_id, forecast_kwh FROM g")
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id").withColumn("cutoff", R.floor_to("ts_utc", 86400) - 21600)
    return J.forecast_asof(hours, _latest(spark, d), cutoff="cutoff").drop("cutoff")


@query("agg19_score", f"WITH {INTEGRATED}, {LOG}, g AS ({ASOF.format(until='h.ts_utc')}), p AS (SELECT ts_utc // 86400 AS day, forecast_kwh AS p, energy_kwh AS a FROM g WHERE forecast_kwh IS NOT NULL), dd AS (SELECT day, sum(p) AS p, sum(a) AS a, sum(abs(p - a)) AS e, sum(p - a) AS s, count(*) AS n FROM p GROUP BY ALL) SELECT round(sum(abs(p - a)) / sum(a), 6) AS wmape, round(sum(e) / sum(n) / 3.75, 6) AS nmae, round(sum(e) / sum(n), 6) AS mae, round(sum(s) / sum(n), 6) AS bias, round(avg(p - a), 6) AS daily_bias, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM dd")
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id", "energy_kwh")
    pairs = J.forecast_asof(hours, _latest(spark, d), 0).filter("forecast_kwh is not null")
    return rounded(A.score(pairs.select(F.floor(F.col("ts_utc") / 86400).alias("day"), F.col("forecast_kwh").alias("predicted"), F.col("energy_kwh").alias("actual")), 3.75))


@query("snk02_coalesce_merge", f"WITH {PLANT} SELECT ts_utc, arg_max(soc, event_id) AS battery_soc_pct, round(arg_max(grid, event_id), 6) AS grid_power_w, arg_max(load, event_id) AS house_load_w FROM pl GROUP BY ALL")
def _(spark, d):
    return M.coalesce_merge(D.plant_state(spark, d), ["ts_utc"], "event_id").withColumn("grid_power_w", F.round("grid_power_w", 6))


@query("snk13_compact", f"WITH {LOG}, o AS (SELECT * FROM latest WHERE ts_utc < {NOW - 14 * 86400} QUALIFY row_number() OVER (PARTITION BY ts_utc, string_id ORDER BY issued_at_utc DESC) = 1) SELECT issued_at_utc, ts_utc, string_id, potential_kwh FROM latest WHERE ts_utc >= {NOW - 14 * 86400} UNION ALL SELECT issued_at_utc, ts_utc, string_id, potential_kwh FROM o")
def _(spark, d):
    return M.compact_issues(_latest(spark, d), NOW, ["ts_utc", "string_id"], 14).select("issued_at_utc", "ts_utc", "string_id", "potential_kwh")


def _sky(spark, d):
    return S.observations(D.shading_obs(spark, d), SKY_NOW)


@query("cmp17_sky_map", sql_rounded("string_id az_bin el_bin value* n* raw* level*", f"WITH {SKY} SELECT {{cols}} FROM fit"))
def _(spark, d):
    return rounded(S.absolute_fit(_sky(spark, d)).drop("cell", "reference"))


@query("srt02_worst_sectors", f"WITH {SKY} SELECT string_id, az_bin, el_bin, round((1 - exp(value)) * 100, 6) + 0.0 AS loss_pct FROM fit QUALIFY row_number() OVER (PARTITION BY string_id ORDER BY value, az_bin, el_bin) <= 12")
def _(spark, d):
    return rounded(S.worst_sectors(S.absolute_fit(_sky(spark, d))).select("string_id", "az_bin", "el_bin", "loss_pct"))


LOOKUP = f"WITH {SKY}, q AS (SELECT DISTINCT string_id, az_bin, el_bin FROM rw), c AS (SELECT * FROM fit), nb AS (SELECT q.string_id, q.az_bin, q.el_bin, greatest(ln(0.05), least(0.0, sum(c.raw * c.n) / sum(c.n) * avg(c.n) / (avg(c.n) + 6.0) - max(c.level))) AS near FROM q, generate_series(-1, 1) a(da), generate_series(-1, 1) e(de), c WHERE NOT (da = 0 AND de = 0) AND c.string_id = q.string_id AND c.az_bin = (q.az_bin + da + 36) % 36 AND c.el_bin = q.el_bin + de GROUP BY ALL) SELECT string_id, az_bin, el_bin, round(greatest(0.05, least(1.0, exp(coalesce(c.value, nb.near, 0.0)))), 6) + 0.0 AS factor FROM q LEFT JOIN c USING (string_id, az_bin, el_bin) LEFT JOIN nb USING (string_id, az_bin, el_bin)"


def _lookup(spark, d):
    rows = _sky(spark, d)
    return rounded(J.sky_lookup(rows.select("string_id", "az_bin", "el_bin").distinct(), S.absolute_fit(rows)))


# Both names run over all cells; the longer one is the older of the two forms.
for _name in ("jon15_sky_lookup", "jon15_sky_lookup_whole"):
    query(_name, LOOKUP)(_lookup)


@query("itr03_joint_fit")
def _(spark, d):
    return rounded(S.joint_fit(_sky(spark, d)))


@query("cmp19_seasonal_cells")
def _(spark, d):
    return rounded(S.seasonal_cells(_sky(spark, d)))


@query("cmp14_curves")
def _(spark, d):
    prior = F.array(*[F.struct(F.lit(a).alias("load"), F.lit(b).alias("eta")) for a, b in ((2.0, 0.86), (10.0, 0.93), (50.0, 0.96), (100.0, 0.95))])
    reference = spark.range(5).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("scope_id"), F.lit(12000.0).alias("reference_w"), prior.alias("prior"))
    return rounded(L.fit_curves(D.conversion(spark, d), reference, SKY_NOW))


LEARN_OBS = "lo AS (SELECT ts_utc * 8 + az AS hour, string_id, CASE WHEN el > 40 THEN 'clear' ELSE 'overcast' END AS weather, CASE WHEN (az - 180) / 15 < -2 THEN 'morning' WHEN (az - 180) / 15 <= 2 THEN 'midday' ELSE 'afternoon' END AS part, ln(ratio) AS residual, CAST(weight AS DOUBLE) AS weight FROM ob)"


@query("itr01_learn_effects", effects_sql(f"{SKY.split('rw AS')[0].strip()} {LEARN_OBS}", "lo"))
def _(spark, d):
    o = D.shading_obs(spark, d)
    obs = o.select((F.col("ts_utc") * 8 + F.col("azimuth_deg")).alias("hour"), "string_id", F.when(F.col("elevation_deg") > 40, "clear").otherwise("overcast").alias("weather"), R.daypart((F.col("azimuth_deg") - 180) / 15).alias("part"), F.log("ratio").alias("residual"), "weight").filter("residual is not null")
    return rounded(L.learn_effects(obs), 5)


PLANES = """SELECT CAST(l_shipdate_s + l_linenumber * 10800 + 150 AS DOUBLE) AS ts, 53.5 AS lat, 10.0 AS lon, 5.0 AS altitude, 3.5 AS turbidity, ghi, CASE WHEN l_linenumber % 2 = 0 THEN ghi * 0.6 END AS dni, CASE WHEN l_linenumber % 2 = 0 THEN ghi * 0.5 END AS dhi, 15.0 AS temp_c, 1.5 AS wind_ms, 30.0 AS tilt, 180.0 AS azimuth, 1.8 AS kwp, -0.004 AS temp_coeff, 0.9 AS system_eff, 0.9 AS shade, -3.47 AS mount_a, -0.0594 AS mount_b, 3.0 AS mount_dt, l_orderkey, l_linenumber, l_partkey FROM x"""
LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 20 AS ghi, {seconds} AS l_shipdate_s FROM lineitem"
PHYSICS_OUT = ["elevation", "sun_az", "cs_ghi", "cs_dni", "poa", "beam_share", "cell_c", "power_w", "poa_ceiling"]
_doubles = PLANES
for _n in ("53.5", "10.0", "5.0 AS alt", "3.5", "15.0", "1.5", "30.0", "180.0", "1.8", "-0.004", "0.9 AS sys", "0.9 AS shade", "-3.47", "-0.0594", "3.0 AS mount"):
    _k = _n.split(" ")[0]
    _doubles = _doubles.replace(f" {_n}", f" CAST({_k} AS DOUBLE){_n[len(_k):]}")


@query("phy13_power_chain", "WITH x AS (" + LINES.format(seconds="epoch_us(l_shipdate) // 1000000") + ") SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in PHYSICS_OUT) + " FROM (" + P.nested_sql(f"({_doubles}) AS src") + ") AS z")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    x = x.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 20).alias("ghi"), F.floor(D.micros(x, "l_shipdate") / 1000000).alias("l_shipdate_s"))
    src = spark.sql(_doubles.replace("FROM x", "FROM {x}"), x=x)
    return P.run(src).select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 4) + 0.0).alias(c) for c in PHYSICS_OUT])


@query("scl25_savings", "SELECT o_orderkey, m AS mode, round(CASE m WHEN 'net_metering' THEN y * 0.32 WHEN 'self_consumption' THEN (y - ex) * 0.32 + ex * 0.08 ELSE y * 0.08 END, 6) AS saved, round(y / 0.559, 6) AS per_year FROM (SELECT o_orderkey, y, greatest(0.0, least(coalesce(e, 0), y)) AS ex FROM (SELECT o_orderkey, o_totalprice / 10000 AS y, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey / 30.0 END AS e FROM orders)), (VALUES ('net_metering'), ('self_consumption'), ('feed_in')) t(m)")
def _(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("y"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") / 30.0).alias("e"), F.explode(F.array(*map(F.lit, ("net_metering", "self_consumption", "feed_in")))).alias("mode"))
    return o.select("o_orderkey", "mode", F.round(R.savings("mode", "y", "e", 0.32, 0.08), 6).alias("saved"), F.round(R.annual("y", F.lit(0.559)), 6).alias("per_year"))


@query("jon07_censor_pairs", f"WITH {INTEGRATED}, ts AS (SELECT DISTINCT ts_utc FROM fm), e AS (SELECT ts_utc, unnest(['s1', 's2']) AS string_id FROM ts), v AS (SELECT e.ts_utc, count(f.string_id) AS got, max(CASE WHEN f.string_id IS NULL THEN NULL WHEN f.value_kind <> 'measured' THEN 1 WHEN f.limit_binding THEN 1 WHEN f.limit_binding IS NULL AND f.limit_commanded_w IS NOT NULL THEN 1 ELSE 0 END) AS flag FROM e LEFT JOIN fm f USING (ts_utc, string_id) GROUP BY ALL) SELECT 'g1' AS scope_id, 'inverter' AS stage, ts_utc, CASE WHEN got < 2 THEN 1 ELSE flag END AS censored FROM v")
def _(spark, d):
    f = D.fivemin(spark, d)
    pairs = f.select("ts_utc").distinct().select(F.lit("g1").alias("scope_id"), F.lit("inverter").alias("stage"), "ts_utc", F.lit(False).alias("curtailable"), F.array(F.lit("s1"), F.lit("s2")).alias("members"))
    return J.censor_pairs(pairs, f)
