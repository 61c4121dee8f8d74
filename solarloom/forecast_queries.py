"""Queries of the forecast plan and the learn cycle over the adapter views, each
with its ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import constants as C
from .functions import physics as P
from .functions import predicates as R
from .operators import forecast as W
from .operators import joins as J
from .operators import learning as L
from .operators import publish as PB
from .operators import shading as S
from .queries import INTEGRATED, SKY, _sky, effects_sql, query, rounded, sql_rounded
from .sources import adapters as D

TZ = "Europe/Berlin"
#: The issues of the events end with these hours; a run at ISSUED.
FIRST, LAST, ISSUED = 1704067200, 1706918400, 1705300000
SITE = {"lat": 53.5, "lon": 10.0, "altitude": 5.0, "turbidity": 3.5}
BIAS = [(9, "0-6h", 1.1), (10, "6-24h", 0.9), (11, "24-48h", 1.05), (12, "48h+", 0.95), (13, "48h+", 1.2), (10, "48h+", 1.01)]
EFFECTS = [("plant", "clear|midday", 0.2, 30.0), ("plant", "overcast|midday", -0.1, 12.0), ("plant", "overcast|morning", 0.15, 8.0), ("plant", "rain|midday", 0.4, 25.0),
           ("string", "s1", 0.1, 20.0), ("string", "s3", -0.2, 5.0), ("string_daypart", "s1|midday", 0.3, 16.0), ("string_daypart", "s2|midday", 0.3, 3.0)]
STRINGS = [("p1", "s1", 0.9, *C.MOUNTS["open_rack_glass_glass"], -0.004, None), ("p1", "s2", 0.9, *C.MOUNTS["close_mount_glass_glass"], -0.004, 430.0),
           ("p1", "s3", 0.85, *C.MOUNTS["insulated_back_glass_polymer"], -0.0035, None)]
STEPPED = ("temp_c", "wind_ms", "clouds_pct", "rain_mm")


def _values(rows):
    def one(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def local_sql(ts: str) -> str:
    """Wall clock of epoch seconds."""
    return f"timezone('{TZ}', timezone('UTC', make_timestamp(CAST({ts} AS BIGINT) * 1000000)))"


def _step_sql(c, default):
    line = f"{c}_lv + ({c}_rv - {c}_lv) * ((hour - {c}_lh) / 3600 * 12 + slot - 11) / (({c}_rh - {c}_lh) / 3600 * 12 - 11)"
    return f"coalesce(CASE WHEN {c}_lh = hour THEN {c}_lv WHEN {c}_lh IS NULL THEN {c}_rv WHEN {c}_rh IS NULL THEN {c}_lv ELSE {line} END, {default}) AS {c}"


WEATHER = """
wx AS (SELECT event_id, epoch_us(ts) // 3600000000 * 3600 AS issued_at_utc, epoch_us(ts) // 3600000000 * 3600 + k % 72 * 3600 AS ts_utc, k % 72 AS horizon_h, value * 3 AS ghi_wm2, CASE WHEN k % 3 <> 0 THEN value * 2 END AS dni_wm2, CASE WHEN k % 3 <> 0 THEN value END AS dhi_wm2,
  CASE WHEN k % 5 <> 0 THEN CAST(10 + k % 15 AS DOUBLE) END AS temp_c, CAST(1 + k % 4 AS DOUBLE) AS wind_ms, CAST(k AS DOUBLE) AS clouds_pct, k % 10 * CAST(0.05 AS DOUBLE) AS rain_mm, CAST(k AS DOUBLE) AS rain_probability_pct FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events WHERE event_type = 'view')),
nwx AS (SELECT * FROM wx QUALIFY row_number() OVER (PARTITION BY ts_utc ORDER BY issued_at_utc DESC, event_id DESC) = 1)"""
CONDITIONS = f"""{WEATHER},
hg AS (SELECT unnest(generate_series({FIRST}, {LAST - 3600}, 3600)) AS hour),
hw AS (SELECT hg.hour, ghi_wm2, dni_wm2, dhi_wm2, temp_c, wind_ms, clouds_pct, rain_mm FROM hg LEFT JOIN nwx ON nwx.ts_utc = hg.hour),
hl AS (SELECT hour, ghi_wm2, dni_wm2, dhi_wm2, {', '.join(f"last_value(CASE WHEN {c} IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS {c}_lh, last_value({c} IGNORE NULLS) OVER b AS {c}_lv, first_value(CASE WHEN {c} IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS {c}_rh, first_value({c} IGNORE NULLS) OVER a AS {c}_rv" for c in STEPPED)} FROM hw
  WINDOW b AS (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sl AS (SELECT *, unnest(generate_series(0, 11)) AS slot FROM hl),
sr AS (SELECT hour, slot, hour + slot * 300 AS ts_utc, CAST(hour + slot * 300 + 150 AS DOUBLE) AS ts, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in SITE.items())}, ghi_wm2, dni_wm2, dhi_wm2, {', '.join(_step_sql(c, {'temp_c': 20.0, 'wind_ms': 1.0, 'clouds_pct': 'NULL', 'rain_mm': 0.0}[c]) for c in STEPPED)} FROM sl),
sn AS ({P.nested_sql('sr', P.SUN + P.CLEARSKY)}),
bs(hour_local, bucket, factor) AS {_values(BIAS)},
ld AS (SELECT *, greatest(0.0, (hour - {ISSUED}) / 3600.0) AS lead FROM sn),
bf AS (SELECT ld.*, coalesce(bs.factor, 1.0) AS bias_factor FROM ld LEFT JOIN bs ON bs.hour_local = hour({local_sql('hour')}) AND bs.bucket = CASE WHEN lead < 6 THEN '0-6h' WHEN lead < 24 THEN '6-24h' WHEN lead < 48 THEN '24-48h' ELSE '48h+' END),
cm AS (SELECT *, {', '.join(f'avg(cs_{c}) OVER (PARTITION BY hour) AS m_{c}' for c in ('ghi', 'dni', 'dhi'))} FROM bf),
cn AS (SELECT * EXCLUDE (ghi_wm2, dni_wm2, dhi_wm2), ghi_wm2 IS NOT NULL AS covered, {', '.join(f'greatest(coalesce(CASE WHEN m_{c} > 1 THEN {c}_wm2 * bias_factor / m_{c} * cs_{c} ELSE {c}_wm2 * bias_factor END, 0.0), 0.0) AS {c}' for c in ('ghi', 'dni', 'dhi'))} FROM cm)"""
CLASSES = f"""
nn AS ({P.nested_sql('(SELECT DISTINCT hour, lat, lon, CAST(floor((hour + 1800) / 86400.0) AS BIGINT) * 86400 AS day FROM cn)', P.DAYLIGHT)}),
ch AS (SELECT hour, avg(ghi) AS g, avg(cs_ghi) AS cs, max(rain_mm) AS rain, avg(clouds_pct) AS clouds, CASE WHEN sum(ghi) > 0 THEN sum(ghi * bias_factor) / sum(ghi) ELSE 1.0 END AS bias_factor, bool_or(covered) AS covered FROM cn GROUP BY ALL),
ck AS (SELECT *, CASE WHEN cs > 20 THEN g / cs END AS kc FROM ch),
cl AS (SELECT ck.hour, CASE WHEN rain >= 0.2 THEN 'rain' WHEN kc >= 0.75 THEN 'clear' WHEN kc >= 0.4 THEN 'partly_cloudy' WHEN kc IS NOT NULL THEN 'overcast' WHEN clouds < 25 THEN 'clear' WHEN clouds < 75 THEN 'partly_cloudy' WHEN clouds IS NOT NULL THEN 'overcast' ELSE 'partly_cloudy' END AS weather,
  CASE WHEN (ck.hour + 1800 - noon_ts) / 3600 < -2 THEN 'morning' WHEN (ck.hour + 1800 - noon_ts) / 3600 <= 2 THEN 'midday' ELSE 'afternoon' END AS part, bias_factor, covered FROM ck JOIN nn USING (hour))"""
GEOMETRY = """
ge(string_id, vf, azimuth, tilt, kwp) AS (VALUES ('s1', 1704500000, CAST(180 AS DOUBLE), CAST(30 AS DOUBLE), CAST(1.8 AS DOUBLE)), ('s1', 1705300000, 175, 35, 1.8), ('s2', 1704100000, 180, 60, 1.0), ('s3', 1704200000, 110, 27, 0.95), ('s3', 1705000000, 112, 27, 0.95), ('s3', 1706000000, 115, 28, 0.9)),
gh AS (SELECT g.string_id, h.hour, coalesce(max(vf) FILTER (vf <= h.hour), min(vf)) AS vf FROM (SELECT DISTINCT hour FROM cn) h, ge g GROUP BY ALL),
gs AS (SELECT gh.string_id, gh.hour, azimuth, tilt, kwp FROM gh JOIN ge USING (string_id, vf))"""
POWER = f"""{GEOMETRY},
st(plant_id, string_id, system_eff, mount_a, mount_b, mount_dt, temp_coeff, max_power_w) AS {_values(STRINGS)},
p0 AS (SELECT cn.*, gs.string_id, azimuth, tilt, kwp, system_eff, mount_a, mount_b, mount_dt, temp_coeff, max_power_w, CAST(floor(((sun_az % 360) + 360) % 360 / 10) AS INT) AS az_bin, CAST(floor(elevation / 5) AS INT) AS el_bin FROM cn JOIN gs USING (hour) JOIN st USING (string_id))"""


def _power_sql(relation: str, name: str) -> str:
    steps = P.COMPONENTS + P.plane("haydavies", "column") + P.POWER
    return f"""{name}0 AS ({P.nested_sql(relation, steps)}),
{name} AS (SELECT * REPLACE (least(power_w, coalesce(max_power_w, power_w)) AS power_w), power_w AS uncapped_w, least(least(CASE WHEN shading_applied > 0 THEN power_w / shading_applied ELSE power_w END, kwp * 1000), coalesce(max_power_w, 1e9)) AS unshaded_w FROM {name}0)"""


BARE = _power_sql("(SELECT *, CAST(1 AS DOUBLE) AS shade, true AS beam_scope FROM p0)", "pw")
SHADED = f"""{SKY.strip()},
sq AS (SELECT DISTINCT string_id, az_bin, el_bin FROM p0),
nb AS (SELECT sq.string_id, sq.az_bin, sq.el_bin, greatest(ln(0.05), least(0.0, sum(c.raw * c.n) / sum(c.n) * avg(c.n) / (avg(c.n) + 6.0) - max(c.level))) AS near FROM sq, generate_series(-1, 1) a(da), generate_series(-1, 1) e(de), fit c WHERE NOT (da = 0 AND de = 0) AND c.string_id = sq.string_id AND c.az_bin = (sq.az_bin + da + 36) % 36 AND c.el_bin = sq.el_bin + de GROUP BY ALL),
p1 AS (SELECT p0.*, greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE), exp(coalesce(c.value, nb.near, 0.0)))) AS shade, p0.string_id = 's1' AS beam_scope FROM p0 LEFT JOIN fit c USING (string_id, az_bin, el_bin) LEFT JOIN nb USING (string_id, az_bin, el_bin)),
{_power_sql('p1', 'ps')}"""
EVALUATED = f"""
ef(scope, key, value, n_eff) AS {_values(EFFECTS)},
es AS (SELECT scope, key, n_eff, CASE WHEN n_eff <= 0 THEN 0 ELSE greatest(-0.7, least(0.7, value * n_eff / (n_eff + 10))) END AS s FROM ef),
eh AS (SELECT string_id, hour, sum(power_w) / 12000 AS physics_kwh, sum(unshaded_w) / 12000 AS unshaded_kwh FROM ps GROUP BY ALL),
ec AS (SELECT eh.*, weather, part, bias_factor, exp(greatest(-1.4, least(1.4, coalesce(a.s, 0) + coalesce(b.s, 0) + CASE WHEN c.n_eff >= {0.7 / (1 - 0.5 ** (1 / 15))} THEN c.s ELSE 0 END))) AS corr FROM eh JOIN cl USING (hour)
  LEFT JOIN es a ON a.scope = 'plant' AND a.key = weather || '|' || part LEFT JOIN es b ON b.scope = 'string' AND b.key = string_id LEFT JOIN es c ON c.scope = 'string_daypart' AND c.key = string_id || '|' || part WHERE covered),
ev AS (SELECT 'p1' AS plant_id, hour AS ts_utc, string_id, physics_kwh * f AS potential_kwh, physics_kwh, unshaded_kwh * f AS unshaded_kwh, weather, part, CASE WHEN physics_kwh > 0 THEN 'physics+learned' ELSE 'physics' END AS method, f AS correction, bias_factor, CASE WHEN unshaded_kwh > 0 THEN physics_kwh / unshaded_kwh ELSE 1.0 END AS shading_factor
  FROM (SELECT *, CASE WHEN physics_kwh > 0 THEN corr ELSE 1.0 END AS f FROM ec))"""
FORECAST = f"{CONDITIONS}, {CLASSES}, {POWER}, {SHADED}, {EVALUATED}"


def weather(spark, d):
    """Every issue of the events as weather of the plant."""
    e = D.table(spark, d, "events").filter("event_type = 'view'")
    k, hour = D.props(e), (F.floor(D.micros(e, "ts") / 3600000000) * 3600).cast("long")
    return e.select(
        "event_id", F.lit("p1").alias("plant_id"), hour.alias("issued_at_utc"), (hour + k % 72 * 3600).alias("ts_utc"), (k % 72).alias("horizon_h"), (F.col("value") * 3).alias("ghi_wm2"), F.when(k % 3 != 0, F.col("value") * 2).alias("dni_wm2"), F.when(k % 3 != 0, F.col("value")).alias("dhi_wm2"),
        F.when(k % 5 != 0, 10.0 + k % 15).alias("temp_c"), (1.0 + k % 4).alias("wind_ms"), k.cast("double").alias("clouds_pct"), (k % 10 * 0.05).alias("rain_mm"), k.cast("double").alias("rain_probability_pct"))


def newest_weather(spark, d):
    rows = weather(spark, d).withColumn("seq", F.struct("issued_at_utc", "event_id"))
    return W.latest_rows(rows, ["plant_id", "ts_utc"], "seq").drop("seq", "event_id", "issued_at_utc", "horizon_h", "rain_probability_pct")


def plants(spark):
    return spark.createDataFrame([("p1", *SITE.values())], "plant_id string, " + ", ".join(f"{k} double" for k in SITE))


def strings(spark):
    return spark.createDataFrame(STRINGS, "plant_id string, string_id string, system_eff double, mount_a double, mount_b double, mount_dt double, temp_coeff double, max_power_w double")


def conditions(spark, d):
    hours = W.hour_grid(plants(spark), FIRST, LAST)
    bias = spark.createDataFrame(BIAS, "hour_local int, bucket string, factor double")
    return W.downscale(W.hourly_weather(hours, newest_weather(spark, d)), bias, ISSUED, TZ)


def cells(spark, d):
    """The absolute map, the first string's taken as a differential one."""
    return S.absolute_fit(_sky(spark, d)).withColumn("method", F.when(F.col("string_id") == "s1", "differential").otherwise("absolute"))


def effects(spark):
    return spark.createDataFrame(EFFECTS, "scope string, key string, value double, n_eff double")


def forecast(spark, d):
    return W.evaluate(conditions(spark, d), strings(spark), D.geometry(spark), cells(spark, d), effects(spark))


def plant_fivemin(spark, d):
    return D.fivemin(spark, d).withColumn("plant_id", F.lit("p1"))


@query("phy16_downscale", sql_rounded("ts_utc covered bias_factor* ghi* dni* dhi* temp_c* wind_ms* clouds_pct* rain_mm* cs_ghi* elevation*", f"WITH {CONDITIONS} SELECT {{cols}} FROM cn", 4))
def _(spark, d):
    return rounded(conditions(spark, d).select("ts_utc", "covered", "bias_factor", "ghi", "dni", "dhi", "temp_c", "wind_ms", "clouds_pct", "rain_mm", "cs_ghi", "elevation"), 4)


@query("cmp01_forecast", sql_rounded("plant_id ts_utc string_id potential_kwh* physics_kwh* unshaded_kwh* weather part method correction* bias_factor* shading_factor*", f"WITH {FORECAST} SELECT {{cols}} FROM ev", 5))
def _(spark, d):
    return rounded(forecast(spark, d), 5)


@query("cmp26_energy_chain", sql_rounded("plant_id ts_utc string_id source_bias* physics_kwh* shading* model* potential_kwh*", f"WITH {FORECAST} SELECT {{cols}} FROM (SELECT plant_id, ts_utc, string_id, bias_factor AS source_bias, unshaded_kwh / correction AS physics_kwh, shading_factor AS shading, correction AS model, potential_kwh FROM ev)", 5))
def _(spark, d):
    return rounded(W.energy_chain(forecast(spark, d)), 5)


#: The purchases of the events as measured irradiance of their interval.
MEASURED = "mg AS (SELECT epoch_us(ts) // 300000000 * 300 AS ts_utc, avg(value) AS ghi FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def measured_ghi(spark, d):
    e = D.table(spark, d, "events").filter("event_type = 'purchase'")
    return e.groupBy((F.floor(D.micros(e, "ts") / 300000000) * 300).cast("long").alias("ts_utc")).agg(F.avg("value").alias("ghi")).withColumn("plant_id", F.lit("p1"))


@query("cmp05_actual_conditions", sql_rounded("ts_utc ghi* dni* dhi* dhi_used* dni_used*", f"WITH {CONDITIONS}, {MEASURED}, ac AS (SELECT cn.* REPLACE (coalesce(mg.ghi, cn.ghi) AS ghi, CAST(NULL AS DOUBLE) AS dni, CAST(NULL AS DOUBLE) AS dhi) FROM cn LEFT JOIN mg USING (ts_utc)) SELECT {{cols}} FROM ({P.nested_sql('ac', P.COMPONENTS)})", 6))
def _(spark, d):
    rows = W.actual_conditions(conditions(spark, d), measured_ghi(spark, d))
    return rounded(P.run(rows, P.COMPONENTS).select("ts_utc", "ghi", "dni", "dhi", "dhi_used", "dni_used"), 6)


@query("phy13_string_power", sql_rounded("ts_utc string_id poa* beam_share* cell_c* power_w* unshaded_w* shading_applied*", f"WITH {CONDITIONS}, {POWER}, {SHADED} SELECT {{cols}} FROM ps", 4))
def _(spark, d):
    return rounded(W.string_power(conditions(spark, d), strings(spark), D.geometry(spark), cells(spark, d)).select("ts_utc", "string_id", "poa", "beam_share", "cell_c", "power_w", "unshaded_w", "shading_applied"), 4)


@query("phy08_isotropic", sql_rounded("ts_utc string_id poa_sky* poa* power_w*", f"WITH {CONDITIONS}, {POWER}, iso AS ({P.nested_sql('(SELECT *, CAST(1 AS DOUBLE) AS shade FROM p0)', P.COMPONENTS + P.plane('isotropic', 'total') + P.POWER)}) SELECT {{cols}} FROM (SELECT * REPLACE (least(power_w, coalesce(max_power_w, power_w)) AS power_w) FROM iso)", 4))
def _(spark, d):
    return rounded(W.string_power(conditions(spark, d), strings(spark), D.geometry(spark), model="isotropic").select("ts_utc", "string_id", "poa_sky", "poa", "power_w"), 4)


@query("phy04_daylight", sql_rounded("day noon_ts* sunrise_ts* sunset_ts*", f"WITH dy AS (SELECT CAST(53.5 AS DOUBLE) AS lat, CAST(10 AS DOUBLE) AS lon, epoch_us(a) // 1000000 AS day FROM (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS a FROM orders)) SELECT {{cols}} FROM ({P.nested_sql('dy', P.DAYLIGHT)})", 2))
def _(spark, d):
    o = D.table(spark, d, "orders")
    days = o.select(F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("n")).distinct()
    return rounded(P.run(days.select((F.col("n") * 86400).alias("day"), F.lit(53.5).alias("lat"), F.lit(10.0).alias("lon")), P.DAYLIGHT).select("day", "noon_ts", "sunrise_ts", "sunset_ts"), 2)


MATERIALISED = f"""ah AS (SELECT hr.*, CAST(ts_utc + 1800 AS DOUBLE) AS ts, CAST(53.5 AS DOUBLE) AS lat, CAST(10 AS DOUBLE) AS lon FROM hr),
mh AS (SELECT *, CASE WHEN coverage >= 0.95 THEN 'exact' WHEN apparent_elevation < 3 THEN 'night' WHEN coverage >= 0.8 THEN 'partial' ELSE 'missing' END AS quality FROM ({P.nested_sql('ah', P.SUN + P.APPARENT)}))"""


@query("agg05_materialise_hours", sql_rounded("string_id ts_utc energy_kwh* coverage* value_kind quality", f"WITH {INTEGRATED}, {MATERIALISED} SELECT {{cols}} FROM mh"))
def _(spark, d):
    return rounded(W.materialise_hours(plant_fivemin(spark, d), plants(spark)).select("string_id", "ts_utc", "energy_kwh", "coverage", "value_kind", "quality"))


@query("agg13_fold_energy", sql_rounded("string_id hour uncapped_kwh*", f"WITH {CONDITIONS}, {POWER}, {BARE} SELECT {{cols}} FROM (SELECT string_id, hour, sum(uncapped_w) / 12000 AS uncapped_kwh FROM pw GROUP BY ALL)", 5))
def _(spark, d):
    power = W.string_power(conditions(spark, d), strings(spark), D.geometry(spark))
    return rounded(W.fold_energy(power, ["string_id", "hour"], {"uncapped_w": "uncapped_kwh"}), 5)


@query("agg14_plant_actual", sql_rounded("string_id hour actual_kwh*", f"WITH {INTEGRATED} SELECT {{cols}} FROM (SELECT string_id, ts_utc // 3600 * 3600 AS hour, sum(power_mean_w) / 12000 AS actual_kwh FROM fm WHERE power_mean_w IS NOT NULL AND value_kind = 'measured' AND coverage >= 0.8 AND NOT coalesce(limit_binding, false) GROUP BY ALL)"))
def _(spark, d):
    return rounded(W.plant_hourly_actual(D.fivemin(spark, d)))


@query("cmp10_collect_shading", sql_rounded("ts_utc string_id azimuth_deg* elevation_deg* ratio* weight* physics_w* beam*", f"WITH {INTEGRATED}, {CONDITIONS}, {POWER}, {BARE}, o AS (SELECT fm.ts_utc, fm.string_id, sun_az AS azimuth_deg, elevation AS elevation_deg, power_mean_w / power_w AS ratio, fm.coverage AS weight, power_w AS physics_w, beam_share AS beam FROM fm JOIN pw USING (ts_utc, string_id) WHERE power_mean_w IS NOT NULL AND value_kind = 'measured' AND fm.coverage >= 0.8 AND NOT coalesce(limit_binding, false) AND elevation >= 8 AND power_w > 0) SELECT {{cols}} FROM o WHERE ratio BETWEEN 0 AND 5", 4))
def _(spark, d):
    power = W.string_power(conditions(spark, d), strings(spark), D.geometry(spark))
    return rounded(W.collect_shading(D.fivemin(spark, d), power), 4)


LEARNED = f"""{INTEGRATED}, {MATERIALISED}, {FORECAST},
lq AS (SELECT mh.string_id, mh.ts_utc, energy_kwh, coverage, value_kind, quality, ev.physics_kwh, coalesce(cl.weather, 'partly_cloudy') AS weather, coalesce(cl.part, 'midday') AS part, CASE value_kind WHEN 'lower_bound' THEN 0.5 WHEN 'reconstructed' THEN 0.35 ELSE 1.0 END AS kw,
  CASE WHEN coverage >= 0.95 THEN 1.0 WHEN coverage >= 0.8 THEN least(1.0, coverage) ELSE 0.0 END AS qw FROM mh LEFT JOIN ev USING (ts_utc, string_id) LEFT JOIN cl ON cl.hour = mh.ts_utc),
lr AS (SELECT *, CASE WHEN physics_kwh IS NULL THEN 'no_physics_row' WHEN physics_kwh <= 0 THEN CASE WHEN quality = 'night' THEN 'night' ELSE 'zero_physics_in_daylight' END WHEN quality = 'night' THEN 'night' WHEN energy_kwh IS NULL THEN 'no_energy' WHEN qw * kw <= 0 THEN 'low_coverage'
  WHEN energy_kwh <= 0 THEN 'no_production' WHEN energy_kwh / physics_kwh < 0.05 OR energy_kwh / physics_kwh > 5 THEN 'ratio_out_of_range' WHEN value_kind = 'lower_bound' AND physics_kwh >= energy_kwh THEN 'censored_and_consistent' END AS reason FROM lq)"""


def _learning(spark, d):
    actual = W.materialise_hours(plant_fivemin(spark, d), plants(spark)).drop("plant_id")
    at = conditions(spark, d)
    classes = W.weather_hours(at).select(F.col("hour").alias("ts_utc"), "weather", "part")
    return W.learning_hours(actual, forecast(spark, d), classes)


@query("cmp09_learning_hours", sql_rounded("string_id ts_utc weather part reason residual* weight*", f"WITH {LEARNED} SELECT {{cols}} FROM (SELECT string_id, ts_utc, weather, part, reason, CASE WHEN reason IS NULL THEN ln(energy_kwh / physics_kwh) END AS residual, CASE WHEN reason IS NULL THEN qw * kw * kw END AS weight FROM lr)", 4))
def _(spark, d):
    return rounded(_learning(spark, d).select("string_id", "ts_utc", "weather", "part", "reason", "residual", "weight"), 4)


@query("flt14_exclusions", f"WITH {LEARNED} SELECT ts_utc, string_id, reason FROM lr WHERE reason = 'low_coverage'")
def _(spark, d):
    return W.exclusions(_learning(spark, d)).drop("detail")


@query("cmp09_learn_effects", effects_sql(f"{LEARNED}, lo AS (SELECT ts_utc AS hour, string_id, weather, part, ln(energy_kwh / physics_kwh) AS residual, CAST(qw * kw * kw AS DOUBLE) AS weight FROM lr WHERE reason IS NULL)", "lo"))
def _(spark, d):
    rows = _learning(spark, d).filter("reason is null").withColumnRenamed("ts_utc", "hour")
    return rounded(L.learn_effects(rows.select("hour", "string_id", "weather", "part", "residual", "weight")), 5)


@query("jon12_history", sql_rounded("ts_utc string_id energy_kwh* ghi_wm2* temp_c* wind_ms*", f"WITH {INTEGRATED}, {WEATHER} SELECT {{cols}} FROM (SELECT hr.ts_utc, string_id, energy_kwh, i.ghi_wm2, coalesce(w.temp_c, 15.0) AS temp_c, coalesce(w.wind_ms, 1.5) AS wind_ms FROM hr JOIN nwx i ON i.ts_utc = hr.ts_utc LEFT JOIN (SELECT * FROM nwx WHERE wind_ms > 1) w ON w.ts_utc = hr.ts_utc)"))
def _(spark, d):
    from .operators import aggregate as A

    n = newest_weather(spark, d)
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id", "energy_kwh")
    return rounded(W.history_conditions(hours, n.select("ts_utc", "ghi_wm2"), n.filter("wind_ms > 1").select("ts_utc", "temp_c", "wind_ms")))


@query("set03_without_hours", f"WITH {INTEGRATED}, bad AS (SELECT ts_utc // 3600 * 3600 AS hour FROM fm GROUP BY ALL HAVING sum(energy_wh) > 40) SELECT string_id, ts_utc FROM fm WHERE ts_utc // 3600 * 3600 NOT IN (SELECT hour FROM bad)")
def _(spark, d):
    f = D.fivemin(spark, d)
    bad = f.groupBy(R.floor_to("ts_utc", 3600).alias("hour")).agg(F.sum("energy_wh").alias("e")).filter("e > 40")
    return W.without_hours(f, bad).select("string_id", "ts_utc")


@query("win07_trailing", sql_rounded("string_id ts_utc power_mean_w*", f"WITH {INTEGRATED} SELECT {{cols}} FROM fm WHERE ts_utc >= {ISSUED - 900} AND ts_utc < {ISSUED}"))
def _(spark, d):
    return rounded(W.trailing(D.fivemin(spark, d), ISSUED).select("string_id", "ts_utc", "power_mean_w"))


SHARE = f"""hy AS (SELECT unnest(generate_series(1735689600, 1735689600 + 8759 * 3600, 3600)) AS hour),
sy AS ({P.nested_sql("(SELECT hour, CAST(hour + 1800 AS DOUBLE) AS ts, CAST(53.5 AS DOUBLE) AS lat, CAST(10 AS DOUBLE) AS lon, CAST(5 AS DOUBLE) AS altitude, CAST(3.5 AS DOUBLE) AS turbidity FROM hy)", P.SUN + P.CLEARSKY)}),
py AS ({P.nested_sql("(SELECT sy.*, cs_ghi AS ghi, cs_dni AS dni, cs_dhi AS dhi, CAST(1 AS DOUBLE) AS shade, v.* FROM sy, (SELECT n_nationkey AS string_id, CAST(90 + n_nationkey * 7 AS DOUBLE) AS azimuth, CAST(10 + n_nationkey * 3 AS DOUBLE) AS tilt, 1 + n_nationkey / 10.0 AS kwp FROM nation) v)", P.COMPONENTS + P.plane('haydavies'))}),
my AS (SELECT string_id, kwp, month(make_timestamp(hour * 1000000)) AS month, sum(poa) AS poa FROM py GROUP BY ALL),
wy AS (SELECT month, sum(s * kwp) AS w FROM (SELECT *, poa / sum(poa) OVER (PARTITION BY string_id) AS s FROM my) GROUP BY ALL)"""


@query("agg20_monthly_share", f"WITH {SHARE} SELECT 'p1' AS plant_id, CAST(month AS INT) AS month, round(w / sum(w) OVER (), 6) + 0.0 AS share FROM wy")
def _(spark, d):
    n = F.col("n_nationkey")
    planes = D.table(spark, d, "nation").select(F.lit("p1").alias("plant_id"), n.alias("string_id"), (90 + n * 7).cast("double").alias("azimuth"), (10 + n * 3).cast("double").alias("tilt"), (1 + n / 10.0).alias("kwp"))
    return rounded(W.monthly_share(plants(spark), planes))


KWP_AT = 750_000


# Strings of twenty plants, at a moment between their segments.
@query("agg23_total_kwp", f"WITH {D.PART_GEOMETRY}, st AS (SELECT DISTINCT string_id FROM pg), m AS (SELECT string_id, coalesce(max(valid_from_ts_utc) FILTER (valid_from_ts_utc <= {KWP_AT}), min(valid_from_ts_utc)) AS vf FROM pg GROUP BY ALL) SELECT 'w' || CAST(CAST(substr(string_id, 2) AS INT) % 20 AS VARCHAR) AS plant_id, round(sum(kwp), 3) + 0.0 AS kwp FROM m JOIN pg USING (string_id) WHERE valid_from_ts_utc = vf GROUP BY ALL")
def _(spark, d):
    geometry = D.part_geometry(spark, d)
    owned = geometry.select("string_id").distinct().select(F.concat(F.lit("w"), (F.substring("string_id", 2, 9).cast("int") % 20).cast("string")).alias("plant_id"), "string_id")
    return W.total_kwp(owned, geometry, KWP_AT)


@query("cmp03_nowcast_plan", sql_rounded("ts_utc nowcast_weight* ghi* dhi_used*", f"WITH {CONDITIONS}, nw AS (SELECT *, CASE WHEN NOT covered OR ts - {ISSUED} <= 0 OR ts - {ISSUED} >= 7200 THEN 0.0 ELSE 6.0 / 9.0 * pow(0.5, (ts - {ISSUED}) / 4200.0) END AS nowcast_weight FROM cn), na AS (SELECT * REPLACE (CASE WHEN nowcast_weight > 0 THEN greatest(0.0, least(nowcast_weight * 0.8 * cs_ghi + (1 - nowcast_weight) * ghi, 1.1 * cs_ghi)) ELSE ghi END AS ghi, CASE WHEN nowcast_weight <= 0 THEN dni END AS dni, CASE WHEN nowcast_weight <= 0 THEN dhi END AS dhi) FROM nw) SELECT {{cols}} FROM ({P.nested_sql('na', P.COMPONENTS)})", 6))
def _(spark, d):
    rows = conditions(spark, d).withColumn("horizon_s", F.col("ts") - ISSUED).withColumn("kt", F.lit(0.8)).withColumn("spread", F.lit(0.1)).withColumn("n_eff", F.lit(6.0))
    return rounded(P.run(PB.apply_nowcast(rows), P.COMPONENTS).select("ts_utc", "nowcast_weight", "ghi", "dhi_used"), 6)


@query("met18_shading_now", sql_rounded("ts_utc string_id loss_pct*", f"WITH {CONDITIONS}, {POWER}, {SHADED} SELECT {{cols}} FROM (SELECT ts_utc, string_id, CASE WHEN elevation >= 3 THEN (1 - shade) * 100 END AS loss_pct FROM p1 WHERE slot = 0)", 4))
def _(spark, d):
    from .operators import views as V

    az, el = R.sky_bins("sun_az", "elevation")
    at = conditions(spark, d).filter("slot = 0").join(strings(spark).select("plant_id", "string_id"), "plant_id").withColumn("az_bin", az).withColumn("el_bin", el)
    return rounded(V.shading_now(J.sky_lookup(at, cells(spark, d))).select("ts_utc", "string_id", "loss_pct"), 4)


@query("met14_irradiance_now", sql_rounded("hour forecast_wm2* measured_wm2* clearsky_wm2* clearsky_index* error_wm2* truth", f"WITH {CONDITIONS}, {MEASURED}, ih AS (SELECT cn.hour, avg(cn.ghi) AS forecast_wm2, avg(mg.ghi) AS measured_wm2, avg(cs_ghi) AS clearsky_wm2 FROM cn LEFT JOIN mg USING (ts_utc) GROUP BY ALL) SELECT {{cols}} FROM (SELECT *, CASE WHEN clearsky_wm2 > 5 THEN coalesce(measured_wm2, forecast_wm2) / clearsky_wm2 END AS clearsky_index, forecast_wm2 - measured_wm2 AS error_wm2, CASE WHEN measured_wm2 IS NOT NULL THEN 'measured' ELSE 'forecast' END AS truth FROM ih)", 7))
def _(spark, d):
    from .operators import views as V

    seen = measured_ghi(spark, d).select("ts_utc", F.col("ghi").alias("m"))
    hours = conditions(spark, d).join(seen, "ts_utc", "left").groupBy("hour").agg(F.avg("ghi").alias("forecast_wm2"), F.avg("m").alias("measured_wm2"), F.avg("cs_ghi").alias("clearsky_wm2"))
    return rounded(V.irradiance_now(hours), 7)
