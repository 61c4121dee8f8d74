"""Queries of published views, scans, stored state and scalar rules over the
adapter views, each with its ANSI SQL. Local days of the SQL are worked out by
Python's calendar, not by the expressions under test."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from . import constants as C
from .forecast_queries import FORECAST, TZ, WEATHER, _values, forecast, local_sql, weather
from .functions import predicates as R
from .operators import aggregate as A
from .operators import joins as J
from .operators import learning as L
from .operators import mutations as M
from .operators import publish as PB
from .operators import shading as S
from .operators import state as T
from .operators import views as V
from .plans.lineage import materialize
from .publish_queries import AT
from .queries import ASOF, INTEGRATED, KWH, LOG, PLANT, SKY, SKY_NOW, SQL, _latest, _sky, query, rounded, sql_rounded
from .sources import adapters as D
from .sources import readers as RD
from .sources import scans as SC


def _local(days: int, hour: int = 0, at: int = AT) -> int:
    """Epoch seconds of a local hour, some days from the day of ``at``."""
    day = datetime.fromtimestamp(at, ZoneInfo(TZ)).date() + timedelta(days=days)
    return int(datetime(day.year, day.month, day.day, hour, tzinfo=ZoneInfo(TZ)).timestamp())


D0, D1, D2, D3 = (_local(k) for k in range(4))
HOUR = AT // 3600 * 3600
NEWEST = f"{LOG}, nw AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY ts_utc, string_id ORDER BY issued_at_utc DESC) = 1)"


def _newest(spark, d):
    return J.newest_issue(_latest(spark, d), ["ts_utc", "string_id"])


def _sum(start, end, value="potential_kwh"):
    return f"sum({value}) FILTER (ts_utc >= {start} AND ts_utc < {end})"


_SUMS = f"coalesce({_sum(D0, D1)}, 0) AS today, {{0}}{_sum(D1, D2)}{{1}} AS tomorrow, {{0}}{_sum(D2, D3)}{{1}} AS day_after, coalesce({_sum(HOUR, D1)}, 0) AS remaining, {_sum(HOUR + 3600, HOUR + 7200)} AS next_hour, {_sum(HOUR, HOUR + 3600)} * 1000 AS now_w"
_SUM_COLS = "today* tomorrow* day_after* remaining* next_hour* now_w*"


@query("met01_plant_local_sums", sql_rounded(f"plant_id {_SUM_COLS}", f"WITH {NEWEST}, g AS (SELECT 'p1' AS plant_id, {_SUMS.format('', '')} FROM nw) SELECT {{cols}} FROM g"))
def _(spark, d):
    return rounded(V.local_day_sums(_newest(spark, d).withColumn("plant_id", F.lit("p1")), AT, TZ, ["plant_id"]))


@query("met19_string_local_sums", sql_rounded(f"string_id {_SUM_COLS}", f"WITH {NEWEST}, g AS (SELECT string_id, {_SUMS.format('coalesce(', ', 0)')} FROM nw GROUP BY ALL) SELECT {{cols}} FROM g"))
def _(spark, d):
    return rounded(V.local_day_sums(_newest(spark, d), AT, TZ, ["string_id"], False))


@query("met05_peak_today", sql_rounded("plant_id peak_ts_utc peak_kwh*", f"WITH {NEWEST}, g AS (SELECT 'p1' AS plant_id, ts_utc AS peak_ts_utc, sum(potential_kwh) AS peak_kwh FROM nw WHERE ts_utc >= {D0} AND ts_utc < {D1} GROUP BY ts_utc QUALIFY row_number() OVER (ORDER BY sum(potential_kwh) DESC, ts_utc) = 1) SELECT {{cols}} FROM g"))
def _(spark, d):
    return rounded(V.peak_today(_newest(spark, d).withColumn("plant_id", F.lit("p1")), AT, TZ, ["plant_id"]))


@query("met06_produced_today", sql_rounded("string_id energy_kwh*", f"WITH {INTEGRATED}, x AS (SELECT string_id, energy_kwh AS k FROM hr WHERE ts_utc >= {D0} AND ts_utc < {HOUR} UNION ALL SELECT string_id, energy_wh / 1000 FROM fm WHERE ts_utc >= {HOUR} AND ts_utc < {AT}), g AS (SELECT string_id, sum(k) AS energy_kwh FROM x GROUP BY ALL) SELECT {{cols}} FROM g"))
def _(spark, d):
    five = D.fivemin(spark, d)
    return rounded(A.energy_between(A.fold_hourly(five), five, D0, AT))


CUTOFF = f"CAST(epoch(timezone('{TZ}', CAST(CAST({local_sql('h.ts_utc')} AS DATE) - 1 AS TIMESTAMP) + INTERVAL 18 HOUR)) AS BIGINT)"


@query("met07_deviation", sql_rounded("day forecast_kwh* produced_kwh* deviation_pct*", f"WITH {INTEGRATED}, {LOG}, g AS ({ASOF.format(until=CUTOFF)}), x AS (SELECT CAST({local_sql('ts_utc')} AS DATE) AS day, sum(forecast_kwh) AS forecast_kwh, sum(energy_kwh) AS produced_kwh FROM g GROUP BY ALL) SELECT {{cols}} FROM (SELECT *, CASE WHEN produced_kwh > 0 AND forecast_kwh <> 0 THEN (forecast_kwh - produced_kwh) / produced_kwh * 100 END AS deviation_pct FROM x)"))
def _(spark, d):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id", "energy_kwh").withColumn("cutoff", R.day_ahead_cutoff("ts_utc", TZ))
    return rounded(V.deviation_by_day(J.forecast_asof(hours, _latest(spark, d), cutoff="cutoff"), TZ))


def _scores(until):
    return f"""WITH {INTEGRATED}, {LOG}, g AS ({ASOF.format(until=until).replace('any_value(h.energy_kwh) AS energy_kwh', 'any_value(h.energy_kwh) AS energy_kwh, any_value(h.value_kind) AS value_kind')}),
p AS (SELECT CAST({local_sql('ts_utc')} AS DATE) AS day, forecast_kwh AS p, energy_kwh AS a, unnest(CASE WHEN value_kind <> 'measured' THEN ['all'] ELSE ['all', 'uncensored'] END) AS population FROM g WHERE forecast_kwh IS NOT NULL),
dd AS (SELECT population, day, sum(p) AS p, sum(a) AS a, sum(abs(p - a)) AS e, sum(p - a) AS s, count(*) AS n FROM p GROUP BY ALL)
SELECT population, round(CASE WHEN count(*) >= 3 THEN sum(abs(p - a)) / sum(a) END, 6) AS wmape, round(CASE WHEN count(*) >= 3 THEN sum(e) / sum(n) / 3.75 END, 6) AS nmae, round(CASE WHEN count(*) >= 3 THEN sum(e) / sum(n) END, 6) AS mae, round(CASE WHEN count(*) >= 3 THEN sum(s) / sum(n) END, 6) AS bias, round(CASE WHEN count(*) >= 3 THEN avg(p - a) END, 6) AS daily_bias, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM dd GROUP BY population"""


def _scored(spark, d, **how):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id", "energy_kwh", "value_kind", R.day_ahead_cutoff("ts_utc", TZ).alias("cutoff"))
    pairs = J.forecast_asof(hours, _latest(spark, d), **how).filter("forecast_kwh is not null")
    return rounded(A.score_populations(pairs.select(R.local_day("ts_utc", TZ).alias("day"), F.col("forecast_kwh").alias("predicted"), F.col("energy_kwh").alias("actual"), (F.col("value_kind") != "measured").alias("censored")), 3.75))


@query("met08_scores", _scores("h.ts_utc"))
def _(spark, d):
    return _scored(spark, d, lead_s=0)


@query("met09_day_ahead_scores", _scores(CUTOFF))
def _(spark, d):
    return _scored(spark, d, cutoff="cutoff")


WINDOWS = [("today", D0, D1), ("week", _local(-4), D1), ("month", _local(-25), D1), ("year", _local(-25), D1), ("all", 0, D1)]
MODES = [("net_metering", 0.32, 0.08), ("self_consumption", 0.32, 0.08), ("feed_in", 0.32, 0.08)]


@query("met10_savings", sql_rounded("name mode yield_kwh* export_kwh* saved*", f"WITH {INTEGRATED}, {PLANT}, ph AS (SELECT ts_utc // 3600 * 3600 AS ts_utc, {KWH.format('CASE WHEN grid < 0 THEN -grid ELSE 0 END')} AS e FROM pl GROUP BY ALL), w(name, a, b) AS {_values(WINDOWS)}, m(mode, price, feed) AS {_values(MODES)}, y AS (SELECT name, sum(energy_kwh) AS y FROM hr JOIN w ON ts_utc >= a AND ts_utc < b GROUP BY ALL), x AS (SELECT name, sum(e) AS e FROM ph JOIN w ON ts_utc >= a AND ts_utc < b GROUP BY ALL), g AS (SELECT name, mode, price, feed, coalesce(y, 0) AS yield_kwh, e AS export_kwh, greatest(0.0, least(coalesce(e, 0), coalesce(y, 0))) AS ex FROM w LEFT JOIN y USING (name) LEFT JOIN x USING (name), m) SELECT {{cols}} FROM (SELECT *, CASE mode WHEN 'net_metering' THEN yield_kwh * price WHEN 'self_consumption' THEN (yield_kwh - ex) * price + ex * feed ELSE yield_kwh * feed END AS saved FROM g)", 5))
def _(spark, d):
    windows = spark.createDataFrame(WINDOWS, "name string, start long, end long")
    modes = spark.createDataFrame(MODES, "mode string, price double, feed_in double")
    return rounded(V.savings_windows(A.fold_hourly(D.fivemin(spark, d)), A.fold_plant(D.plant_state(spark, d)), windows, modes), 5)


@query("met11_amortisation", "SELECT o_orderkey, round(least(100.0, o_totalprice / 90000 * 100), 9) + 0.0 AS progress_pct, round(CASE WHEN y > 0 AND m <= 1200 THEN m END, 9) + 0.0 AS months, CASE WHEN y > 0 AND m <= 1200 THEN CAST(CAST(o_orderdate AS DATE) + CAST(floor(m * 30.44) AS INT) AS DATE) END AS target FROM (SELECT *, greatest(0.0, 90000.0 - o_totalprice) / y * 12 AS m FROM (SELECT *, CAST(o_custkey % 50 * 40 AS DOUBLE) AS y FROM orders))")
def _(spark, d):
    o = D.table(spark, d, "orders")
    return rounded(o.select("o_orderkey", R.amortisation(F.lit(90000.0), "o_totalprice", (F.col("o_custkey") % 50 * 40).cast("double"), F.col("o_orderdate").cast("date")).alias("a")).select("o_orderkey", "a.*"), 9)


@query("met12_outlook", sql_rounded("rain_probability_pct* clouds_pct* rain_mm*", f"WITH {WEATHER} SELECT {{cols}} FROM (SELECT round(max(rain_probability_pct), 1) AS rain_probability_pct, round(avg(clouds_pct), 1) AS clouds_pct, round(sum(rain_mm), 2) AS rain_mm FROM nwx WHERE ts_utc >= {D1} AND ts_utc < {D2})", 2))
def _(spark, d):
    from .operators.forecast import latest_rows

    newest = latest_rows(weather(spark, d).withColumn("seq", F.struct("issued_at_utc", "event_id")), ["ts_utc"], "seq")
    return rounded(V.outlook_of(newest, AT, TZ), 2)


#: Part of the price of every line as stored effects.
STORED = "fx AS (SELECT ['plant', 'string', 'string_daypart'][l_linenumber % 3 + 1] AS scope, l_orderkey AS id, l_partkey % 7 || CASE WHEN l_linenumber % 3 = 1 THEN '' ELSE '|' || l_suppkey % 5 END AS key, l_discount - 0.05 AS value, l_quantity AS n_eff FROM lineitem)"


def _effects(spark, d):
    x = D.table(spark, d, "lineitem")
    kind, a, b = F.col("l_linenumber") % 3, (F.col("l_partkey") % 7).cast("string"), (F.col("l_suppkey") % 5).cast("string")
    return x.select(F.when(kind == 0, "plant").when(kind == 1, "string").otherwise("string_daypart").alias("scope"), F.col("l_orderkey").alias("id"), F.when(kind == 1, a).otherwise(F.concat_ws("|", a, b)).alias("key"), (F.col("l_discount") - 0.05).alias("value"), F.col("l_quantity").cast("double").alias("n_eff"))


@query("met13_model_summary", f"WITH {STORED} SELECT scope, key, factor, n_eff, count(*) AS n FROM (SELECT scope, key, round(exp(CASE WHEN n_eff <= 0 THEN 0 ELSE greatest(-0.7, least(0.7, value * n_eff / (n_eff + 10))) END), 4) + 0.0 AS factor, round(n_eff, 2) + 0.0 AS n_eff FROM fx WHERE scope <> 'string_daypart' OR n_eff >= {0.7 / (1 - 0.5 ** (1 / 15))}) GROUP BY ALL")
def _(spark, d):
    return V.model_summary(_effects(spark, d)).groupBy("scope", "key", "factor", "n_eff").agg(F.count("*").alias("n"))


@query("met13_observations", f"WITH {STORED} SELECT round(sum(n_eff), 2) + 0.0 AS observations FROM fx WHERE scope = 'plant'")
def _(spark, d):
    return V.observations_seen(_effects(spark, d))


LIGHT = [("s1", AT - 86400, AT), ("s2", AT - 43200, AT), ("s3", AT, AT)]


@query("met15_string_details", f"WITH {INTEGRATED}, dl(string_id, a, b) AS {_values(LIGHT)}, g AS (SELECT string_id, count(*) AS n, round(avg(coverage), 3) AS coverage_mean, round(avg(CAST(limit_binding AS INT)), 6) AS curtailed_fraction, count(*) FILTER (value_kind = 'measured') AS n_measured FROM fm JOIN dl USING (string_id) WHERE ts_utc >= a AND ts_utc < b GROUP BY ALL) SELECT k.*, coalesce(n, 0) AS n, coverage_mean, curtailed_fraction, n_measured FROM (VALUES ('s1', CAST(175.0 AS DOUBLE)), ('s2', 180.0), ('s3', 115.0)) k(string_id, azimuth_deg) LEFT JOIN g USING (string_id)")
def _(spark, d):
    light = spark.createDataFrame(LIGHT, "string_id string, start long, end long")
    at = J.geometry_asof(light.select("string_id", F.lit(AT).cast("long").alias("ts_utc")), D.geometry(spark)).select("string_id", "azimuth_deg")
    return V.string_details(at, D.fivemin(spark, d), light).select("string_id", "azimuth_deg", "n", "coverage_mean", F.round("curtailed_fraction", 6).alias("curtailed_fraction"), "n_measured")


@query("met16_collector_health", sql_rounded("health_pct* strings", f"WITH {INTEGRATED}, g AS (SELECT string_id, arg_max(coverage, ts_utc) AS c FROM fm GROUP BY ALL) SELECT {{cols}} FROM (SELECT avg(c) * 100 AS health_pct, count(*) AS strings FROM g)"))
def _(spark, d):
    return rounded(V.collector_health(D.fivemin(spark, d)))


SEASONS = f"""{SKY},
sc AS (SELECT *, sum(w) OVER (PARTITION BY string_id, az_bin, el_bin, half ORDER BY logr, w ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY string_id, az_bin, el_bin, half) AS tot FROM rw),
sh AS (SELECT string_id, az_bin, el_bin, half, coalesce(min(logr) FILTER (cum >= 0.8 * tot), max(logr)) AS q, max(tot) AS hn FROM sc GROUP BY ALL HAVING max(tot) >= 4 AND count(DISTINCT ts_utc // 86400) >= 10),
se AS (SELECT string_id, az_bin, el_bin, max(q) FILTER (half = 0) AS rising, max(q) FILTER (half = 1) AS falling, max(hn) FILTER (half = 0) AS rising_n, max(hn) FILTER (half = 1) AS falling_n FROM sh GROUP BY ALL HAVING abs(max(q) FILTER (half = 0) - max(q) FILTER (half = 1)) >= 0.18)"""


@query("cmp19_seasonal_split", sql_rounded("string_id az_bin el_bin rising* falling* rising_n* falling_n*", f"WITH {SEASONS} SELECT {{cols}} FROM se"))
def _(spark, d):
    return rounded(S.seasonal_cells(_sky(spark, d)))


SQL["cmp19_seasonal_cells"] = SQL["cmp19_seasonal_split"]


@query("met17_sky_grid", sql_rounded("string_id azimuth* elevation* loss_pct* raw_ratio* n* season place", f"WITH {SEASONS}, g AS (SELECT string_id, CAST((az_bin + 0.5) * 10 AS DOUBLE) AS azimuth, CAST((el_bin + 0.5) * 5 AS DOUBLE) AS elevation, (1 - exp(value)) * 100 AS loss_pct, exp(raw) AS raw_ratio, n, 'all' AS season, 0 AS place FROM fit UNION ALL SELECT string_id, (az_bin + 0.5) * 10, (el_bin + 0.5) * 5, (1 - exp(greatest(ln(0.05), least(0.0, v * m / (m + 6.0) - level)))) * 100, exp(v), m, s, 1 FROM (SELECT *, unnest([rising, falling]) AS v, unnest([rising_n, falling_n]) AS m, unnest(['ascending', 'descending']) AS s FROM se) JOIN lv USING (string_id)) SELECT {{cols}} FROM g"))
def _(spark, d):
    rows = _sky(spark, d)
    cells = S.absolute_fit(rows)
    return rounded(V.sky_grid(cells, S.by_half(S.seasonal_cells(rows), cells)))


@query("jon15_seasonal_lookup", f"WITH {SEASONS}, q AS (SELECT DISTINCT string_id, az_bin, el_bin, half FROM rw) SELECT string_id, az_bin, el_bin, half, round(greatest(0.05, least(1.0, exp(coalesce(CASE WHEN rising IS NOT NULL THEN greatest(ln(0.05), least(0.0, CASE half WHEN 0 THEN rising ELSE falling END * CASE half WHEN 0 THEN rising_n ELSE falling_n END / (CASE half WHEN 0 THEN rising_n ELSE falling_n END + 6.0) - lv.level)) END, c.value, nb.near, 0.0)))), 6) + 0.0 AS factor FROM q LEFT JOIN lv USING (string_id) LEFT JOIN se USING (string_id, az_bin, el_bin) LEFT JOIN fit c USING (string_id, az_bin, el_bin) LEFT JOIN (SELECT x.string_id, x.az_bin, x.el_bin, greatest(ln(0.05), least(0.0, sum(c.raw * c.n) / sum(c.n) * avg(c.n) / (avg(c.n) + 6.0) - max(c.level))) AS near FROM (SELECT DISTINCT string_id, az_bin, el_bin FROM q) x, generate_series(-1, 1) a(da), generate_series(-1, 1) e(de), fit c WHERE NOT (da = 0 AND de = 0) AND c.string_id = x.string_id AND c.az_bin = (x.az_bin + da + 36) % 36 AND c.el_bin = x.el_bin + de GROUP BY ALL) nb USING (string_id, az_bin, el_bin)")
def _(spark, d):
    rows = _sky(spark, d)
    cells = S.absolute_fit(rows)
    return rounded(J.sky_lookup(rows.select("string_id", "az_bin", "el_bin", "half").distinct(), cells, S.by_half(S.seasonal_cells(rows), cells)))


MEMBERS = [("g1", "s1"), ("g1", "s2"), ("g2", "s3")]
GROUPS = [("g1", "direct", 1600.0, 0.97, 0.96), ("g2", "storage", 800.0, 0.97, 0.96)]
CURVE = [(5.0, 0.90), (10.0, 0.93), (50.0, 0.96), (100.0, 0.95)]
SERIES = f"{NEWEST}, mb(group_id, string_id) AS {_values(MEMBERS)}, sr AS (SELECT group_id, ts_utc, round(sum(round(potential_kwh * 10, 4)), 4) AS kwh FROM nw JOIN mb USING (string_id) GROUP BY ALL)"
_ETA = "CASE WHEN x < 5 THEN 0.90 WHEN x < 10 THEN 0.90 + 0.03 * (x - 5) / 5 WHEN x < 50 THEN 0.93 + 0.03 * (x - 10) / 40 WHEN x < 100 THEN 0.96 - 0.01 * (x - 50) / 50 ELSE 0.95 END"
CONVERTED = f"{SERIES}, gr(group_id, output_path, rated, mppt, charge) AS {_values(GROUPS)}, cv AS (SELECT group_id, ts_utc, output_path, kwh, CASE output_path WHEN 'direct' THEN least(kwh * {_ETA}, rated / 1000) WHEN 'storage' THEN kwh * mppt * charge END AS out_kwh FROM (SELECT *, kwh / (rated / 1000) * 100 AS x FROM sr JOIN gr USING (group_id)))"


def _series(spark, d):
    members = spark.createDataFrame(MEMBERS, "group_id string, string_id string")
    return V.group_series(_newest(spark, d).withColumn("potential_kwh", F.col("potential_kwh") * 10), members), members


def _converted(spark, d):
    series, members = _series(spark, d)
    curve = F.array(*[F.struct(F.lit(a).alias("load"), F.lit(b).alias("eta")) for a, b in CURVE])
    groups = spark.createDataFrame(GROUPS, "group_id string, output_path string, rated_ac_w double, mppt_eff double, charge_eff double").withColumn("curve", curve)
    return V.convert_group(series, groups), members, groups


def _group_sums(relation, value):
    return f"(SELECT group_id, coalesce({_sum(D0, D1, value)}, 0) AS today, coalesce({_sum(D1, D2, value)}, 0) AS tomorrow, coalesce({_sum(AT, D1, value)}, 0) AS remaining FROM {relation} GROUP BY ALL)"


@query("met20_group_sums", sql_rounded("group_id today* tomorrow* remaining*", f"WITH {SERIES} SELECT {{cols}} FROM {_group_sums('sr', 'kwh')}"))
def _(spark, d):
    return rounded(V.group_sums(_series(spark, d)[0], AT, TZ))


@query("cmp13_convert_groups", sql_rounded("group_id ts_utc output_path kwh* out_kwh*", f"WITH {CONVERTED} SELECT {{cols}} FROM cv"))
def _(spark, d):
    return rounded(_converted(spark, d)[0])


@query("met21_group_output", sql_rounded("group_id today* tomorrow* remaining*", f"WITH {CONVERTED} SELECT {{cols}} FROM {_group_sums('cv', 'out_kwh')}"))
def _(spark, d):
    return rounded(V.group_sums(_converted(spark, d)[0], AT, TZ, "out_kwh"))


ALL_STRINGS = [("s1",), ("s2",), ("s3",), ("s4",)]


@query("met22_plant_ac", sql_rounded("ts_utc ac_kwh* partial", f"WITH {CONVERTED} SELECT {{cols}} FROM (SELECT ts_utc, sum(out_kwh) AS ac_kwh, true AS partial FROM cv WHERE output_path = 'direct' GROUP BY ALL)"))
def _(spark, d):
    converted, members, groups = _converted(spark, d)
    return rounded(V.plant_ac(converted, spark.createDataFrame(ALL_STRINGS, "string_id string"), groups, members))


# Every string of the parts; suppliers are members of their nation's group.
@query("set06_output_paths", f"WITH {D.PART_GEOMETRY}, mb AS (SELECT 't' || CAST(s_suppkey % 500 AS VARCHAR) AS string_id, min(s_nationkey) AS n FROM supplier GROUP BY ALL) SELECT string_id, coalesce(path, 'none') AS path FROM (SELECT DISTINCT string_id FROM pg) LEFT JOIN (SELECT string_id, CASE n_nationkey % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'storage' ELSE 'none' END AS path FROM mb JOIN nation ON n = n_nationkey) USING (string_id)")
def _(spark, d):
    members = D.table(spark, d, "supplier").groupBy(F.concat(F.lit("t"), (F.col("s_suppkey") % 500).cast("string")).alias("string_id")).agg(F.min("s_nationkey").alias("group_id"))
    kind = F.col("n_nationkey") % 3
    groups = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"), F.when(kind == 0, "direct").when(kind == 1, "storage").otherwise("none").alias("output_path"))
    return V.path_lists(D.part_geometry(spark, d).select("string_id").distinct(), groups, members)


@query("snk16_forecast_attribute", f"WITH {FORECAST}, g AS (SELECT string_id, CAST({local_sql('ts_utc')} AS DATE) AS day, ts_utc FROM ev) SELECT string_id, day, CAST(count(*) AS INT) AS n, strftime({local_sql('min(ts_utc)')}, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS first_hour, strftime({local_sql('max(ts_utc)')}, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS last_hour FROM g GROUP BY string_id, day")
def _(spark, d):
    days = V.forecast_attribute(forecast(spark, d), TZ, ["string_id"])
    hours = F.from_json("hours", "array<struct<datetime: string, potential_kwh: double, unshaded_kwh: double>>")
    return days.withColumn("h", hours).select("string_id", "day", F.size("h").alias("n"), F.element_at("h", 1)["datetime"].alias("first_hour"), F.element_at("h", -1)["datetime"].alias("last_hour"))


@query("cmp22_learn_summary", "WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type = 'click') AS u, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY ALL) SELECT user_id, CASE WHEN h = 0 THEN 'nothing new to fold' ELSE h || ' hourly rows folded, ' || u || ' observations learned' || CASE WHEN e + s > 0 THEN ', ' || (e + s) || ' skipped (low_coverage ' || s || ', night ' || e || ')' ELSE '' END || CASE WHEN p > 0 THEN ', ' || p || ' shading' ELSE '' END END AS summary FROM g")
def _(spark, d):
    def n(kind):
        return F.count_if(F.col("event_type") == kind)

    stats = D.table(spark, d, "events").groupBy("user_id").agg(n("view").alias("hours_materialised"), n("click").alias("observations_used"), F.create_map(F.lit("night"), n("error"), F.lit("low_coverage"), n("signup")).alias("skipped"), n("purchase").alias("shading"), F.lit(0).alias("bias"), F.lit(0).alias("censored"), F.lit(0).alias("rejected"))
    return V.learn_summary(stats).select("user_id", "summary")


@query("set05_tracked_entities", "SELECT e AS entity_id, min(event_id) AS pos, CAST(row_number() OVER (ORDER BY min(event_id)) AS INT) AS place FROM (SELECT event_type || '.' || user_id % 7 AS e, event_id FROM events) GROUP BY e")
def _(spark, d):
    e = D.table(spark, d, "events")
    return V.tracked_entities(e.select(F.concat_ws(".", "event_type", (F.col("user_id") % 7).cast("string")).alias("entity_id"), F.col("event_id").alias("pos")))


@query("agg03_last_before", sql_rounded("entity_id last_value*", f"WITH {INTEGRATED} SELECT {{cols}} FROM (SELECT entity_id, arg_max(value, ts_utc) AS last_value FROM smp WHERE value IS NOT NULL AND ts_utc < {AT} GROUP BY ALL)"))
def _(spark, d):
    return rounded(A.last_before(D.samples(spark, d), AT))


@query("agg11_counts", "WITH g AS (SELECT 'g' || l_suppkey % 5 AS scope_id, count(*) AS n, count(*) FILTER (l_linenumber % 4 <> 0) AS usable, min(CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT)) AS first_ts_utc FROM lineitem GROUP BY ALL) SELECT scope_id, coalesce(n, 0) AS n, coalesce(usable, 0) AS usable, first_ts_utc FROM (VALUES ('g0'), ('g1'), ('g2'), ('g9')) t(scope_id) LEFT JOIN g USING (scope_id)")
def _(spark, d):
    expected = spark.createDataFrame([("g0",), ("g1",), ("g2",), ("g9",)], "scope_id string")
    return A.counts_by(D.conversion(spark, d), "scope_id", expected, F.coalesce("censored", F.lit(1)) == 0)


UNIT_ROWS = [("speed", "km/h", 1 / 3.6), ("speed", " MPH ", 0.44704), ("pressure", "kPa", 10.0), ("power", "kW", 1000.0), ("illuminance", "klx", 1000.0), ("precipitation", "in", 25.4), ("irradiance", "furlong", 1.0)]


@query("scl22_units", f"WITH u(quantity, unit, f) AS {_values(UNIT_ROWS)} SELECT o_orderkey, quantity, unit, round(o_totalprice * f, 4) + 0.0 AS value FROM orders, u UNION ALL SELECT o_orderkey, 'temperature', s, round(CASE s WHEN '°F' THEN (o_totalprice - 32) * 5 / 9 WHEN 'K' THEN o_totalprice - 273.15 ELSE o_totalprice END, 4) + 0.0 FROM orders, (VALUES ('°F'), ('K'), ('°C')) t(s)")
def _(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    rows = F.array(*[F.struct(F.lit(q).alias("quantity"), F.lit(u).alias("unit")) for q, u in [(q, u) for q, u, _ in UNIT_ROWS] + [("temperature", s) for s in ("°F", "K", "°C")]])
    o = o.select("o_orderkey", "v", F.explode(rows).alias("r")).select("o_orderkey", "v", "r.*")
    value = F.col("v")
    for q in [*C.UNITS, "temperature"]:
        value = F.when(F.col("quantity") == q, R.to_unit("v", "unit", q)).otherwise(value)
    return o.select("o_orderkey", "quantity", "unit", (F.round(value, 4) + 0.0).alias("value"))


@query("scl_limits", "SELECT l_orderkey, l_linenumber, l_partkey, round(li, 6) + 0.0 AS live_w, round(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE least(li, 900.0) END, 6) + 0.0 AS effective_w, round(CASE WHEN l_suppkey % 3 = 0 AND l_quantity > 0 THEN least(li, l_quantity * 20) ELSE li END, 6) + 0.0 AS charger_w, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS holds, CASE WHEN l_discount > 0.05 THEN 'lower_bound' ELSE 'measured' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'ok' WHEN l_orderkey % 10 < 3 THEN 'night' ELSE 'missing' END AS availability FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN l_quantity / 100 * 1600 ELSE l_quantity * 30 END AS li FROM lineitem)")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    live = R.limit_watts(F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") * 30), F.col("l_partkey") % 2 == 0, F.lit(1600.0))
    state = F.when(F.col("l_suppkey") % 3 == 0, " Float ").when(F.col("l_suppkey") % 3 == 1, "BULK").otherwise("new")
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", live.alias("live_w"), R.effective_limit(F.when(F.col("l_linenumber") % 4 != 0, live), F.lit(True), F.lit(900.0)).alias("effective_w"), R.charger_limit(live, F.col("l_quantity") * 20, state).alias("charger_w"),
                            R.charger_limits(state).alias("holds"), R.kind_for(F.col("l_discount") > 0.05).alias("kind"), R.availability(F.when(F.col("l_linenumber") % 2 == 0, F.lit(1)), F.col("l_orderkey") % 10).alias("availability")))


@query("flt10_curtailed", f"WITH {INTEGRATED} SELECT string_id, ts_utc // 86400 AS day, coalesce(bool_and(limit_binding), false) AS fully, round(coalesce(avg(CAST(limit_binding AS INT)), 0), 6) + 0.0 AS fraction FROM fm GROUP BY ALL")
def _(spark, d):
    f = D.fivemin(spark, d).groupBy("string_id", F.floor(F.col("ts_utc") / 86400).alias("day")).agg(R.fully_curtailed("limit_binding").alias("fully"), R.curtailed_fraction("limit_binding").alias("fraction"))
    return rounded(f)


@query("scl29_daylight_clamp", "SELECT o_orderkey, CASE WHEN p THEN s ELSE greatest(s, 21600) END AS start, CASE WHEN p THEN e ELSE least(e, 64800) END AS stop FROM (SELECT o_orderkey, o_custkey % 5 = 0 AS p, o_orderkey % 86400 AS s, o_orderkey % 86400 + 7200 AS e FROM orders)")
def _(spark, d):
    o = D.table(spark, d, "orders")
    start, known = F.col("o_orderkey") % 86400, F.col("o_custkey") % 5 != 0
    a, b = R.clamp_daylight(start, start + 7200, F.when(known, 21600.7), F.when(known, 64800.2))
    return o.select("o_orderkey", a.alias("start"), b.alias("stop"))


@query("scl30_local_days", f"WITH t AS (SELECT DISTINCT CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) + l_linenumber * 3600 AS ts FROM lineitem), l AS (SELECT ts, {local_sql('ts')} AS w FROM t) SELECT ts, CAST(hour(w) AS INT) AS local_hour, CAST(epoch(timezone('{TZ}', CAST(CAST(w AS DATE) AS TIMESTAMP))) AS BIGINT) AS day_start, CAST(epoch(timezone('{TZ}', CAST(CAST(w AS DATE) + 1 AS TIMESTAMP))) AS BIGINT) AS day_end, CAST(epoch(timezone('{TZ}', CAST(CAST(w AS DATE) - 1 AS TIMESTAMP) + INTERVAL 18 HOUR)) AS BIGINT) AS cutoff, strftime(w, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch(CAST(w AS TIMESTAMP)) - ts = 7200 THEN '+02:00' ELSE '+01:00' END AS iso FROM l")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    ts = x.select((F.floor(D.micros(x, "l_shipdate") / 1000000) + F.col("l_linenumber") * 3600).alias("ts")).distinct()
    a, b = R.day_bounds("ts", TZ)
    return ts.select("ts", R.local_hour("ts", TZ).alias("local_hour"), a.alias("day_start"), b.alias("day_end"), R.day_ahead_cutoff("ts", TZ).alias("cutoff"), R.iso_time("ts", TZ).alias("iso"))


@query("scl31_fingerprint")
def _(spark, d):
    """SQL has no CRC-32 here; the tests hold it against zlib."""
    return D.table(spark, d, "events").select(F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("entity_id")).distinct().withColumn("print", R.fingerprint("entity_id"))


@query("scl_scalars", sql_rounded("l_orderkey l_linenumber l_partkey closed cloud_ghi* lux_ghi* bucket", "SELECT {cols} FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((l_orderkey * 7 + l_linenumber - 1) / 300.0) AS BIGINT) * 300 - 300 AS closed, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity * 20 AS DOUBLE) ELSE l_quantity * 20 * (1 - 0.75 * pow(l_partkey % 101 / 100.0, 3.4)) END AS cloud_ghi, greatest(0.0, (l_extendedprice - 5000) / 120) AS lux_ghi, CAST([2, 5, 10, 20, 35, 50, 75, 100][1 + len(list_filter([3.5, 7.5, 15, 27.5, 42.5, 62.5, 87.5], lambda b: b < l_quantity * 2))] AS INT) AS bucket FROM lineitem)"))
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    clouds = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 101)
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", R.closed_interval(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("closed"), R.cloud_ghi((F.col("l_quantity") * 20).cast("double"), clouds).alias("cloud_ghi"), R.lux_to_ghi(F.col("l_extendedprice") - 5000).alias("lux_ghi"), R.nearest_load(F.col("l_quantity").cast("double") * 2).alias("bucket")))


@query("src03_numeric", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN round(value) ELSE NULL END AS number FROM events")
def _(spark, d):
    e = D.table(spark, d, "events")
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(k == 1, "unavailable").when(k == 2, " Unknown").when(k == 3, "").when(k == 4, F.round("value").cast("string")).otherwise("12 W")
    return e.select("event_id", R.numeric(text).alias("number"))


@query("src02_densify", "WITH s AS (SELECT event_type AS entity_id, CAST(event_id * 37 AS DOUBLE) AS ts, value, lead(event_id * 37) OVER (PARTITION BY event_type ORDER BY event_id) AS nx FROM events) SELECT entity_id, t AS ts_utc, value FROM (SELECT entity_id, value, ts + 30 * unnest(range(0, CAST(greatest(ceil((coalesce(nx, ts) - ts) / 30.0) - 1, 0) AS BIGINT) + 1)) AS t FROM s)")
def _(spark, d):
    e = D.table(spark, d, "events")
    return RD.densify(e.select(F.col("event_type").alias("entity_id"), (F.col("event_id") * 37).cast("double").alias("ts_utc"), "value"))


@query("src08_statistics", "SELECT epoch_us(ts) // 3600000000 * 3600 AS ts_utc, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL")
def _(spark, d):
    e = D.table(spark, d, "events")
    seconds = D.micros(e, "ts") / 1000000
    return RD.statistics_hours(e.select(F.when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds).alias("start"), F.when(F.col("event_type") != "error", F.col("value")).alias("mean"), F.col("event_id").alias("seq")))


def _payload():
    """Two hours of one variable, the second without a value, as JSON text."""
    label = (F.col("issued") + F.col("k") * 3600).cast("string")
    return F.concat(F.lit('{"hourly": {"time": ['), label, F.lit(", "), (F.col("issued") + F.col("k") * 3600 + 3600).cast("string"), F.lit('], "shortwave_radiation": ['), F.col("value").cast("string"), F.lit('], "cloud_cover": [null, 40]}}'))


@query("src04_forecast_payload", sql_rounded("issued_at_utc ts_utc horizon_h ghi_wm2* clouds_pct*", "WITH p AS (SELECT event_id * 3600 AS i, CAST(props->>'$.k' AS INT) AS k, value FROM events WHERE event_type = 'view'), r AS (SELECT i AS issued_at_utc, i + (k + s - 1) * 3600 AS ts_utc, CAST(k + s - 1 AS INT) AS horizon_h, CASE s WHEN 0 THEN value END AS ghi_wm2, CASE s WHEN 1 THEN CAST(40 AS DOUBLE) END AS clouds_pct FROM p, (VALUES (0), (1)) t(s)) SELECT {cols} FROM r"))
def _(spark, d):
    e = D.table(spark, d, "events").filter("event_type = 'view'").select((F.col("event_id") * 3600).alias("issued"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    rows = RD.parse_forecast(e.select(_payload().alias("payload"), F.col("issued").alias("issued_at_utc"), F.lit("w").alias("source")))
    return rounded(rows.select("issued_at_utc", "ts_utc", "horizon_h", "ghi_wm2", "clouds_pct"))


@query("src06_cloud_rows", sql_rounded("ts_utc ghi_wm2*", "SELECT {cols} FROM (SELECT e.ts_utc, cs * (1 - 0.75 * pow(c / 100.0, 3.4)) AS ghi_wm2 FROM (SELECT event_id * 3600 AS ts_utc, event_id % 101 AS c FROM events) e JOIN (SELECT event_id * 3600 AS ts_utc, value * 2 AS cs FROM events WHERE event_id % 2 = 0) s USING (ts_utc))"))
def _(spark, d):
    e = D.table(spark, d, "events")
    rows = e.select((F.col("event_id") * 3600).alias("ts_utc"), (F.col("event_id") % 101).alias("clouds_pct"))
    return rounded(RD.rows_from_clouds(rows, e.filter("event_id % 2 = 0").select((F.col("event_id") * 3600).alias("ts_utc"), (F.col("value") * 2).alias("cs_ghi"))).select("ts_utc", "ghi_wm2"))


@query("src10_string_range", f"WITH {INTEGRATED} SELECT ts_utc, round(power_mean_w, 6) + 0.0 AS power_mean_w FROM fm WHERE string_id = 's2' AND ts_utc >= {D0} AND ts_utc < {D1}")
def _(spark, d):
    return rounded(SC.string_range(D.fivemin(spark, d), "s2", D0, D1).select("ts_utc", "power_mean_w"))


@query("src11_clean_measurements", f"WITH {INTEGRATED} SELECT string_id, ts_utc FROM fm WHERE power_mean_w IS NOT NULL AND value_kind = 'measured' AND coverage >= 0.8 AND NOT coalesce(limit_binding, false)")
def _(spark, d):
    return RD.clean_measurements(D.fivemin(spark, d)).select("string_id", "ts_utc")


@query("src12_hourly_range", f"WITH {INTEGRATED} SELECT string_id, ts_utc FROM hr WHERE ts_utc >= {D0} AND ts_utc < {D1}")
def _(spark, d):
    return SC.hourly_range(A.fold_hourly(D.fivemin(spark, d)), D0, D1).select("string_id", "ts_utc")


@query("src14_verification", f"WITH {WEATHER} SELECT ts_utc, horizon_h, issued_at_utc FROM wx WHERE ts_utc >= {D0} AND ts_utc < {D2} AND horizon_h <= 48")
def _(spark, d):
    return SC.issues_to_verify(weather(spark, d).withColumn("source", F.lit("w")), D0, D2, "w", 48).select("ts_utc", "horizon_h", "issued_at_utc")


@query("src15_battery_charge", f"WITH {PLANT} SELECT ts_utc, soc AS battery_soc_pct FROM pl WHERE ts_utc >= {D0} AND ts_utc < {D1}")
def _(spark, d):
    return SC.battery_charge(D.plant_state(spark, d), D0, D1)


@query("src13_weather_range", f"SELECT ts_utc, round(ghi, 6) + 0.0 AS ghi FROM (SELECT epoch_us(ts) // 300000000 * 300 AS ts_utc, avg(value) AS ghi FROM events WHERE event_type = 'purchase' GROUP BY ALL) WHERE ts_utc >= {D0} AND ts_utc < {D1}")
def _(spark, d):
    from .forecast_queries import measured_ghi

    return rounded(SC.weather_range(measured_ghi(spark, d), D0, D1).select("ts_utc", "ghi"))


@query("src16_training_pairs", "SELECT 'g' || l_suppkey % 5 AS scope_id, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 AND l_extendedprice / 10 * (1 - l_discount - l_tax) >= 0 AND l_linenumber % 4 <> 0 GROUP BY ALL")
def _(spark, d):
    return SC.training_pairs(D.conversion(spark, d)).groupBy("scope_id").agg(F.count("*").alias("n"))


@query("src18_observations", "SELECT 's' || l_suppkey % 3 + 1 AS string_id, count(*) AS n, round(avg(l_quantity / 25), 6) + 0.0 AS ratio FROM lineitem GROUP BY ALL".replace("'s' || l_suppkey % 3 + 1", "'s' || CAST(l_suppkey % 3 + 1 AS VARCHAR)"))
def _(spark, d):
    return rounded(SC.observations_to_fit(D.shading_obs(spark, d)).groupBy("string_id").agg(F.count("*").alias("n"), F.avg("ratio").alias("ratio")))


@query("src19_effects_of", f"WITH {STORED} SELECT key, round(value, 6) + 0.0 AS value, n_eff FROM fx WHERE scope = 'string'")
def _(spark, d):
    return rounded(SC.effects_of(_effects(spark, d), "string"))


def _old_new(spark, d):
    old = _effects(spark, d).groupBy("scope", "key").agg(F.sum("value").alias("value"), F.sum("n_eff").alias("n_eff"))
    return old, old.filter("n_eff % 3 = 0").withColumn("value", F.col("value") + 1)


_TOTALS = f"{STORED}, ol AS (SELECT scope, key, sum(value) AS value, sum(n_eff) AS n_eff FROM fx GROUP BY ALL)"


@query("snk05_replace_scope", sql_rounded("scope key value*", f"WITH {_TOTALS} SELECT {{cols}} FROM (SELECT scope, key, value FROM ol WHERE scope <> 'string' UNION ALL SELECT scope, key, value + 1 FROM ol WHERE scope = 'string' AND n_eff % 3 = 0)", 4))
def _(spark, d):
    old, new = _old_new(spark, d)
    return rounded(M.replace_scope(old, new.filter("scope = 'string'"), "string").select("scope", "key", "value"), 4)


@query("snk06_merge_scope", sql_rounded("scope key value*", f"WITH {_TOTALS} SELECT {{cols}} FROM (SELECT scope, key, value + CASE WHEN n_eff % 3 = 0 THEN 1 ELSE 0 END AS value FROM ol)", 4))
def _(spark, d):
    old, new = _old_new(spark, d)
    return rounded(T.merge_scope(old, new, ["scope", "key"]).select("scope", "key", "value"), 4)


@query("snk07_replace_segment", f"WITH {D.PART_GEOMETRY}, nw AS (SELECT 't' || CAST(s_suppkey AS VARCHAR) AS string_id, s_suppkey * 1000 + 7 AS valid_from_ts_utc, CAST(s_nationkey AS DOUBLE) AS azimuth_deg FROM supplier) SELECT string_id, valid_from_ts_utc, azimuth_deg FROM pg WHERE NOT (string_id IN (SELECT string_id FROM nw) AND valid_from_ts_utc = (SELECT max(q.valid_from_ts_utc) FROM pg q WHERE q.string_id = pg.string_id)) UNION ALL SELECT * FROM nw")
def _(spark, d):
    key = F.col("s_suppkey")
    new = D.table(spark, d, "supplier").select(F.concat(F.lit("t"), key.cast("string")).alias("string_id"), (key * 1000 + 7).alias("valid_from_ts_utc"), F.col("s_nationkey").cast("double").alias("azimuth_deg"), F.lit(20.0).alias("tilt_deg"), F.lit(1.0).alias("kwp"))
    return M.replace_latest_segment(D.part_geometry(spark, d), new).select("string_id", "valid_from_ts_utc", "azimuth_deg")


@query("snk11_resets", f"WITH {STORED} SELECT 'string' AS reset, count(*) AS n FROM fx WHERE key <> '3' AND NOT starts_with(key, '3|') UNION ALL SELECT 'scope', count(*) FROM fx WHERE scope <> 'plant' UNION ALL SELECT 'prefix', count(*) FROM fx WHERE NOT starts_with(key, '1|') UNION ALL SELECT 'all', 0 UNION ALL SELECT 'pairs', count(*) FROM lineitem WHERE l_suppkey % 5 <> 1 AND l_suppkey % 3 <> 0")
def _(spark, d):
    e = _effects(spark, d)
    members = D.table(spark, d, "lineitem").select(F.concat(F.lit("g"), (F.col("l_suppkey") % 5).cast("string")).alias("scope_id"), F.array(F.when(F.col("l_suppkey") % 3 == 0, "g1").otherwise("x")).alias("members"))
    out = None
    for name, rows in (("string", M.clear_string(e, "3")), ("scope", T.reset(e, "plant")), ("prefix", T.reset(e, prefix="1|")), ("all", T.reset(e)), ("pairs", M.clear_pairs(members, "g1"))):
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("reset"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("snk12_cursor", "SELECT c_name AS name, CASE c_name WHEN 'Customer#000000007' THEN 7 ELSE c_custkey * 3600 END AS ts_utc FROM customer UNION ALL SELECT 'Customer#000000007', 7 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_name = 'Customer#000000007')")
def _(spark, d):
    """The marks of all customers, of which one is moved."""
    old = D.table(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") * 3600).alias("ts_utc"))
    return T.set_cursor(old, "Customer#000000007", 7)


@query("snk13_tiers", f"SELECT t AS tier, count(*) AS n FROM (SELECT epoch_us(l_shipdate) // 1000000 AS ts FROM lineitem), (VALUES ('weather_actual_5min', 90), ('exclusions', 90), ('conversion_5min', 730), ('forecast_log', 730)) v(t, dd) WHERE ts >= {SKY_NOW} - dd * 86400 GROUP BY ALL")
def _(spark, d):
    x = D.table(spark, d, "lineitem")
    rows = x.select(F.floor(D.micros(x, "l_shipdate") / 1000000).alias("ts_utc"))
    out = None
    for name, df in T.compact_tables({t: rows for t in ("weather_actual_5min", "exclusions", "conversion_5min", "forecast_log")}, SKY_NOW).items():
        n = df.groupBy(F.lit(name).alias("tier")).agg(F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("sta01_effect_rows", f"WITH {STORED} SELECT scope, key, count(*) AS n, CAST(5 AS BIGINT) AS updated_at FROM fx GROUP BY ALL")
def _(spark, d):
    again = T.effect_rows(T.effects_from_rows(_effects(spark, d)), 5)
    return again.groupBy("scope", "key", "updated_at").agg(F.count("*").alias("n"))


PRIOR = [(2.0, 0.86), (10.0, 0.93), (50.0, 0.96), (100.0, 0.95)]
CURVES = f"""cp AS (SELECT 'g' || l_suppkey % 5 AS scope_id, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS ts, l_extendedprice / 10 AS in_w, l_extendedprice / 10 * (1 - l_discount - l_tax) AS out_w FROM lineitem WHERE l_linenumber % 4 <> 0),
cl0 AS (SELECT *, in_w / 12000 * 100 AS load, out_w / in_w AS eta FROM cp WHERE in_w > 0 AND out_w >= 0 AND in_w / 12000 * 100 >= 1),
cb AS (SELECT *, [2, 5, 10, 20, 35, 50, 75, 100][1 + len(list_filter([3.5, 7.5, 15, 27.5, 42.5, 62.5, 87.5], lambda b: b < load))] AS bucket, pow(0.5, greatest(0.0, ({SKY_NOW} - ts) / 86400.0) / 365.0) AS w FROM cl0 WHERE out_w < 0.98 * 12000 AND eta > 0.3 AND eta <= 1.05),
cg AS (SELECT scope_id, bucket, count(*) AS n, sum(w) AS n_eff, sum(w * eta) / sum(w) AS measured FROM cb GROUP BY ALL),
cz AS (SELECT scope_id, bucket, sum(w * (eta - measured) * (eta - measured)) / sum(w) AS variance FROM cb JOIN cg USING (scope_id, bucket) GROUP BY ALL),
cx AS (SELECT scope_id, max(load) AS max_load FROM cl0 GROUP BY ALL),
cq AS (SELECT cg.*, variance, max_load, CASE WHEN bucket <= 10 THEN 0.86 + 0.07 * (bucket - 2) / 8 WHEN bucket <= 50 THEN 0.93 + 0.03 * (bucket - 10) / 40 ELSE 0.96 - 0.01 * (bucket - 50) / 50 END AS base FROM cg JOIN cz USING (scope_id, bucket) JOIN cx USING (scope_id)),
cv AS (SELECT *, greatest(base - 0.05, least(least(base + 0.05, 1.0), base + (measured - base) * n_eff / (n_eff + 50))) AS eta FROM cq)"""


def _curves(spark, d):
    prior = F.array(*[F.struct(F.lit(a).alias("load"), F.lit(b).alias("eta")) for a, b in PRIOR])
    reference = spark.range(5).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("scope_id"), F.lit(12000.0).alias("reference_w"), prior.alias("prior"))
    return L.fit_curves(D.conversion(spark, d), reference, SKY_NOW), reference


@query("agg21_fit_curves", sql_rounded("scope_id bucket n n_eff* measured* variance* eta* max_load*", f"WITH {CURVES} SELECT {{cols}} FROM cv"))
def _(spark, d):
    return rounded(_curves(spark, d)[0])


SQL["cmp14_curves"] = SQL["agg21_fit_curves"]


@query("flt20_looks_derived", f"WITH {CURVES}, g AS (SELECT scope_id, min(bucket) AS lo, max(bucket) AS hi, arg_min(measured, bucket) AS a, arg_max(measured, bucket) AS b FROM cv WHERE n_eff >= 5 GROUP BY ALL) SELECT scope_id, hi >= 4 * lo AND abs(a - b) < 0.015 AS derived FROM g")
def _(spark, d):
    return L.looks_derived(_curves(spark, d)[0])


def _stored_curves(spark, d):
    """The curves as stored rows, fitted once: their readers scan them often."""
    bins, reference = _curves(spark, d)
    return T.curve_rows(materialize(bins.withColumn("stage", F.lit("inverter")))), reference


@query("sta02_stored_curves", sql_rounded("scope_id stage bucket eta* n_eff* learned max_load*", f"WITH {CURVES}, b AS (SELECT unnest([2, 5, 10, 20, 35, 50, 75, 100]) AS bucket), s AS (SELECT unnest(['g0', 'g1', 'g2', 'g3', 'g4']) AS scope_id), p AS (SELECT *, CASE WHEN bucket <= 10 THEN 0.86 + 0.07 * (bucket - 2) / 8 WHEN bucket <= 50 THEN 0.93 + 0.03 * (bucket - 10) / 40 ELSE 0.96 - 0.01 * (bucket - 50) / 50 END AS pe FROM b, s) SELECT {{cols}} FROM (SELECT p.scope_id, 'inverter' AS stage, p.bucket, coalesce(cv.eta, pe) AS eta, coalesce(cv.n_eff, 0) AS n_eff, coalesce(cv.n_eff, 0) >= 50 AS learned, coalesce(cx.max_load, 0) AS max_load FROM p LEFT JOIN cv USING (scope_id, bucket) LEFT JOIN cx ON cx.scope_id = p.scope_id)"))
def _(spark, d):
    rows, reference = _stored_curves(spark, d)
    return rounded(T.curves_from_rows(rows, reference.withColumn("stage", F.lit("inverter"))).drop("prior_eta"))


@query("cmp14_reachable", f"WITH {CURVES}, b AS (SELECT unnest([2, 5, 10, 20, 35, 50, 75, 100]) AS bucket), r AS (SELECT cx.scope_id, b.bucket, b.bucket <= [2, 5, 10, 20, 35, 50, 75, 100][1 + len(list_filter([3.5, 7.5, 15, 27.5, 42.5, 62.5, 87.5], lambda e: e < cx.max_load))] AS within, coalesce(cv.n_eff, 0) >= 50 AS learned FROM cx CROSS JOIN b LEFT JOIN cv ON cv.scope_id = cx.scope_id AND cv.bucket = b.bucket) SELECT scope_id, 'inverter' AS stage, count(*) FILTER (within) AS reachable, count(*) FILTER (within AND learned) AS learned, round(count(*) FILTER (within AND learned) / count(*) FILTER (within), 6) + 0.0 AS coverage FROM r GROUP BY ALL")
def _(spark, d):
    rows, reference = _stored_curves(spark, d)
    return rounded(T.reachable(T.curves_from_rows(rows, reference.withColumn("stage", F.lit("inverter")))))


# Suppliers as configured strings, some of which have no segment yet.
@query("sta04_seed_geometry", f"WITH {D.PART_GEOMETRY}, st AS (SELECT 't' || CAST(s_suppkey + 450 AS VARCHAR) AS string_id FROM supplier) SELECT string_id, CAST(count(*) AS INT) AS segments FROM (SELECT string_id FROM pg UNION ALL SELECT string_id FROM st WHERE string_id NOT IN (SELECT string_id FROM pg)) GROUP BY ALL")
def _(spark, d):
    configured = D.table(spark, d, "supplier").select(F.concat(F.lit("t"), (F.col("s_suppkey") + 450).cast("string")).alias("string_id"), F.lit(200.0).alias("azimuth_deg"), F.lit(20.0).alias("tilt_deg"), F.lit(0.5).alias("kwp"))
    return T.seed_geometry(D.part_geometry(spark, d), configured).groupBy("string_id").agg(F.count("*").cast("int").alias("segments"))


@query("sta05_migrate", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(NULL AS DOUBLE) AS rain_probability_pct FROM orders")
def _(spark, d):
    return T.migrate(D.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey bigint, o_custkey string, rain_probability_pct double")


@query("cmp15_changed_sources", "SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS scope_id FROM orders WHERE o_custkey % 3 = 0")
def _(spark, d):
    c = D.table(spark, d, "orders").select("o_custkey").distinct()
    scope = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    now = c.select(scope.alias("scope_id"), F.concat(F.lit("sensor.a"), F.col("o_custkey").cast("string")).alias("entity_id"))
    was = c.select(scope.alias("scope_id"), R.fingerprint(F.concat(F.when(F.col("o_custkey") % 3 == 0, "sensor.b").otherwise("sensor.a"), F.col("o_custkey").cast("string"))).cast("double").alias("value"))
    return T.changed_sources(now, was)


@query("cmp27_conversion_pairs", sql_rounded("ts_utc scope_id stage in_w* out_w* coverage* curtailable", f"""WITH {INTEGRATED}, sc(scope_id, stage, string_id, want, curtailable) AS (VALUES ('s1', 'mppt', 's1', 1, true), ('g1', 'inverter', 's2', 2, false), ('g1', 'inverter', 's3', 2, false)),
i AS (SELECT scope_id, stage, ts_utc, any_value(curtailable) AS curtailable, sum(power_mean_w) AS in_w, min(coverage) AS c FROM fm JOIN sc USING (string_id) WHERE power_mean_w IS NOT NULL GROUP BY scope_id, stage, ts_utc HAVING count(*) = any_value(want)),
o AS (SELECT scope_id, ts_utc, power_mean_w * 0.9 - 20 AS out_w, coverage AS oc FROM fm, (VALUES ('s1'), ('g1')) t(scope_id) WHERE string_id = 's1' AND power_mean_w IS NOT NULL)
SELECT {{cols}} FROM (SELECT ts_utc, scope_id, stage, in_w, out_w, least(c, oc) AS coverage, curtailable FROM i JOIN o USING (scope_id, ts_utc) WHERE in_w > 0 AND out_w >= 0)"""))
def _(spark, d):
    f = D.fivemin(spark, d)
    scopes = spark.createDataFrame([("s1", "mppt", ["s1"], True), ("g1", "inverter", ["s2", "s3"], False)], "scope_id string, stage string, members array<string>, curtailable boolean")
    outputs = f.filter("string_id = 's1' and power_mean_w is not null").select("ts_utc", F.explode(F.array(F.lit("s1"), F.lit("g1"))).alias("scope_id"), (F.col("power_mean_w") * 0.9 - 20).alias("out_w"), F.col("coverage").alias("out_coverage"))
    return rounded(T.conversion_pairs(f, outputs, scopes).drop("members"))


@query("cmp20_refit_due", "SELECT s AS string_id, n, was, n >= 1.10 * was AND n - was >= 24 AS due FROM (SELECT 's' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS s, count(*) AS n, count(*) FILTER (l_suppkey % 3 = 0 OR (l_suppkey % 3 = 1 AND l_linenumber > 1)) AS was FROM lineitem GROUP BY ALL)")
def _(spark, d):
    obs = D.table(spark, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("string_id"), (F.col("l_suppkey") % 3).alias("k"), "l_linenumber")
    before = obs.filter("k = 0 or (k = 1 and l_linenumber > 1)").groupBy("string_id").agg(F.count("*").alias("n"))
    return S.refit_due(obs.groupBy("string_id").agg(F.count("*").alias("n")), before)


@query("prj01_curve_text", "SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN '5:0.9, ' || (10 + o_custkey % 50) || ':0.935' END AS curve FROM orders")
def _(spark, d):
    o = D.table(spark, d, "orders")
    text = F.concat(F.lit("5:0.90, "), (10 + F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_custkey") % 4 != 0, ":0.935").otherwise(":x"))
    return o.select("o_orderkey", RD.curve_text(RD.parse_curve(text)).alias("curve"))


STATE = f"""w AS (SELECT string_id, ts_utc // 7200 AS win, ts_utc, (ts_utc // 7200 + 1) * 7200 AS e, power_mean_w * 5 AS m FROM fm)"""


@query("cmp02_sky_reasons", f"WITH {INTEGRATED}, {STATE}, g AS (SELECT string_id, win, count(m) AS seen, max(CASE WHEN m IS NOT NULL THEN ts_utc END) < max(e) - 900 AS stale FROM w GROUP BY ALL) SELECT string_id, win, CASE WHEN win % 5 = 0 THEN 'no_source' WHEN win % 5 = 1 THEN 'learning_off' WHEN seen = 0 THEN 'no_measurement' WHEN stale THEN 'stale' ELSE 'other' END AS reason FROM g")
def _(spark, d):
    f = D.fivemin(spark, d)
    win = F.floor(F.col("ts_utc") / 7200)
    rows = f.select("string_id", win.alias("win"), "ts_utc", ((win + 1) * 7200).alias("end"), (F.col("power_mean_w") * 5).alias("measured"), F.lit(100.0).alias("clearsky"), F.lit(70.0).alias("forecast"))
    got = PB.sky_state(rows, ["string_id", "win"], F.col("win") % 5 != 0, F.col("win") % 5 != 1)
    known = F.col("reason").isin("no_source", "learning_off", "no_measurement", "stale")
    return got.select("string_id", "win", F.when(known, F.col("reason")).otherwise("other").alias("reason"))
