"""Queries of the collector stream, the learn cycle of several plants, scores
over days and the Perez sky, with their ANSI SQL where they have one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import forecast_queries as W
from .functions import physics as P
from .functions import predicates as R
from .operators import aggregate as A
from .operators import joins as J
from .operators import turbidity as U
from .plans.cycle import learn_cycle
from .plans.lineage import folder, shared_dir
from .queries import INTEGRATED, LINES, LOG, SAMPLES, _doubles, _latest, query, rounded, sql_rounded
from .sources import adapters as D
from .streaming.collector import collect, run_available
from .view_queries import ASOF, CUTOFF, TZ, local_sql

LATE_S, WATCHDOG_S = 600, 300
#: Windows that the watermark of all events has closed.
CLOSED = f"(SELECT floor((epoch_us(max(ts)) // 1000 / 1000.0 - {LATE_S} - {2.5 * WATCHDOG_S}) / 300) * 300 FROM events)"


@query("str04_collect", sql_rounded("entity_id ts_utc energy_wh* power_mean_w* coverage* sample_count peak_w*", f"WITH {INTEGRATED} SELECT {{cols}} FROM integ WHERE ts_utc + 300 <= {CLOSED}"))
def _(spark, d):
    """All events through the stateful stream: the batch's rows of the windows
    that are closed when the stream has read them."""
    reader = spark.readStream.schema(D.table(spark, d, "events").schema)
    where, store = folder(spark, f"{d}/events.parquet")
    whole = store.getFileStatus(where).isDirectory()
    events = reader.parquet(f"{d}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    samples = events.select(F.concat(F.lit("s"), (F.col("user_id") % 3 + 1).cast("string")).alias("entity_id"), F.timestamp_micros(D.micros(events, "ts")).alias("ts"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    top = f"{shared_dir(spark)}/collect-{uuid.uuid4().hex}"
    where, store = folder(spark, top)
    store.deleteOnExit(where)
    return rounded(run_available(collect(samples, WATCHDOG_S, lateness=f"{LATE_S} seconds"), f"{top}/rows", f"{top}/state"))


def cycle_tables(spark, d):
    """Strings s1 and s2 as plant p1, s3 as p2; both under the weather of the
    events."""
    plant = F.when(F.col("string_id") == "s3", "p2").otherwise("p1")
    both = F.explode(F.array(F.lit("p1"), F.lit("p2")))
    return {
        "plants": W.plants(spark).select(both.alias("plant_id"), *W.SITE), "strings": W.strings(spark).withColumn("plant_id", plant), "geometry": D.geometry(spark),
        "weather": W.newest_weather(spark, d).drop("plant_id").select("*", both.alias("plant_id")), "fivemin": D.fivemin(spark, d).withColumn("plant_id", plant),
        "effects": spark.createDataFrame([("p1", "string", "s1", 0.1, 20.0), ("p2", "string", "s3", -0.2, 5.0)], "plant_id string, scope string, key string, value double, n_eff double"),
        "shading": spark.createDataFrame([], "plant_id string, ts_utc long, string_id string, azimuth_deg double, elevation_deg double, ratio double, weight double, physics_w double, beam double")}


@query("cmp11_learn_cycle")
def _(spark, d):
    """One cycle for two plants, of which one is behind: per table and plant
    that it changes the rows, their first and last hour."""
    marks = spark.createDataFrame([("p1", W.FIRST + 40 * 3600), ("p2", W.FIRST)], "plant_id string, cursor long")
    out, cursors = learn_cycle(cycle_tables(spark, d), W.LAST, marks, max_hours=24 * 40, tz=TZ)
    counted = [out[t].groupBy("plant_id").agg(F.count("*").alias("n"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last")).withColumn("name", F.lit(t)) for t in ("fivemin", "hourly", "shading")]
    counted += [out["effects"].groupBy("plant_id").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")).withColumn("name", F.lit("effects"))]
    counted += [cursors.select("plant_id", F.lit(1).cast("long").alias("n"), F.col("cursor").alias("first"), F.col("cursor").alias("last"), F.lit("cursor").alias("name"))]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    return rows


DAYS = (7, 30)


def _windows_sql(until):
    metric = "CASE WHEN count(d.day) >= 3 THEN {} END"
    return f"""WITH {INTEGRATED}, {LOG}, g AS ({ASOF.format(until=until).replace('any_value(h.energy_kwh) AS energy_kwh', 'any_value(h.energy_kwh) AS energy_kwh, any_value(h.value_kind) AS value_kind')}),
p AS (SELECT CAST({local_sql('ts_utc')} AS DATE) AS day, forecast_kwh AS p, energy_kwh AS a, unnest(CASE WHEN value_kind <> 'measured' THEN ['all'] ELSE ['all', 'uncensored'] END) AS population FROM g WHERE forecast_kwh IS NOT NULL),
td AS (SELECT CAST({local_sql('max(epoch_us(ts)) // 1000000')} AS DATE) AS today FROM events),
dd AS (SELECT population, day, sum(p) AS p, sum(a) AS a, sum(abs(p - a)) AS e, sum(p - a) AS s, count(*) AS n FROM p GROUP BY ALL),
w(window_days) AS (VALUES (7), (30)), q(population) AS (VALUES ('all'), ('uncensored')),
d AS (SELECT w.window_days, dd.* FROM dd, td, w WHERE day < today AND day >= today - window_days)
SELECT w.window_days, q.population, round({metric.format('sum(abs(p - a)) / sum(a)')}, 6) AS wmape, round({metric.format('sum(e) / sum(n) / 3.75')}, 6) AS nmae, round({metric.format('sum(e) / sum(n)')}, 6) AS mae, round({metric.format('sum(s) / sum(n)')}, 6) AS bias, round({metric.format('avg(p - a)')}, 6) AS daily_bias, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, count(d.day) AS days
FROM w CROSS JOIN q LEFT JOIN d ON d.window_days = w.window_days AND d.population = q.population GROUP BY ALL"""


def _windows(spark, d, **how):
    hours = A.fold_hourly(D.fivemin(spark, d)).select("ts_utc", "string_id", "energy_kwh", "value_kind", R.day_ahead_cutoff("ts_utc", TZ).alias("cutoff"))
    pairs = J.forecast_asof(hours, _latest(spark, d), **how).filter("forecast_kwh is not null")
    events = D.table(spark, d, "events")
    today = events.select(R.local_day(F.floor(F.max(D.micros(events, "ts")) / 1000000), TZ).alias("day")).first()[0]
    return rounded(A.score_windows(pairs.select(R.local_day("ts_utc", TZ).alias("day"), F.col("forecast_kwh").alias("predicted"), F.col("energy_kwh").alias("actual"), (F.col("value_kind") != "measured").alias("censored")), today, DAYS, 3.75))


@query("met08_score_windows", _windows_sql("h.ts_utc"))
def _(spark, d):
    return _windows(spark, d, lead_s=0)


@query("met09_score_windows", _windows_sql(CUTOFF))
def _(spark, d):
    return _windows(spark, d, cutoff="cutoff")


LIGHT = P.SUN + P.CLEARSKY + P.COMPONENTS
PEREZ_OUT = ["epsilon", "brightness", "circumsolar", "horizon", "poa_sky", "poa", "power_w"]


@query("phy08_perez", f"WITH x AS ({LINES.format(seconds='epoch_us(l_shipdate) // 1000000')}), li AS ({P.nested_sql(f'({_doubles}) AS src', LIGHT)}), ok AS (SELECT *, bool_and(plausible) OVER (PARTITION BY l_orderkey) AS components_ok FROM li) SELECT l_orderkey, l_linenumber, l_partkey, components_ok, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in PEREZ_OUT)} FROM ({P.nested_sql('ok', P.plane('perez') + P.POWER)})")
def _(spark, d):
    """The planes of all line items, an order a batch: Perez where all of its
    components are plausible, else Hay-Davies."""
    x = D.table(spark, d, "lineitem")
    x = x.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 20).alias("ghi"), F.floor(D.micros(x, "l_shipdate") / 1000000).alias("l_shipdate_s"))
    light = P.run(spark.sql(_doubles.replace("FROM x", "FROM {x}"), x=x), LIGHT)
    sound = light.groupBy("l_orderkey").agg(F.every("plausible").alias("components_ok"))
    rows = P.run(light.join(sound, "l_orderkey"), P.plane("perez") + P.POWER)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "components_ok", *[(F.round(c, 4) + 0.0).alias(c) for c in PEREZ_OUT])


SITES = "SELECT DISTINCT c_custkey % 400 AS site, (c_custkey % 400) * 0.35 - 70 AS lat, (c_custkey % 400) * 0.8 - 160 AS lon, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey"
CELL_SQL = "CAST(greatest(0, least(2159, round_even((90 - 0.5 / 12 - lat) * 12, 0))) AS INT) AS r, CAST(greatest(0, least(4319, round_even((lon + 180 - 0.5 / 12) * 12, 0))) AS INT) AS c"


@query("phy02_turbidity", f"""WITH st AS ({SITES}), sd AS (SELECT site, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, day FROM st),
gc AS (SELECT DISTINCT {CELL_SQL}, s_suppkey % 400 AS k FROM (SELECT s_suppkey, CAST((s_suppkey % 400) * 0.35 - 70 AS DOUBLE) AS lat, CAST((s_suppkey % 400) * 0.8 - 160 AS DOUBLE) AS lon FROM supplier)),
gr AS (SELECT r, c, month, 2 + (k * month) % 30 / 10.0 AS v FROM gc, generate_series(1, 12) m(month) WHERE NOT (k % 7 = 0 AND month = 6)),
x AS (SELECT *, {CELL_SQL}, date_trunc('month', day) AS f, day(day) AS dm, month(day) AS m, day(last_day(day)) AS own FROM sd),
y AS (SELECT *, day(last_day(f - INTERVAL 1 MONTH)) AS before, day(last_day(f + INTERVAL 1 MONTH)) AS after, dm >= own / 2.0 AS late FROM x),
z AS (SELECT *, CASE WHEN late THEN m WHEN m = 1 THEN 12 ELSE m - 1 END AS a, CASE WHEN NOT late THEN m WHEN m = 12 THEN 1 ELSE m + 1 END AS b, CASE WHEN late THEN (dm - own / 2.0) / (own / 2.0 + after / 2.0) ELSE (dm + before / 2.0) / (before / 2.0 + own / 2.0) END AS share FROM y)
SELECT site, day, round(coalesce(ga.v + (gb.v - ga.v) * share, 3.5 - 0.01 * abs(lat) + 0.8 * cos(2 * pi() * (dayofyear(day) - CASE WHEN lat >= 0 THEN 200 ELSE 17.5 END) / 365)), 6) + 0.0 AS turbidity, ga.v IS NOT NULL AND gb.v IS NOT NULL AS gridded
FROM z LEFT JOIN gr ga ON ga.r = z.r AND ga.c = z.c AND ga.month = a LEFT JOIN gr gb ON gb.r = z.r AND gb.c = z.c AND gb.month = b""")
def _(spark, d):
    """Sites of the customers on the days of their orders; the cells of the
    suppliers are the grid, of some without June."""
    def place(key):
        return [((F.col(key) % 400) * 0.35 - 70).cast("double").alias("lat"), ((F.col(key) % 400) * 0.8 - 160).cast("double").alias("lon")]

    orders = D.table(spark, d, "orders").join(D.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = orders.select((F.col("c_custkey") % 400).alias("site"), *place("c_custkey"), F.to_date("o_orderdate").alias("day")).distinct()
    row, col = U.grid_cell("lat", "lon")
    cells = D.table(spark, d, "supplier").select((F.col("s_suppkey") % 400).alias("k"), *place("s_suppkey")).select("k", row.alias("row"), col.alias("col")).distinct()
    grid = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).filter("not (k % 7 = 0 and month = 6)")
    grid = grid.select("row", "col", "month", (2 + (F.col("k") * F.col("month")) % 30 / 10.0).alias("value"))
    return U.site_turbidity(days, grid).select("site", "day", F.round("turbidity", 6).alias("turbidity"), "gridded")
