"""Queries on the store, readers' columns and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import calendar, tariff
from gridloom.operators import curves
from gridloom.plans.base import LOCAL, days, hourly, query, r, zonal
from gridloom.session import table
from gridloom.sources import readers, store


@query(
    "store_merge",
    ", n AS (SELECT zone, ts, CASE WHEN hour(ts) = 3 THEN NULL ELSE p + 1 END AS p FROM zonal WHERE hour(ts) % 3 = 0), m AS (SELECT coalesce(o.zone, n.zone) AS zone, coalesce(o.ts, n.ts) AS ts, coalesce(n.p, o.p) AS p FROM (SELECT * FROM zonal WHERE day(ts) < 20) o FULL JOIN n ON o.zone = n.zone AND o.ts = n.ts) SELECT zone, ts, round(p, 6) AS p FROM m WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 25 DAY",
)
def store_merge(spark, sf_dir):
    """Stored hours with fetched ones in, nulls not taken, cut to the last 25 days."""
    z = zonal(spark, sf_dir)
    fresh = z.filter(F.hour("ts") % 3 == 0).withColumn("p", F.when(F.hour("ts") != 3, F.col("p") + 1))
    rows = store.merged(z.filter(F.dayofmonth("ts") < 20), fresh, ["zone", "ts"], fill=True)
    return store.kept_window(rows, "ts", 25).select("zone", "ts", r("p").alias("p"))


_CONTENT = """, t AS (SELECT event_type AS zone, ts, md5(concat_ws('|', coalesce(CAST(event_id AS VARCHAR), '\\N'), coalesce(event_type, '\\N'), coalesce(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '\\N'))) AS h FROM events),
m AS (SELECT zone, count(*) AS rows, min(ts) AS start, max(ts) AS stop, lpad(format('{:x}', CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) % 4294967296 AS BIGINT)), 8, '0') || lpad(format('{:x}', CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) % 4294967296 AS BIGINT)), 8, '0') AS content FROM t GROUP BY 1)
"""


def _manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return store.manifest(rows, "zone", "ts", ["event_id", "zone", "cents"])


@query("store_manifest", _CONTENT + "SELECT zone, rows, start, stop, content FROM m")
def store_manifest(spark, sf_dir):
    """Rows, range and content hash of each series."""
    return _manifest(spark, sf_dir).select("zone", "rows", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "content")


@query("snapshot_id", _CONTENT + "SELECT substr(sha256(string_agg(zone || ':' || content, '|' ORDER BY zone)), 1, 16) AS snapshot FROM m")
def snapshot_id(spark, sf_dir):
    """The data's version."""
    return store.snapshot_id(_manifest(spark, sf_dir), "zone")


@query(
    "missing_windows",
    ", c AS (SELECT zone, min(ts) AS a, max(ts) AS b FROM zonal GROUP BY 1), w AS (SELECT min(a) - INTERVAL 5 HOUR AS lo, max(b) AS hi FROM c) SELECT zone, lo AS gap_start, a - INTERVAL 1 HOUR AS gap_stop FROM c, w WHERE lo < a UNION ALL SELECT zone, b + INTERVAL 1 HOUR, hi FROM c, w WHERE hi > b",
)
def missing_windows(spark, sf_dir):
    """What each zone lacks of the window from five hours before the first to the last hour of all."""
    cover = zonal(spark, sf_dir).groupBy("zone").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    ends = cover.agg((F.min("start") - F.expr("interval 5 hours")).alias("lo"), F.max("stop").alias("hi"))
    return store.missing_windows(cover.crossJoin(F.broadcast(ends)), F.col("lo"), F.col("hi")).select("zone", "gap_start", "gap_stop")


@query(
    "store_problems",
    ", c AS (SELECT zone, count(*) AS n, max(ts) AS stop, avg(CASE WHEN hour(ts) % 7 = 3 AND zone > 'e' THEN 1e0 ELSE 0e0 END) AS nulls FROM zonal WHERE zone <> (SELECT min(event_type) FROM events) OR day(ts) < 10 GROUP BY 1), w AS (SELECT max(ts) AS now FROM zonal) SELECT zone, unnest(list_filter([CASE WHEN floor((epoch(now) - epoch(stop)) / 86400) > 3 THEN 'stale ' || CAST(floor((epoch(now) - epoch(stop)) / 86400) AS BIGINT) || 'd' END, CASE WHEN nulls > 0.02 THEN 'nulls' END], lambda x: x IS NOT NULL)) AS problem FROM c, w",
)
def store_problems(spark, sf_dir):
    """Stale series and such with too many nulls."""
    z = zonal(spark, sf_dir)
    first = table(spark, sf_dir, "events").agg(F.min("event_type").alias("first"))
    now = z.agg(F.max("ts").alias("now"))
    some = z.crossJoin(F.broadcast(first)).filter((F.col("zone") != F.col("first")) | (F.dayofmonth("ts") < 10))
    entries = some.groupBy("zone").agg(F.count("*").alias("rows"), F.max("ts").alias("stop"), F.avg(((F.hour("ts") % 7 == 3) & (F.col("zone") > "e")).cast("double")).alias("null_share"))
    return store.problems(entries.crossJoin(F.broadcast(now)), "zone", F.col("now"))


@query(
    "model_fingerprint",
    ", c AS (SELECT zone AS feature, round(avg(p), 3) AS coef FROM zonal GROUP BY 1) SELECT substr(sha256(string_agg(feature || '=' || printf('%.10f', coef::DOUBLE), ';' ORDER BY feature)), 1, 16) AS fingerprint FROM c",
)
def model_fingerprint(spark, sf_dir):
    """The fingerprint of a model whose coefficients are the zones' mean prices; states learned against another are dropped."""
    model = zonal(spark, sf_dir).groupBy(F.col("zone").alias("feature")).agg(r(F.avg("p"), 3).alias("coef"))
    current = store.fingerprint(model, "feature", "coef")
    return store.valid_states(current.withColumn("state", F.lit(1)), current).select("fingerprint")


@query(
    "coerced_times",
    "-- times\nSELECT event_id, date_trunc('second', ts) AS ts FROM events",
)
def coerced_times(spark, sf_dir):
    """Times told in four forms, read back."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    forms = [F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), F.unix_timestamp(at).cast("string")]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", readers.coerced(text).cast("timestamp_ntz").alias("ts"))


@query(
    "site_weighted",
    ", s AS (SELECT event_type AS zone, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), x AS (SELECT ts, CASE WHEN hour(ts) % 5 = i % 5 THEN NULL ELSE p END AS wind, p * 2 AS sun, i AS ww, 6 - i AS sw FROM zonal JOIN s USING (zone)) SELECT ts, round(sum(wind * ww) / sum(ww) FILTER (wind IS NOT NULL) + 1e-9, 6) AS wind, round(sum(sun * sw) / sum(sw), 6) AS sun FROM x GROUP BY ts",
)
def site_weighted(spark, sf_dir):
    """Site means by weights of the sites that have a value."""
    z = zonal(spark, sf_dir)
    names = z.select("zone").distinct().agg(F.array_sort(F.collect_list("zone")).alias("z"))  # a row a zone
    sites = names.select(F.posexplode("z").alias("i", "zone")).select("zone", (F.col("i") + 1).alias("ww"), (5 - F.col("i")).alias("sw"))
    rows = z.join(F.broadcast(sites.select("zone", F.col("ww").alias("i"))), "zone").select("zone", "ts", F.when(F.hour("ts") % 5 != F.col("i") % 5, F.col("p")).alias("wind"), (F.col("p") * 2).alias("sun"))
    return readers.site_means(rows, sites, "zone", {"wind": "ww", "sun": "sw"}).select("ts", r(F.col("wind") + 1e-9).alias("wind"), r("sun").alias("sun"))


@query(
    "meter_daily",
    ", c AS (SELECT zone, ts, p, sum(p) OVER (PARTITION BY zone ORDER BY ts) AS counter FROM zonal), e AS (SELECT zone, max(ts) AS stop, arg_max(counter, ts) AS now FROM c GROUP BY 1), d AS (SELECT c.zone, CAST(ts AS DATE) AS day, avg(p) AS m FROM c JOIN e ON c.zone = e.zone WHERE ts >= stop - INTERVAL 28 DAY GROUP BY 1, 2), w AS (SELECT zone, avg(m) * 24 / 1000 AS power FROM d GROUP BY 1) SELECT c.zone, round((any_value(now) - arg_min(counter, ts)) / 14, 6) AS daily, round(any_value(power), 6) AS power FROM c JOIN e ON c.zone = e.zone JOIN w ON w.zone = c.zone WHERE ts >= stop - INTERVAL 14 DAY GROUP BY 1",
)
def meter_daily(spark, sf_dir):
    """Energy a day from a running counter over 14 days, and from power over 28."""
    from pyspark.sql import Window

    z = zonal(spark, sf_dir)
    counter = z.withColumn("counter", F.sum("p").over(Window.partitionBy("zone").orderBy("ts")))
    daily = readers.counter_daily(counter, ["zone"], "counter", 14)
    return daily.join(readers.power_daily(z, ["zone"], "p", 28).withColumnRenamed("daily", "power"), "zone").select("zone", r("daily").alias("daily"), r("power").alias("power"))


_OUT = f", o AS (SELECT ts, CAST({LOCAL} AS DATE) AS day, {LOCAL} AS start, round(p / 1000, 6) AS value FROM hourly)\n"


@query("price_entries", _OUT + "SELECT ts, day, start AS local_start, start + INTERVAL 1 HOUR AS local_stop, value FROM o")
def price_entries(spark, sf_dir):
    """Hourly entries with local start and stop and the price per kWh."""
    start = calendar.local(F.col("ts"))
    return hourly(spark, sf_dir).select("ts", F.to_date(start).alias("day"), start.cast("timestamp_ntz").alias("local_start"), (start + F.expr("interval 1 hour")).cast("timestamp_ntz").alias("local_stop"), F.round(F.col("p") / 1000, 6).alias("value"))


@query("day_price_stats", _OUT + "SELECT day, count(*) AS entries, min(value) AS low, round(avg(value) + 1e-9, 6) AS mean, max(value) AS high, list(value ORDER BY ts) AS prices FROM o GROUP BY day")
def day_price_stats(spark, sf_dir):
    """Each local day's entries in order, with least, mean and greatest."""
    rows = hourly(spark, sf_dir).select("ts", F.to_date(calendar.local(F.col("ts"))).alias("day"), F.round(F.col("p") / 1000, 6).alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("prices")  # a day's hours
    return rows.groupBy("day").agg(F.count("*").alias("entries"), F.min("value").alias("low"), r(F.avg("value") + 1e-9).alias("mean"), F.max("value").alias("high"), ordered)


_LOCAL_CURVES = f""", b AS (SELECT ts, CAST({LOCAL} AS DATE) AS day, hour({LOCAL}) AS hour, p - 100 AS spot, (greatest(p - 100, 0) / 1000 + 0.004 + CASE WHEN hour({LOCAL}) < 7 OR hour({LOCAL}) >= 22 THEN 0.02 ELSE 0.035 END + 0.02253) * 1.255 AS buy FROM hourly), f AS (SELECT * FROM b WHERE day IN (SELECT day FROM b GROUP BY 1 HAVING count(*) = 24)),
c AS (SELECT 'spot' AS kind, day, hour, spot AS v FROM f UNION ALL SELECT 'buy', day, hour, buy FROM f)
"""


@query(
    "local_day_curves",
    _LOCAL_CURVES + "SELECT a.kind, a.day, a.k, round(a.cheap + 1e-9, 5) AS cheap, round(b.peak + 1e-9, 5) AS peak FROM (SELECT kind, day, row_number() OVER (PARTITION BY kind, day ORDER BY v, hour) AS k, avg(v) OVER (PARTITION BY kind, day ORDER BY v, hour ROWS UNBOUNDED PRECEDING) AS cheap FROM c) a JOIN (SELECT kind, day, row_number() OVER (PARTITION BY kind, day ORDER BY v DESC, hour) AS k, avg(v) OVER (PARTITION BY kind, day ORDER BY v DESC, hour ROWS UNBOUNDED PRECEDING) AS peak FROM c) b ON a.kind = b.kind AND a.day = b.day AND a.k = b.k",
)
def local_day_curves(spark, sf_dir):
    """Both curves of spot and consumer price for whole local days."""
    at = calendar.local(F.col("ts"))
    spot = F.col("p") - 100
    buy = tariff.consumer_price(spot, F.when(calendar.is_night_tariff(at), 0.02).otherwise(0.035))
    rows = hourly(spark, sf_dir).select(F.to_date(at).alias("day"), F.hour(at).alias("hour"), F.explode(F.array(F.struct(F.lit("spot").alias("kind"), spot.alias("p")), F.struct(F.lit("buy").alias("kind"), buy.alias("p")))).alias("x")).select("day", "hour", "x.*")
    out = curves.duration_curves(curves.complete_days(rows, ["kind", "day"]), ["kind", "day"], 24)
    return out.select("kind", "day", F.col("k").cast("long").alias("k"), r(F.col("cheap") + 1e-9, 5).alias("cheap"), r(F.col("peak") + 1e-9, 5).alias("peak"))


@query(
    "history_curves",
    ", h AS (SELECT ts, p FROM hourly WHERE day(ts) < 15), n AS (SELECT ts, p - 5 AS p FROM hourly WHERE hour(ts) >= 12), u AS (SELECT coalesce(n.ts, h.ts) AS ts, coalesce(n.p, h.p) AS p FROM h FULL JOIN n ON n.ts = h.ts), d AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, p FROM u), w AS (SELECT * FROM d WHERE day IN (SELECT day FROM d GROUP BY 1 HAVING count(*) = 24)) SELECT day, CAST(k AS BIGINT) AS k, round(cheap, 6) AS cheap FROM (SELECT day, row_number() OVER (PARTITION BY day ORDER BY p, hour) AS k, avg(p) OVER (PARTITION BY day ORDER BY p, hour ROWS UNBOUNDED PRECEDING) AS cheap FROM w) WHERE k <= 12",
)
def history_curves(spark, sf_dir):
    """Curves of days put together from history and fresh hours, of which fresh ones count."""
    h = hourly(spark, sf_dir)
    rows = store.merged(h.filter(F.dayofmonth("ts") < 15), h.filter(F.hour("ts") >= 12).withColumn("p", F.col("p") - 5), ["ts"])
    dated = rows.select(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "p")
    return curves.duration_curves(curves.complete_days(dated, ["day"]), ["day"]).select("day", F.col("k").cast("long").alias("k"), r("cheap").alias("cheap"))


@query(
    "padded_curves",
    ", k AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY p, hour) AS k, avg(p) OVER (PARTITION BY day ORDER BY p, hour ROWS UNBOUNDED PRECEDING) AS cheap FROM days WHERE hour <> 5 OR day(day) % 2 = 0) SELECT day, max(k) AS hours, list(round(cheap, 6) ORDER BY k) || list_resize([]::DOUBLE[], CAST(24 - max(k) AS BIGINT), NULL) AS cheap FROM k GROUP BY day",
)
def padded_curves(spark, sf_dir):
    """Curves of partial days too, as arrays of 24 with nulls at their ends."""
    rows = days(spark, sf_dir).filter((F.col("hour") != 5) | (F.dayofmonth("day") % 2 == 0))
    curve = curves.duration_curves(rows, ["day"], 24)
    held = curve.groupBy("day").agg(F.count("*").alias("hours"), F.transform(F.array_sort(F.collect_list(F.struct("k", "cheap"))), lambda x: r(x["cheap"])).alias("cheap"))
    return held.select("day", "hours", F.concat("cheap", F.array_repeat(F.lit(None).cast("double"), (24 - F.col("hours")).cast("int"))).alias("cheap"))
