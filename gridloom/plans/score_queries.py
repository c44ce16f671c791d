"""Queries on scores by part, blocks, histograms and segments of days."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.operators import curves, ranks, scores
from gridloom.plans.base import days, hourly, pairs, query, r, zonal
from gridloom.session import table

#: Whole days with the day before's prices, as SQL; ``day_pairs`` is the same.
PAIRS = ", dp AS (SELECT a.day, a.hour, a.ts, a.p AS actual, b.p AS pred FROM whole a JOIN hourly b ON b.ts = a.ts - INTERVAL 24 HOUR), full_days AS (SELECT * FROM dp WHERE day IN (SELECT day FROM dp GROUP BY 1 HAVING count(*) = 24))\n"


def day_pairs(spark, sf_dir):
    whole = curves.complete_days(days(spark, sf_dir), ["day"]).withColumnRenamed("p", "actual")
    before = hourly(spark, sf_dir).select((F.col("ts") + F.expr("interval 24 hours")).alias("ts"), F.col("p").alias("pred"))
    joined = whole.join(before, "ts")
    full = F.count("*").over(Window.partitionBy("day"))
    return joined.withColumn("n", full).filter("n = 24").select("day", "hour", "ts", "actual", "pred")


@query(
    "quarter_scores",
    ", n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM pairs), q AS (SELECT *, least(i // (n // 4), 3) AS q FROM n) SELECT CAST(q + 1 AS BIGINT) AS quarter, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(abs(actual - pred)), 6) AS mae, round(avg(actual), 6) AS actual, count(*) AS n FROM q GROUP BY q",
)
def quarter_scores(spark, sf_dir):
    """Errors of four slices of as many rows, the last with the rest: their borders are told by the rows' days, then hours of one day."""
    rows = pairs(spark, sf_dir)
    return scores.quarters(rows, "ts").groupBy("quarter").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r(F.avg(F.abs(F.col("actual") - F.col("pred")))).alias("mae"), r(F.avg("actual")).alias("actual"), F.count("*").alias("n"))


_SEGMENTS = {
    "all": ("true", lambda: F.lit(True)),
    "night": ("hour(ts) < 6", lambda: F.hour("ts") < 6),
    "peak": ("hour(ts) BETWEEN 17 AND 20", lambda: F.hour("ts").between(17, 20)),
    "weekend": ("isodow(ts) > 5", lambda: ~calendar.is_workday(F.col("ts"))),
    "high": ("actual >= (SELECT quantile_cont(actual, 0.95) FROM pairs)", lambda: F.col("actual") >= F.col("high")),
    "low": ("actual <= (SELECT quantile_cont(actual, 0.05) FROM pairs)", lambda: F.col("actual") <= F.col("low")),
}


@query(
    "segment_scores",
    ", s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS segment, actual, pred FROM pairs WHERE {sql}" for name, (sql, _) in _SEGMENTS.items()) + ") SELECT segment, count(*) AS n, round(avg(abs(actual - pred)), 6) AS mae, round(avg(actual - pred), 6) + 0.0 AS bias FROM s GROUP BY 1 HAVING count(*) >= 20",
)
def segment_scores(spark, sf_dir):
    """Errors of six segments, of 20 rows at least: each row goes to the segments it is in, in one pass."""
    rows = pairs(spark, sf_dir)
    cuts = rows.agg(F.percentile("actual", 0.95).alias("high"), F.percentile("actual", 0.05).alias("low"))
    dealt = rows.crossJoin(F.broadcast(cuts)).select("actual", "pred", F.explode(F.filter(F.array(*[F.when(flag(), F.lit(name)) for name, (_, flag) in _SEGMENTS.items()]), lambda s: s.isNotNull())).alias("segment"))
    error = F.col("actual") - F.col("pred")
    return dealt.groupBy("segment").agg(F.count("*").alias("n"), r(F.avg(F.abs(error))).alias("mae"), r(F.avg(error)).alias("bias")).filter("n >= 20")


@query(
    "band_coverage",
    ", b AS (SELECT *, hour(ts) AS h, abs(actual - pred) <= 25 AS inside FROM pairs) SELECT CAST(month(ts) AS BIGINT) AS month, CAST(h AS BIGINT) AS hour, round(avg(abs(actual - pred)), 6) AS mae, round(avg(CASE WHEN inside THEN 1e0 ELSE 0e0 END), 6) AS coverage, round(max(abs(actual - pred)), 6) AS worst FROM b GROUP BY 1, 2",
)
def band_coverage(spark, sf_dir):
    """Errors, worst errors and the coverage of bands of 25 either side, by month and hour."""
    error = F.abs(F.col("actual") - F.col("pred"))
    inside = F.col("actual").between(F.col("pred") - 25, F.col("pred") + 25).cast("double")
    return pairs(spark, sf_dir).groupBy(F.month("ts").cast("long").alias("month"), F.hour("ts").cast("long").alias("hour")).agg(r(F.avg(error)).alias("mae"), r(F.avg(inside)).alias("coverage"), r(F.max(error)).alias("worst"))


@query(
    "daylight_scores",
    "SELECT count(*) FILTER (actual > 40) AS n, round(avg(abs(actual - pred)) FILTER (actual > 40), 6) AS mae, round(avg(abs(actual - pred)) FILTER (actual > 40) / avg(actual) FILTER (actual > 40), 6) AS relative FROM pairs",
)
def daylight_scores(spark, sf_dir):
    """Errors where there is something to forecast (above 40), and relative to it."""
    up = F.col("actual") > 40
    of = lambda x: F.avg(F.when(up, x))
    error = F.abs(F.col("actual") - F.col("pred"))
    return pairs(spark, sf_dir).agg(F.count_if(up).alias("n"), r(of(error)).alias("mae"), r(of(error) / of(F.col("actual"))).alias("relative"))


@query(
    "split_scores",
    "SELECT isodow(ts) > 5 AS weekend, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'day' ELSE 'evening' END AS part, count(*) AS n, round(avg(actual - pred), 6) + 0.0 AS bias, round(avg(abs(actual - pred)), 6) AS mae, round(sqrt(avg((actual - pred) ** 2)), 6) AS rmse FROM pairs GROUP BY 1, 2",
)
def split_scores(spark, sf_dir):
    """Bias and errors by weekend and part of the day."""
    hour, error = F.hour("ts"), F.col("actual") - F.col("pred")
    part = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "day").otherwise("evening")
    return pairs(spark, sf_dir).groupBy((~calendar.is_workday(F.col("ts"))).alias("weekend"), part.alias("part")).agg(F.count("*").alias("n"), r(F.avg(error)).alias("bias"), r(F.avg(F.abs(error))).alias("mae"), r(F.sqrt(F.avg(error * error))).alias("rmse"))


@query("monthly_scores", "SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, count(*) AS n, round(avg(abs(actual - pred)), 6) AS mae, round(avg(actual - pred), 6) + 0.0 AS bias, CASE WHEN var_pop(actual) > 0 THEN round(1 - avg((actual - pred) ** 2) / var_pop(actual), 6) ELSE 0 END AS r2 FROM pairs GROUP BY 1, 2")
def monthly_scores(spark, sf_dir):
    """The headline figures by month."""
    out = pairs(spark, sf_dir).groupBy(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(*scores.headline())
    return out.select("year", "month", "n", *[r(c).alias(c) for c in ("mae", "bias", "r2")])


_CURVES = PAIRS + """, c AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY actual, hour) AS k, avg(actual) OVER (PARTITION BY day ORDER BY actual, hour ROWS UNBOUNDED PRECEDING) AS a FROM full_days), d AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY pred, hour) AS k, avg(pred) OVER (PARTITION BY day ORDER BY pred, hour ROWS UNBOUNDED PRECEDING) AS b FROM full_days),
e AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY actual DESC, hour) AS k, avg(actual) OVER (PARTITION BY day ORDER BY actual DESC, hour ROWS UNBOUNDED PRECEDING) AS a FROM full_days), f AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY pred DESC, hour) AS k, avg(pred) OVER (PARTITION BY day ORDER BY pred DESC, hour ROWS UNBOUNDED PRECEDING) AS b FROM full_days),
both_ AS (SELECT 'cheap' AS direction, c.day, c.k, a, b FROM c JOIN d ON c.day = d.day AND c.k = d.k UNION ALL SELECT 'peak', e.day, e.k, a, b FROM e JOIN f ON e.day = f.day AND e.k = f.k)
"""


def _curve_pairs(spark, sf_dir):
    rows = day_pairs(spark, sf_dir)
    curve = lambda c, out: curves.duration_curves(rows.select("day", "hour", F.col(c).alias("p")), ["day"], 24).select("day", "k", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(d).alias(out)) for d in ("cheap", "peak")])).alias("x")).select("day", "k", "x.*")
    return curve("actual", "actual").join(curve("pred", "pred"), ["day", "k", "direction"])


@query("curve_scores", _CURVES + "SELECT direction, k, count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(avg(a - b), 6) + 0.0 AS bias, CASE WHEN var_pop(a) > 0 THEN round(1 - avg((a - b) ** 2) / var_pop(a), 6) ELSE 0 END AS r2 FROM both_ GROUP BY 1, 2")
def curve_scores(spark, sf_dir):
    """Errors of each level of the cheap and the dear curve."""
    out = _curve_pairs(spark, sf_dir).groupBy("direction", F.col("k").cast("long").alias("k")).agg(*scores.headline())
    return out.select("direction", "k", "n", *[r(c).alias(c) for c in ("mae", "rmse", "bias", "r2")])


@query("curve_rank", _CURVES + ", q AS (SELECT a, b FROM both_ WHERE direction = 'cheap' AND k = 4), s AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM q) SELECT round(corr(a, b), 6) AS rho FROM s")
def curve_rank(spark, sf_dir):
    """The rank correlation over days of the mean of the four cheapest hours."""
    level = _curve_pairs(spark, sf_dir).filter("direction = 'cheap' and k = 4").withColumn("all", F.lit(1))
    return scores.spearman(level, ["all"], "actual", "pred").select(r("rho").alias("rho"))


_BLOCKS = PAIRS + ", bl AS (SELECT day, hour AS start, avg(actual) OVER w AS a, avg(pred) OVER w AS b, count(*) OVER w AS n FROM full_days WINDOW w AS (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), b4 AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY a) AS place FROM bl WHERE n = 4)\n"


@query(
    "block_choice",
    _BLOCKS + "SELECT day, CAST(arg_min(start, (b, start)) AS BIGINT) AS chosen, CAST(arg_min(start, (a, start)) AS BIGINT) AS best, CAST(arg_min(place, (b, start)) AS BIGINT) AS place, round(100 * (arg_min(a, (b, start)) - min(a)) / abs(min(a)), 5) AS regret FROM b4 GROUP BY day",
)
def block_choice(spark, sf_dir):
    """The four hours that the forecast would choose, their true rank and what they cost too much."""
    out = ranks.block_choice(day_pairs(spark, sf_dir), ["day"], "actual", "pred")
    return out.select("day", *[F.col(c).cast("long").alias(c) for c in ("chosen", "best", "place")], r("regret", 5).alias("regret"))


@query(
    "block_concordance",
    _BLOCKS + ", six AS (SELECT * FROM b4 WHERE start % 4 = 0), t AS (SELECT x.day, y.a - x.a AS da, y.b - x.b AS db FROM six x JOIN six y ON x.day = y.day AND x.start < y.start) SELECT d.day, CAST(count(da) FILTER (abs(da) >= 5) AS BIGINT) AS pairs, CAST(count(da) FILTER (abs(da) >= 5 AND da * db > 0) AS BIGINT) AS concordant FROM (SELECT DISTINCT day FROM six) d LEFT JOIN t ON t.day = d.day GROUP BY 1",
)
def block_concordance(spark, sf_dir):
    """Pairs of a day's six blocks that differ by 5 or more, and how many the forecast has in order."""
    out = ranks.block_concordance(day_pairs(spark, sf_dir), ["day"], "actual", "pred")
    return out.select("day", F.col("pairs").cast("long").alias("pairs"), F.col("concordant").cast("long").alias("concordant"))


@query(
    "block_extremes",
    _BLOCKS.replace("JOIN hourly b ON b.ts = a.ts - INTERVAL 24 HOUR", "JOIN hourly b ON b.ts = a.ts") + "SELECT day, round(min(a), 6) AS cheapest, round(max(a), 6) AS dearest, CAST(arg_max(start, (a, -start)) AS BIGINT) AS dear_start FROM b4 GROUP BY day",
)
def block_extremes(spark, sf_dir):
    """The cheapest and the dearest four hours of each whole day."""
    whole = curves.complete_days(days(spark, sf_dir), ["day"])
    out = ranks.blocks(whole, ["day"], ["p"]).groupBy("day").agg(r(F.min("p")).alias("cheapest"), r(F.max("p")).alias("dearest"), F.max(F.struct("p", -F.col("start"))).alias("top"))
    return out.select("day", "cheapest", "dearest", (-F.col("top")["col2"]).cast("long").alias("dear_start"))


@query(
    "share_distance",
    ", k AS (SELECT day, hour, p, row_number() OVER (PARTITION BY day ORDER BY p, hour) - 1 AS place, 1 + hour % 5 AS kwh FROM whole), a AS (SELECT place, sum(kwh) / (SELECT sum(kwh) FROM k WHERE day(day) <= 10) AS s FROM k WHERE day(day) <= 10 GROUP BY 1), b AS (SELECT place, sum(kwh) / (SELECT sum(kwh) FROM k) AS s FROM k GROUP BY 1) SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS l1, round(max(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS largest, round(abs(sum(coalesce(a.s, 0) - coalesce(b.s, 0)) FILTER (coalesce(a.place, b.place) < 4)), 6) AS top4 FROM a FULL JOIN b ON a.place = b.place",
)
def share_distance(spark, sf_dir):
    """How far the shares of load by price rank learned from the months' first ten days lie from those of all days."""
    whole = curves.complete_days(days(spark, sf_dir), ["day"]).withColumn("kwh", 1 + F.col("hour") % 5)
    some = ranks.shares_by_rank(whole.filter(F.dayofmonth("day") <= 10), ["day"], "p", "kwh")
    return ranks.share_distance(some, ranks.shares_by_rank(whole, ["day"], "p", "kwh")).select(*[r(c).alias(c) for c in ("l1", "largest", "top4")])


@query("daily_histogram", ", b AS (SELECT day, least(greatest(floor((p + 10) / 10), 0), 10) AS bin FROM whole) SELECT day, " + ", ".join(f"round(avg(CASE WHEN bin = {k} THEN 1e0 ELSE 0e0 END), 6) AS b{k}" for k in range(11)) + " FROM b GROUP BY day")
def daily_histogram(spark, sf_dir):
    """Shares of eleven bins of each whole day."""
    place = ranks.bin_number(F.col("p"), -10.0, 10.0, 11)
    rows = curves.complete_days(days(spark, sf_dir), ["day"]).withColumn("bin", place)
    return rows.groupBy("day").agg(*[r(F.avg((F.col("bin") == k).cast("double"))).alias(f"b{k}") for k in range(11)])


@query("residual_histogram", ", e AS (SELECT actual - pred AS e FROM pairs), q AS (SELECT quantile_cont(e, 0.01) AS lo, quantile_cont(e, 0.99) AS hi FROM e) SELECT CAST(least(floor((e - lo) / ((hi - lo) / 39)), 38) AS BIGINT) AS bin, count(*) AS n FROM e, q WHERE e BETWEEN lo AND hi GROUP BY 1")
def residual_histogram(spark, sf_dir):
    """39 bins of the errors between their 1 % and 99 % quantiles."""
    e = pairs(spark, sf_dir).select((F.col("actual") - F.col("pred")).alias("e"))
    ends = e.agg(F.percentile("e", 0.01).alias("lo"), F.percentile("e", 0.99).alias("hi"))
    rows = e.crossJoin(F.broadcast(ends)).filter("e between lo and hi")
    return rows.groupBy(F.least(F.floor((F.col("e") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 39)), F.lit(38)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("decile_errors", ", q AS (SELECT quantile_cont(pred, 0.9) AS hi, quantile_cont(pred, 0.1) AS lo FROM pairs), e AS (SELECT abs(actual - pred) AS e, pred >= hi AS up, pred <= lo AS down FROM pairs, q) SELECT round(avg(e) FILTER (up), 6) AS top, round(avg(e) FILTER (down), 6) AS bottom, round(avg(e) FILTER (up) / avg(e) FILTER (down), 6) AS ratio FROM e")
def decile_errors(spark, sf_dir):
    """Errors where the forecast is in its highest and its lowest tenth."""
    rows = pairs(spark, sf_dir)
    cuts = rows.agg(F.percentile("pred", 0.9).alias("hi"), F.percentile("pred", 0.1).alias("lo"))
    e = F.abs(F.col("actual") - F.col("pred"))
    top, bottom = F.avg(F.when(F.col("pred") >= F.col("hi"), e)), F.avg(F.when(F.col("pred") <= F.col("lo"), e))
    return rows.crossJoin(F.broadcast(cuts)).agg(r(top).alias("top"), r(bottom).alias("bottom"), r(F.try_divide(top, bottom)).alias("ratio"))


@query("binned_ratio", "SELECT CAST(floor(pred / 10) AS BIGINT) AS bin, count(*) AS n, round(avg(actual), 6) AS actual, round(avg(actual) / avg(pred), 6) AS ratio FROM pairs GROUP BY 1")
def binned_ratio(spark, sf_dir):
    """Mean actual, and its ratio to the forecast, by bins of the forecast."""
    return pairs(spark, sf_dir).groupBy(F.floor(F.col("pred") / 10).cast("long").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("actual")).alias("actual"), r(F.try_divide(F.avg("actual"), F.avg("pred"))).alias("ratio"))


@query("density_contour", ", b AS (SELECT CAST(floor(p + 5) AS BIGINT) AS bin FROM hourly WHERE p >= -5 AND p < 65) SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS density FROM b GROUP BY 1")
def density_contour(spark, sf_dir):
    """Density of bins one wide from -5 to 65."""
    rows = hourly(spark, sf_dir).filter("p >= -5 and p < 65").groupBy(F.floor(F.col("p") + 5).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return rows.select("bin", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("density"))  # 70 rows


_LEVELS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "quantile_density",
    ", q AS (SELECT day, quantile_cont(p, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM whole GROUP BY 1), s AS (SELECT day, unnest([q[1], q[2], q[3], q[4]]) AS a, unnest([q[2], q[3], q[4], q[5]]) AS b, unnest([0.2, 0.25, 0.25, 0.2]::DOUBLE[]) AS m FROM q) SELECT day, CAST(i AS BIGINT) AS bin, round(sum(m * greatest((least(b, 5 * i + 5) - greatest(a, 5 * i)) / (b - a), 0)), 6) AS mass FROM s, range(30) t(i) WHERE b > 5 * i AND a < 5 * i + 5 GROUP BY 1, 2 HAVING sum(m * greatest((least(b, 5 * i + 5) - greatest(a, 5 * i)) / (b - a), 0)) > 1e-6",
)
def quantile_density(spark, sf_dir):
    """The mass of bins five wide that a day's five quantiles mean."""
    q = curves.complete_days(days(spark, sf_dir), ["day"]).groupBy("day").agg(F.percentile("p", F.array(*[F.lit(x) for x in _LEVELS])).alias("q"))
    out = ranks.density(q, ["day"], "q", _LEVELS, 0.0, 150.0, 5.0).filter("mass > 1e-6")
    return out.select("day", F.col("bin").cast("long").alias("bin"), r("mass").alias("mass"))


@query(
    "day_records",
    ", b AS (SELECT day, hour, p, avg(p) OVER w4 AS b4, count(*) OVER w4 AS n4, avg(p) OVER w2 AS b2, count(*) OVER w2 AS n2 FROM whole WINDOW w4 AS (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), w2 AS (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) SELECT day, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.1), 6) AS p10, round(median(p), 6) AS p50, round(quantile_cont(p, 0.9), 6) AS p90, round(min(b4) FILTER (n4 = 4), 6) AS cheap4, round(max(b4) FILTER (n4 = 4), 6) AS dear4, round(min(b2) FILTER (n2 = 2), 6) AS cheap2, round(max(b2) FILTER (n2 = 2), 6) AS dear2, count(*) FILTER (p < 40) AS cheap_hours, count(*) FILTER (p > 60) AS dear_hours FROM b GROUP BY day",
)
def day_records(spark, sf_dir):
    """One record a whole day: mean, quantiles, cheapest and dearest blocks, cheap and dear hours."""
    whole = curves.complete_days(days(spark, sf_dir), ["day"])
    run = lambda k: Window.partitionBy("day").orderBy("hour").rowsBetween(0, k - 1)
    wide = whole.select("day", "p", *[F.when(F.count("*").over(run(k)) == k, F.avg("p").over(run(k))).alias(f"b{k}") for k in (4, 2)])
    q = F.percentile("p", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = wide.groupBy("day").agg(r(F.avg("p")).alias("mean"), q.alias("q"), *[r(f(f"b{k}")).alias(f"{n}{k}") for k in (4, 2) for n, f in (("cheap", F.min), ("dear", F.max))], F.count_if(F.col("p") < 40).alias("cheap_hours"), F.count_if(F.col("p") > 60).alias("dear_hours"))
    return out.select("day", "mean", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "cheap4", "dear4", "cheap2", "dear2", "cheap_hours", "dear_hours")


_PART = "CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'midday' ELSE 'evening' END"


@query(
    "segment_days",
    f", s AS (SELECT day, {_PART} AS segment, p, hour FROM days) SELECT day, segment, round(avg(p), 6) AS mean, list_transform(list(p ORDER BY p), lambda x: round(x, 6)) AS prices, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.9), 6) AS p90 FROM s GROUP BY 1, 2 HAVING count(*) = 6",
)
def segment_days(spark, sf_dir):
    """A row for each day and segment that has its six hours: mean, sorted prices, quantiles."""
    rows = curves.segments(days(spark, sf_dir))
    out = rows.groupBy("day", "segment").agg(F.count("p").alias("n"), r(F.avg("p")).alias("mean"), F.transform(F.array_sort(F.collect_list("p")), lambda x: r(x)).alias("prices"), F.percentile("p", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).filter("n = 6")
    return out.select("day", "segment", "mean", "prices", r(F.col("q")[0]).alias("p10"), r(F.col("q")[1]).alias("p90"))


@query(
    "segment_merge",
    ", rk AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY p, hour) AS k, avg(p) OVER (PARTITION BY day ORDER BY p, hour ROWS UNBOUNDED PRECEDING) AS cheap FROM whole), rd AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY p DESC, hour) AS k, avg(p) OVER (PARTITION BY day ORDER BY p DESC, hour ROWS UNBOUNDED PRECEDING) AS peak FROM whole) SELECT rk.day, rk.k, round(cheap + 1e-9, 5) AS cheap, round(peak + 1e-9, 5) AS peak FROM rk JOIN rd ON rk.day = rd.day AND rk.k = rd.k WHERE rk.k <= 12",
)
def segment_merge(spark, sf_dir):
    """A whole day's curves from the curves of its four segments: each made monotone, turned back into prices, merged and sorted anew.

    With the true curves of the segments the day's own curves come out, which is what the SQL makes directly.
    """
    part = curves.duration_curves(curves.segments(curves.complete_days(days(spark, sf_dir), ["day"])), ["day", "segment"], 6)
    merged = curves.merged_segments(part, ["day"], "segment")
    return merged.select("day", F.col("k").cast("long").alias("k"), r(F.col("cheap") + 1e-9, 5).alias("cheap"), r(F.col("peak") + 1e-9, 5).alias("peak"))


@query("common_days", "-- common\nWITH d AS (SELECT event_type AS zone, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2) SELECT day FROM d GROUP BY day HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)")
def common_days(spark, sf_dir):
    """Days that all zones have."""
    z = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.to_date("ts").alias("day")).distinct()
    return z.groupBy("day").agg(F.count("*").alias("n")).crossJoin(F.broadcast(z.agg(F.count_distinct("zone").alias("all")))).filter("n = all").select("day")


@query("migration_gate", ", e AS (SELECT z.zone, abs(z.p - a.p) AS old, abs(z.p - b.p) AS new FROM zonal z JOIN zonal a ON a.zone = z.zone AND a.ts = z.ts - INTERVAL 24 HOUR JOIN zonal b ON b.zone = z.zone AND b.ts = z.ts - INTERVAL 168 HOUR), m AS (SELECT zone, avg(new) < avg(old) AS a, sqrt(avg(new * new)) < sqrt(avg(old * old)) AS b, max(new) < max(old) AS c FROM e GROUP BY 1) SELECT count(*) AS zones, CAST(count_if(a AND b AND c) AS BIGINT) AS won, count_if(a AND b AND c) * 2 > count(*) AS passes FROM m")
def migration_gate(spark, sf_dir):
    """In how many zones the week-before forecast beats the day-before one on three figures, and whether in most."""
    from gridloom.operators.align import time_lag

    rows = time_lag(time_lag(zonal(spark, sf_dir), ["zone"], "p", 24, "a"), ["zone"], "p", 168, "b").na.drop()
    old, new = F.abs(F.col("p") - F.col("a")), F.abs(F.col("p") - F.col("b"))
    wins = (F.avg(new) < F.avg(old)) & (F.avg(new * new) < F.avg(old * old)) & (F.max(new) < F.max(old))
    return rows.groupBy("zone").agg(wins.alias("wins")).agg(F.count("*").alias("zones"), F.count_if("wins").alias("won"), (F.count_if("wins") * 2 > F.count("*")).alias("passes"))
