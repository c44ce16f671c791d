"""Queries on windows, seasons, fits, scores, risk and online learners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import align, scores, series
from gridloom.plans.base import days, hourly, pairs, query, r, zonal
from gridloom.session import table


@query("rolling_stats", "SELECT zone, ts, round(avg(p) OVER w, 9) AS mean, round(min(p) OVER w, 6) AS low, round(max(p) OVER w, 6) AS high, round(max(p) OVER w - min(p) OVER w, 6) AS span FROM zonal WINDOW w AS (PARTITION BY zone ORDER BY ts ROWS 23 PRECEDING)")
def rolling_stats(spark, sf_dir):
    """Mean, extremes and span of the last 24 rows of each zone."""
    w = series.rolling(["zone"], 23)
    return zonal(spark, sf_dir).select("zone", "ts", r(F.avg("p").over(w), 9).alias("mean"), r(F.min("p").over(w)).alias("low"), r(F.max("p").over(w)).alias("high"), r(F.max("p").over(w) - F.min("p").over(w)).alias("span"))


@query("rolling_week", "SELECT zone, ts, CASE WHEN count(p) OVER w >= 24 THEN round(avg(p) OVER w, 9) END AS mean, round(median(p) OVER w, 9) AS middle FROM zonal WINDOW w AS (PARTITION BY zone ORDER BY ts RANGE BETWEEN INTERVAL 604799 SECOND PRECEDING AND CURRENT ROW)")
def rolling_week(spark, sf_dir):
    """Mean (of 24 rows at least) and median of the last 168 hours, by time."""
    from gridloom.operators import sliding

    rows = zonal(spark, sf_dir)
    means = series.over_hours(rows, ["zone"], 168, lambda w: {"mean": F.when(F.count("p").over(w) >= 24, r(F.avg("p").over(w), 9))})
    return means.join(sliding.by_hours(rows, ["zone"], "p", 168, {"middle": 0.5}), ["zone", "ts"]).select("zone", "ts", "mean", r("middle", 9).alias("middle"))


@query("centred_mean", "SELECT zone, ts, round(avg(p) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean, round(p - lag(p) OVER (PARTITION BY zone ORDER BY ts), 6) + 0.0 AS step FROM zonal")
def centred_mean(spark, sf_dir):
    """Centred means of seven rows, and first differences."""
    return zonal(spark, sf_dir).select("zone", "ts", r(F.avg("p").over(series.rolling(["zone"], 3, 3))).alias("mean"), r(F.col("p") - F.lag("p").over(Window.partitionBy("zone").orderBy("ts"))).alias("step"))


_SEASON = """, a AS (SELECT zone, ts, p, p - avg(p) OVER (PARTITION BY zone, hour(ts)) AS r1 FROM zonal),
b AS (SELECT *, r1 - avg(r1) OVER (PARTITION BY zone, isodow(ts)) AS r2 FROM a),
c AS (SELECT *, r2 - avg(r2) OVER (PARTITION BY zone, weekofyear(ts)) AS r3 FROM b)
"""


@query("seasonal_fit", _SEASON + "SELECT zone, ts, round(p - r1, 6) + 0.0 AS by_hour, round(r1 - r2, 6) + 0.0 AS by_weekday, round(r2 - r3, 6) + 0.0 AS by_week, round(r3, 6) + 0.0 AS residual FROM c")
def seasonal_fit(spark, sf_dir):
    """Hour, weekday and week parts of each price, and what they leave."""
    fit = series.seasonal(zonal(spark, sf_dir), ["zone"], "p")
    return fit.select("zone", "ts", *[r(c).alias(c) for c in ("by_hour", "by_weekday", "by_week", "residual")])


@query("variance_shares", _SEASON + "SELECT zone, round(1 - var_pop(r1) / var_pop(p), 6) AS hour_share, round((var_pop(r1) - var_pop(r2)) / var_pop(p), 6) AS weekday_share, round((var_pop(r2) - var_pop(r3)) / var_pop(p), 6) AS week_share FROM c GROUP BY zone")
def variance_shares(spark, sf_dir):
    """The share of variance that each seasonal part takes."""
    fit = series.seasonal(zonal(spark, sf_dir), ["zone"], "p")
    one = F.col("p") - F.col("by_hour")
    two = one - F.col("by_weekday")
    share = lambda x: r(F.when(F.var_pop("p") > 0, F.try_divide(x, F.var_pop("p"))))
    return fit.groupBy("zone").agg(share(F.var_pop("p") - F.var_pop(one)).alias("hour_share"), share(F.var_pop(one) - F.var_pop(two)).alias("weekday_share"), share(F.var_pop(two) - F.var_pop("residual")).alias("week_share"))


@query("seasonal_smooth", ", h AS (SELECT zone, hour(ts) AS h, avg(p) AS m FROM zonal GROUP BY ALL) SELECT a.zone, CAST(a.h AS BIGINT) AS hour, round(avg(b.m), 6) AS smooth FROM h a JOIN h b ON a.zone = b.zone AND least((a.h - b.h + 24) % 24, (b.h - a.h + 24) % 24) <= 2 GROUP BY ALL")
def seasonal_smooth(spark, sf_dir):
    """Hourly means smoothed on the ring of 24 hours."""
    means = zonal(spark, sf_dir).groupBy("zone", F.hour("ts").alias("hour")).agg(F.avg("p").alias("m"))
    return series.circular_smooth(means, ["zone"], "hour", "m", 24, 5).select("zone", F.col("hour").cast("long").alias("hour"), r("m").alias("smooth"))


@query("acf", """, c AS (SELECT zone, ts, p - avg(p) OVER (PARTITION BY zone) AS c FROM zonal), n AS (SELECT zone, c, row_number() OVER (PARTITION BY zone ORDER BY ts) AS n FROM c),
s AS (SELECT zone, sum(c * c) AS s FROM n GROUP BY zone)
SELECT a.zone, CAST(a.n - b.n AS BIGINT) AS lag, round(sum(a.c * b.c) / min(s.s), 6) + 0.0 AS acf FROM n a JOIN n b ON a.zone = b.zone AND a.n - b.n BETWEEN 1 AND 24 JOIN s ON s.zone = a.zone GROUP BY 1, 2""")
def acf(spark, sf_dir):
    """Autocorrelation at 24 lags of each zone's rows."""
    return series.lagged_moments(zonal(spark, sf_dir), ["zone"], "p", list(range(1, 25))).select("zone", F.col("lag").cast("long").alias("lag"), r("acf").alias("acf"))


@query("hour_of_week_shape", "SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, round(avg(p) / (SELECT avg(p) FROM hourly), 6) AS shape, round(quantile_cont(p, 0.1), 6) AS low FROM hourly GROUP BY 1, 2")
def hour_of_week_shape(spark, sf_dir):
    """Mean, spread, share of the mean and 10 % quantile by hour of the week."""
    h = hourly(spark, sf_dir)
    return h.crossJoin(F.broadcast(h.agg(F.avg("p").alias("all")))).groupBy(F.weekday("ts").cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(r(F.avg("p")).alias("mean"), r(F.stddev_samp("p")).alias("sd"), r(F.avg("p") / F.first("all")).alias("shape"), r(F.percentile("p", F.lit(0.1))).alias("low"))


@query("monthly_factor", "-- months\nWITH m AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS month, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT month, round(m / (SELECT avg(m) FROM m), 6) AS factor FROM m")
def monthly_factor(spark, sf_dir):
    """Each month's mean over the mean of the months."""
    m = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(F.avg("o_totalprice").alias("m"))
    return m.select("month", r(F.col("m") / F.avg("m").over(Window.partitionBy())).alias("factor"))  # twelve rows


@query("episodes", """, f AS (SELECT zone, ts, p > 55 AS hit FROM zonal), g AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ts) - sum(hit::INT) OVER (PARTITION BY zone ORDER BY ts) AS run FROM f)
SELECT zone, min(ts) AS start, count(*) AS hours FROM g WHERE hit GROUP BY zone, run HAVING count(*) >= 2""")
def episodes(spark, sf_dir):
    """Runs of two rows or more above 55."""
    return series.episodes(zonal(spark, sf_dir), ["zone"], F.col("p") > 55, 2)


_HEAD = "count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, round(sqrt(avg((pred - actual) ** 2)), 6) AS rmse, round(avg(actual - pred), 6) + 0.0 AS bias, CASE WHEN var_pop(actual) > 0 THEN round(1 - avg((pred - actual) ** 2) / var_pop(actual), 6) ELSE 0 END AS r2, round(min(actual), 6) AS low, round(max(actual), 6) AS high"


_ROUNDED = ("mae", "rmse", "bias", "r2", "low", "high")


def _headline(rows, *keys):
    out = rows.groupBy(*keys).agg(*scores.headline())
    return out.select(*[c for c in out.columns if c not in _ROUNDED], *[r(c).alias(c) for c in _ROUNDED])


@query("metrics_headline", f"SELECT {_HEAD} FROM pairs")
def metrics_headline(spark, sf_dir):
    """Errors of the day-before forecast."""
    return _headline(pairs(spark, sf_dir))


@query("metrics_by_hour", f"SELECT CAST(hour(ts) AS BIGINT) AS hour, {_HEAD} FROM pairs GROUP BY 1")
def metrics_by_hour(spark, sf_dir):
    """The same by hour."""
    return _headline(pairs(spark, sf_dir), F.hour("ts").cast("long").alias("hour"))


@query("weekly_bias", f"SELECT CAST(isoyear(ts) AS BIGINT) AS year, CAST(weekofyear(ts) AS BIGINT) AS week, {_HEAD} FROM pairs GROUP BY 1, 2")
def weekly_bias(spark, sf_dir):
    """The same by ISO week."""
    return _headline(pairs(spark, sf_dir), F.expr("extract(YEAROFWEEK FROM ts)").cast("long").alias("year"), F.weekofyear("ts").cast("long").alias("week"))


@query("worst_days", "SELECT CAST(ts AS DATE) AS day, round(avg(abs(pred - actual)), 6) AS mae FROM pairs GROUP BY 1 ORDER BY avg(abs(pred - actual)) DESC, 1 LIMIT 10")
def worst_days(spark, sf_dir):
    """The ten days with the largest mean error."""
    by_day = pairs(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("m"))
    return by_day.orderBy(F.desc("m"), "day").limit(10).select("day", r("m").alias("mae"))


@query("spearman", """, d AS (SELECT CAST(ts AS DATE) AS day, actual, pred FROM pairs), k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY actual) + (count(*) OVER (PARTITION BY day, actual) - 1) / 2 AS a,
 rank() OVER (PARTITION BY day ORDER BY pred) + (count(*) OVER (PARTITION BY day, pred) - 1) / 2 AS b FROM d) SELECT day, round(corr(a, b), 6) AS rho FROM k GROUP BY day""")
def spearman(spark, sf_dir):
    """Rank correlation of each day."""
    rows = pairs(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return scores.spearman(rows, ["day"], "actual", "pred").select("day", r("rho").alias("rho"))


@query("peak_capture", "SELECT CAST(count_if(actual >= 60 AND pred >= 42) AS BIGINT) AS hits, CAST(count_if(actual >= 60 AND pred < 42) AS BIGINT) AS missed, CAST(count_if(actual < 60 AND pred >= 42) AS BIGINT) AS false_alarms FROM pairs")
def peak_capture(spark, sf_dir):
    """How many high prices a warning at 70 % of the threshold catches."""
    event, warned = F.col("actual") >= 60, F.col("pred") >= 42
    return pairs(spark, sf_dir).agg(F.count_if(event & warned).alias("hits"), F.count_if(event & ~warned).alias("missed"), F.count_if(~event & warned).alias("false_alarms"))


@query("price_histogram", ", x AS (SELECT CAST(least(greatest(floor(p / 5), 0), 20) AS BIGINT) AS bin FROM hourly) SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY bin")
def price_histogram(spark, sf_dir):
    """Shares of bins 5 wide."""
    bins = hourly(spark, sf_dir).groupBy(F.least(F.greatest(F.floor(F.col("p") / 5), F.lit(0)), F.lit(20)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.select("bin", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # 21 rows


@query("share_by_rank", ", k AS (SELECT CAST(row_number() OVER (PARTITION BY day ORDER BY p, hour) - 1 AS BIGINT) AS place, p FROM whole) SELECT place, count(*) AS n, round(sum(p), 4) AS total FROM k GROUP BY place")
def share_by_rank(spark, sf_dir):
    """Sums by rank within the day."""
    from gridloom.operators import curves

    place = F.row_number().over(Window.partitionBy("day").orderBy("p", "hour")) - 1
    return curves.complete_days(days(spark, sf_dir), ["day"]).select(place.cast("long").alias("place"), "p").groupBy("place").agg(F.count("*").alias("n"), r(F.sum("p"), 4).alias("total"))


@query("regime_split", "SELECT CASE WHEN actual - pred < -20 THEN 'far below' WHEN actual < pred THEN 'below' WHEN actual - pred <= 20 THEN 'above' ELSE 'far above' END AS regime, count(*) AS n, round(avg(actual), 6) AS actual, round(corr(actual, pred), 6) AS correlation FROM pairs GROUP BY 1")
def regime_split(spark, sf_dir):
    """Means and correlation by size of the change."""
    d = F.col("actual") - F.col("pred")
    regime = F.when(d < -20, "far below").when(d < 0, "below").when(d <= 20, "above").otherwise("far above")
    return pairs(spark, sf_dir).groupBy(regime.alias("regime")).agg(F.count("*").alias("n"), r(F.avg("actual")).alias("actual"), r(F.corr("actual", "pred")).alias("correlation"))


@query("ols_simple", "SELECT round(regr_slope(actual, pred), 6) AS slope, round(regr_intercept(actual, pred), 6) AS intercept, round(regr_r2(actual, pred), 6) AS r2 FROM pairs")
def ols_simple(spark, sf_dir):
    """A line through actual against forecast."""
    return pairs(spark, sf_dir).agg(r(F.regr_slope("actual", "pred")).alias("slope"), r(F.regr_intercept("actual", "pred")).alias("intercept"), r(F.regr_r2("actual", "pred")).alias("r2"))


@query("ridge_two_feature", """-- ridge
WITH m AS (SELECT avg(l_quantity) a, avg(l_discount) b, avg(l_extendedprice) y, count(*) n FROM lineitem),
s AS (SELECT sum((l_quantity - a) ** 2) + 10 AS aa, sum((l_quantity - a) * (l_discount - b)) AS ab, sum((l_discount - b) ** 2) + 10 AS bb, sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS byy, min(a) a, min(b) b, min(y) y FROM lineitem, m),
c AS (SELECT (bb * ay - ab * byy) / (aa * bb - ab * ab) AS q, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS d, a, b, y FROM s)
SELECT round(q, 3) AS quantity, round(d, 3) AS discount, round(y - q * a - d * b, 3) AS intercept FROM c""")
def ridge_two_feature(spark, sf_dir):
    """Ridge from one aggregate of products; the driver solves a 3 by 3 system."""
    c = series.ridge(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], 10.0)
    return spark.createDataFrame([(round(c["l_quantity"], 3), round(c["l_discount"], 3), round(c["intercept"], 3))], "quantity double, discount double, intercept double")


_PAST = ", e AS (SELECT a.zone, a.ts, a.p, b.p AS l FROM zonal a JOIN zonal b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 1 HOUR), f AS (SELECT zone, regr_slope(p, l) AS b, regr_intercept(p, l) AS a, regr_syy(p, l) - regr_slope(p, l) * regr_sxy(p, l) AS sse, count(*) AS n FROM e GROUP BY zone) "


@query("ar1_ou", _PAST + "SELECT zone, round(b, 6) AS phi, round(a / (1 - b), 6) AS mu, round(sqrt(sse / n), 6) AS sigma, CASE WHEN b > 0 THEN round(-ln(2.0) / ln(b), 6) END AS half_life FROM f")
def ar1_ou(spark, sf_dir):
    """AR(1) of each zone, and the mean, noise and half-life that it means."""
    rows = align.time_lag(zonal(spark, sf_dir), ["zone"], "p", 1, "l").filter("l is not null")
    fit = rows.groupBy("zone").agg(F.regr_slope("p", "l").alias("b"), F.regr_intercept("p", "l").alias("a"), (F.regr_syy("p", "l") - F.regr_slope("p", "l") * F.regr_sxy("p", "l")).alias("sse"), F.count("*").alias("n"))
    b = F.col("b")
    return fit.select("zone", r("b").alias("phi"), r(F.try_divide(F.col("a"), 1 - b)).alias("mu"), r(F.sqrt(F.col("sse") / F.col("n"))).alias("sigma"), F.when(b > 0, r(-F.ln(F.lit(2.0)) / F.ln(b))).alias("half_life"))


@query("var_cvar", ", v AS (SELECT zone, quantile_cont(p, 0.95) AS v FROM zonal GROUP BY zone) SELECT z.zone, round(min(v), 6) AS value_at_risk, round(avg(p), 6) AS cvar FROM zonal z JOIN v ON z.zone = v.zone WHERE p >= v GROUP BY z.zone")
def var_cvar(spark, sf_dir):
    """The 95 % quantile of each zone and the mean from there on."""
    return scores.value_at_risk(zonal(spark, sf_dir), ["zone"], "p").select("zone", r("value_at_risk").alias("value_at_risk"), r("cvar").alias("cvar"))


@query("hill_index", ", k AS (SELECT zone, abs(p) AS x, row_number() OVER (PARTITION BY zone ORDER BY abs(p) DESC) AS n FROM zonal) SELECT zone, round(avg(ln(x)) FILTER (n <= 30) - max(ln(x)) FILTER (n = 31), 6) AS xi FROM k WHERE n <= 31 GROUP BY zone")
def hill_index(spark, sf_dir):
    """The Hill tail index from 30 values."""
    return scores.hill(zonal(spark, sf_dir), ["zone"], "p", 30).select("zone", r("xi").alias("xi"))


@query("hedge_min_variance", "SELECT round(covar_pop(actual, pred) / var_pop(pred), 6) AS ratio, round(100 * corr(actual, pred) ** 2, 6) AS saved_percent FROM pairs")
def hedge_min_variance(spark, sf_dir):
    """The hedge that leaves the least variance, and what it saves."""
    return pairs(spark, sf_dir).agg(r(F.try_divide(F.covar_pop("actual", "pred"), F.var_pop("pred"))).alias("ratio"), r(100 * F.pow(F.corr("actual", "pred"), 2)).alias("saved_percent"))
