"""Queries on tails and resampled losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import scores, tails
from gridloom.plans.base import hourly, query, r, zonal

#: The density of the standard normal law at its 5 % and 1 % quantiles.
NORMAL_DENSITY = {0.05: 0.10313564037537139, 0.01: 0.026652142203457805}
_TAILS = """, x AS (SELECT zone, p - avg(p) OVER (PARTITION BY zone) AS x FROM zonal), q AS (SELECT zone, quantile_cont(abs(x), 0.95) AS u, count(*) AS n FROM x GROUP BY 1),
y AS (SELECT zone, CAST(sign(x) AS INTEGER) AS side, u, n, abs(x) - u AS y FROM x JOIN q USING (zone) WHERE abs(x) > u),
o AS (SELECT *, row_number() OVER (PARTITION BY zone, side ORDER BY y) AS i, count(*) OVER (PARTITION BY zone, side) AS m FROM y),
w AS (SELECT zone, side, min(u) AS u, min(n) AS n, count(*) AS n_over, avg(y) AS a0, avg(y * (m - i) / (m - 1)) AS a1 FROM o WHERE m >= 30 GROUP BY 1, 2),
fit AS (SELECT zone, side, u, n, n_over, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS scale FROM w WHERE a0 > 2 * a1)
"""


def _fits(spark, sf_dir):
    mean = zonal(spark, sf_dir).groupBy("zone").agg(F.avg("p").alias("m"))
    centred = zonal(spark, sf_dir).join(mean, "zone").select("zone", (F.col("p") - F.col("m")).alias("x"))
    return tails.gpd_fit(tails.exceedances(centred, ["zone"], "x"), ["zone"])


@query("gpd_tails", _TAILS + "SELECT zone, side, round(u, 6) AS u, n_over, round(xi, 6) + 0.0 AS xi, round(scale, 6) AS scale FROM fit")
def gpd_tails(spark, sf_dir):
    """Generalised Pareto fits of both tails of each zone."""
    return _fits(spark, sf_dir).select("zone", "side", r("u").alias("u"), "n_over", r("xi").alias("xi"), r("scale").alias("scale"))


@query("gpd_cvar", _TAILS + """, a AS (SELECT unnest([0.01, 0.001]::DOUBLE[]) AS alpha), v AS (SELECT *, u + scale * CASE WHEN abs(xi) < 1e-9 THEN ln(n_over / n / alpha) ELSE (pow(n_over / n / alpha, xi) - 1) / xi END AS var FROM fit, a)
SELECT zone, side, alpha, round(var, 6) AS value_at_risk, CASE WHEN alpha < n_over / n THEN CASE WHEN xi < 1 THEN round((var + scale - xi * u) / (1 - xi), 6) ELSE 'inf'::DOUBLE END END AS cvar FROM v""")
def gpd_cvar(spark, sf_dir):
    """Quantile and mean beyond it that the fits mean, at 1 % and 0.1 %."""
    levels = _fits(spark, sf_dir).withColumn("alpha", F.explode(F.array(F.lit(0.01), F.lit(0.001))))
    return levels.select("zone", "side", "alpha", r(tails.gpd_var(F.col("alpha"))).alias("value_at_risk"), r(tails.gpd_cvar(F.col("alpha"))).alias("cvar"))


@query("normal_cvar", f"SELECT zone, round(-avg(p) + stddev_pop(p) * {NORMAL_DENSITY[0.05]} / 0.05, 6) + 0.0 AS cvar5, round(-avg(p) + stddev_pop(p) * {NORMAL_DENSITY[0.01]} / 0.01, 6) + 0.0 AS cvar1 FROM zonal GROUP BY 1")
def normal_cvar(spark, sf_dir):
    """The mean loss beyond 5 % and 1 % if prices were normal."""
    cvar = lambda a: r(-F.avg("p") + F.stddev_pop("p") * NORMAL_DENSITY[a] / a)
    return zonal(spark, sf_dir).groupBy("zone").agg(cvar(0.05).alias("cvar5"), cvar(0.01).alias("cvar1"))


_LOAD = "(0.6 + 0.05 * (hour(ts) % 12))"


@query("weekly_bootstrap", f""", d AS (SELECT CAST(ts AS DATE) AS day, sum(p * {_LOAD}) AS cost, sum({_LOAD}) AS kwh FROM hourly GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY day) - 1 AS k, cost, kwh, count(*) OVER () AS n FROM d),
s AS (SELECT path, draw, ('0x' || substr(md5('7-' || path || '-' || draw), 1, 7))::BIGINT AS h FROM range(2000) a(path), range(7) b(draw)),
t AS (SELECT path, sum(cost) AS total, sum(cost) / sum(kwh) AS ratio FROM s JOIN k ON k.k = h % k.n WHERE n >= 7 GROUP BY 1), q AS (SELECT quantile_cont(ratio, 0.95) AS q FROM t)
SELECT round(avg(ratio), 6) AS mean, round(avg(total), 5) AS weekly, round(min(q), 6) AS value_at_risk, round(avg(ratio) FILTER (ratio >= q), 6) AS cvar FROM t, q""")
def weekly_bootstrap(spark, sf_dir):
    """Cost per kWh of a load over weeks of days drawn with replacement: mean, 95 % quantile and the mean from there on."""
    load = 0.6 + 0.05 * (F.hour("ts") % 12)
    daily = hourly(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("p") * load).alias("cost"), F.sum(load).alias("kwh"))
    weeks = tails.resampled_ratios(daily, "day", "cost", "kwh").withColumn("all", F.lit(1))
    risk = scores.value_at_risk(weeks, ["all"], "ratio")
    mean = weeks.groupBy("all").agg(F.avg("ratio").alias("mean"), F.avg("total").alias("weekly"))
    return mean.join(risk, "all").select(r("mean").alias("mean"), r("weekly", 5).alias("weekly"), r("value_at_risk").alias("value_at_risk"), r("cvar").alias("cvar"))
