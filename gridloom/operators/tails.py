"""Tails of losses: generalised Pareto fits over a threshold, what they mean for a CVaR, and resampled weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name
from gridloom.session import settled

#: Fewest values over the threshold for a fit.
LEAST_EXCEEDANCES = 30


def exceedances(values: DataFrame, keys: list[str], value: str, quantile: float = 0.95, accuracy: int | None = None) -> DataFrame:
    """keys, side (-1, 1), u, n (rows of the key), y: how far each value lies beyond u on its side.

    u is a quantile of the absolute values of the key, exact (which holds a key's distinct values in memory) or, with accuracy, by Spark's sketch: a
    value whose rank is within 1 / accuracy of the wanted one. Null values take no part.
    """
    (x,) = fresh_name(values, "x")
    known = values.select(*keys, F.col(value).alias(x)).filter(F.col(x).isNotNull())
    level = F.percentile(F.abs(x), quantile) if accuracy is None else F.percentile_approx(F.abs(x), quantile, accuracy)
    u = known.groupBy(*keys).agg(level.alias("u"), F.count("*").alias("n"))
    # a row a key goes back to the values
    return known.join(u, keys).filter(F.abs(x) > F.col("u")).select(*keys, F.signum(x).cast("int").alias("side"), "u", "n", (F.abs(x) - F.col("u")).alias("y"))


def gpd_fit(over: DataFrame, keys: list[str], least: int = LEAST_EXCEEDANCES) -> DataFrame:
    """keys, side, u, n, n_over, xi, scale of a generalised Pareto law, by probability-weighted moments.

    With a0 the mean of y and a1 the mean of y weighted by the share of larger ones, xi = 2 - a0 / (a0 - 2 a1) and
    scale = 2 a0 a1 / (a0 - 2 a1). A side with fewer than ``least`` values, or with all of them equal to 0, has no row.
    """
    by = Window.partitionBy(*keys, "side")
    ranked = over.select(*keys, "side", "u", "n", "y").withColumn("_i", F.row_number().over(by.orderBy("y"))).withColumn("_m", F.count("*").over(by))
    share = (F.col("_m") - F.col("_i")) / (F.col("_m") - 1)
    sums = ranked.filter(F.col("_m") >= max(least, 2)).groupBy(*keys, "side").agg(
        F.first("u").alias("u"), F.first("n").alias("n"), F.count("*").alias("n_over"), F.avg("y").alias("_a0"), F.avg(F.col("y") * share).alias("_a1")
    )
    spread = F.col("_a0") - 2 * F.col("_a1")
    return sums.filter(spread > 0).select(*keys, "side", "u", "n", "n_over", (2 - F.col("_a0") / spread).alias("xi"), (2 * F.col("_a0") * F.col("_a1") / spread).alias("scale"))


def gpd_likelihood(over: DataFrame, keys: list[str], least: int = LEAST_EXCEEDANCES, rounds: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """keys, side, u, n, n_over, xi, scale of the generalised Pareto law of greatest likelihood, for all keys at once.

    With t = xi / scale the best xi is the mean of ln(1 + t y), so one number a key is left to find. A round is one aggregate by key of what
    the likelihood's slope and bend at t need; a Newton step, kept between the bounds that slopes have shown so far, gives the next t. Keys
    whose t has settled leave the rows. Each round's t is a checkpointed row a key. Sides with fewer than ``least`` values, or with all
    of them equal to 0, have no row.
    """
    by = [*keys, "side"]
    rows = settled(over.select(*by, "u", "n", "y"))
    start = rows.groupBy(*by).agg(F.first("u").alias("u"), F.first("n").alias("n"), F.count("*").alias("n_over"), F.avg("y").alias("mean"), F.max("y").alias("most")).filter((F.col("n_over") >= least) & (F.col("mean") > 0))
    lowest, tiny = -(1 - 1e-7) / F.col("most"), 1e-7 / F.col("mean")
    start = start.withColumns({"low": lowest, "high": 1e4 / F.col("mean"), "t": 0.1 / F.col("mean"), "open": F.lit(True)})
    now = settled(start)
    for _ in range(rounds):
        z = 1 + F.col("t") * F.col("y")
        active = now.filter("open").select(*by, "t")
        sums = rows.join(active, by).groupBy(*by).agg(F.avg(F.ln(z)).alias("a"), F.avg(F.col("y") / z).alias("b"), F.avg(F.pow(F.col("y") / z, 2)).alias("c"))
        slope = 1 / F.col("t") - F.col("b") / F.col("a") - F.col("b")
        bend = -1 / (F.col("t") * F.col("t")) + F.col("c") / F.col("a") + F.pow(F.col("b") / F.col("a"), 2) + F.col("c")
        told = now.join(sums, by, "left").withColumns({"slope": slope, "bend": bend})
        told = told.withColumns({"low": F.when(F.col("open") & (F.col("slope") > 0), F.col("t")).otherwise(F.col("low")), "high": F.when(F.col("open") & (F.col("slope") <= 0), F.col("t")).otherwise(F.col("high"))})
        newton = F.col("t") - F.col("slope") / F.col("bend")
        # far apart, bounds are halved in what 1 + t * most grows by
        grown = lambda c: 1 + F.col(c) * F.col("most")
        middle = (F.sqrt(grown("low") * grown("high")) - 1) / F.col("most")
        inside = (F.col("bend") < 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(inside, newton).otherwise(middle)
        step = F.when(F.abs(step) < tiny, F.when(step < 0, -tiny).otherwise(tiny)).otherwise(step)
        still = F.abs(step - F.col("t")) > tolerance * (F.abs(F.col("t")) + 1 / F.col("mean"))
        told = told.select(*by, "u", "n", "n_over", "mean", "most", "low", "high", F.when(F.col("open"), step).otherwise(F.col("t")).alias("t"), (F.col("open") & still).alias("open"))
        now = settled(told)
        if not now.filter("open").limit(1).count():
            break
    last = rows.join(now.select(*by, "t"), by).groupBy(*by).agg(F.avg(F.ln(1 + F.col("t") * F.col("y"))).alias("xi"))
    return now.join(last, by).select(*by, "u", "n", "n_over", "xi", (F.col("xi") / F.col("t")).alias("scale"))


def gpd_var(alpha: float | Column) -> Column:
    """The value that a share alpha lies beyond, from columns u, n, n_over, xi, scale; where xi is near 0, its limit."""
    odds = F.col("n_over") / F.col("n") / alpha
    return F.col("u") + F.col("scale") * F.when(F.abs("xi") < 1e-9, F.ln(odds)).otherwise((F.pow(odds, F.col("xi")) - 1) / F.col("xi"))


def gpd_cvar(alpha: float | Column) -> Column:
    """The mean beyond ``gpd_var``; infinite where xi is 1 or more, null where alpha isn't under the tail's share."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    mean = (gpd_var(alpha) + F.col("scale") - F.col("xi") * F.col("u")) / (1 - F.col("xi"))
    return F.when((alpha > 0) & (alpha < F.col("n_over") / F.col("n")), F.when(F.col("xi") < 1, mean).otherwise(F.lit(float("inf"))))


def resampled_ratios(daily: DataFrame, day: str, above: str, below: str, days: int = 7, paths: int = 2000, seed: int = 7) -> DataFrame:
    """path, total, ratio: sums of ``above`` over ``days`` days drawn with replacement, and their ratio to those of ``below``.

    daily: a row a day. Draws are hashes of seed, path and draw. With fewer than ``days`` days there is no row; where the lower sum is 0
    the ratio is null.
    """
    k, n, draw = fresh_name(daily, "place", "days", "draw")
    held = daily.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(above).alias("a"), F.col(below).alias("b")))).alias("all"))  # a row a day
    numbered = held.select(F.posexplode("all").alias(k, "x")).select(k, "x.a", "x.b")
    count = daily.agg(F.count("*").alias(n)).filter(F.col(n) >= days)
    draws = daily.sparkSession.range(paths).withColumnRenamed("id", "path").withColumn(draw, F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    name = F.md5(F.concat_ws("-", F.lit(seed), "path", draw).cast("binary"))
    picked = draws.join(F.broadcast(count)).withColumn(k, F.conv(F.substring(name, 1, 7), 16, 10).cast("long") % F.col(n))  # one row is broadcast
    return picked.join(numbered, k).groupBy("path").agg(F.sum("a").alias("total"), F.try_divide(F.sum("a"), F.sum("b")).alias("ratio"))


def jump_moments(changes: DataFrame, keys: list[str], change: str, quantile: float = 0.95, least: int = LEAST_EXCEEDANCES) -> DataFrame:
    """keys, u, body_sd, jump_rate, up_share, and up_mean, up_sd, down_mean, down_sd: changes up to a quantile u of their size are a body,
    others are jumps, whose sizes have a log-normal law for each side (mean and spread of their logarithms).

    A side with fewer than ``least`` jumps has nulls. Null changes take no part; without a jump up_share is 0.
    """
    known = changes.filter(F.col(change).isNotNull())
    joined = known.join(known.groupBy(*keys).agg(F.percentile(F.abs(change), quantile).alias("u")), keys)  # a row a key
    jump, size = F.abs(change) > F.col("u"), F.abs(change)
    sides = {"up": jump & (F.col(change) > 0), "down": jump & (F.col(change) < 0)}
    law = [F.when(F.count_if(on) >= least, how(F.when(on, F.ln(size)))).alias(f"{side}_{name}") for side, on in sides.items() for name, how in (("mean", F.avg), ("sd", F.stddev_pop))]
    share = F.coalesce(F.avg(F.when(jump, (F.col(change) > 0).cast("double"))), F.lit(0.0))
    return joined.groupBy(*keys).agg(F.first("u").alias("u"), F.stddev_pop(F.when(~jump, F.col(change))).alias("body_sd"), F.avg(jump.cast("double")).alias("jump_rate"), share.alias("up_share"), *law)


def mean_excess(values: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """keys, k, u, excess, n: over each quantile u of the levels, how many values lie above it and how far on average."""
    known = values.filter(F.col(value).isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(x) for x in levels])).alias("cuts"))
    above = known.join(cuts, keys).select(*keys, F.col(value).alias("x"), F.posexplode("cuts").alias("k", "u")).filter(F.col("x") > F.col("u"))
    return above.groupBy(*keys, "k").agg(F.first("u").alias("u"), F.avg(F.col("x") - F.col("u")).alias("excess"), F.count("*").alias("n"))


def jump_path(seeds: DataFrame, seed: str, body_sd: Column, rate: Column, up_share: Column, up: tuple[Column, Column], down: tuple[Column, Column]) -> DataFrame:
    """seeds with ``change``: a normal body, and by chance a log-normal jump on top, up or down; drawn from hashes of the seed column.

    up, down: mean and spread of a side's logarithms; a side where these are null doesn't jump.
    """
    u = lambda n: uniform(F.col(seed), n)
    size = lambda law: F.coalesce(F.exp(law[0] + law[1] * normal_quantile(u(1))), F.lit(0.0))
    jump = F.when(u(0) < rate, F.when(u(2) < up_share, size(up)).otherwise(-size(down))).otherwise(0.0)
    return seeds.withColumn("change", body_sd * normal_quantile(u(3)) + jump)


def uniform(seed: Column, number: int) -> Column:
    """A number in (0, 1) from a hash of a seed and a number: the same in every run and on every partition."""
    return (F.conv(F.substring(F.md5(F.concat_ws("-", seed, F.lit(number)).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4_294_967_296.0


# Acklam's rational approximation of the normal quantile, numerators and denominators, highest power first.
MIDDLE = ([-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239], [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0])
OUTER = ([-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0])


# A polynomial for the normal law's upper share, right to 7.5e-8 (Abramowitz and Stegun 26.2.17), lowest power first.
SHARE_SCALE, SHARE = 0.2316419, [0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_share_sql(z: str) -> str:
    """The share of the standard normal law up to z, as SQL that Spark and DuckDB read alike."""
    t = f"(1e0 / (1e0 + {SHARE_SCALE}e0 * abs({z})))"
    poly = "0e0"
    for c in reversed(SHARE):
        poly = f"(({poly} + {c}e0) * {t})"
    upper = f"({poly} * exp(-0.5e0 * ({z}) * ({z})) / sqrt(2e0 * pi()))"
    return f"(CASE WHEN ({z}) < 0 THEN {upper} ELSE 1e0 - {upper} END)"


def normal_quantile_sql(u: str) -> str:
    """The normal quantile of an expression as SQL, right to about 1e-9 of its size; Spark and DuckDB read the same text."""
    poly = lambda c, x: "0e0" if not c else f"({poly(c[:-1], x)} * {x} + {c[-1]!r}e0)"
    middle = f"(({u}) - 0.5e0)"
    square = f"({middle} * {middle})"
    low, high = f"sqrt(-2e0 * ln({u}))", f"sqrt(-2e0 * ln(1e0 - ({u})))"
    ratio = lambda pair, x: f"({poly(pair[0], x)} / {poly(pair[1], x)})"
    return f"(CASE WHEN ({u}) < 0.02425e0 THEN {ratio(OUTER, low)} WHEN ({u}) > 0.97575e0 THEN -{ratio(OUTER, high)} ELSE {middle} * {ratio(MIDDLE, square)} END)"


def normal_quantile(u: Column) -> Column:
    """The same as a column."""
    poly = lambda c, x: F.lit(c[0]) if len(c) == 1 else poly(c[:-1], x) * x + c[-1]
    ratio = lambda pair, x: poly(pair[0], x) / poly(pair[1], x)
    middle, low, high = u - 0.5, F.sqrt(-2 * F.ln(u)), F.sqrt(-2 * F.ln(1 - u))
    return F.when(u < 0.02425, ratio(OUTER, low)).when(u > 0.97575, -ratio(OUTER, high)).otherwise(middle * ratio(MIDDLE, middle * middle))
