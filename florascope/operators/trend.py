"""Trends of annual series: slopes, rank trend tests and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_p


def _series(ts: DataFrame) -> DataFrame:
    """(pixel, s): each pixel's values in time order. A series holds as many values as there are years."""
    return ts.where("value is not null").groupBy("pixel").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s"))


def _pairs(ts: DataFrame) -> DataFrame:
    """(pixel, dt, dv) of each pair of times of a pixel, made within its own series: no join, no shuffle beyond the grouping."""
    later = lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct((y.t - x.t).alias("dt"), (y.value - x.value).alias("dv"), x.value.alias("v"), y.value.alias("w")))
    return _series(ts).select("pixel", F.explode(F.flatten(F.transform("s", later))).alias("p")).select("pixel", "p.*")


def theil_sen(ts: DataFrame) -> DataFrame:
    """(pixel, slope): median of the slopes of all pairs of times; series of one value have none."""
    return _pairs(ts).where("dt > 0").groupBy("pixel").agg(F.percentile(F.col("dv") / F.col("dt"), F.lit(0.5)).alias("slope"))


def mann_kendall(ts: DataFrame) -> DataFrame:
    """(pixel, n, s, tau): sum of the signs of all later differences, and its share of n (n - 1) / 2."""
    s = _pairs(ts).groupBy("pixel").agg(F.sum(F.signum("dv")).cast("long").alias("s"))
    n = ts.where("value is not null").groupBy("pixel").agg(F.count("*").alias("n"))
    return n.join(s, "pixel", "left").select("pixel", "n", F.coalesce("s", F.lit(0)).alias("s"), F.try_divide(F.coalesce("s", F.lit(0)), F.col("n") * (F.col("n") - 1) / 2).alias("tau"))


def mk_z(tau: Column, n: Column | int = 25) -> Column:
    """Continuity-corrected Z of tau over n values, with the variance without ties."""
    n = F.lit(n) if isinstance(n, int) else n
    s = tau * n * (n - 1) / 2
    sd = F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return F.when(s > 0, (s - 1) / sd).when(s < 0, (s + 1) / sd).when(s == 0, 0.0)


def mk_p(tau: Column, n: Column | int = 25) -> Column:
    return normal_p(mk_z(tau, n))


def mk_variance_with_ties(ts: DataFrame) -> DataFrame:
    """(pixel, var_s): [n (n - 1)(2n + 5) - sum t (t - 1)(2t + 5)] / 18 over groups of t equal values."""
    t = F.col("c")
    g = ts.where("value is not null").groupBy("pixel", "value").agg(F.count("*").alias("c"))
    x = g.groupBy("pixel").agg(F.sum("c").alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("ties"))
    n = F.col("n")
    return x.select("pixel", ((n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0).alias("var_s"))


def tie_flags(ts: DataFrame, atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """(pixel, tied): whether two times of a pixel have the same value within atol + rtol * |later value|."""
    near = F.abs("dv") <= atol + rtol * F.abs("w")
    return _pairs(ts).groupBy("pixel").agg(F.bool_or(near).alias("tied"))


def stack_summary(ts: DataFrame) -> DataFrame:
    """(pixel, mean_value, first_value, last_value) of each series, nulls skipped in the mean."""
    return ts.groupBy("pixel").agg(F.avg("value").alias("mean_value"), F.min_by("value", "t").alias("first_value"), F.max_by("value", "t").alias("last_value"))


def trend_class(slope: Column, p: Column, sig: float = 0.05) -> Column:
    """Greening, Browning, Stable (slope 0 too) or No data."""
    return (
        F.when(slope.isNull() | p.isNull(), "No data").when((p <= sig) & (slope > 0), "Greening").when((p <= sig) & (slope < 0), "Browning").otherwise("Stable")
    )


def pixel_class(slope: Column, p: Column, sig: float = 0.05) -> Column:
    """1, -1 or 0 for the map; a slope of exactly 0 with a small p stays null, as do missing values."""
    return F.when((p <= sig) & (slope > 0), 1).when((p <= sig) & (slope < 0), -1).when(p > sig, 0)


def trend_rasters(slope: DataFrame, tau: DataFrame, p: DataFrame, n: int = 25) -> DataFrame:
    """(row, col, slope, tau, p) of three rasters (row, col, value). Where the whole band of p-values is empty they come from tau over n years."""
    on, real = ["row", "col"], lambda c: F.when(~F.isnan(c), F.col(c))
    x = slope.withColumnRenamed("value", "slope").join(tau.withColumnRenamed("value", "tau"), on, "left").join(p.withColumnRenamed("value", "p"), on, "left")
    x = x.withColumns({c: real(c) for c in ("slope", "tau", "p")})
    if p.where("value is not null and not isnan(value)").limit(1).count():
        return x.select(*on, "slope", "tau", "p")
    return x.select(*on, "slope", "tau", mk_p(F.col("tau"), n).alias("p"))
