"""Rank tests, regression and correlation as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_p, normal_p, t_p
from ..session import stage
from .ranks import average_ranks, bh_adjust


def _pooled(df: DataFrame, group: str, value: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Ranks of the rows of groups with at least `least` rows, and one row with n, k and the tie term sum(t^3 - t)."""
    x = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    # Read several times below: what led to it isn't computed again.
    x = stage(x, "ranked")
    big = x.groupBy("g").count().where(F.col("count") >= least).select("g")
    x = x.join(big, "g", "left_semi")
    ties = x.groupBy("v").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    return average_ranks(x, "v"), ties


def kruskal_wallis(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """One row (h, k, n, p): H with the tie correction over groups of at least `least` rows; null h for fewer than two groups."""
    ranked, ties = _pooled(df, group, value, least)
    g = ranked.groupBy("g").agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k"), F.sum("m").alias("n"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.when((F.col("k") >= 2) & (F.col("ties") < n * n * n - n), F.try_divide(raw, 1 - F.col("ties") / (n * n * n - n)))
    # Both sides are one row.
    out = s.join(F.broadcast(ties)).select(h.alias("h"), "k", "n")
    return out.withColumn("p", chi2_p("h", (F.col("k") - 1).cast("double")))


def kruskal_effect(df: DataFrame, group: str, value: str, n_all: DataFrame, least: int = 3) -> DataFrame:
    """Adds epsilon_squared = (H - k + 1) / (n - k); n_all is one row (n_all) and may count rows outside the groups."""
    kw = kruskal_wallis(df, group, value, least)
    return kw.join(F.broadcast(n_all)).withColumn("epsilon_squared", F.try_divide(F.col("h") - F.col("k") + 1, F.col("n_all") - F.col("k")))


def dunn(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """(group_a, group_b, z, p, p_adj) for each pair of groups, group_a < group_b; p adjusted by Benjamini-Hochberg."""
    ranked, ties = _pooled(df, group, value, least)
    g = ranked.groupBy("g").agg(F.avg("rank").alias("mean"), F.count("*").alias("m"))
    n = g.agg(F.sum("m").cast("double").alias("n")).join(F.broadcast(ties))
    a = g.select(F.col("g").alias("group_a"), F.col("mean").alias("ma"), F.col("m").alias("na"))
    b = g.select(F.col("g").alias("group_b"), F.col("mean").alias("mb"), F.col("m").alias("nb"))
    # Groups are few: one row each.
    pairs = a.join(F.broadcast(b), F.col("group_a") < F.col("group_b")).join(F.broadcast(n))
    nn = F.col("n")
    var = (nn * (nn + 1) / 12 - F.col("ties") / (12 * (nn - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    z = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.greatest(var, F.lit(0.0))))
    out = pairs.select("group_a", "group_b", z.alias("z")).withColumn("p", normal_p("z"))
    return bh_adjust(out, "p")


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, slope, intercept, r2, se, t, p) of the line y on x; the figures are null for fewer than 4 rows or constant x."""
    a = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count("*").alias("n"), F.covar_pop(y, x).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    ok = (F.col("n") >= 4) & (F.col("vx") > 0)
    slope = F.when(ok, F.try_divide("c", "vx"))
    r2 = F.when(ok & (F.col("vy") > 0), F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")))
    a = a.select("n", slope.alias("slope"), F.when(ok, F.col("my") - slope * F.col("mx")).alias("intercept"), r2.alias("r2"), "vx", "vy", "mx")
    rest = F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("vy") * F.col("n"))
    a = a.withColumn("s", F.when(F.col("n") > 2, F.sqrt(rest / F.greatest(F.col("n") - 2, F.lit(1)))))
    a = a.withColumn("se", F.try_divide(F.col("s"), F.sqrt(F.col("vx") * F.col("n"))))
    return a.withColumn("t", F.try_divide("slope", "se")).withColumn("p", t_p("t", (F.col("n") - 2).cast("double")))


def ols_band(df: DataFrame, x: str, y: str, at: list[float]) -> DataFrame:
    """(x, fit, low, high): the line of ols() with its 95 % band 1.96 s sqrt(1/n + (x - mean)^2 / Sxx) at the given places."""
    line = ols(df, x, y)
    half = 1.96 * F.col("s") * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), 2) / (F.col("vx") * F.col("n")))
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    rows = line.where("slope is not null").withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in at])))
    return rows.select("x", fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho, p): correlation of average ranks over rows where both are there; null where one side is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = stage(d, "ranked")
    r = average_ranks(average_ranks(d, "x", "rx"), "y", "ry")
    sx, sy = F.stddev_pop("rx"), F.stddev_pop("ry")
    out = r.agg(F.count("*").alias("n"), F.when((sx > 0) & (sy > 0), F.try_divide(F.covar_pop("rx", "ry"), sx * sy)).alias("rho"))
    rho, n = F.col("rho"), F.col("n").cast("double")
    t = F.when(n > 2, F.try_divide(rho * F.sqrt(n - 2), F.sqrt(F.greatest(F.lit(0.0), 1 - rho * rho))))
    p = F.when(F.abs(rho) >= 1 - 1e-15, 0.0).otherwise(t_p(t, n - 2))
    return out.withColumn("p", p)


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var1, var2, rho, p) of each pair of columns over rows complete in all of them."""
    whole = df.select(*columns).dropna()
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            one = spearman(whole, a, b).select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), "rho", "p")
            out = one if out is None else out.unionByName(one)
    return out
