"""Abundance tables, diversity of plots, elevation bands and the composite structure index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..session import stage
from .clean import to_number


def abundance(veg: DataFrame) -> DataFrame:
    """(plot_id, species_name, abund): summed abundance, one for each record without a number. Absence is a missing row."""
    a = F.coalesce(to_number(F.col("abundance")), F.lit(1.0))
    return veg.groupBy("plot_id", "species_name").agg(F.sum(a).alias("abund"))


def abundance_pivot(abund: DataFrame, species: list[str]) -> DataFrame:
    """Wide form for named species, zero-filled; only for few columns."""
    return abund.groupBy("plot_id").pivot("species_name", species).agg(F.sum("abund")).na.fill(0.0)


def alpha_diversity(abund: DataFrame) -> DataFrame:
    """(plot_id, richness, shannon, simpson) in one aggregation: with totals T, S = sum a, H = ln T - sum(a ln a)/T,
    D = 1 - sum(a^2)/T^2, which equals the sums over shares. Plots without a positive abundance have 0 in all."""
    a = F.when(F.col("abund") > 0, F.col("abund"))
    g = abund.groupBy("plot_id").agg(F.count(a).alias("richness"), F.sum(a).alias("t"), F.sum(a * F.log(a)).alias("l"), F.sum(a * a).alias("q"))
    t = F.col("t")
    h = F.when(F.col("richness") > 1, F.log(t) - F.col("l") / t).otherwise(0.0)
    d = F.when(F.col("richness") > 1, 1 - F.col("q") / (t * t)).otherwise(0.0)
    return g.select("plot_id", "richness", h.alias("shannon"), d.alias("simpson"))


def stratum_richness(veg: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Distinct species of each plot in each stratum as richness_<stratum>, 0 where none; null strata don't count."""
    cols = [F.count_distinct(F.when(F.col("stratum") == s, F.col("species_name"))).alias(f"richness_{s}") for s in params.strata]
    return veg.where("stratum is not null").groupBy("plot_id").agg(*cols)


def guarded_left_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A left join that may not add rows: raises if a key is on several rows of right."""
    if right.where(F.col(on).isNotNull()).groupBy(on).count().where("count > 1").limit(1).count():
        raise RuntimeError(f"{on} is not unique on the right side: the join would repeat rows")
    return left.join(right, on, "left")


def band(c: Column, params: Params = DEFAULTS) -> Column:
    """Label of the half-open elevation band, null outside all."""
    return reduce(lambda acc, b: acc.when((c >= b[0]) & (c < b[1]), b[2]), params.bands, F.when(F.lit(False), F.lit(None).cast("string")))


def band_summary(df: DataFrame, value: str, params: Params = DEFAULTS) -> DataFrame:
    """n, mean, sd (null for one row) and median of every band, empty bands too."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(i, b[2]) for i, b in enumerate(params.bands)], "band_order int, elevation_band string")
    g = df.where(F.col(value).isNotNull()).groupBy(band(F.col("elevation"), params).alias("elevation_band")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.lit(0.5)).alias("median"))
    return labels.join(g, "elevation_band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column>: (x - mean) / sample deviation; 0 for all rows where the deviation is null or 0. The statistics are one row."""
    # Read twice: for the statistics and for the rows.
    df = stage(df, "scored")
    stats = df.agg(*[f(F.col(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(F.broadcast(stats))

    def z(c: str) -> Column:
        s = F.col(f"_s_{c}")
        return F.when(s.isNull() | (s == 0), 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.nullif(s, F.lit(0.0)))

    return out.withColumns({f"z_{c}": z(c) for c in columns}).drop(*stats.columns)


def sci_index(df: DataFrame, components: list[str], name: str = "sci_index") -> DataFrame:
    """Sum of the components' z scores, nulls skipped."""
    out = z_scores(df, components)
    return out.withColumn(name, reduce(lambda a, b: a + b, [F.coalesce(f"z_{c}", F.lit(0.0)) for c in components]))


def group_summary(df: DataFrame, group: str, value: str, small: int = 30) -> DataFrame:
    """n, mean, sd, standard error, 95 % interval and a small-sample flag of each non-null group."""
    g = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return g.withColumns({"se": se, "ci_low": F.col("mean") - 1.96 * se, "ci_high": F.col("mean") + 1.96 * se, "small_sample": F.col("n") < small})


def rolling_by_rank(df: DataFrame, order: list[str], value: str, window: int = 120, least: int = 30, buckets: int | None = None) -> DataFrame:
    """Centred rolling mean, deviation and count over `window` rows in the given order, null below `least` rows.

    Rows are numbered over a range partitioning (no single-task sort); each block of rows then borrows the rows of its
    neighbours within the window, so the windows run block by block.
    """
    from .ranks import global_row_number

    half = window // 2
    step = max(window * 50, 10_000)
    rows = global_row_number(df, order, "_rn")
    block = F.floor(F.col("_rn") / step)
    lent = F.array_distinct(F.array(F.floor((F.col("_rn") - half) / step), block, F.floor((F.col("_rn") + half) / step)))
    spread = rows.withColumn("_home", block).withColumn("_block", F.explode(lent))
    w = Window.partitionBy("_block").orderBy("_rn").rowsBetween(-half, window - half - 1)
    n = F.count(value).over(w)
    out = spread.withColumns({
        "rolling_n": n, "rolling_mean": F.when(n >= least, F.avg(value).over(w)), "rolling_sd": F.when(n >= least, F.stddev_samp(value).over(w)),
    })
    return out.where("_block = _home").drop("_block", "_home", "_rn")
