"""Indicator values of species for groups, and the shapes their results are reported in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indval(presence: DataFrame, groups: DataFrame) -> DataFrame:
    """(species_name, group, stat) on presence: A = best group's mean over the sum of the groups' means, B = that mean.

    presence: distinct (plot_id, species_name); groups: (plot_id, grp), one row a plot; plots without presence rows count in
    their group's size. The best group is the one with the highest mean, the first in order on ties.
    """
    g = groups.where("grp is not null")
    sizes = g.groupBy("grp").agg(F.count("*").alias("m"))
    means = presence.join(g, "plot_id").groupBy("species_name", "grp").agg(F.count("*").alias("o")).join(F.broadcast(sizes), "grp").select(
        "species_name", "grp", (F.col("o") / F.col("m")).alias("mean"))
    best = means.groupBy("species_name").agg(F.sum("mean").alias("total"), F.min(F.struct((-F.col("mean")).alias("neg"), "grp")).alias("b"))
    mean = -F.col("b.neg")
    return best.select("species_name", F.col("b.grp").alias("group"), (mean / (F.col("total") + 1e-12) * mean).alias("stat"))


def top_per_group(ind: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("group").orderBy(F.desc("stat"), "species_name")
    return ind.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def one_hot(ind: DataFrame, groups: list[str]) -> DataFrame:
    return ind.withColumns({f"s.{g}": (F.col("group") == g).cast("int") for g in groups})


def melt_groups(wide: DataFrame, groups: list[str]) -> DataFrame:
    """Long form of the s.<group> columns, only those that are 1, with the prefix stripped."""
    cols = F.array(*[F.struct(F.lit(f"s.{g}").alias("variable"), F.col(f"`s.{g}`").alias("value")) for g in groups])
    x = wide.select("species_name", "stat", F.explode(cols).alias("r")).where("r.value = 1")
    return x.select("species_name", "stat", F.regexp_replace("r.variable", r"^s\.", "").alias("group"))


def pivot_top(top: DataFrame, groups: list[str]) -> DataFrame:
    return top.groupBy("species_name").pivot("group", groups).agg(F.first("stat")).na.fill(0.0)
