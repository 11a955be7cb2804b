"""Ranks and adjusted p-values over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, stage


def global_row_number(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Numbers rows from 0 in a total order: range partitions are numbered inside, each begins after the rows before it."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = shuffle_partitions(df.sparkSession)
    parts = stage(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_id", 33)
    sizes = sorted((r.p, r.n) for r in parts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_id")
    starts, total = [], 0
    for p, k in sizes:
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += k
    return parts.withColumn(name, F.element_at(F.create_map(*starts), part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def average_ranks(df: DataFrame, value: str, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties averaged; null values get none. With `by`, within each group.

    Equal values are counted first, so what is ranked is the distinct values; without `by` they are summed over a range
    partitioning, not in one task.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.select(*by, value, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2).alias(name))
        return df.join(ranked, [*by, value], "left")
    return df.join(count_ranks(counts, value, "_n", name).select(value, name), value, "left")


def count_ranks(counts: DataFrame, value: str, count: str, name: str = "rank") -> DataFrame:
    """counts (value, count, ...) of distinct values with the average rank of each."""
    n = shuffle_partitions(counts.sparkSession)
    parts = stage(counts.repartitionByRange(n, value).sortWithinPartitions(value).withColumn("_p", F.spark_partition_id()), "ranks")
    sizes = sorted((r["_p"], r.n) for r in parts.groupBy("_p").agg(F.sum(count).alias("n")).collect())
    if not sizes:
        return counts.withColumn(name, F.lit(None).cast("double"))
    starts, total = [], 0
    for p, k in sizes:
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += k
    w = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(count).over(w), F.lit(0)) + F.element_at(F.create_map(*starts), F.col("_p"))
    return parts.withColumn(name, before + (F.col(count) + 1) / 2).drop("_p")


def bh_adjust(df: DataFrame, p: str, name: str = "p_adj", tests: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over the whole table; null p-values stay null and don't count.

    tests: number of tests made, if those with p = 1 aren't all in the table.
    """
    return df.join(bh_table(df, p, name, tests), p, "left")


def bh_table(df: DataFrame, p: str, name: str = "p_adj", tests: int | None = None) -> DataFrame:
    """(p, name): each distinct p-value of the table with its adjusted one.

    p * n / rank is made monotone from the right: within range partitions by a window, across them by the smallest value of each
    later partition (one number a partition on the driver).
    """
    n = shuffle_partitions(df.sparkSession)
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_k"))
    parts = stage(counts.repartitionByRange(n, "_p").withColumn("_part", F.spark_partition_id()), "bh")
    sizes = sorted((r["_part"], r.n) for r in parts.groupBy("_part").agg(F.sum("_k").alias("n")).collect())
    if not sizes:
        return counts.select(F.col("_p").alias(p), F.lit(None).cast("double").alias(name))
    total = tests or sum(k for _, k in sizes)
    starts, at = [], 0
    for q, k in sizes:
        starts += [F.lit(q), F.lit(at).cast("long")]
        at += k
    up = Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    # The rank of equal p-values is that of the last of them.
    rank = F.sum("_k").over(up) + F.element_at(F.create_map(*starts), F.col("_part"))
    raw = stage(parts.withColumn("_raw", F.col("_p") * total / rank), "raw")
    lows = sorted((r["_part"], r.low) for r in raw.groupBy("_part").agg(F.min("_raw").alias("low")).collect())
    later, best = {}, 1.0
    for q, low in reversed(lows):
        later[q] = best
        best = min(best, low)
    table = F.create_map(*[x for q, v in later.items() for x in (F.lit(q), F.lit(float(v)))])
    down = Window.partitionBy("_part").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    adj = F.least(F.min("_raw").over(down), F.element_at(table, F.col("_part")), F.lit(1.0))
    return raw.select(F.col("_p").alias(p), adj.alias(name))
