"""Rasters as rows (row, col, value): sampling, terrain, areas, classes and spatial autocorrelation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_p


@dataclass(frozen=True)
class Affine:
    """North-up grid: upper-left corner and cell sizes."""

    x0: float
    y0: float
    xres: float
    yres: float

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.yres)

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / self.xres)


def sample(points: DataFrame, grid: DataFrame, affine: Affine, lon: str, lat: str, name: str, nodata: float | None = None) -> DataFrame:
    """points with the value of the cell each lies in as name; null outside the grid, for nodata, not-a-number and infinite values."""
    v = F.col("value")
    clean = F.when(~F.isnan(v) & (F.abs(v) != float("inf")) & (v != nodata if nodata is not None else F.lit(True)), v)
    cells = grid.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), clean.alias(name))
    at = points.withColumns({"_r": affine.row(F.col(lat)), "_c": affine.col(F.col(lon))})
    return at.join(cells, ["_r", "_c"], "left").drop("_r", "_c")


def neighbourhood(grid: DataFrame) -> DataFrame:
    """(row, col, w) with w the 3 x 3 values by (dr + 1) * 3 + dc + 1; only cells whose nine values are all there.

    Each cell sends its value to its nine neighbours and one grouping collects them: a shuffle, no joins.
    """
    to = F.array(*[F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit((dr + 1) * 3 + dc + 1).alias("k"), "value") for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    sent = grid.where("value is not null").select(F.explode(to).alias("s")).select("s.*")
    g = sent.groupBy("row", "col").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("w")).where(F.size("w") == 9)
    return g.select("row", "col", F.col("w.value").alias("w"))


def horn(grid: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """(row, col, slope, aspect) in degrees by Horn's weights; aspect is the angle of (dz/dy, -dz/dx) in 0..360."""
    w = [F.col("w")[k] for k in range(9)]
    dx = ((w[2] + 2 * w[5] + w[8]) - (w[0] + 2 * w[3] + w[6])) / (8 * cell_x)
    dy = ((w[6] + 2 * w[7] + w[8]) - (w[0] + 2 * w[1] + w[2])) / (8 * cell_y)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    aspect = F.pmod(F.degrees(F.atan2(dy, -dx)) + 360, F.lit(360.0))
    return neighbourhood(grid).select("row", "col", slope.alias("slope"), aspect.alias("aspect"))


def subsample(grid: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column: a systematic sample, renumbered."""
    return grid.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).withColumns({"row": F.col("row") / step, "col": F.col("col") / step}).withColumns(
        {"row": F.col("row").cast("long"), "col": F.col("col").cast("long")})


def morans_i(grid: DataFrame) -> DataFrame:
    """One row (n, i, z, p): rook neighbours, lag averaged over those there (0 where none is), W taken as 4 n, two-sided normal p.

    All null below 10 cells. Each cell sends its value to its four neighbours; one grouping and one aggregation follow.
    """
    x = grid.where("value is not null and not isnan(value)").select("row", "col", "value")
    none = F.lit(None).cast("double")
    sides = ((0, 1), (1, 0), (0, -1), (-1, 0))
    to = F.array(
        *[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col"), none.alias("own"), F.col("value").alias("near")) for a, b in sides],
        F.struct("row", "col", F.col("value").alias("own"), none.alias("near")),
    )
    g = x.select(F.explode(to).alias("s")).select("s.*").groupBy("row", "col").agg(
        F.max("own").alias("y"), F.sum("near").alias("near"), F.count("near").alias("k")).where("y is not null")
    k = F.greatest(F.col("k"), F.lit(1)).cast("double")
    g = g.select("y", (F.coalesce("near", F.lit(0.0)) / k).alias("lag"), k.alias("k"))
    s = g.agg(F.count("*").cast("double").alias("n"), F.covar_pop("y", "lag").alias("c"), F.var_pop("y").alias("v"), F.sum(F.col("k") * F.col("k")).alias("w2"))
    n = F.col("n")
    w, n1 = 4 * n, F.nullif(n - 1, F.lit(0.0))
    i = F.when(n >= 10, F.col("c") * n / (F.col("v") * n + 1e-12) * n / w)
    variance = F.greatest(F.lit(1e-12), (n * n * w - n * F.col("w2") + 3 * w * w - n * w) / (w * w * (n * n - 1) + 1e-12))
    s = s.where("n > 0").select(n.cast("long").alias("n"), i.alias("i"), F.when(n >= 10, (i + 1 / n1) / F.sqrt(variance)).alias("z"))
    return s.withColumn("p", normal_p("z"))


def class_counts(classes: DataFrame, column: str) -> DataFrame:
    """(class, n, pct) of the non-null classes; the total comes from the same grouping."""
    g = classes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_t"))
    return g.join(F.broadcast(total)).select("class", "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def pixel_area_km2(lat: Column, xres: float, yres: float) -> Column:
    """Area of a cell of xres by yres degrees at a latitude."""
    return F.lit(111_320.0 * xres) * F.cos(F.radians(lat)) * F.lit(111_320.0 * yres) / 1e6


def area_statistics(pixels: DataFrame, slope: str, p: str, area_km2: float, sig: float = 0.05) -> DataFrame:
    """(category, n, km2, pct): greening, browning, stable (a slope of 0 counts here) and total, in one aggregation."""
    v = pixels.where(F.col(slope).isNotNull() & F.col(p).isNotNull())
    s = F.col(p) <= sig
    a = v.agg(F.count_if(s & (F.col(slope) > 0)).alias("Greening"), F.count_if(s & (F.col(slope) < 0)).alias("Browning"), F.count("*").alias("Total"))
    a = a.withColumn("Stable", F.col("Total") - F.col("Greening") - F.col("Browning"))
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in ("Greening", "Browning", "Stable", "Total")])
    return a.select("Total", F.explode(rows).alias("r")).select(
        "r.category", "r.n", (F.col("r.n") * area_km2).alias("km2"), F.try_divide(F.col("r.n") * 100.0, F.nullif(F.col("Total"), F.lit(0))).alias("pct"))


def quantile_limits(df: DataFrame, value: str, diverging: bool = False) -> DataFrame:
    """One row (low, high): 2 % and 98 % quantiles, symmetric about 0 for diverging scales."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    if not diverging:
        return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    m = F.greatest(F.abs(F.col("q")[0]), F.abs(F.col("q")[1]))
    return q.select((-m).alias("low"), m.alias("high"))


def union_steps(grid: DataFrame, steps: tuple[int, ...] = (10, 20, 30), res: float = 0.0025) -> DataFrame:
    """Moran's I on grids thinned to every step-th cell: (step, km, n, i, z, p)."""
    parts = [morans_i(subsample(grid, s)).withColumns({"step": F.lit(s), "km": F.lit(s * res * 111)}) for s in steps]
    return reduce(lambda a, b: a.unionByName(b), parts)
