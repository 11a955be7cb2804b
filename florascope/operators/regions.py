"""The nearest region of each point, and coordinates in other reference systems."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from .nearby import containing_regions, rings_of


def region_edges(regions: DataFrame, key: str, wkt: str) -> DataFrame:
    """(region, x1, y1, x2, y2): every edge of every region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, w in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                for r in rings_of(w):
                    e = np.hstack([r[:-1], r[1:]])
                    yield pd.DataFrame(e, columns=["x1", "y1", "x2", "y2"]).assign(region=k)[["region", "x1", "y1", "x2", "y2"]]

    return regions.select(F.col(key).cast("string"), F.col(wkt)).dropna().mapInPandas(run, "region string, x1 double, y1 double, x2 double, y2 double")


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.sqrt(F.pow(x - (x1 + t * dx), 2) + F.pow(y - (y1 + t * dy), 2))


def nearest_regions(points: DataFrame, point_key: str, lon: str, lat: str, regions: DataFrame, key: str, wkt: str, region_col: str = "region", step: float = 0.05) -> DataFrame:
    """(point_key, region_col, dist): the region that holds each point (dist 0) or else the one with the nearest border, in degrees.

    Ties go to the lowest key. Points outside all regions look for edges in growing squares of grid cells around them: an
    equi-join on cells of side step * 2^k for k = 0, 1, ..., each round only for points that found nothing nearer than the
    square's rim. Null coordinates give no row; point_key has to be unique.
    """
    held = containing_regions(points.select(point_key, lon, lat), lon, lat, regions, key, wkt, region_col).groupBy(point_key).agg(F.min(region_col).alias(region_col))
    held = stage(held.withColumn("dist", F.lit(0.0)), "held")
    edges = stage(region_edges(regions, key, wkt), "edges")
    n_edges = edges.count()
    left = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)).select(point_key, lon, lat)
    left = stage(left.join(held.select(point_key), point_key, "left_anti"), "left")
    out = held
    x, y = F.col(lon), F.col(lat)
    size = step
    while n_edges and left.limit(1).count():
        cell = lambda c, s=size: F.floor(c / s)
        span = lambda a, b: F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b)))
        placed = edges.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
        near = F.explode(F.array(*[F.struct((cell(x) + i).alias("cx"), (cell(y) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        probe = left.withColumn("c", near).select(point_key, lon, lat, "c.cx", "c.cy")
        # An edge lies in a few cells; the bound is on the edges themselves.
        met = probe.join(broadcast_if_small(placed, n_edges * 4, 72), ["cx", "cy"])
        d = segment_distance(x, y, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        best = met.groupBy(point_key).agg(F.min(F.struct(F.round(d, 9).alias("k"), "region", d.alias("d"))).alias("b"))
        # Only what lies within one cell of the point is surely complete.
        found = stage(best.where((F.col("b.d") <= size) | F.lit(size >= 720)).select(point_key, F.col("b.region").alias(region_col), F.col("b.d").alias("dist")), "near")
        out = out.unionByName(found)
        left = stage(left.join(found.select(point_key), point_key, "left_anti"), "left")
        if size >= 720:
            break
        size *= 4
    return out


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (WGS 84, northern half) by the usual series; exact to millimetres within a zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(6 * zone - 183)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, aa = F.pow(F.tan(phi), 2), ep * F.pow(F.cos(phi), 2), lam * F.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (aa + (1 - t + c) * F.pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(aa, 5) / 120) + 500000
    north = k0 * (m + n * F.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(aa, 6) / 720))
    return east, north


def reproject(points: DataFrame, lon: str, lat: str, epsg: int) -> DataFrame:
    """Adds x and y in the given system: EPSG:4326 as it is, EPSG:32601..32660 as UTM; others raise."""
    if epsg == 4326:
        return points.withColumns({"x": F.col(lon), "y": F.col(lat)})
    if 32601 <= epsg <= 32660:
        east, north = utm(F.col(lon), F.col(lat), epsg - 32600)
        return points.withColumns({"x": east, "y": north})
    raise ValueError(f"EPSG:{epsg} isn't supported")


def reproject_regions(regions: DataFrame, wkt: str, epsg: int) -> DataFrame:
    """regions with the coordinates of their texts (longitude latitude) in the given system; its values are those of reproject().

    The points of all texts go through one distributed projection and are put together again in their places. Null texts stay null.
    """
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    x = regions.withColumn("_id", F.xxhash64(wkt))
    pairs = F.regexp_extract_all(wkt, F.lit(f"({number}\\s+{number})"), F.lit(1))
    points = x.select("_id", wkt).distinct().select("_id", F.posexplode(pairs).alias("_k", "_xy"))
    xy = F.split("_xy", r"\s+")
    points = reproject(points.select("_id", "_k", xy[0].cast("double").alias("lon"), xy[1].cast("double").alias("lat")), "lon", "lat", epsg)
    made = points.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_k", F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("t")))).alias("_new"))
    between = F.split(wkt, f"{number}\\s+{number}")
    text = F.array_join(F.zip_with(between, F.col("_new.t"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return x.join(made, "_id", "left").withColumn(wkt, F.when(F.col("_new").isNull(), F.col(wkt)).otherwise(text)).drop("_id", "_new")


def with_fallback(vector: DataFrame, raster: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, source): the vector's value of each point; the raster's only if the vector gives none at all, to any point."""
    known = vector.agg(F.count_if(F.col(value).isNotNull()).alias("_known"))
    # One row: whether the vector knows anything.
    x = vector.select(key, F.col(value).cast("string").alias("_v")).join(raster.select(key, F.col(value).cast("string").alias("_r")), key, "left").join(F.broadcast(known))
    return x.select(key, F.when(F.col("_known") > 0, F.col("_v")).otherwise(F.col("_r")).alias(value), F.when(F.col("_known") > 0, "vector").otherwise("raster").alias("source"))
