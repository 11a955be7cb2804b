"""Points near other points, and the region that holds a point.

Near pairs meet through an equi-join on grid cells as high and wide as the distance. Regions are covered by an adaptive
quadtree: cells inside a region accept a point by the equi-join alone, only cells on a border carry the edges that an exact
test there needs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, broadcast_if_small, spread, stage

EARTH_M = 6_371_008.8
#: A cell with more positions than this is split: its positions are spread over salts, those they meet are repeated.
HOT_CELL = 2000
#: Keys at one position before they are spread over salts, and parts of a cell's points where the cover can't be broadcast.
HOT_SPOT, SALTS = 2000, 16
#: Levels of the quadtree below a region's first cells, and the edges a border cell may hold before it is split further.
DEPTH, FEW_EDGES = 6, 6


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _cells(row: Column, height: float) -> Column:
    """Number of cells in a row of latitude: each at least as wide as the distance, anywhere in it or its neighbours."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + 2 * height)
    return F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(edge)) * (360.0 / height) * 0.999))


def near_pairs(points: DataFrame, key: str, lon: str, lat: str, metres: float) -> DataFrame:
    """(key_a, key_b) for each pair of different keys key_a < key_b of which some positions are at most metres apart.

    One row a pair, however many positions a key has. Null and not-a-number coordinates, positions outside -180..180 and -90..90,
    and null keys don't count; equal positions count as 0 m apart; the seam at 180 degrees and the poles are no borders. An empty
    table gives no rows; other columns aren't read. Equal positions are joined once for all their keys.
    """
    p = points.select(F.col(key).cast("string").alias("k"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    p = p.where("k is not null and x between -180 and 180 and y between -90 and 90 and not isnan(x) and not isnan(y)").distinct()
    keyed = stage(p.withColumn("pos", F.xxhash64("x", "y")), "points")
    height = math.degrees(metres / EARTH_M) * 1.0001
    at = F.floor(F.col("y") / height)
    spots = keyed.select("x", "y").distinct().withColumn("iy", at)
    column = lambda row: F.floor((F.col("x") + 180) / 360 * _cells(row, height)) % _cells(row, height)
    own = spots.withColumn("ix", column(F.col("iy")))
    hot = stage(own.groupBy("iy", "ix").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CELL).select(
        "iy", "ix", F.ceil(F.col("n") / HOT_CELL).cast("int").alias("salts")), "hot")
    hot = broadcast_if_small(hot, hot.count(), 32)
    built = own.join(hot, ["iy", "ix"], "left").select(
        "iy", "ix", F.col("x").alias("x2"), F.col("y").alias("y2"),
        F.pmod(F.xxhash64("x", "y"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
    )
    step = lambda dy, dx: F.struct(
        (F.col("iy") + dy).alias("iy"), F.pmod(column(F.col("iy") + dy) + dx, _cells(F.col("iy") + dy, height)).alias("ix")
    )
    around = F.array_distinct(F.array(step(0, 0), step(0, 1), step(1, -1), step(1, 0), step(1, 1)))
    probe = spots.select("x", "y", F.explode(around).alias("c")).select("x", "y", "c.iy", "c.ix").join(hot, ["iy", "ix"], "left").select(
        "iy", "ix", "x", "y", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    )
    close = haversine_m(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= metres
    met = probe.join(built, ["iy", "ix", "salt"]).where(close).select("x", "y", "x2", "y2").distinct()
    first = keyed.select("x", "y", F.col("k").alias("a"))
    second = keyed.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("k").alias("b"))
    # A position shared by many keys is cut: the keys of the other side are spread over salts, each pair is made once.
    crowd = stage(keyed.groupBy(F.col("x").alias("x2"), F.col("y").alias("y2")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_SPOT).select(
        "x2", "y2", F.ceil(F.col("n") / HOT_SPOT).cast("int").alias("salts")), "crowd")
    crowd = broadcast_if_small(crowd, crowd.count(), 32)
    second = second.join(crowd, ["x2", "y2"], "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    asked = met.join(first, ["x", "y"]).join(crowd, ["x2", "y2"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    pairs = asked.join(second, ["x2", "y2", "salt"]).where(F.col("a") != F.col("b"))
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def rings_of(wkt: str | None) -> list[np.ndarray]:
    """Rings of a POLYGON or MULTIPOLYGON text as arrays (n, 2); none for anything else."""
    if not wkt or not re.match(r"\s*(?:SRID=\d+;)?\s*(?:MULTI)?POLYGON", wkt, re.I):
        return []
    out = []
    for part in re.findall(r"\(([^()]+)\)", wkt):
        r = np.array([[float(v) for v in xy.split()[:2]] for xy in part.split(",")])
        out.append(r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]))
    return out


def inside(x: float, y: float, edges: np.ndarray) -> bool:
    """Even-odd rule over edges (x1, y1, x2, y2); an edge holds its lower end and not its upper one."""
    e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    return bool((x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum() % 2)


def cover(rings: list[np.ndarray]) -> list[tuple[int, int, int, bool, list[float]]]:
    """(level, ix, iy, interior, edges) cells of one region; a cell of a level is 360 / 2^level degrees wide and high.

    A border cell's edges are those a ray to the right can cross from any point in it.
    """
    if not rings:
        return []
    edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    lo_x, hi_x = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    lo_y, hi_y = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    span = max(hi_x.max() - lo_x.min(), hi_y.max() - lo_y.min(), 1e-9)
    top = max(0, min(20, math.floor(math.log2(360 / span))))
    size = 360 / 2**top
    todo = [
        (top, ix, iy, np.arange(len(edges)))
        for ix in range(math.floor((lo_x.min() + 180) / size), math.floor((hi_x.max() + 180) / size) + 1)
        for iy in range(math.floor((lo_y.min() + 90) / size), math.floor((hi_y.max() + 90) / size) + 1)
    ]
    out = []
    while todo:
        level, ix, iy, held = todo.pop()
        size = 360 / 2**level
        x0, y0 = ix * size - 180, iy * size - 90
        x1, y1 = x0 + size, y0 + size
        held = held[(hi_x[held] >= x0) & (lo_x[held] <= x1) & (hi_y[held] >= y0) & (lo_y[held] <= y1)]
        if not len(held):
            if inside((x0 + x1) / 2, (y0 + y1) / 2, edges):
                out.append((level, ix, iy, True, []))
        elif level < top + DEPTH and len(held) > FEW_EDGES or level < top + 3:
            todo += [(level + 1, 2 * ix + i, 2 * iy + j, held) for i in (0, 1) for j in (0, 1)]
        else:
            out.append((level, ix, iy, False, edges[(hi_x >= x0) & (hi_y >= y0) & (lo_y <= y1)].ravel().tolist()))
    return out


def _code(level: Column | int, ix: Column, iy: Column) -> Column:
    lev = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(lev.cast("long"), 58) + F.shiftleft(ix.cast("long"), 29) + iy.cast("long")


def region_cover(regions: DataFrame, key: str, wkt: str) -> DataFrame:
    """(cell, level, region, interior, edges): the adaptive coverage of all regions, made where the regions lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(lv, ix, iy, k, inner, e) for k, w in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for lv, ix, iy, inner, e in cover(rings_of(w))]
            yield pd.DataFrame(rows, columns=["level", "ix", "iy", "region", "interior", "edges"])

    cells = spread(regions.select(F.col(key).cast("string"), F.col(wkt)).dropna()).mapInPandas(
        run, "level int, ix long, iy long, region string, interior boolean, edges array<double>"
    )
    return cells.select(_code(F.col("level"), F.col("ix"), F.col("iy")).alias("cell"), "level", "region", "interior", "edges")


def containing_regions(points: DataFrame, lon: str, lat: str, regions: DataFrame, key: str, wkt: str, region_col: str = "region") -> DataFrame:
    """points with region_col, one row for each region that holds the point; points in no region are left out.

    Regions are POLYGON or MULTIPOLYGON texts in the points' coordinates, holes by the even-odd rule; a point on a border belongs
    to the region above or right of it. Null or impossible coordinates and null or unreadable geometries match nothing. Columns of
    points are kept as they are (region_col must not be one of them); empty tables give no rows.
    """
    cells = stage(region_cover(regions, key, wkt), "cover")
    levels = [r.level for r in cells.select("level").distinct().orderBy("level").collect()]
    if not levels:
        return points.limit(0).withColumn(region_col, F.lit(None).cast("string"))
    n, edges = cells.agg(F.count("*"), F.coalesce(F.sum(F.size("edges")), F.lit(0))).first()
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    fits = x.between(-180, 180) & y.between(-90, 90) & ~F.isnan(x) & ~F.isnan(y)
    codes = [_code(v, F.floor((x + 180) / (360 / 2**v)), F.floor((y + 90) / (360 / 2**v))) for v in levels]
    placed = points.where(fits).withColumn("_cell", F.explode(F.array(*codes)))
    cover_ = cells.select(F.col("cell").alias("_cell"), F.col("region").alias(region_col), F.col("interior").alias("_interior"), F.col("edges").alias("_edges"))
    on = ["_cell"]
    if n * 64 + edges * 8 <= BROADCAST_BYTES:
        cover_ = broadcast_if_small(cover_, 1, n * 64 + edges * 8)
    else:
        on = ["_cell", "_salt"]
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in points.columns if c != "_salt"]), F.lit(SALTS)).cast("int"))
        cover_ = cover_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = lambda i, k: F.element_at("_edges", i * 4 + k)
    crossed = lambda i: ((e(i, 2) > y) != (e(i, 4) > y)) & (x < (e(i, 3) - e(i, 1)) * (y - e(i, 2)) / (e(i, 4) - e(i, 2)) + e(i, 1))
    hits = F.size(F.filter(F.sequence(F.lit(0), (F.size("_edges") / 4).cast("int") - 1), lambda i: F.when((e(i, 2) > y) != (e(i, 4) > y), crossed(i)).otherwise(False)))
    # Interior cells accept at once; the edges of border cells alone are looked at.
    return placed.join(cover_, on).where(F.when(F.col("_interior"), True).otherwise(hits % 2 == 1)).drop("_cell", "_salt", "_interior", "_edges")
