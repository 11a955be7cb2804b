"""Queries on series, rasters and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diversity, nearby, ranks, raster, regions, stats, trend
from ..session import read, stage
from . import views as v
from .community import _rank_sql, r

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_T = v.with_(v.TS)
_PAIRS = _T + ", P AS (SELECT a.pixel, b.t - a.t AS dt, b.value - a.value AS dv, a.value AS v1, b.value AS v2 FROM TS a JOIN TS b ON a.pixel = b.pixel AND a.t < b.t) "


@query(_PAIRS + "SELECT pixel, round(quantile_cont(dv / dt, 0.5), 8) AS slope FROM P GROUP BY 1")
def theil_sen(spark, d):
    return trend.theil_sen(v.series(spark, d)).select("pixel", r("slope", 8))


@query(_PAIRS + "SELECT pixel, n, s, round(s / (n * (n - 1) / 2), 9) AS tau FROM (SELECT pixel, sum(sign(dv))::BIGINT AS s FROM P GROUP BY 1) JOIN (SELECT pixel, count(*) AS n FROM TS GROUP BY 1) USING (pixel)")
def mann_kendall_s(spark, d):
    return trend.mann_kendall(v.series(spark, d)).select("pixel", "n", "s", r("tau", 9))


@query(_PAIRS + """, M AS (SELECT pixel, n::DOUBLE AS n, s::DOUBLE AS s FROM (SELECT pixel, sum(sign(dv)) AS s FROM P GROUP BY 1) JOIN (SELECT pixel, count(*) AS n FROM TS GROUP BY 1) USING (pixel))
SELECT pixel, round(CASE WHEN s > 0 THEN (s - 1) WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18), 7) AS z FROM M""")
def mk_z(spark, d):
    m = trend.mann_kendall(v.series(spark, d))
    return m.select("pixel", r(trend.mk_z(F.round("tau", 14), F.col("n")), 7, "z"))


@query()
def mk_p(spark, d):
    m = trend.mann_kendall(v.series(spark, d))
    return m.select("pixel", r(trend.mk_p(F.col("tau"), F.col("n")), 10, "p"))


@query(_T + ", G AS (SELECT pixel, round(value) AS value, count(*) AS c FROM TS GROUP BY 1, 2) SELECT pixel, round((sum(c) * (sum(c) - 1) * (2 * sum(c) + 5) - sum(c * (c - 1) * (2 * c + 5))) / 18.0::DOUBLE, 6) AS var_s FROM G GROUP BY 1")
def mk_var_ties(spark, d):
    return trend.mk_variance_with_ties(v.series(spark, d).withColumn("value", F.round("value"))).select("pixel", r("var_s"))


@query(_T + ", TR AS (SELECT pixel, t, trunc(value / 10) AS value FROM TS), P AS (SELECT a.pixel, bool_or(abs(b.value - a.value) <= 1e-6 + 1e-5 * abs(b.value)) AS tied FROM TR a JOIN TR b ON a.pixel = b.pixel AND a.t < b.t GROUP BY 1) SELECT count(*) AS n, round(avg(tied::INT::DOUBLE), 8) AS tied_share FROM P")
def tie_fraction(spark, d):
    x = v.series(spark, d).withColumn("value", (F.col("value") / 10).cast("long").cast("double"))
    return trend.tie_flags(x).agg(F.count("*").alias("n"), r(F.avg(F.col("tied").cast("double")), 8, "tied_share"))


@query(_T + "SELECT pixel, round(avg(value), 8) AS mean_value, round(arg_min(value, t), 8) AS first_value, round(arg_max(value, t), 8) AS last_value FROM TS GROUP BY 1")
def stack_mean_first_last(spark, d):
    return trend.stack_summary(v.series(spark, d)).select("pixel", r("mean_value", 8), r("first_value", 8), r("last_value", 8))


def _trend_table(spark, d) -> DataFrame:
    """One row a pixel: slope and p-value of its series, elevation and group of the place of the same number."""
    ts = v.series(spark, d)
    t = trend.theil_sen(ts).join(trend.mann_kendall(ts), "pixel").withColumn("p", trend.mk_p(F.round("tau", 14), F.col("n")))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("pixel"), ((F.col("c_acctbal") + 1000) / 2).alias("elevation"), F.col("c_mktsegment").alias("grp"))
    return stage(t.join(c, "pixel", "left").select(F.col("pixel").alias("plot"), "slope", "p", "elevation", "grp"), "trends")


# DuckDB has no error function: its tail by a published polynomial (absolute error below 1.5e-7), enough for classes and counts.
_TT = _PAIRS + """, SL AS (SELECT pixel, quantile_cont(dv / dt, 0.5) AS slope, sum(sign(dv))::BIGINT AS s FROM P GROUP BY 1), NN AS (SELECT pixel, count(*) AS n FROM TS GROUP BY 1),
ZZ AS (SELECT pixel, slope, abs(CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END) / sqrt(n * (n - 1) * (2 * n + 5) / 18) / sqrt(2::DOUBLE) AS x FROM SL JOIN NN USING (pixel)),
ER AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS u FROM ZZ),
TT AS (SELECT pixel AS plot, slope, u * (0.254829592::DOUBLE + u * (-0.284496736::DOUBLE + u * (1.421413741::DOUBLE + u * (-1.453152027::DOUBLE + u * 1.061405429::DOUBLE)))) * exp(-x * x) AS p,
  (c_acctbal + 1000) / 2 AS elevation, c_mktsegment AS grp FROM ER LEFT JOIN customer ON c_custkey = pixel) """


@query(_TT + "SELECT plot, CASE WHEN slope IS NULL OR p IS NULL THEN 'No data' WHEN p <= 0.05 AND slope > 0 THEN 'Greening' WHEN p <= 0.05 AND slope < 0 THEN 'Browning' ELSE 'Stable' END AS trend_class FROM TT")
def trend_class(spark, d):
    return _trend_table(spark, d).select("plot", trend.trend_class(F.col("slope"), F.col("p")).alias("trend_class"))


@query(_TT + "SELECT c AS pixel_class, count(*) AS n FROM (SELECT CASE WHEN p <= 0.05 AND slope > 0 THEN 1 WHEN p <= 0.05 AND slope < 0 THEN -1 WHEN p > 0.05 THEN 0 END AS c FROM TT) GROUP BY 1")
def classify_pixels(spark, d):
    return _trend_table(spark, d).groupBy(trend.pixel_class(F.col("slope"), F.col("p")).alias("pixel_class")).agg(F.count("*").alias("n"))


_SUM = "count(*) AS n, round(avg(slope), 8) AS mean, round(quantile_cont(slope, 0.5), 8) AS median, round(stddev_samp(slope), 8) AS sd, round(avg((slope > 0)::INT::DOUBLE) * 100, 6) AS pct_positive, round(avg((slope > 0 AND p <= 0.05)::INT::DOUBLE) * 100, 6) AS pct_greening"


def _trend_summary(df: DataFrame, by: str) -> DataFrame:
    pos = lambda c: F.avg(c.cast("double")) * 100
    up = F.col("slope") > 0
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), r(F.avg("slope"), 8, "mean"), r(F.percentile("slope", F.lit(0.5)), 8, "median"), r(F.stddev_samp("slope"), 8, "sd"),
        r(pos(up), 6, "pct_positive"), r(pos(up & (F.col("p") <= 0.05)), 6, "pct_greening"))


@query(_TT + f"SELECT elev_band, {_SUM} FROM (SELECT *, {v.BAND} AS elev_band FROM TT) WHERE elev_band IS NOT NULL GROUP BY 1")
def evi_by_band(spark, d):
    return _trend_summary(_trend_table(spark, d).withColumn("elev_band", diversity.band(F.col("elevation"))), "elev_band")


@query(_TT + f"SELECT grp, {_SUM} FROM TT WHERE grp IS NOT NULL GROUP BY 1 ORDER BY median DESC, grp")
def evi_by_group(spark, d):
    return _trend_summary(_trend_table(spark, d), "grp").orderBy(F.desc("median"), "grp")


_AREA = """, S AS (SELECT count(*) FILTER (WHERE {p} <= 0.05 AND slope > 0) AS g, count(*) FILTER (WHERE {p} <= 0.05 AND slope < 0) AS b, count(*) AS t FROM {x})
SELECT category, n, round(n * 0.0625::DOUBLE, 6) AS km2, round(n * 100.0::DOUBLE / t, 6) AS pct FROM (SELECT unnest(['Greening', 'Browning', 'Stable', 'Total']) AS category, unnest([g, b, t - g - b, t]) AS n, t FROM S)"""


@query(_TT + _AREA.format(p="p", x="TT"))
def area_stats_nominal(spark, d):
    return raster.area_statistics(_trend_table(spark, d), "slope", "p", 0.0625).select("category", "n", r("km2"), r("pct"))


_BH = """, K AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM TT),
Q AS (SELECT *, least(1.0::DOUBLE, min(p * m / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM K)"""


@query(_TT + _BH + _AREA.format(p="q", x="Q"))
def area_stats_fdr(spark, d):
    x = ranks.bh_adjust(_trend_table(spark, d), "p", "q")
    return raster.area_statistics(x, "slope", "q", 0.0625).select("category", "n", r("km2"), r("pct"))


@query(_TT + f", R AS (SELECT {_rank_sql('slope')} AS a, {_rank_sql('elevation')} AS b FROM TT) SELECT count(*) AS n, round(corr(a, b), 7) AS rho FROM R")
def spearman_rho(spark, d):
    return stats.spearman(_trend_table(spark, d), "slope", "elevation").select("n", r("rho", 7))


@query(_TT + "SELECT grp, round(avg(slope), 8) AS mean, round(1.96::DOUBLE * stddev_samp(slope) / sqrt(count(*)), 8) AS half_width FROM TT GROUP BY 1")
def group_mean_interval(spark, d):
    return _trend_table(spark, d).groupBy("grp").agg(r(F.avg("slope"), 8, "mean"), r(1.96 * F.stddev_samp("slope") / F.sqrt(F.count("*")), 8, "half_width"))


@query("SELECT plot_id, round(cos(radians(latitude)) * 111320.0::DOUBLE * 0.0025 * 111320.0::DOUBLE * 0.0025 / 1e6, 9) AS km2 FROM (SELECT DISTINCT plot_id, latitude FROM plot_points_gpkg WHERE latitude BETWEEN 26.7 AND 28.4)")
def pixel_area(spark, d):
    x = read(spark, d, "plot_points_gpkg").where("latitude between 26.7 and 28.4 and not isnan(latitude)").select("plot_id", "latitude").distinct()
    return x.select("plot_id", r(raster.pixel_area_km2(F.col("latitude"), 0.0025, 0.0025), 9, "km2"))


# Rasters

_GRID = raster.Affine(88.7, 28.4, 0.0547, 0.0034)
_AT = "floor((28.4::DOUBLE - latitude) / 0.0034::DOUBLE)::BIGINT", "floor((longitude - 88.7::DOUBLE) / 0.0547::DOUBLE)::BIGINT"


@query(v.with_(v.E, v.GR) + f'SELECT plot_id, round(value, 8) AS value FROM (SELECT plot_id, {_AT[0]} AS ri, {_AT[1]} AS ci FROM E WHERE longitude IS NOT NULL AND latitude IS NOT NULL) LEFT JOIN GR ON "row" = ri AND col = ci')
def raster_sample(spark, d):
    e = v.env(spark, d).where("longitude is not null and latitude is not null").select("plot_id", "longitude", "latitude")
    return raster.sample(e, v.grid(spark, d), _GRID, "longitude", "latitude", "value").select("plot_id", r("value", 8))


_NB = "N AS (SELECT c.\"row\", c.col, " + ", ".join(f"max(CASE WHEN n.\"row\" - c.\"row\" = {a} AND n.col - c.col = {b} THEN n.value END) AS w{(a + 1) * 3 + b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1)) + \
    " FROM GR c JOIN GR n ON n.\"row\" BETWEEN c.\"row\" - 1 AND c.\"row\" + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1 GROUP BY 1, 2 HAVING count(*) = 9)"


@query(v.with_(v.GR, _NB) + """, D AS (SELECT "row", col, ((w2 + 2 * w5 + w8) - (w0 + 2 * w3 + w6)) / 240.0::DOUBLE AS dx, ((w6 + 2 * w7 + w8) - (w0 + 2 * w1 + w2)) / 240.0::DOUBLE AS dy FROM N)
SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 7) AS slope, round((degrees(atan2(dy, -dx)) + 360) % 360, 6) AS aspect FROM D""")
def horn_slope_aspect(spark, d):
    return raster.horn(v.grid(spark, d), 30.0, 30.0).select("row", "col", r("slope", 7), r("aspect"))


@query(v.with_(v.GR) + 'SELECT ("row" / 10)::BIGINT AS "row", (col / 10)::BIGINT AS col, round(value, 8) AS value FROM GR WHERE "row" % 10 = 0 AND col % 10 = 0')
def grid_subsample(spark, d):
    return raster.subsample(v.grid(spark, d), 10).select("row", "col", r("value", 8))


_MORAN = """, L AS (SELECT c.value AS y, coalesce(avg(n.value), 0) AS lag, greatest(count(n.value), 1)::DOUBLE AS k FROM GR c
  LEFT JOIN GR n ON abs(n."row" - c."row") + abs(n.col - c.col) = 1 AND n."row" BETWEEN c."row" - 1 AND c."row" + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1 GROUP BY c."row", c.col, c.value),
S AS (SELECT count(*)::DOUBLE AS n, covar_pop(y, lag) AS c, var_pop(y) AS v, sum(k * k) AS w2 FROM L), I AS (SELECT *, c * n / (v * n + 1e-12) * n / (4 * n) AS i FROM S)
SELECT n::BIGINT AS n, round(i, 7) AS i, round((i + 1 / (n - 1)) / sqrt(greatest(1e-12, (n * n * 4 * n - n * w2 + 3 * 16 * n * n - n * 4 * n) / (16 * n * n * (n * n - 1) + 1e-12))), 5) AS z FROM I"""


@query(v.with_(v.GR) + _MORAN)
def morans_i(spark, d):
    return raster.morans_i(v.grid(spark, d)).select("n", r("i", 7), r("z", 5))


def _steps_sql(steps: tuple[int, ...]) -> str:
    one = lambda k: _MORAN.replace("FROM GR c", f"FROM G{k} c").replace("LEFT JOIN GR n", f"LEFT JOIN G{k} n")
    parts = [f'SELECT {k} AS step, {k} * 0.0025::DOUBLE * 111 AS km, * FROM (WITH G{k} AS (SELECT ("row" / {k})::BIGINT AS "row", (col / {k})::BIGINT AS col, value FROM GR WHERE "row" % {k} = 0 AND col % {k} = 0){one(k)})' for k in steps]
    return v.with_(v.GR) + " UNION ALL ".join(parts)


@query(_steps_sql((2, 4, 6)))
def morans_i_steps(spark, d):
    return raster.union_steps(v.grid(spark, d), (2, 4, 6)).select("step", "km", "n", r("i", 7), r("z", 5))


@query()
def morans_i_p(spark, d):
    return raster.union_steps(v.grid(spark, d), (1, 2, 4, 6)).select("step", r("p", 8))


@query(v.with_(v.GR) + ", X AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM GR) SELECT round(lo, 7) AS low, round(hi, 7) AS high FROM X")
def colour_limits(spark, d):
    return raster.quantile_limits(v.grid(spark, d), "value").select(r("low", 7), r("high", 7))


# Regions

_RINGS = r"""rings AS (SELECT unit_id, row_number() OVER () AS ring, string_split(w, ',') AS v FROM (SELECT unit_id, unnest(regexp_extract_all(geometry_wkt, '\(([^()]+)\)', 1)) AS w FROM soil_map_vector)),
pts AS (SELECT unit_id, ring, i, split_part(trim(v[i]), ' ', 1)::DOUBLE AS x, split_part(trim(v[i]), ' ', 2)::DOUBLE AS y FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM rings)),
eg AS (SELECT a.unit_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pts a JOIN pts b ON a.ring = b.ring AND b.i = a.i + 1),
C AS (SELECT plot_id, longitude AS x, latitude AS y FROM E WHERE longitude IS NOT NULL AND latitude IS NOT NULL),
H AS (SELECT plot_id, unit_id FROM C JOIN eg ON (y1 > C.y) <> (y2 > C.y) AND C.x < (x2 - x1) * (C.y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@query(v.with_(v.E, _RINGS) + "SELECT plot_id, unit_id FROM C LEFT JOIN H USING (plot_id)")
def point_in_polygon(spark, d):
    """Left join: plots in no unit keep a null."""
    e = v.env(spark, d).where("longitude is not null and latitude is not null").select("plot_id", "longitude", "latitude")
    hit = nearby.containing_regions(e, "longitude", "latitude", read(spark, d, "soil_map_vector"), "unit_id", "geometry_wkt", "unit_id").select("plot_id", "unit_id")
    return e.select("plot_id").join(hit, "plot_id", "left")


@query(v.with_(v.E, _RINGS) + """, DD AS (SELECT plot_id, unit_id, min(sqrt(pow(C.x - (x1 + t * (x2 - x1)), 2) + pow(C.y - (y1 + t * (y2 - y1)), 2))) AS dist FROM C, eg,
  LATERAL (SELECT CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((C.x - x1) * (x2 - x1) + (C.y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) END AS t) q
  WHERE plot_id NOT IN (SELECT plot_id FROM H) GROUP BY 1, 2),
N AS (SELECT plot_id, unit_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY round(dist, 9), unit_id) AS k FROM DD) WHERE k = 1)
SELECT plot_id, unit_id, 0.0::DOUBLE AS dist FROM H UNION ALL SELECT plot_id, unit_id, round(dist, 7) FROM N""")
def nearest_polygon(spark, d):
    e = v.env(spark, d).where("longitude is not null and latitude is not null").select("plot_id", "longitude", "latitude")
    x = regions.nearest_regions(e, "plot_id", "longitude", "latitude", read(spark, d, "soil_map_vector"), "unit_id", "geometry_wkt", "unit_id")
    return x.select("plot_id", "unit_id", r("dist", 7))


@query(v.with_(v.E, _RINGS) + "SELECT plot_id, soil_type, gridcode FROM C LEFT JOIN H USING (plot_id) LEFT JOIN soil_map_vector USING (unit_id)")
def soil_attributes(spark, d):
    """Attributes harvested from the containing unit."""
    units = read(spark, d, "soil_map_vector").select("unit_id", "soil_type", "gridcode")
    return point_in_polygon(spark, d).join(units, "unit_id", "left").select("plot_id", "soil_type", "gridcode")
