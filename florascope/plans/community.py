"""Queries on the inventory: cleaning, quality, diversity, bands, indicators, networks, index and reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clean, distances, diversity, indicators, network, ordination, ranks, raster, stats
from ..session import read, stage
from . import views as v

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


# Cleaning

@query("SELECT DISTINCT source, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS normal FROM documents")
def normalize_names(spark, d):
    return read(spark, d, "documents").select("source", F.regexp_replace(F.lower("source"), "[^a-z0-9]", "").alias("normal")).distinct()


@query(f"SELECT record_id, {v.sql_space('species_name')} AS species_name, {v.sql_space('stratum')} AS stratum FROM veg_long_csv")
def collapse_whitespace(spark, d):
    return clean.collapse_all(read(spark, d, "veg_long_csv").select("record_id", "species_name", "stratum"))


@query(f"SELECT DISTINCT {v.sql_title(v.sql_space('species_name'))} AS species_name FROM veg_long_csv")
def title_case_names(spark, d):
    return read(spark, d, "veg_long_csv").select(clean.clean_species(F.col("species_name")).alias("species_name")).distinct()


@query("SELECT doc_id, try_cast(lang AS DOUBLE) AS lang_number, try_cast(n_chars::VARCHAR AS DOUBLE) AS n_number FROM documents")
def numeric_coercion(spark, d):
    x = read(spark, d, "documents")
    return x.select("doc_id", clean.to_number(F.col("lang")).alias("lang_number"), clean.to_number(F.col("n_chars").cast("string")).alias("n_number"))


@query("SELECT record_id FROM veg_long_csv WHERE plot_id <> '' AND species_name <> ''")
def required_key_filter(spark, d):
    return clean.valid_keys(read(spark, d, "veg_long_csv"), ["plot_id", "species_name"]).select("record_id")


@query("SELECT DISTINCT plot_id, longitude, latitude FROM plot_points_gpkg WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
def valid_coordinates(spark, d):
    return read(spark, d, "plot_points_gpkg").where(clean.valid_coordinates()).select("plot_id", "longitude", "latitude").distinct()


@query("SELECT fid, coalesce(longitude BETWEEN 88.7 AND 92.2 AND latitude BETWEEN 26.7 AND 28.4 AND NOT isnan(longitude) AND NOT isnan(latitude), false) AS inside_bbox FROM plot_points_gpkg")
def bbox_flag(spark, d):
    return read(spark, d, "plot_points_gpkg").select("fid", clean.inside_bbox().alias("inside_bbox"))


@query("SELECT stratum, count(*) AS n, count(abundance) AS n_abundance FROM (SELECT 'Trees' AS stratum, NULL::DOUBLE AS abundance FROM veg_long_csv WHERE stratum = 'Trees' UNION ALL SELECT 'Shrubs', abundance FROM veg_long_csv WHERE stratum = 'Shrubs') GROUP BY 1")
def strata_union(spark, d):
    x = read(spark, d, "veg_long_csv")
    parts = {"Trees": x.where("stratum = 'Trees'").select("record_id"), "Shrubs": x.where("stratum = 'Shrubs'").select("record_id", "abundance")}
    return clean.union_strata(parts).groupBy("stratum").agg(F.count("*").alias("n"), F.count("abundance").alias("n_abundance"))


@query(v.with_(v.E) + "SELECT plot_id, longitude AS x, latitude AS y, 4326 AS crs FROM E WHERE longitude IS NOT NULL AND latitude IS NOT NULL")
def plot_points(spark, d):
    e = v.env(spark, d).where("longitude is not null and latitude is not null")
    return e.select("plot_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.lit(4326).alias("crs"))


# Quality

@query("SELECT plot_id, species_name, stratum, count(*) AS n FROM veg_long_csv GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return clean.duplicate_groups(read(spark, d, "veg_long_csv"), ["plot_id", "species_name", "stratum"])


_VEG = ["record_id", "plot_id", "species_name", "stratum", "abundance", "longitude", "latitude", "forest_type", "local_name", "crew_code"]
_GONE = {"record_id": "record_id IS NULL", **{c: f"{c} IS NULL OR isnan({c})" for c in ("abundance", "longitude", "latitude")}}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_GONE.get(c, f'{c} IS NULL OR {c} = ' + chr(39) * 2)}) AS n_missing, count(*) AS n_rows, "
    f"round(count(*) FILTER (WHERE {_GONE.get(c, f'{c} IS NULL OR {c} = ' + chr(39) * 2)}) * 100.0::DOUBLE / count(*), 6) AS pct_missing FROM veg_long_csv" for c in _VEG))
def missingness(spark, d):
    return clean.missingness(read(spark, d, "veg_long_csv").select(*_VEG)).withColumn("pct_missing", F.round("pct_missing", 6))


@query(v.with_(v.V) + "SELECT plot_id, count(DISTINCT species_name) AS n_species FROM V GROUP BY 1")
def species_count_by_plot(spark, d):
    return v.veg(spark, d).groupBy("plot_id").agg(F.count_distinct("species_name").alias("n_species"))


_NUM = ["elevation", "slope", "aspect", "bio1", "bio12", "longitude", "latitude"]
_LONG = "L AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM E" for c in _NUM) + ")"


@query(v.with_(v.E, _LONG) + "SELECT variable, round(avg((value IS NULL)::INT::DOUBLE), 6) AS na_rate FROM L GROUP BY 1")
def na_rates(spark, d):
    return clean.na_rates(v.env(spark, d), _NUM).select("variable", r("na_rate"))


@query(v.with_(v.E, _LONG, "Q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM L GROUP BY 1)") + """
SELECT variable, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5::DOUBLE * (q3 - q1), 6) AS lower, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS upper,
  count(*) FILTER (WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers FROM L JOIN Q USING (variable) GROUP BY variable, q1, q3""")
def iqr_outliers(spark, d):
    x = clean.iqr_outliers(v.env(spark, d), _NUM)
    return x.select("variable", r("q1"), r("q3"), r("lower"), r("upper"), "n_outliers")


@query(v.with_(v.E, "C AS (" + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM E" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + ")") + "SELECT var1, var2, round(r, 6) AS r FROM C WHERE abs(r) >= 0.5")
def collinear_pairs(spark, d):
    return clean.collinear_pairs(v.env(spark, d), _NUM, 0.5).select("var1", "var2", r("r"))


@query(v.with_(v.V, v.AB, v.PR) + """, N AS (SELECT species_name, string_split(species_name, ' ')[1] AS genus, translate(lower(array_to_string(string_split(species_name, ' ')[2:], ' ')), 'àéü', '#$%') AS plain
  FROM (SELECT DISTINCT species_name FROM V) WHERE len(string_split(species_name, ' ')) >= 2), C AS (SELECT species_name, count(*) AS n FROM PR GROUP BY 1)
SELECT a.genus, a.species_name AS species_1, b.species_name AS species_2, levenshtein(a.plain, b.plain)::INT AS edit_distance, coalesce(ca.n, 0) AS n_1, coalesce(cb.n, 0) AS n_2
FROM N a JOIN N b ON a.genus = b.genus AND a.species_name < b.species_name LEFT JOIN C ca ON ca.species_name = a.species_name LEFT JOIN C cb ON cb.species_name = b.species_name
WHERE levenshtein(a.plain, b.plain) <= 2""".replace("\n", " "))
def taxonomic_duplicates(spark, d):
    p = v.presence(spark, d)
    x = clean.taxonomic_duplicates(v.veg(spark, d).select("species_name"), p.groupBy("species_name").agg(F.count("*").alias("n")))
    return x.select("genus", "species_1", "species_2", "edit_distance", "n_1", "n_2")


# Diversity

@query(v.with_(v.V, v.AB) + "SELECT plot_id, species_name, round(abund, 6) AS abund FROM AB")
def abundance_long(spark, d):
    return v.abund(spark, d).select("plot_id", "species_name", r("abund"))


@query(v.with_(v.V, v.AB, v.PR, "T AS (SELECT species_name, row_number() OVER (ORDER BY count(*) DESC, species_name) AS k FROM PR GROUP BY 1)") + "SELECT plot_id, " + ", ".join(
    f"round(sum(CASE WHEN k = {k} THEN abund ELSE 0 END), 6) AS top_{k}" for k in range(1, 6)) + " FROM AB LEFT JOIN T USING (species_name) GROUP BY 1")
def abundance_pivot(spark, d):
    """The five most frequent species as columns."""
    top = v.presence(spark, d).groupBy("species_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species_name").limit(5)
    names = [x.species_name for x in top.collect()]
    wide = diversity.abundance_pivot(v.abund(spark, d), names)
    return wide.select("plot_id", *[r(F.col(f"`{s}`"), name=f"top_{i + 1}") for i, s in enumerate(names)])


@query(v.with_(v.V, v.AB, v.AL) + "SELECT plot_id, richness, round(shannon, 6) AS shannon, round(simpson, 6) AS simpson FROM AL")
def alpha_diversity(spark, d):
    return v.alpha(spark, d).select("plot_id", "richness", r("shannon"), r("simpson"))


@query(v.with_(v.V, v.SR) + "SELECT * FROM SR")
def stratum_richness(spark, d):
    return v.strata(spark, d)


_ALPHA = v.with_(v.V, v.AB, v.AL, v.SR, v.E)


@query(_ALPHA + 'SELECT plot_id, richness, round(shannon, 6) AS shannon, round(simpson, 6) AS simpson, "richness_Trees", "richness_Shrubs", "richness_Herbs", "richness_Regeneration", elevation, forest_type, dzongkhag FROM AL LEFT JOIN SR USING (plot_id) LEFT JOIN E USING (plot_id)')
def alpha_with_env(spark, d):
    a = v.alpha(spark, d).join(v.strata(spark, d), "plot_id", "left").join(v.env(spark, d), "plot_id", "left")
    cols = [f"richness_{s}" for s in ("Trees", "Shrubs", "Herbs", "Regeneration")]
    return a.select("plot_id", "richness", r("shannon"), r("simpson"), *cols, "elevation", "forest_type", "dzongkhag")


@query(_ALPHA + "SELECT count(*) AS n_left, count(*) AS n_joined FROM AL")
def join_fanout_guard(spark, d):
    a = v.alpha(spark, d)
    j = diversity.guarded_left_join(a, v.env(spark, d), "plot_id")
    return a.agg(F.count("*").alias("n_left")).join(F.broadcast(j.agg(F.count("*").alias("n_joined"))))


# Bands

@query(v.with_(v.E) + f"SELECT plot_id, {v.BAND} AS elev_band FROM E")
def elevation_bands(spark, d):
    return v.env(spark, d).select("plot_id", diversity.band(F.col("elevation")).alias("elev_band"))


_AE = v.with_(v.V, v.AB, v.AL, v.E, v.AE, f"BD AS (SELECT *, {v.BAND} AS band FROM AE)")
_LABELS = ", ".join(f"({i}, '{b[2]}')" for i, b in enumerate(diversity.DEFAULTS.bands))


@query(_AE + f"""SELECT band_order, elevation_band, coalesce(n, 0) AS n, round(m, 6) AS mean, round(s, 6) AS sd, med AS median FROM (VALUES {_LABELS}) t(band_order, elevation_band)
LEFT JOIN (SELECT band, count(*) AS n, avg(richness) AS m, stddev_samp(richness) AS s, quantile_cont(richness::DOUBLE, 0.5) AS med FROM BD GROUP BY 1) ON band = elevation_band""")
def band_summary_all_labels(spark, d):
    x = diversity.band_summary(v.alpha_env(spark, d), "richness")
    return x.select("band_order", "elevation_band", "n", r("mean"), r("sd"), "median")


def _banded(spark, d) -> DataFrame:
    return v.alpha_env(spark, d).withColumn("band", diversity.band(F.col("elevation")))


_KW = """, K AS (SELECT band, richness::DOUBLE AS x FROM BD WHERE band IN (SELECT band FROM BD WHERE band IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)),
R AS (SELECT band, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM K),
TI AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS t FROM K GROUP BY x)),
S AS (SELECT sum(q) AS s, count(*) AS k, sum(m)::DOUBLE AS n FROM (SELECT sum(rk) * sum(rk) / count(*) AS q, count(*) AS m FROM R GROUP BY band)),
H AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k, n FROM S, TI)
"""


@query(_AE + _KW + "SELECT round(h, 6) AS h, k, n::BIGINT AS n FROM H")
def kruskal_h(spark, d):
    return stats.kruskal_wallis(_banded(spark, d), "band", "richness").select(r("h"), "k", "n")


@query(_AE + _KW + "SELECT round((h - k + 1) / (n_all - k), 8) AS epsilon_squared, n_all FROM H, (SELECT count(*) AS n_all FROM BD WHERE elevation IS NOT NULL)")
def kruskal_epsilon(spark, d):
    n = v.alpha_env(spark, d).where("elevation is not null").agg(F.count("*").alias("n_all"))
    return stats.kruskal_effect(_banded(spark, d), "band", "richness", n).select(r("epsilon_squared", 8), "n_all")


@query(_AE + _KW + """, G AS (SELECT band, avg(rk) AS m, count(*)::DOUBLE AS c FROM R GROUP BY 1)
SELECT a.band AS group_a, b.band AS group_b, round((a.m - b.m) / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / a.c + 1 / b.c)), 6) AS z
FROM G a JOIN G b ON a.band < b.band, H, TI""")
def dunn_z(spark, d):
    return stats.dunn(_banded(spark, d), "band", "richness").select("group_a", "group_b", r("z"))


@query(_AE + "SELECT regr_count(richness, elevation) AS n, round(regr_slope(richness, elevation), 8) AS slope, round(regr_intercept(richness, elevation), 6) AS intercept, round(regr_r2(richness, elevation), 8) AS r2 FROM AE")
def ols_richness_elevation(spark, d):
    return stats.ols(v.alpha_env(spark, d), "elevation", "richness").select("n", r("slope", 8), r("intercept"), r("r2", 8))


@query(v.with_(v.V, v.AB, v.AL, v.E, v.AE) + """, X AS (SELECT richness::DOUBLE AS y, elevation AS x FROM AE WHERE richness IS NOT NULL AND elevation IS NOT NULL),
O AS (SELECT count(*) AS n, covar_pop(y, x) / var_pop(x) AS b, avg(y) - covar_pop(y, x) / var_pop(x) * avg(x) AS a, avg(x) AS mx, var_pop(x) AS vx,
  sqrt((1 - pow(covar_pop(y, x), 2) / (var_pop(x) * var_pop(y))) * var_pop(y) * count(*) / (count(*) - 2)) AS s FROM X)
SELECT x, round(a + b * x, 6) AS fit, round(a + b * x - 1.96::DOUBLE * s * sqrt(1.0::DOUBLE / n + pow(x - mx, 2) / (vx * n)), 6) AS low, round(a + b * x + 1.96::DOUBLE * s * sqrt(1.0::DOUBLE / n + pow(x - mx, 2) / (vx * n)), 6) AS high
FROM O, (SELECT unnest(range(0, 5001, 250))::DOUBLE AS x)""")
def ols_band(spark, d):
    return stats.ols_band(v.alpha_env(spark, d), "elevation", "richness", [float(x) for x in range(0, 5001, 250)]).select("x", r("fit"), r("low"), r("high"))


# Beta diversity

_BC = v.with_(v.V, v.AB, "X AS (SELECT * FROM AB WHERE abund > 0)", "T AS (SELECT plot_id, sum(abund) AS t FROM X GROUP BY 1)",
              "SH AS (SELECT a.plot_id AS id_a, b.plot_id AS id_b, sum(least(a.abund, b.abund)) AS s FROM X a JOIN X b ON a.species_name = b.species_name AND a.plot_id < b.plot_id GROUP BY 1, 2)",
              "BC AS (SELECT a.plot_id AS id_a, b.plot_id AS id_b, 1 - 2 * coalesce(s, 0) / (a.t + b.t) AS d FROM T a JOIN T b ON a.plot_id < b.plot_id LEFT JOIN SH ON id_a = a.plot_id AND id_b = b.plot_id)", v.E)


@query(_BC + "SELECT id_a, id_b, round(d, 6) AS d FROM BC")
def bray_curtis(spark, d):
    """distances.bray_curtis of all plots, made where it is written."""
    from ..operators import replicates

    cells, e = _cells(spark, d, v.abund(spark, d).where("abund > 0").select("plot_id").distinct())
    return replicates.pair_table(spark, [x.plot_id for x in e], replicates.distance_rows(cells, len(e)) if e else None, "d", 6)


_HAV = "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2)))"
_KM = f"KM AS (SELECT a.plot_id AS id_a, b.plot_id AS id_b, {_HAV} AS km FROM E a JOIN E b ON a.plot_id < b.plot_id AND a.longitude IS NOT NULL AND a.latitude IS NOT NULL AND b.longitude IS NOT NULL AND b.latitude IS NOT NULL)"


@query(v.with_(v.E, _KM) + "SELECT id_a, id_b, round(km, 5) AS km FROM KM")
def haversine_km(spark, d):
    """distances.haversine_pairs of all plots, made where it is written."""
    from ..operators import replicates

    e = v.env(spark, d).where("longitude is not null and latitude is not null").select("plot_id", "longitude", "latitude").orderBy("plot_id").toArrow()
    return replicates.pair_table(spark, e["plot_id"].to_pylist(), replicates.great_circle_rows(e["longitude"].to_numpy(), e["latitude"].to_numpy()), "km", 5)


def _groups(spark, d) -> DataFrame:
    return v.env(spark, d).select("plot_id", F.col("forest_type").alias("grp"))


_PG = _BC + """, P AS (SELECT d, a.forest_type AS ga, b.forest_type AS gb, id_a, id_b FROM BC JOIN E a ON a.plot_id = id_a JOIN E b ON b.plot_id = id_b WHERE a.forest_type IS NOT NULL AND b.forest_type IS NOT NULL),
SZ AS (SELECT g, count(*) AS m FROM (SELECT id_a AS i, ga AS g FROM P UNION SELECT id_b, gb FROM P) GROUP BY 1),
W AS (SELECT sum(coalesce(s, 0) / m) AS ssw, sum(m)::DOUBLE AS n, count(*)::DOUBLE AS k FROM SZ LEFT JOIN (SELECT ga, sum(d * d) AS s FROM P WHERE ga = gb GROUP BY 1) ON ga = g),
F AS (SELECT ((sst - ssw) / (k - 1)) / (ssw / (n - k)) AS f, n, k FROM W, (SELECT sum(d * d) AS s2 FROM P) x, (SELECT 1), LATERAL (SELECT s2 / n AS sst) y)
"""


def _cells(spark, d, e: DataFrame) -> tuple[DataFrame, list]:
    """(cells (i, species_name, abund), rows of e in the order of i) of the plots that have species and are in e (plot_id, ...)."""
    from ..session import broadcast_if_small, dense_ids

    a = stage(v.abund(spark, d).where("abund > 0"), "abund")
    e, n = dense_ids(a.select("plot_id").distinct().join(e, "plot_id"), "plot_id", "i")
    cells = a.join(broadcast_if_small(e.select("plot_id", "i"), n, 40), "plot_id").select("i", "species_name", "abund")
    return stage(cells, "cells"), e.orderBy("i").collect()


def _permanova(spark, d) -> DataFrame:
    """distances.permanova of all plots with a group, by blocks of rows: no pair is shuffled."""
    from ..operators import replicates

    cells, e = _cells(spark, d, _groups(spark, d).where("grp is not null"))
    labels, n = [x.grp for x in e], len(e)
    f, k = replicates.permanova_blocks(cells, labels, 0).first()["observed"], len(set(labels))
    rows = [(f if f is not None and math.isfinite(f) else None, n, k)] if 1 < k < n else []
    x = spark.createDataFrame(rows, "f double, n long, k long")
    return x.withColumn("r2", distances.permanova_r2(F.col("f"), F.col("n"), F.col("k")))


@query(_PG + "SELECT round(f, 6) AS f, n::BIGINT AS n, k::BIGINT AS k FROM F")
def permanova_f(spark, d):
    return _permanova(spark, d).select(r("f"), "n", "k")


@query(_PG + "SELECT round(f * (k - 1) / (f * (k - 1) + n - k), 8) AS r2 FROM F")
def permanova_r2(spark, d):
    return _permanova(spark, d).select(r("r2", 8))


@query(_BC + ", " + _KM + " SELECT round(corr(d, km), 7) AS r, count(*) AS n_pairs FROM BC JOIN KM USING (id_a, id_b)")
def mantel_r(spark, d):
    """distances.mantel of all plots with a place, a row of pairs at a time."""
    from ..operators import replicates

    cells, e = _cells(spark, d, v.env(spark, d).where("longitude is not null and latitude is not null").select("plot_id", "longitude", "latitude"))
    got = replicates.mantel_blocks(cells, np.array([x.longitude for x in e], float), np.array([x.latitude for x in e], float))
    return spark.createDataFrame([(got, len(e) * (len(e) - 1) // 2)], "r double, n_pairs long").select(r("r", 7), "n_pairs")


@query(_PG + ", R AS (SELECT ga = gb AS same, rank() OVER (ORDER BY round(d, 10)) + (count(*) OVER (PARTITION BY round(d, 10)) - 1) / 2.0::DOUBLE AS rk FROM P) SELECT round((avg(rk) FILTER (WHERE NOT same) - avg(rk) FILTER (WHERE same)) / (count(*) / 2.0::DOUBLE), 6) AS r, count(*) AS n_pairs FROM R")
def anosim_r(spark, d):
    """distances.anosim of all plots with a group: distinct distances are counted where they are made, no pair is shuffled."""
    from ..operators import replicates

    cells, e = _cells(spark, d, _groups(spark, d).where("grp is not null"))
    return distances.anosim_counts(replicates.distance_counts(cells, [x.grp for x in e])).select(r("r"), "n_pairs")


@query(v.with_(v.E, "C AS (SELECT forest_type AS g, avg(longitude) AS cx, avg(latitude) AS cy FROM E WHERE forest_type IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)") + "SELECT plot_id, forest_type AS grp, round(sqrt(pow(longitude - cx, 2) + pow(latitude - cy, 2)), 8) AS dist FROM E JOIN C ON g = forest_type WHERE longitude IS NOT NULL AND latitude IS NOT NULL")
def group_dispersion(spark, d):
    """Distances to group centroids on given coordinates (here longitude and latitude)."""
    e = v.env(spark, d).where("longitude is not null and latitude is not null").select("plot_id", "longitude", "latitude")
    return distances.group_dispersion(e, _groups(spark, d), ["longitude", "latitude"]).select("plot_id", "grp", r("dist", 8))


# Inputs of the ordination

@query(v.with_(v.E, _LONG) + "SELECT variable, round(avg((value IS NULL)::INT::DOUBLE), 6) AS na_rate, round(stddev_samp(value), 5) AS sd FROM L GROUP BY 1 HAVING avg((value IS NULL)::INT::DOUBLE) < 0.5 AND stddev_samp(value) > 0")
def usable_predictors(spark, d):
    return clean.usable_predictors(v.env(spark, d), _NUM).select("variable", r("na_rate"), r("sd", 5))


@query(v.with_(v.E) + ", M AS (SELECT quantile_cont(elevation, 0.5) AS h, quantile_cont(aspect, 0.5) AS a FROM E) SELECT plot_id, coalesce(elevation, h) AS elevation, coalesce(aspect, a) AS aspect FROM E, M")
def median_impute(spark, d):
    return clean.median_impute(v.env(spark, d).select("plot_id", "elevation", "aspect"), ["elevation", "aspect"])


@query(v.with_(v.E) + "SELECT plot_id, round(sin(radians(aspect)), 9) AS northness, round(cos(radians(aspect)), 9) AS eastness FROM E")
def aspect_components(spark, d):
    n, e = clean.aspect_components(F.col("aspect"))
    return v.env(spark, d).select("plot_id", r(n, 9, "northness"), r(e, 9, "eastness"))


@query(v.with_(v.V, v.AB, v.PR) + "SELECT species_name, count(*) AS n FROM PR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def top_species(spark, d):
    return v.presence(spark, d).groupBy("species_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species_name").limit(200)


@query(v.with_(v.V, v.AB, "X AS (SELECT * FROM AB WHERE abund > 0)", "RS AS (SELECT plot_id, sum(abund) AS r FROM X GROUP BY 1)", "CS AS (SELECT species_name, sum(abund) AS c FROM X GROUP BY 1)") + "SELECT round(sum(abund * abund / (r * c)) - 1, 5) AS inertia FROM X JOIN RS USING (plot_id) JOIN CS USING (species_name)")
def chi2_inertia(spark, d):
    return ordination.chi2_inertia(v.abund(spark, d)).select(r("inertia", 5))


_GROUPS = {"climate": "bio|mat|map|prec|temp|arid", "topography": "elevation|slope|aspect|dem|altitude", "soil": "soil|fao|clay|sand|ph|bulk"}


@query("SELECT column_name AS variable, CASE " + " ".join(f"WHEN regexp_matches(lower(column_name), '{p}') THEN '{g}'" for g, p in _GROUPS.items()) + " ELSE 'other' END AS grp FROM (DESCRIBE SELECT * FROM env_master_csv)")
def variable_groups(spark, d):
    names = spark.createDataFrame([(c,) for c in read(spark, d, "env_master_csv").columns], "variable string")
    return names.select("variable", clean.variable_group(F.col("variable")).alias("grp"))


@query(v.with_(v.E, "B AS (SELECT plot_id, bio1 FROM E)", "M AS (SELECT quantile_cont(abs(bio1), 0.5) AS m, max(abs(bio1)) AS x FROM B)") + "SELECT plot_id, round(CASE WHEN m > 80 THEN bio1 / 10 ELSE bio1 END, 6) AS bio1, CASE WHEN m > 80 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS scale, x * (CASE WHEN m > 80 THEN 0.1 ELSE 1.0 END) > 60 AS warn FROM B, M")
def unit_autoscale(spark, d):
    x = clean.autoscale(v.env(spark, d).select("plot_id", "bio1"), "bio1")
    return x.select("plot_id", r("bio1"), "scale", "warn")


@query(v.with_(v.E) + "SELECT coalesce(min(bio12) < 0, false) AS has_negative, count(*) FILTER (WHERE bio12 < 0) AS n_negative FROM E")
def negative_precipitation(spark, d):
    return v.env(spark, d).agg(F.coalesce(F.min("bio12") < 0, F.lit(False)).alias("has_negative"), F.count_if(F.col("bio12") < 0).alias("n_negative"))


@query(v.with_(v.V, v.AB, v.PR) + "SELECT DISTINCT species_name FROM PR WHERE NOT regexp_matches(species_name, '(?i)(unknown|not.?listed|unidentified|indet)')")
def known_taxa(spark, d):
    return v.presence(spark, d).select("species_name").distinct().where(~clean.ambiguous_taxon(F.col("species_name")))


# Indicators

_IV = v.with_(v.V, v.AB, v.PR, v.E, """GS AS (SELECT forest_type AS g, count(*) AS m FROM E WHERE forest_type IS NOT NULL GROUP BY 1),
MN AS (SELECT species_name, forest_type AS g, count(*) / any_value(m)::DOUBLE AS mean FROM PR JOIN E USING (plot_id) JOIN GS ON g = forest_type GROUP BY 1, 2),
IV AS (SELECT species_name, g AS "group", mean / (total + 1e-12) * mean AS stat FROM (SELECT *, sum(mean) OVER (PARTITION BY species_name) AS total,
  row_number() OVER (PARTITION BY species_name ORDER BY mean DESC, g) AS k FROM MN) WHERE k = 1)""")
_KINDS = ["Alpine heath", "Cedar scrub", "Cloud hemlock forest", "Dry pine forest", "Lowland mixed forest", "Mid-slope broadleaf forest", "Moist broadleaf forest", "Open land", "Stone oak forest", "Upper fir forest"]


def _indval(spark, d) -> DataFrame:
    return indicators.indval(v.presence(spark, d), _groups(spark, d)).withColumn("stat", F.round("stat", 9))


@query(_IV + 'SELECT species_name, "group", round(stat, 9) AS stat FROM IV')
def indval(spark, d):
    return _indval(spark, d)


@query(v.with_(v.E) + """, P AS (SELECT plot_id, ((hash_id * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM (SELECT plot_id, CAST(substr(plot_id, 3) AS BIGINT) AS hash_id FROM E)),
N AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM P)
SELECT plot_id, p, round(least(1.0::DOUBLE, min(p * n / k) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adj FROM (SELECT plot_id, p, n, max(k) OVER (PARTITION BY p) AS k FROM N)""")
def bh_fdr(spark, d):
    x = v.env(spark, d).select("plot_id", ((F.substring("plot_id", 3, 20).cast("long") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    return ranks.bh_adjust(x, "p").select("plot_id", "p", r("p_adj", 9))


_TOP = _IV + ', R AS (SELECT species_name, "group", round(stat, 9) AS stat FROM IV), T5 AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY stat DESC, species_name) AS rank_in_group FROM R) '


@query(_TOP + "SELECT * FROM T5 WHERE rank_in_group <= 5")
def top5_per_group(spark, d):
    return indicators.top_per_group(_indval(spark, d))


@query(_TOP + 'SELECT species_name, stat, "group" FROM R')
def indicator_melt(spark, d):
    return indicators.melt_groups(indicators.one_hot(_indval(spark, d), _KINDS), _KINDS)


@query(_TOP + "SELECT species_name, " + ", ".join(f'coalesce(max(CASE WHEN "group" = \'{k}\' THEN stat END), 0) AS "{k}"' for k in _KINDS) + " FROM T5 WHERE rank_in_group <= 5 GROUP BY 1")
def indicator_pivot(spark, d):
    return indicators.pivot_top(indicators.top_per_group(_indval(spark, d)), _KINDS)


@query(_TOP + 'SELECT * FROM R ORDER BY "group", stat DESC, species_name LIMIT 20')
def top20_indicators(spark, d):
    return _indval(spark, d).orderBy("group", F.desc("stat"), "species_name").limit(20)


# Networks

_NET = v.with_(v.V, v.AB, v.PR, """FS AS (SELECT species_name, count(*) AS n FROM PR GROUP BY 1 HAVING count(*) >= 3), FP AS (SELECT PR.* FROM PR JOIN FS USING (species_name)),
SP AS (SELECT a.species_name AS src, b.species_name AS dst, count(*) AS weight FROM FP a JOIN FP b ON a.plot_id = b.plot_id AND a.species_name < b.species_name GROUP BY 1, 2), ED AS (SELECT * FROM SP WHERE weight >= 3),
DG AS (SELECT species_name, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT src AS species_name, weight FROM ED UNION ALL SELECT dst, weight FROM ED) GROUP BY 1)""")


def _frequent(spark, d) -> DataFrame:
    p = stage(v.presence(spark, d), "presence")
    return p.join(network.frequent_species(p).select("species_name"), "species_name", "left_semi")


@query(_NET + "SELECT * FROM ED")
def cooccurrence_edges(spark, d):
    return network.edges(_frequent(spark, d))


@query(_NET + "SELECT a.species_name AS src, b.species_name AS dst, coalesce(weight, 0) AS weight FROM FS a JOIN FS b ON a.species_name < b.species_name LEFT JOIN SP ON src = a.species_name AND dst = b.species_name")
def all_pair_counts(spark, d):
    return network.all_pair_counts(_frequent(spark, d))


@query(_NET + "SELECT * FROM DG")
def node_degree(spark, d):
    return network.degrees(network.edges(_frequent(spark, d)))


@query(_NET + "SELECT species_name FROM FS WHERE species_name IN (SELECT species_name FROM DG)")
def drop_isolates(spark, d):
    nodes = network.frequent_species(v.presence(spark, d)).select("species_name")
    return nodes.join(network.degrees(network.edges(_frequent(spark, d))), "species_name", "left_semi")


@query(_NET + "SELECT * FROM (SELECT SP.src, SP.dst, weight AS x, a.n AS n_src, b.n AS n_dst, (SELECT count(DISTINCT plot_id) FROM FP) AS n FROM SP JOIN FS a ON a.species_name = src JOIN FS b ON b.species_name = dst)")
def hypergeom_inputs(spark, d):
    return network.hypergeometric(_frequent(spark, d), tails=False)


_HYP = _NET + """, HI AS (SELECT SP.src, SP.dst, weight AS x, a.n AS k, b.n AS m, (SELECT count(DISTINCT plot_id) FROM FP) AS n FROM SP JOIN FS a ON a.species_name = src JOIN FS b ON b.species_name = dst),
HD AS (SELECT x, k, m, n, least(1.0::DOUBLE, sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(m - i + 1) - lgamma(n - k - m + i + 1)
  - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)))) AS p FROM (SELECT *, unnest(range(greatest(x, k + m - n), least(k, m) + 1)) AS i FROM (SELECT DISTINCT x, k, m, n FROM HI)) GROUP BY 1, 2, 3, 4),
HP AS (SELECT src, dst, x, p FROM HI JOIN HD USING (x, k, m, n))"""


@query(_HYP + " SELECT src, dst, x, round(p, 6) AS p FROM HP")
def hypergeom_tail(spark, d):
    return network.hypergeometric(_frequent(spark, d)).select("src", "dst", "x", r("p", 6))


@query(_HYP + """, M AS (SELECT count(*) * (count(*) - 1) / 2 AS m FROM (SELECT DISTINCT species_name FROM FP)),
RK AS (SELECT *, rank() OVER (ORDER BY round(p, 12)) + count(*) OVER (PARTITION BY round(p, 12)) - 1 AS rk FROM HP, M),
AD AS (SELECT *, least(1.0::DOUBLE, min(p * m / rk) OVER (ORDER BY rk RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM RK)
SELECT src, dst, x, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM AD WHERE p_adj <= 0.05""")
def significant_pairs(spark, d):
    return network.significant_pairs(_frequent(spark, d)).select("src", "dst", "x", r("p", 6), r("p_adj", 6))


@query(_NET + """, L AS (SELECT species_name, substr(species_name, 1, 1) AS c FROM FS), X AS (SELECT a.c AS ca, b.c AS cb, weight FROM ED JOIN L a ON a.species_name = src JOIN L b ON b.species_name = dst),
M AS (SELECT sum(weight)::DOUBLE AS m FROM ED), G AS (SELECT c, sum(i) AS i, sum(k) AS k FROM (SELECT ca AS c, CASE WHEN ca = cb THEN weight ELSE 0 END AS i, weight AS k FROM X UNION ALL SELECT cb, 0, weight FROM X) GROUP BY 1)
SELECT round(sum(i / m - pow(k / (2 * m), 2)), 9) AS q FROM G, M""")
def modularity_given_labels(spark, d):
    """Communities given by the first letter of the name."""
    p = _frequent(spark, d)
    labels = p.select("species_name").distinct().withColumn("community", F.substring("species_name", 1, 1))
    return network.modularity(network.edges(p), labels).select(r("q", 9))


@query(_NET + ", T AS (SELECT species_name FROM DG ORDER BY degree DESC, species_name LIMIT 60) SELECT src, dst, weight FROM ED WHERE src IN (FROM T) AND dst IN (FROM T)")
def top60_subgraph(spark, d):
    return network.top_subgraph(network.edges(_frequent(spark, d)))


# Index and reports

_COMP = ["richness", "shannon", "simpson", "richness_Trees", "richness_Shrubs", "richness_Herbs", "richness_Regeneration"]
_SC = _ALPHA + ', A AS (SELECT AL.*, SR.* EXCLUDE (plot_id), E.elevation, E.forest_type, E.longitude, E.latitude FROM AL LEFT JOIN SR USING (plot_id) LEFT JOIN E USING (plot_id)), Z AS (SELECT A.*, ' + ", ".join(
    f'CASE WHEN s_{i} IS NULL OR s_{i} = 0 THEN 0 ELSE ("{c}" - m_{i}) / s_{i} END AS z_{i}' for i, c in enumerate(_COMP)) + " FROM A, (SELECT " + ", ".join(
    f'avg("{c}") AS m_{i}, stddev_samp("{c}") AS s_{i}' for i, c in enumerate(_COMP)) + " FROM A)), SCI AS (SELECT *, " + " + ".join(f"coalesce(z_{i}, 0)" for i in range(len(_COMP))) + " AS sci FROM Z) "


def _sci(spark, d) -> DataFrame:
    a = v.alpha(spark, d).join(v.strata(spark, d), "plot_id", "left").join(v.env(spark, d), "plot_id", "left")
    return diversity.sci_index(stage(a, "alpha"), _COMP)


@query(_SC + "SELECT plot_id, round(z_0, 6) AS z_richness, round(z_1, 6) AS z_shannon, round(z_2, 6) AS z_simpson FROM SCI")
def z_scores(spark, d):
    return _sci(spark, d).select("plot_id", r("z_richness"), r("z_shannon"), r("z_simpson"))


@query(_SC + "SELECT plot_id, round(sci, 5) AS sci_index FROM SCI")
def sci_index(spark, d):
    return _sci(spark, d).select("plot_id", r("sci_index", 5))


@query(_SC + "SELECT forest_type, count(*) AS n, round(avg(sci), 5) AS mean, round(stddev_samp(sci), 5) AS sd, round(avg(sci) - 1.96::DOUBLE * stddev_samp(sci) / sqrt(count(*)), 5) AS ci_low, count(*) < 30 AS small_sample FROM SCI WHERE forest_type IS NOT NULL GROUP BY 1")
def sci_group_summary(spark, d):
    return diversity.group_summary(_sci(spark, d), "forest_type", "sci_index").select("forest_type", "n", r("mean", 5), r("sd", 5), r("ci_low", 5), "small_sample")


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query(_SC + ", RR AS (SELECT " + ", ".join(f"{_rank_sql(f'round({c}, 9)')} AS {c}" for c in ("richness", "shannon", "simpson")) + " FROM SCI) " + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS rho FROM RR" for a, b in (("richness", "shannon"), ("richness", "simpson"), ("shannon", "simpson"))))
def sci_component_spearman(spark, d):
    x = v.alpha(spark, d).select(*[F.round(c, 9).alias(c) for c in ("richness", "shannon", "simpson")])
    return stats.spearman_matrix(x, ["richness", "shannon", "simpson"]).select("var1", "var2", r("rho"))


@query(_SC + ", " + ", ".join(f"R{i} AS (SELECT corr(a, b) AS rho FROM (SELECT {_rank_sql('round(sci, 8)')} AS a, {_rank_sql(f'round(sci - coalesce(z_{i}, 0), 8)')} AS b FROM SCI))" for i in range(len(_COMP))) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS left_out, round(rho, 6) AS rho, CASE WHEN rho >= 0.95 THEN 'high' WHEN rho >= 0.90 THEN 'moderate' ELSE 'low' END AS stability FROM R{i}" for i, c in enumerate(_COMP)))
def sci_leave_one_out(spark, d):
    s = _sci(spark, d)
    x = s.select(F.round("sci_index", 8).alias("sci"), *[F.round(F.col("sci_index") - F.coalesce(f"z_{c}", F.lit(0.0)), 8).alias(f"w_{c}") for c in _COMP])
    x = stage(x, "scores")
    label = F.when(F.col("rho") >= 0.95, "high").when(F.col("rho") >= 0.90, "moderate").otherwise("low")
    out = None
    for c in _COMP:
        one = stats.spearman(x, "sci", f"w_{c}").select(F.lit(c).alias("left_out"), F.col("rho"), label.alias("stability"))
        out = one if out is None else out.unionByName(one)
    return out.select("left_out", r("rho"), "stability")


@query(_SC + "SELECT forest_type, count(*) AS n_plots, round(avg(richness), 6) AS mean_richness, round(avg(shannon), 6) AS mean_shannon, round(avg(sci), 5) AS mean_sci FROM SCI GROUP BY 1")
def group_report(spark, d):
    g = _sci(spark, d).groupBy("forest_type").agg(F.count("*").alias("n_plots"), F.avg("richness").alias("mr"), F.avg("shannon").alias("ms"), F.avg("sci_index").alias("mi"))
    return g.select("forest_type", "n_plots", r("mr", 6, "mean_richness"), r("ms", 6, "mean_shannon"), r("mi", 5, "mean_sci"))


@query(_SC + "SELECT plot_id, longitude, latitude, richness, round(sci, 5) AS sci_index FROM SCI WHERE longitude BETWEEN 88.55 AND 92.35 AND latitude BETWEEN 26.55 AND 28.55")
def spatial_master(spark, d):
    """Map points within the window and 0.15 degrees around it."""
    return _sci(spark, d).where("longitude between 88.55 and 92.35 and latitude between 26.55 and 28.55").select("plot_id", "longitude", "latitude", "richness", r("sci_index", 5))


@query(_SC + "SELECT round(-greatest(abs(quantile_cont(sci, 0.02)), abs(quantile_cont(sci, 0.98))), 5) AS low, round(greatest(abs(quantile_cont(sci, 0.02)), abs(quantile_cont(sci, 0.98))), 5) AS high FROM SCI")
def map_limits(spark, d):
    return raster.quantile_limits(_sci(spark, d), "sci_index", True).select(r("low", 5), r("high", 5))


@query(v.with_(v.E) + "SELECT forest_type AS \"class\", count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM E WHERE forest_type IS NOT NULL GROUP BY 1")
def class_percentages(spark, d):
    return raster.class_counts(v.env(spark, d), "forest_type").select("class", "n", r("pct"))


@query(_AE + "SELECT plot_id, count(elevation) OVER w AS rolling_n, round(CASE WHEN count(richness) OVER w >= 30 THEN avg(richness) OVER w END, 6) AS rolling_mean FROM AE WHERE elevation IS NOT NULL WINDOW w AS (ORDER BY elevation, plot_id ROWS BETWEEN 60 PRECEDING AND 59 FOLLOWING)")
def rolling_mean_120(spark, d):
    x = v.alpha_env(spark, d).where("elevation is not null").select("plot_id", "elevation", "richness")
    return diversity.rolling_by_rank(x, ["elevation", "plot_id"], "richness").select("plot_id", "rolling_n", r("rolling_mean"))


@query(v.with_(v.V) + "SELECT DISTINCT plot_id, stratum, species_name FROM V")
def distinct_records(spark, d):
    return v.veg(spark, d).select("plot_id", "stratum", "species_name").distinct()


@query(v.with_(v.V, v.AB) + "SELECT plot_id, species_name, round(abund / sum(abund) OVER (PARTITION BY plot_id), 9) AS share FROM AB WHERE abund > 0")
def abundance_share(spark, d):
    w = Window.partitionBy("plot_id")
    return v.abund(spark, d).where("abund > 0").select("plot_id", "species_name", r(F.col("abund") / F.sum("abund").over(w), 9, "share"))


@query(_AE + "SELECT 'richness' AS metric, avg(richness) AS value FROM AE UNION ALL SELECT 'plots', count(*)::DOUBLE FROM AE UNION ALL SELECT 'max_richness', max(richness)::DOUBLE FROM AE")
def summary_metrics(spark, d):
    a = v.alpha_env(spark, d).agg(F.avg("richness").alias("richness"), F.count("*").cast("double").alias("plots"), F.max("richness").cast("double").alias("max_richness"))
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in a.columns])).alias("m")).select("m.*")
