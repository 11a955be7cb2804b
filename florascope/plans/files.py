"""Queries that write the test tables in each file format, read them again through the library's readers and return what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean
from ..session import read, shared_dir
from ..sources import readers, sinks
from .community import r

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _path(spark, name: str) -> str:
    """A new path in the shared folder; formats that need a real file get the local part of its address."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}-{name}"


@query("SELECT unit_id, gridcode::INT AS gridcode, soil_type, geometry_wkt FROM soil_map_vector")
def csv_round_trip(spark, d):
    """CSV sink and scan with a schema; quotes and commas inside the texts survive."""
    path = _path(spark, "soils")
    sinks.export_csv(read(spark, d, "soil_map_vector"), path)
    return readers.read_csv(spark, path, "unit_id string, gridcode int, soil_type string, geometry_wkt string")


@query("SELECT forest_type, count(*) AS n, round(avg(longitude), 7) AS mean_lon FROM veg_long_csv WHERE forest_type IS NOT NULL GROUP BY 1")
def table_round_trip(spark, d):
    """Atomic table sink, written twice: the second run replaces the first."""
    path = _path(spark, "veg")
    veg = read(spark, d, "veg_long_csv").select("record_id", "forest_type", "longitude")
    sinks.write_table(veg.limit(1), path)
    sinks.write_table(veg, path)
    return spark.read.parquet(path).where("forest_type is not null").groupBy("forest_type").agg(F.count("*").alias("n"), r(F.avg("longitude"), 7, "mean_lon"))


@query("""SELECT fid::BIGINT AS point_id, plot_id, round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM plot_points_gpkg
WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(longitude) AND NOT isnan(latitude)""")
def gpkg_round_trip(spark, d):
    """Point layer written as a GeoPackage and scanned again."""
    path = _path(spark, "points.gpkg").removeprefix("file://").removeprefix("file:")
    points = read(spark, d, "plot_points_gpkg").where("not isnan(longitude) and not isnan(latitude)").select(F.col("fid").alias("point_id"), "plot_id", "longitude", "latitude")
    sinks.export_gpkg(points, path, "plots")
    x = readers.read_points(spark, path, path + ".csv", ["point_id", "plot_id"])
    return x.select(F.col("point_id").cast("long").alias("point_id"), "plot_id", r("longitude", 7), r("latitude", 7))


@query("SELECT dzongkhag AS district, count(*)::BIGINT AS n FROM env_master_csv WHERE dzongkhag IS NOT NULL GROUP BY 1")
def json_round_trip(spark, d):
    """A summary as an atomic JSON file, and read back."""
    path = _path(spark, "summary.json").removeprefix("file://").removeprefix("file:")
    rows = read(spark, d, "env_master_csv").where("dzongkhag is not null").groupBy("dzongkhag").agg(F.count("*").alias("n")).collect()
    sinks.write_json(path, {x.dzongkhag: x.n for x in rows})
    return spark.createDataFrame(sorted(sinks.read_json(path).items()), "district string, n long")


@query("SELECT unnest(['env_master_csv', 'nothing_here', 'veg_long_csv']) AS name, unnest([true, false, true]) AS found, unnest(['parquet', 'parquet', 'parquet']) AS kind")
def inventory_of_files(spark, d):
    """File inventory: what is there and what is missing."""
    names = ["env_master_csv", "nothing_here", "veg_long_csv"]
    f = readers.file_inventory(spark, [f"{d}/{n}.parquet" for n in names])
    kind = F.when(F.col("kind") == "directory", "parquet").otherwise(F.col("kind"))
    return f.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "found", kind.alias("kind"))


@query("SELECT count(*) FILTER (found) AS available, count(*) FILTER (NOT found) AS missing FROM (SELECT unnest([true, false, true]) AS found)")
def inventory_counts(spark, d):
    return inventory_of_files(spark, d).agg(F.count_if("found").alias("available"), F.count_if(~F.col("found")).alias("missing"))


@query("SELECT 'veg_long_csv' AS name, 'there' AS state UNION ALL SELECT 'nothing_here', 'missing'")
def optional_scan(spark, d):
    """An optional table is none where its file is missing; the head check reads a few rows only."""
    parquet = lambda s, p: s.read.parquet(p)
    out = []
    for n in ("veg_long_csv", "nothing_here"):
        df = readers.read_optional(spark, f"{d}/{n}.parquet", parquet)
        out.append((n, "missing" if df is None else "there" if readers.head_check(df, ["plot_id", "species_name"]) else "empty"))
    return spark.createDataFrame(out, "name string, state string")


@query("SELECT round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 8) AS median, round(stddev_samp(value) / avg(value) * 100, 6) AS cv_percent FROM events")
def country_series(spark, d):
    """The series whose header is 'evi' in any spelling, out of a CSV table read as text."""
    path = _path(spark, "country")
    sinks.export_csv(read(spark, d, "events").select(F.col("value").alias(" EVI "), "user_id"), path)
    return readers.country_series(readers.read_csv(spark, path)).select(r("mean", 8), r("median", 8), r("cv_percent"))


@query("SELECT plot_id, species_name, NULL::VARCHAR AS remarks FROM veg_long_csv WHERE plot_id IS NOT NULL")
def canonical_columns(spark, d):
    """Headers in free spelling brought to the canonical ones; a column the table lacks is added as null."""
    x = clean.standardize_columns(read(spark, d, "veg_long_csv").select(F.col("plot_id").alias("Plot ID"), F.col("species_name").alias("Species Name")))
    clean.require_columns(x, ["plot_id", "species_name"])
    return clean.add_missing(x, ["remarks"], "string").where("plot_id is not null").select("plot_id", "species_name", "remarks")
