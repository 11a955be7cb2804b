"""DataFrames over files: tables, workbooks, GeoPackages, shapefiles and rasters, each a Spark data source of its own.

Files travel as Spark reads them (binaryFile), so any file system Spark knows will do; they are decoded in the tasks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Affine
from .formats import GeoTiff, dbf_rows, gpkg_rows, shp_shapes, xlsx_rows, xlsx_sheets


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema one pass; without one, all columns as text (nothing is inferred from the data)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.csv(path)


def read_optional(spark: SparkSession, path: str, reader: Callable[[SparkSession, str], DataFrame] = read_csv) -> DataFrame | None:
    """None where there is no such file."""
    return reader(spark, path) if exists(spark, path) else None


def head_check(df: DataFrame, columns: list[str], rows: int = 5) -> int:
    """Rows among the first few; raises for missing columns. Reads no more than that."""
    if gone := set(columns) - set(df.columns):
        raise ValueError(f"columns not found: {', '.join(sorted(gone))}")
    return len(df.select(*columns).limit(rows).collect())


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_xlsx(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """The named columns of a sheet as text; columns it lacks are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = [[r.get(c) for c in columns] for r in xlsx_rows(bytes(data), sheet)]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return _files(spark, path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def read_inventory_workbook(spark: SparkSession, path: str, columns: list[str], strata: tuple[str, ...] = ("Trees", "Shrubs", "Herbs", "Regeneration")) -> DataFrame:
    """All strata sheets of a workbook in one table with their stratum; raises if it has none of them."""
    from ..operators.clean import union_strata

    # A workbook's directory of sheets is a few hundred bytes; only its names come to the driver.
    names = _files(spark, path).select("content").rdd.flatMap(lambda r: list(xlsx_sheets(bytes(r.content)))).distinct().collect()
    found = [s for s in strata if s in names]
    if not found:
        raise ValueError(f"{path} has none of the sheets {', '.join(strata)}")
    return union_strata({s: read_xlsx(spark, path, s, columns) for s in found})


def read_gpkg(spark: SparkSession, path: str, columns: list[str], layer: str | None = None) -> DataFrame:
    """Features with the named attributes as text and geometry_wkt; SQLite needs a real file, so each task writes its own copy."""
    names = [*columns, "geometry_wkt"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
                    f.write(bytes(data))
                    f.flush()
                    rows = [[None if r.get(c) is None else str(r[c]) for c in names] for r in gpkg_rows(f.name, layer)]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return _files(spark, path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in names))


def read_points(spark: SparkSession, gpkg: str, fallback_csv: str, columns: list[str]) -> DataFrame:
    """Points of a GeoPackage with longitude and latitude; of the CSV table where it is missing, unreadable or empty."""
    try:
        if exists(spark, gpkg):
            xy = F.regexp_extract_all("geometry_wkt", F.lit(r"[-+0-9.eE]+(?=[ )])"), F.lit(0))
            df = read_gpkg(spark, gpkg, columns).withColumns({"longitude": F.get(xy, F.lit(0)).cast("double"), "latitude": F.get(xy, F.lit(1)).cast("double")})
            if df.limit(1).count():
                return df.drop("geometry_wkt")
    except Exception as e:  # noqa: BLE001 - a corrupt file is what the fallback is for
        print(f"{gpkg} can't be read ({type(e).__name__}); reading {fallback_csv}")
    return read_csv(spark, fallback_csv).select(*columns, F.col("longitude").cast("double"), F.col("latitude").cast("double"))


def read_shapefile(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Shapes with the named attributes as text and geometry_wkt; path ends in .shp, its .dbf lies beside it."""
    names = [*columns, "geometry_wkt"]
    folder, base = os.path.split(path)
    stem = base[: -len(".shp")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by = {p[-4:].lower(): bytes(c) for p, c in zip(pdf["path"], pdf["content"], strict=True)}
        rows = [[None if a.get(c) is None else str(a[c]) for c in columns] + [g] for a, g in zip(dbf_rows(by[".dbf"]), shp_shapes(by[".shp"]), strict=True)]
        return pd.DataFrame(rows, columns=names, dtype=object)

    files = _files(spark, folder, f"{stem}.*").where(F.lower("path").rlike(r"\.(shp|dbf)$")).select("path", "content")
    return files.groupBy(F.regexp_replace("path", r"\.[^.]*$", "")).applyInPandas(run, ", ".join(f"`{c}` string" for c in names))


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, Affine]:
    """(band, row, col, value) of a raster and where it lies; cells without a value are left out. Blocks are decoded as they come."""
    head = GeoTiff(bytes(_files(spark, path).select("content").first()[0]))
    grid = Affine(head.x0, head.y0, head.xres, head.yres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                t = GeoTiff(bytes(data))
                for k in range(len(t)):
                    for band, rows, cols, v in t.block(k):
                        ok = v == v
                        yield pd.DataFrame({"band": band, "row": rows[ok], "col": cols[ok], "value": v[ok]})

    return _files(spark, path).select("content").mapInPandas(run, "band int, row long, col long, value double"), grid


def discover_rasters(spark: SparkSession, folder: str, fallback: dict[str, str] | None = None) -> DataFrame:
    """(path, variable) of the files bio<number>.tif of a folder; contents aren't read.

    fallback: paths by variable, used where the folder is missing or holds no such file; those that don't exist are left out.
    """
    schema = "path string, variable string"
    found = spark.createDataFrame([], schema)
    if exists(spark, folder):
        f = _files(spark, folder, "*.tif").select("path")
        n = F.regexp_extract(F.lower(F.element_at(F.split("path", "/"), -1)), r"bio_?(\d+)", 1)
        found = f.where(n != "").select("path", F.concat(F.lit("bio"), n.cast("int")).alias("variable"))
    if fallback and not found.limit(1).count():
        return spark.createDataFrame([(p, v) for v, p in fallback.items() if exists(spark, p)], schema)
    return found


def country_series(df: DataFrame) -> DataFrame:
    """One row (mean, median, cv_percent) of the column whose normalised header is 'evi'."""
    from ..operators.clean import normalize_header, to_number

    name = next((c for c in df.columns if normalize_header(c) == "evi"), None)
    if name is None:
        raise ValueError("no column called evi")
    x = to_number(F.col(f"`{name}`"))
    return df.agg(F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), (F.try_divide(F.stddev_samp(x), F.avg(x)) * 100).alias("cv_percent"))


def file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind, found, size, modified) of the given files, without reading them."""
    rows = []
    fs = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        hp = fs.Path(p)
        f = hp.getFileSystem(spark._jsc.hadoopConfiguration())
        ok = bool(f.exists(hp))
        s = f.getFileStatus(hp) if ok else None
        kind = "directory" if ok and s.isDirectory() else os.path.splitext(p)[1].lstrip(".").lower() or "file"
        rows.append((p, kind, ok, s.getLen() if ok else None, s.getModificationTime() / 1000 if ok else None))
    return spark.createDataFrame(rows, "path string, kind string, found boolean, size long, modified double")
