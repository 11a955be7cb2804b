"""Tables, exports, manifests and reports written so that a reader never meets half of one."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .formats import write_gpkg


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet beside the target, then put in its place: a failed run leaves the old table."""
    spark = df.sparkSession
    tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(tmp)
    fs = spark._jvm.org.apache.hadoop.fs
    src, dst = fs.Path(tmp), fs.Path(path)
    f = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    f.delete(dst, True)
    if not f.rename(src, dst):
        raise OSError(f"{path} can't be replaced")


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file only for reports, as a single task writes it."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(path: str, payload: object, tries: int = 3) -> None:
    """Through a temporary file in the same folder; what JSON doesn't know is written as text."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    text = json.dumps(payload, indent=2, default=str)
    for k in range(tries):
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        try:
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(tmp, path)
            return
        except OSError:
            os.path.exists(tmp) and os.unlink(tmp)
            if k == tries - 1:
                raise
            time.sleep(0.1 * 2**k)


def read_json(path: str) -> dict:
    """What the file says, or nothing if it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def write_text(path: str, title: str, sections: dict[str, list[str]]) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{title}\n{'=' * len(title)}\n")
        for head, lines in sections.items():
            f.write(f"\n{head.upper()}\n{'-' * len(head)}\n" + "".join(f"{x}\n" for x in lines))


def export_gpkg(df: DataFrame, path: str, layer: str, lon: str = "longitude", lat: str = "latitude", most: int = 5_000_000) -> int:
    """Points with both coordinates as a GeoPackage: one file of one SQLite database, so at most `most` rows."""
    df = df.where(f"`{lon}` is not null and `{lat}` is not null")
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for one GeoPackage: write a table instead")
    write_gpkg(path, layer, [r.asDict() for r in df.toLocalIterator(True)], lon, lat)
    return n


def alias_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A second name for a table, without a second copy."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df
