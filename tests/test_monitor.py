import io

import pytest
from pyspark.sql import functions as F

from florascope import monitor
from florascope.operators import network, ordination, regions, trend
from florascope.pipeline import Result
from florascope.sources import readers


def test_profiler_and_bottlenecks():
    p = monitor.Profiler()

    @p
    def slow(x):
        return sum(range(x))

    @p
    def bad():
        raise ValueError("no")

    assert slow(200_000) == sum(range(200_000)) and slow(10) == 45
    with pytest.raises(ValueError):
        bad()
    by = dict(p.top())
    assert {k.rpartition(".")[2]: (c.n, c.failed) for k, c in by.items()} == {"slow": (2, 0), "bad": (1, 1)}
    assert p.bottlenecks(1)[0].endswith("slow") and p.bottlenecks(101) == []


def test_track_counts_jobs(spark):
    with monitor.Track(spark, "tracked") as t:
        spark.range(100).repartition(3).count()
    assert t.usage.jobs >= 1 and t.usage.stages >= 1 and t.usage.tasks >= 3 and t.usage.seconds > 0 and t.usage.peak_mb > 1


def test_progress():
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    out = Terminal()
    assert list(monitor.progress(iter("abc"), 3, "x", out)) == ["a", "b", "c"] and "3/3" in out.getvalue()
    plain = io.StringIO()
    assert list(monitor.progress([1], 1, "x", plain)) == [1] and plain.getvalue() == ""


def test_checks(spark):
    df = spark.range(2).toDF("a")
    assert monitor.check_table(df, ["a"]) == [] and monitor.check_table(df, ["b"], 3) == ["column b is missing", "2 rows of at least 3"]
    assert monitor.check_result(Result("00", "ok")) == [] and len(monitor.check_result(Result("00", "fine", None, [], -1))) == 3
    said = monitor.check_setup(spark, "/nowhere", ["x"])
    assert said["missing_tables"] == ["x"] and not said["ok"] and said["spark"] == spark.version


def test_fallback_display_and_hubs(spark):
    v = spark.createDataFrame([("a", None), ("b", "clay")], "k string, s string")
    raster = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, s string")
    got = {r.k: (r.s, r.source) for r in regions.with_fallback(v, raster, "k", "s").collect()}
    assert got == {"a": (None, "vector"), "b": ("clay", "vector")}
    none = {r.k: (r.s, r.source) for r in regions.with_fallback(v.withColumn("s", F.lit(None).cast("string")), raster, "k", "s").collect()}
    assert none == {"a": ("1", "raster"), "b": ("2", "raster")}
    x = spark.createDataFrame([(1.0, -4.0), (2.0, 0.0)], "a double, b double")
    assert sorted(map(tuple, ordination.display_scaled(x, ["a", "b"], 0.85).collect())) == [pytest.approx((0.2125, -0.85)), pytest.approx((0.425, 0.0))]
    n = spark.createDataFrame([(f"s{i}", float(i // 2)) for i in range(10)], "species_name string, betweenness double")
    assert {r.species_name for r in network.hubs(n, 3).collect()} == {"s9", "s8", "s7", "s6"}


def test_trend_rasters_and_layers(spark, tmp_path):
    make = lambda v: spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "row long, col long, value double")
    slope, tau = make([0.1, -0.2, float("nan")]), make([0.8, -0.1, 0.0])
    given = {r.col: r for r in trend.trend_rasters(slope, tau, make([0.03, None, 0.5])).collect()}
    assert given[0].p == 0.03 and given[1].p is None and given[2].slope is None
    made = {r.col: r.p for r in trend.trend_rasters(slope, tau, make([None, float("nan"), None])).collect()}
    assert made[0] < 1e-6 and 0.4 < made[1] < 0.6 and made[2] == 1.0
    (tmp_path / "a.tif").write_bytes(b"x")
    layers = readers.discover_rasters(spark, str(tmp_path), {"bio1": str(tmp_path / "a.tif"), "bio2": str(tmp_path / "none.tif")}).collect()
    assert [r.variable for r in layers] == ["bio1"]
    (tmp_path / "bio_12.tif").write_bytes(b"x")
    assert [r.variable for r in readers.discover_rasters(spark, str(tmp_path), {"bio1": "x"}).collect()] == ["bio12"]
    assert readers.discover_rasters(spark, str(tmp_path / "nothing")).count() == 0


def test_reproject_regions(spark):
    wkt = "MULTIPOLYGON (((90 27, 90.5 27, 90.5 27.5, 90 27)), ((91 27, 91.5 27.25, 91 27)))"
    df = spark.createDataFrame([(1, wkt), (2, None)], "id int, wkt string")
    got = {r.id: r.wkt for r in regions.reproject_regions(df, "wkt", 32646).collect()}
    points = spark.createDataFrame([(90.0, 27.0), (91.5, 27.25)], "lon double, lat double")
    want = [f"{r.x} {r.y}" for r in regions.reproject(points, "lon", "lat", 32646).collect()]
    assert got[2] is None and got[1].startswith(f"MULTIPOLYGON ((({want[0]}, ") and f"{want[1]}, " in got[1] and got[1].endswith(")))")
    assert regions.reproject_regions(df, "wkt", 4326).where("id = 1").first().wkt == "MULTIPOLYGON (((90.0 27.0, 90.5 27.0, 90.5 27.5, 90.0 27.0)), ((91.0 27.0, 91.5 27.25, 91.0 27.0)))"
