import dataclasses
import json

import pytest

from florascope import pipeline as p
from florascope.streaming import inventory

SF = "/root/testdata/sf0.001"


def test_ids_and_levels():
    assert len(p.REGISTRY) == 14
    assert [p.normalize_id(x) for x in ("1", "1b", "01B", " 11 ", "x")] == ["01", "01b", "01b", "11", "x"]
    assert p.levels(list(p.REGISTRY)) == [["00"], ["01"], ["01b", "02"], ["02b", "03", "05"], ["04", "06", "07", "09"], ["08"], ["10"], ["11"]]
    assert p.select(["9"]) == ["00", "01", "02", "03", "09"]
    assert p.levels(p.select(["4"])) == [["00"], ["01"], ["02"], ["03"], ["04"]]
    with pytest.raises(ValueError, match="unknown"):
        p.with_dependencies(["99"])
    a = p.Stage("a", "a", ("b",), p.inspection, ())
    circle = {"a": a, "b": dataclasses.replace(a, id="b", deps=("a",))}
    with pytest.raises(ValueError, match="Circular"):
        p.levels(["a", "b"], circle)
    with pytest.raises(ValueError, match="Circular"):
        p.levels(["04"])


def test_run_cache_and_dry_run(spark, tmp_path):
    c = p.Context(spark, SF, str(tmp_path))
    plan = p.dry_run(c, ["3"])
    assert plan["missing_inputs"] == [] and plan["sequential_s"] >= plan["parallel_s"] > 0
    got = {x.id: x for x in p.run(c, ["9"])}
    assert {x.status for x in got.values()} == {"ok"} and c.table("09", "sci").count() > 10
    assert {x.status for x in p.run(c, ["9"])} == {"cached"}
    other = p.Context(spark, SF, str(tmp_path), dataclasses.replace(p.DEFAULTS, iqr_multiplier=2.0))
    assert p.run(other, ["0"])[0].status == "ok"
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert m["results"][0]["id"] == "00" and (tmp_path / "report.txt").exists()


def test_failures(spark, tmp_path):
    def bad(c):
        raise RuntimeError("no")

    reg = {
        "00": p.Stage("00", "bad", (), bad, ("x",)), "01": p.Stage("01", "after", ("00",), p.inspection, ("files",)),
        "02": p.Stage("02", "later", ("01",), p.inspection, ("files",)), "03": p.Stage("03", "free", (), p.inspection, ("files",)),
    }
    c = p.Context(spark, SF, str(tmp_path))
    assert {x.id: x.status for x in p.run(c, go_on=True, registry=reg)} == {"00": "failed", "01": "skipped", "02": "skipped", "03": "ok"}
    assert {x.id for x in p.run(c, registry=reg, use_cache=False)} == {"00", "03"}


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "a", 1.0, "2024-01-01 10:00:00"), (1, "a", 1.0, "2024-01-01 10:00:00"), (2, "a", 3.0, "2024-01-01 11:00:00"), (3, "a", 9.0, "2024-03-01 11:00:00")], "id long, k string, value double, ts string")
    df.selectExpr("id", "k", "value", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(src))
    s = inventory.stream_table(spark, str(src), "id long, k string, value double, ts timestamp")
    inventory.run_available(inventory.first_records(s, "ts", ["id"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3]
    inventory.run_available(inventory.windowed_counts(s, "ts", ["k"]), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert [(r.n, round(r.mean_value, 3)) for r in spark.read.parquet(str(tmp_path / "o2")).collect()] == [(3, 1.667)]
