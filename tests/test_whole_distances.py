import numpy as np
import pytest

from florascope.operators import distances, ordination, replicates
from florascope.plans import registry

SF = "/root/testdata/sf0.001"


def _table(spark):
    rng = np.random.default_rng(8)
    y = rng.poisson(0.6, (40, 30)).astype(float)
    y[:, 0] += 1
    y[7] = y[3]
    cells = spark.createDataFrame([(int(i), f"s{j}", float(y[i, j])) for i, j in zip(*np.nonzero(y), strict=True)], "i long, species_name string, abund double")
    return np.abs(y[:, None] - y[None]).sum(2) / (y[:, None] + y[None]).sum(2), cells, ["u"] * 13 + ["v"] * 17 + ["w"] * 10


def test_rows_with_and_without_dense_species(spark, monkeypatch):
    d, cells, _ = _table(spark)
    for dense in (0, 8 * 40 * 5, 64 << 20):
        monkeypatch.setattr(replicates, "DENSE_BYTES", dense)
        row = replicates.distance_rows(cells, 40)
        assert all(np.allclose(row(i), d[i, i + 1 :], atol=1e-12) for i in range(40))


def test_anosim_without_the_matrix(spark, monkeypatch):
    d, cells, labels = _table(spark)
    want = replicates.anosim_test(spark, d.round(10), labels, 49).first()
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 40 * 40 * 8 - 1)
    monkeypatch.setattr(replicates, "check_size", lambda *x: None)
    for size in (64 << 20, 0):
        monkeypatch.setattr(replicates, "LABEL_BYTES", size)
        assert tuple(replicates.anosim_blocks(cells, labels, 49).first()) == pytest.approx(tuple(want))
    got = distances.anosim_counts(replicates.distance_counts(cells, labels)).first()
    assert got.r == pytest.approx(want.observed) and got.n_pairs == 780
    assert replicates.anosim_blocks(cells, ["u"] * 40, 9).first().p is None


def test_mantel_without_matrices(spark, monkeypatch):
    d, cells, _ = _table(spark)
    rng = np.random.default_rng(9)
    lon, lat = 89 + 3 * rng.random(40), 27 + rng.random(40)
    lon[7], lat[7] = lon[3], lat[3]
    x, y = np.radians(lon), np.radians(lat)
    km = 2 * np.arcsin(np.sqrt(np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2))
    want = replicates.mantel_test(spark, d, km, 99).first()
    assert tuple(replicates.mantel_p_blocks(cells, lon, lat, 99).first()) == pytest.approx(tuple(want))


def test_coordinates_without_the_matrix(spark, monkeypatch):
    d, cells, _ = _table(spark)
    want = ordination.pcoa(spark, d, list(range(40)), 5)[0].orderBy("plot_id").toPandas().drop(columns="plot_id").to_numpy()
    assert np.allclose(ordination.pcoa_cells(cells, 40, 5), want, atol=1e-6)
    a = np.random.default_rng(10).normal(size=(300, 300))
    a = a + a.T
    monkeypatch.setattr(ordination, "MATRIX_BYTES", 0)
    w, v = ordination.top_eigenpairs(lambda x: a @ x, 300, 4)
    top = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(w, top) and np.abs(a @ v - v * w).max() < 1e-6


def test_metric_scaling_without_the_matrix(spark):
    d, cells, _ = _table(spark)
    for steps in (2, 6):
        got, stress = ordination.metric_rows(cells, 40, 2, 2, steps)
        want = min((ordination.smacof(d, 2, np.random.default_rng([42, a]), True, steps) for a in range(2)), key=lambda x: x[1])
        assert stress == pytest.approx(want[1]) and np.allclose(got, want[0])


def test_metric_scaling_above_the_matrix_limit(spark, monkeypatch):
    steps = ordination.metric_rows
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 1000)
    monkeypatch.setattr(replicates, "check_size", lambda *x: None)
    monkeypatch.setattr(ordination, "metric_rows", lambda cells, m: steps(cells, m, steps=2))
    rows = registry.QUERIES["pcoa_smacof"](spark, SF).collect()
    assert rows and rows[0].pct_1 + rows[0].pct_2 == pytest.approx(100)


@pytest.mark.parametrize("name", ["anosim_p", "mantel_p", "permdisp"])
def test_queries_hold_no_matrix(spark, monkeypatch, name):
    def no(*_):
        raise AssertionError("a whole matrix")

    monkeypatch.setattr(replicates, "distance_matrix", no)
    assert registry.QUERIES[name](spark, SF).count() >= 1


def test_anosim_r_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.delattr(registry.community.distances, "bray_curtis")
    assert registry.QUERIES["anosim_r"](spark, SF).first().n_pairs > 0


@pytest.mark.parametrize(("name", "made"), [("bray_curtis", "bray_curtis"), ("haversine_km", "haversine_pairs")])
def test_all_pairs_join_none(spark, monkeypatch, name, made):
    monkeypatch.delattr(registry.community.distances, made)
    rows = registry.QUERIES[name](spark, SF)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    ids = rows.select("id_a", "id_b").collect()
    assert len(ids) == len(set(ids)) and all(a < b for a, b in ids)
    n = len({x for r in ids for x in r})
    assert len(ids) == n * (n - 1) // 2


def test_half_up_as_spark_rounds(spark):
    x = np.concatenate([np.arange(2000) / 1280 + 1e-7 * 5, 1 - 2 * np.arange(640) / 1280, np.random.default_rng(1).random(500)])
    want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").selectExpr("i", "round(x, 6) AS r").orderBy("i").collect()
    assert replicates.half_up(x, 6).tolist() == [r.r for r in want]
