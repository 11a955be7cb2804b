import numpy as np
import pytest

from florascope.operators import ordination, replicates
from florascope.plans import registry
from florascope.plans import views

SF = "/root/testdata/sf0.001"


def _table(spark):
    rng = np.random.default_rng(3)
    y = rng.poisson(0.7, (24, 9)).astype(float)
    y[:, 0] += 1
    x = rng.normal(size=(24, 3))
    cells = spark.createDataFrame([(int(i), f"p{i:02d}", f"s{j}", float(y[i, j])) for i, j in zip(*np.nonzero(y), strict=True)], "i long, plot_id string, species_name string, abund double")
    env = spark.createDataFrame([(f"p{i:02d}", *map(float, x[i])) for i in range(24)], "plot_id string, a double, b double, c double")
    return y, x, cells, env


def test_sparse_tests_equal_dense_ones(spark, monkeypatch):
    y, x, cells, env = _table(spark)
    monkeypatch.setattr(replicates, "CELLS", 20)
    want, got = ordination.cca_test(spark, y, x, 99).collect(), ordination.cca_test_cells(cells, x, 99).collect()
    assert [tuple(r) for r in got] == [(r.axis, pytest.approx(r.eigenvalue), r.n, pytest.approx(r.p)) for r in want]
    groups = {"climate": ["a"], "topography": ["b", "c"]}
    part = {r.component: r.adj_r2 for r in ordination.variance_partition(spark, y, {"climate": x[:, :1], "topography": x[:, 1:]}).collect()}
    assert {r.component: r.adj_r2 for r in ordination.variance_partition_cells(cells, env, groups).collect()} == pytest.approx(part)
    d = np.abs(y[:, None] - y[None]).sum(2) / (y[:, None] + y[None]).sum(2)
    labels = ["u"] * 9 + ["v"] * 15
    assert tuple(replicates.permanova_blocks(cells, labels, 49).first()) == pytest.approx(tuple(replicates.permanova_test(spark, d, labels, 49).first()))


def test_plots_are_the_units(spark):
    q = lambda n: registry.QUERIES[n](spark, SF)
    plots = {r.plot_id for r in views.abund(spark, SF).where("abund > 0").select("plot_id").distinct().collect()}
    for name in ("cca_site_scores", "pcoa_eigen"):
        rows = q(name).collect()
        assert {r.plot_id for r in rows} == plots and all(x is not None for r in rows for x in r)
    assert [r.eigenvalue for r in q("cca_permutation").collect()] == pytest.approx([r.eigenvalue for r in q("cca_axes").orderBy("axis").collect()[:2]])
    assert q("permanova_p").first().observed == pytest.approx(q("permanova_f").first().f, abs=1e-5)
    assert q("anosim_p").first().observed == pytest.approx(q("anosim_r").first().r, abs=1e-5)
    assert q("mantel_p").first().observed == pytest.approx(abs(q("mantel_r").first().r), abs=1e-5)


def test_permanova_and_mantel_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.delattr(registry.community.distances, "bray_curtis")
    monkeypatch.delattr(registry.community.distances, "haversine_pairs")
    want = {"permanova_f": ("f", "n", "k"), "permanova_r2": ("r2",), "mantel_r": ("r", "n_pairs")}
    rows = {n: registry.QUERIES[n](spark, SF).collect() for n in want}
    assert all(len(x) == 1 and x[0].__fields__ == list(want[n]) for n, x in rows.items())
    f, n, k = rows["permanova_f"][0]
    assert rows["permanova_r2"][0].r2 == pytest.approx(f * (k - 1) / (f * (k - 1) + n - k), abs=1e-6)
