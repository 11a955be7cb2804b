import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from florascope.functions import special
from florascope.operators import clean, distances, diversity, indicators, network, ordination, ranks, raster, regions, replicates, stats, trend


def test_special_functions():
    assert special.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and special.f_sf(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.hypergeom_upper(3, 10, 4, 5) == pytest.approx((4 * 15 + 1 * 6) / 252)
    assert special.hypergeom_upper(0, 10, 4, 5) == pytest.approx(1.0)


def _alpha(spark, vec):
    return diversity.alpha_diversity(spark.createDataFrame([("p", f"s{i}", float(x)) for i, x in enumerate(vec)], "plot_id string, species_name string, abund double")).first()


@pytest.mark.parametrize(("vec", "h", "d"), [
    ([0] * 5, 0, 0), ([10], 0, 0), ([1, 1], math.log(2), 0.5), ([1] * 5, math.log(5), 0.8), ([1, 1, 1, 0, 0], math.log(3), 2 / 3),
])
def test_alpha_closed_forms(spark, vec, h, d):
    r = _alpha(spark, vec)
    assert r.shannon == pytest.approx(h, abs=1e-12) and r.simpson == pytest.approx(d, abs=1e-12) and r.richness == sum(x > 0 for x in vec)
    s = _alpha(spark, [3 * x for x in vec])
    assert s.shannon == pytest.approx(r.shannon) and s.simpson == pytest.approx(r.simpson)


def test_abundance_and_strata(spark):
    v = spark.createDataFrame([("1", "A b", "Trees", None), ("1", "A b", "Trees", 2.0), ("1", "C d", "Herbs", float("nan")), ("2", "A b", None, 1.0)], "plot_id string, species_name string, stratum string, abundance double")
    assert {tuple(r) for r in diversity.abundance(v).collect()} == {("1", "A b", 3.0), ("1", "C d", 1.0), ("2", "A b", 1.0)}
    assert [tuple(r) for r in diversity.stratum_richness(v).collect()] == [("1", 1, 0, 1, 0)]
    with pytest.raises(RuntimeError):
        diversity.guarded_left_join(v, v, "plot_id")


def test_z_scores(spark):
    df = spark.createDataFrame([(float(i), 7.0, None if i == 3 else float(i)) for i in range(1, 6)], "x double, c double, n double")
    rows = diversity.sci_index(df, ["x", "c", "n"]).collect()
    assert sum(r.z_x for r in rows) == pytest.approx(0) and np.std([r.z_x for r in rows], ddof=1) == pytest.approx(1)
    assert all(r.z_c == 0 for r in rows) and [r.z_n for r in rows].count(None) == 1
    assert sum(r.sci_index for r in rows) == pytest.approx(0, abs=1e-9)
    assert diversity.z_scores(df.limit(1), ["x"]).first().z_x == 0


def test_indval_matrix(spark):
    m = [(5, 0, 2), (4, 0, 1), (6, 0, 3), (0, 5, 1), (0, 6, 2), (0, 4, 1)]
    pres = spark.createDataFrame([(str(i), f"sp_{'ABC'[j]}") for i, r in enumerate(m) for j, x in enumerate(r) if x], "plot_id string, species_name string")
    grp = spark.createDataFrame([(str(i), "forest_A" if i < 3 else "forest_B") for i in range(6)], "plot_id string, grp string")
    got = {r.species_name: r for r in indicators.indval(pres, grp).collect()}
    assert got["sp_A"].stat == pytest.approx(1) and got["sp_B"].group == "forest_B" and got["sp_C"].stat == pytest.approx(0.5) and got["sp_C"].group == "forest_A"
    occ = (np.array(m) > 0).astype(float)
    p = {r.species_name: r for r in replicates.indval_test(spark, occ, ["a", "b", "c"], ["A"] * 3 + ["B"] * 3, 99).collect()}
    assert 0 < p["a"].p < 0.35 and p["c"].p == pytest.approx(1.0)
    again = {r.species_name: r.p for r in replicates.indval_test(spark, occ, ["a", "b", "c"], ["A"] * 3 + ["B"] * 3, 99).collect()}
    assert again == {k: r.p for k, r in p.items()}


def test_ranks_and_bh(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 30, 500) / 100
    df = spark.createDataFrame([(i, float(x) if i % 50 else None) for i, x in enumerate(v)], "i long, p double")
    import pandas as pd

    s = pd.Series([x if i % 50 else None for i, x in enumerate(v)], dtype=float)
    want = s.rank()
    got = {r.i: r["rank"] for r in ranks.average_ranks(df, "p").collect()}
    assert all((got[i] is None and want.isna()[i]) or got[i] == pytest.approx(want[i]) for i in got)
    ok = s.dropna().sort_values()
    adj = (ok * len(ok) / np.arange(1, len(ok) + 1))[::-1].cummin().clip(upper=1)[::-1]
    q = {r.i: r.p_adj for r in ranks.bh_adjust(df, "p").collect()}
    assert all(q[i] == pytest.approx(adj[i]) for i in adj.index) and q[0] is None
    n = {r.i: r.n for r in ranks.global_row_number(df, ["p", "i"], "n").collect()}
    assert sorted(n.values()) == list(range(500))


def test_rank_tests(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("c", 1.0)], "g string, v double")
    k = stats.kruskal_wallis(df, "g", "v").first()
    assert k.h == pytest.approx(3.857142857) and k.k == 2 and k.p == pytest.approx(0.0495, abs=1e-3)
    assert stats.kruskal_wallis(df.where("g = 'a'"), "g", "v").first().h is None
    d = stats.dunn(df, "g", "v").first()
    assert abs(d.z) == pytest.approx(math.sqrt(k.h)) and d.p_adj == pytest.approx(d.p)
    s = stats.spearman(spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "x double, y double"), "x", "y").first()
    assert s.rho == pytest.approx(1) and s.p == 0
    line = stats.ols(spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)], "x double, y double"), "x", "y").first()
    assert line.slope == pytest.approx(2) and line.intercept == pytest.approx(1) and line.r2 == pytest.approx(1)
    assert stats.spearman(df.withColumn("c", F.lit(1.0)), "v", "c").first().rho is None


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.poisson(1.0, (12, 8)).astype(float)
    y[:, 0] += 1
    ab = spark.createDataFrame([(f"{i:02d}", f"s{j}", float(y[i, j])) for i in range(12) for j in range(8)], "plot_id string, species_name string, abund double")
    pairs = distances.bray_curtis(ab)
    ids = [f"{i:02d}" for i in range(12)]
    m = replicates.distance_matrix(pairs, ids)
    for i in range(12):
        for j in range(12):
            assert m[i, j] == pytest.approx(np.abs(y[i] - y[j]).sum() / (y[i] + y[j]).sum(), abs=1e-12)
    lab = ["a"] * 6 + ["b"] * 6
    g = spark.createDataFrame(list(zip(ids, lab, strict=True)), "plot_id string, grp string")
    f = distances.permanova(pairs, g).first()
    assert replicates.permanova_test(spark, m, lab, 49).first().observed == pytest.approx(f.f)
    assert replicates.anosim_test(spark, m, lab, 49).first().observed == pytest.approx(distances.anosim(pairs, g).first().r)
    p = replicates.mantel_test(spark, m, m, 49).first()
    assert p.observed == pytest.approx(1) and p.p == pytest.approx(1 / 50)
    x, share = ordination.pcoa(spark, m, ids, 11)
    c = x.orderBy("plot_id").toPandas().drop(columns="plot_id").to_numpy()
    assert share.sum() == pytest.approx(1) and c.shape == (12, 11)
    assert 0 < replicates.permdisp_test(spark, c[:, :3], lab, 49).first().p <= 1
    two, stress = ordination.nmds(spark, m, ids, 2, starts=4)
    assert two.count() == 12 and 0 < stress < 0.4


def test_smacof_recovers_a_plane():
    x = np.random.default_rng(2).normal(size=(15, 2))
    d = ordination._euclid(x)
    best = min((ordination.smacof(d, 2, np.random.default_rng(s), metric=True, steps=500) for s in range(4)), key=lambda r: r[1])
    assert best[1] < 0.01
    assert ordination.isotonic(np.array([1.0, 3, 2, 2, 5])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])


def test_cca_against_dense(spark):
    rng = np.random.default_rng(3)
    y = rng.poisson(2.0, (20, 9)).astype(float)
    y[:, 0] += 1
    x = rng.normal(size=(20, 3))
    ab = spark.createDataFrame([(f"{i:02d}", f"s{j}", float(y[i, j])) for i in range(20) for j in range(9)], "plot_id string, species_name string, abund double")
    env = spark.createDataFrame([(f"{i:02d}", *map(float, x[i])) for i in range(20)], "plot_id string, a double, b double, c double")
    fit = ordination.cca(ab, env, ["a", "b", "c"])
    assert fit["eigenvalues"] == pytest.approx(ordination._cca_eig(y, x)[:3])
    e = np.outer(y.sum(1), y.sum(0)) / y.sum()
    assert fit["inertia"] == pytest.approx(((y - e) ** 2 / e).sum() / y.sum()) and fit["share_constrained"].sum() == pytest.approx(100)
    t = ordination.cca_test(spark, y, x, 49).collect()
    assert all(0 < r.p <= 1 and r.n == 49 for r in t)
    v = {r.variable: r.vif for r in ordination.vif(env.withColumn("d", F.col("a") * 2), ["a", "b", "d"]).collect()}
    assert v["a"] is None and v["b"] == pytest.approx(1, abs=0.5)
    part = {r.component: r.adj_r2 for r in ordination.variance_partition(spark, y, {"climate": x[:, :1], "topography": x[:, 1:]}).collect()}
    assert part["full"] + part["unexplained"] == pytest.approx(1)


def test_network(spark):
    e = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("c", "d", 3), ("d", "e", 5), ("e", "f", 5), ("d", "f", 5)], "src string, dst string, weight long")
    names, near = network.adjacency(e)
    lab = network.louvain(near)
    assert len(set(lab)) == 2 and lab[0] == lab[1] == lab[2] and lab[3] == lab[4] == lab[5]
    labels = spark.createDataFrame([(n, int(c)) for n, c in zip(names, lab, strict=True)], "species_name string, community int")
    assert network.modularity(e, labels).first().q == pytest.approx(network.graph_modularity(near, lab))
    b = {r.species_name: r.betweenness for r in network.betweenness(spark, names, near).collect()}
    assert b["c"] == b["d"] == pytest.approx(2 * 6 / 20) and b["a"] == 0
    m = (np.random.default_rng(4).random((30, 12)) < 0.4).astype(np.int8)
    s = network.swap_null(m, np.random.default_rng(5))
    assert (s.sum(0) == m.sum(0)).all() and (s.sum(1) == m.sum(1)).all() and (s != m).any()
    r = network.null_modularity(spark, m, 2, 9).first()
    assert 0 <= r.p <= 1 and r.null_sd >= 0


def test_trend_and_raster(spark):
    ts = spark.createDataFrame([(1, t, float(2 * t)) for t in range(10)] + [(2, t, 5.0) for t in range(4)] + [(3, 0, 1.0)], "pixel long, t int, value double")
    assert {r.pixel: r.slope for r in trend.theil_sen(ts).collect()} == {1: 2.0, 2: 0.0}
    mk = {r.pixel: r for r in trend.mann_kendall(ts).collect()}
    assert mk[1].s == 45 and mk[1].tau == 1 and mk[2].s == 0 and mk[3].tau is None
    var = {r.pixel: r.var_s for r in trend.mk_variance_with_ties(ts).collect()}
    assert var[1] == pytest.approx(10 * 9 * 25 / 18) and var[2] == 0
    assert {r.pixel: r.tied for r in trend.tie_flags(ts).collect()} == {1: False, 2: True}
    g = spark.createDataFrame([(r, c, float(3 * c)) for r in range(5) for c in range(5)], "row long, col long, value double")
    h = raster.horn(g, 3.0, 3.0).collect()
    assert len(h) == 9 and all(x.slope == pytest.approx(45) and x.aspect == pytest.approx(180) for x in h)
    a = np.random.default_rng(6).normal(size=(6, 6))
    i = raster.morans_i(spark.createDataFrame([(r, c, float(a[r, c])) for r in range(6) for c in range(6)], "row long, col long, value double")).first()
    lag, k = np.zeros((6, 6)), np.zeros((6, 6))
    for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)):
        for r in range(6):
            for c in range(6):
                if 0 <= r + dr < 6 and 0 <= c + dc < 6:
                    lag[r, c] += a[r + dr, c + dc]
                    k[r, c] += 1
    z, w = a - a.mean(), lag / k
    assert i.i == pytest.approx(float((z * (w - w.mean())).sum() / (z * z).sum() / 4)) and 0 <= i.p <= 1
    assert raster.morans_i(g.limit(5)).first().i is None


def test_cleaning(spark):
    df = spark.createDataFrame([("D'ORSAY-x  (l.)\t b2b",)], "s string")
    assert df.select(clean.clean_species(F.col("s"))).first()[0] == "D'Orsay-X (L.) B2B"
    w = clean.standardize_columns(spark.createDataFrame([(1, 2, "x")], "Plot_ID long, ForTyp long, SpeciesName string"))
    assert w.columns == ["plot_id", "forest_type", "species_name"] and dict(w.dtypes)["forest_type"] == "string"
    with pytest.raises(ValueError, match="not found"):
        clean.require_columns(df, ["nope"])
    r = spark.createDataFrame([(90.0, 27.5)], "lon double, lat double")
    x = regions.reproject(r, "lon", "lat", 32646).first()
    assert x.x == pytest.approx(203559.9, abs=1500) and x.y == pytest.approx(3044800, abs=3000)
    assert regions.reproject(r, "lon", "lat", 4326).first().x == 90.0
    with pytest.raises(ValueError):
        regions.reproject(r, "lon", "lat", 3857)
