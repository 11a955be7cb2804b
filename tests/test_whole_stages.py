from pathlib import Path

import pytest

from florascope import pipeline as p

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    c = p.Context(spark, SF, str(tmp_path_factory.mktemp("stages")))
    got = p.run(c, ["5", "11"])
    assert {x.status for x in got} == {"ok"}, got
    return c


def test_ordination_takes_all_plots_and_predictors(ran):
    plots = {r.plot_id for r in ran.table("01", "abundance").where("abund > 0").select("plot_id").distinct().collect()}
    sites = ran.table("05", "sites").collect()
    assert {r.plot_id for r in sites} == plots and all(x is not None for r in sites for x in r)
    assert {r.variable for r in ran.table("05", "vif").collect()} == {"elevation", "slope", "bio1", "bio12", "aspect_northness", "aspect_eastness"}


def test_stages_give_their_products(ran):
    assert 0 < ran.table("04", "permanova").first().p <= 1
    assert {r.axis for r in ran.table("05", "permutation").collect()} == {1, 2} and ran.table("05", "partition").count() > 5
    species = ran.table("01", "abundance").where("abund > 0").select("species_name").distinct().count()
    assert ran.table("05", "species").count() == species
    assert all(0 < r.p <= r.p_adj <= 1 for r in ran.table("06", "indval").collect())
    nodes = ran.table("07", "nodes").collect()
    assert nodes and all(r.community >= 1 and r.betweenness >= 0 for r in nodes) and 0 <= ran.table("07", "null_model").first().p <= 1
    assert {"src", "dst", "p_adj"} <= set(ran.table("07", "pairs").columns)
    assert ran.table("08", "areas_fdr").count() == 4
    s = ran.table("09", "sensitivity").collect()
    assert len(s) >= 3 and all(r.interpretation for r in s if r.rho is not None)


def test_dense_products_soils_maps_and_reports(ran):
    scores = ran.table("04", "scores")
    assert scores.count() > 10 and {"NMDS1", "NMDS2", "stress", "PCo1", "elevation", "soil_type"} <= set(scores.columns)
    assert all(0 < ran.table("04", t).first().p <= 1 for t in ("permdisp", "anosim", "mantel"))
    e = ran.table("02", "env_master")
    assert e.where("longitude between 88.7 and 92.2 and latitude between 26.7 and 28.4 and (soil_unit is null or soil_type is null)").count() == 0
    top = ran.table("05", "display").selectExpr("max(greatest(abs(CCA1), abs(CCA2))) m").first().m
    assert abs(top - 1) < 1e-9
    n, hubs = ran.table("07", "nodes"), ran.table("07", "hubs")
    assert 15 <= hubs.count() <= n.count() and ran.table("07", "summary").first().n_nodes == n.count()
    m = ran.table("10", "map_points")
    assert {"sci_index", "nmds_axis"} <= set(m.columns) and ran.table("10", "ranges").where("low <= median and median <= high").count() >= 4
    assert all((Path(ran.out) / "reports" / f"{i}.txt").stat().st_size > 50 for i in ("04", "05", "07", "08", "11"))
    assert p.validate(p.REGISTRY["09"], ran) == []
