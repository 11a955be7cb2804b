import numpy as np
import pytest

from florascope.operators import replicates
from florascope.plans import registry

SF = "/root/testdata/sf0.01"


def test_every_species_gets_its_p(spark):
    want = {r.species_name: r.stat for r in registry.QUERIES["indval"](spark, SF).collect()}
    got = {r.species_name: r for r in registry.QUERIES["indval_permutation"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 2000
    assert all(r.stat == pytest.approx(want[s], abs=1e-8) and 0 < r.p <= r.p_adj <= 1 for s, r in got.items())


def test_blocks_draw_the_same_shuffles(spark, monkeypatch):
    occ = (np.random.default_rng(1).random((40, 15)) < 0.3).astype(float)
    occ[0] = 1
    labels, names = ["a"] * 10 + ["b"] * 30, [f"s{j}" for j in range(15)]
    want = {r.species_name: (r.stat, r.p) for r in replicates.indval_test(spark, occ, names, labels, 49).collect()}
    cells = spark.createDataFrame([(int(i), names[j]) for i, j in zip(*np.nonzero(occ), strict=True)], "i long, species_name string")
    for size in (200_000, 3):
        monkeypatch.setattr(replicates, "CELLS", size)
        got = {r.species_name: (r.stat, r.p) for r in replicates.indval_cells(cells, labels, 49).collect()}
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
