import numpy as np
import pytest

from florascope.operators import ordination, replicates
from florascope.plans import registry

SF = "/root/testdata/sf0.001"


def _table(spark, whole=True):
    rng = np.random.default_rng(12)
    y = rng.poisson(0.8, (50, 20)) * rng.integers(1, 5, (50, 20)) * 1.0
    y[:, 0] = rng.integers(1, 400, 50)
    y[9, 1], y[11, 1], y[30, 2] = 70000, 900, 255
    if not whole:
        y[:, 3] /= 8
    cells = spark.createDataFrame([(int(i), f"s{j}", float(y[i, j])) for i, j in zip(*np.nonzero(y), strict=True)], "i long, species_name string, abund double")
    return np.abs(y[:, None] - y[None]).sum(2) / (y[:, None] + y[None]).sum(2), cells


@pytest.mark.parametrize("whole", [True, False])
def test_rows_hold_no_cells(spark, monkeypatch, whole):
    """Any number of cells: no array of them is held or bounded by MATRIX_BYTES."""
    d, cells = _table(spark, whole)
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    row = replicates.distance_rows(cells, 50)
    for piece in (1 << 15, 7):
        monkeypatch.setattr(replicates, "PIECE", piece)
        monkeypatch.setattr(replicates, "_LEVELS", [])
        assert all(np.allclose(row(i), d[i, i + 1 :], atol=1e-12) for i in range(50))


def test_permanova_of_any_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    assert registry.QUERIES["permanova_f"](spark, SF).first().f > 0


def test_mantel_of_any_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    assert -1 <= registry.QUERIES["mantel_r"](spark, SF).first().r <= 1


def test_bray_curtis_of_any_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    x = registry.QUERIES["bray_curtis"](spark, SF)
    n = x.select("id_a").union(x.select("id_b")).distinct().count()
    assert x.count() == n * (n - 1) // 2 > 0


def test_permanova_p_of_any_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    cells = _table(spark)[1]
    assert 0 < replicates.permanova_blocks(cells, ["u"] * 20 + ["v"] * 30, 9).first().p <= 1


def test_coordinates_of_any_number_of_cells(spark, monkeypatch):
    """permdisp: no bound on the cells, and the disk doesn't hold the parts of all products."""
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    made, gone = [], []
    stage, unstage = ordination.stage, ordination.unstage
    monkeypatch.setattr(ordination, "stage", lambda df, name: made.append(name) or stage(df, name))
    monkeypatch.setattr(ordination, "unstage", lambda *x: gone.extend(x) or unstage(*x))
    assert ordination.pcoa_cells(_table(spark)[1], 50, 3).shape == (50, 3)
    assert len(gone) == len(made) > 0


def test_anosim_p_of_any_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 0)
    d, cells = _table(spark)
    labels = ["u"] * 20 + ["v"] * 30
    got = tuple(replicates.anosim_blocks(cells, labels, 19).first())
    monkeypatch.undo()
    assert got == pytest.approx(tuple(replicates.anosim_test(spark, d.round(10), labels, 19).first()))
