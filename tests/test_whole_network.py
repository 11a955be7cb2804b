import numpy as np

from florascope.functions import special
from florascope.operators import network
from florascope.plans import registry

SF = "/root/testdata/sf0.01"


def test_every_edge_counts(spark):
    edges = registry.QUERIES["cooccurrence_edges"](spark, SF).select("src", "dst").collect()
    nodes = {r.species_name for r in registry.QUERIES["louvain"](spark, SF).collect()}
    assert nodes == {x for e in edges for x in e} and len(nodes) > 200


def test_sparse_null_model_against_dense():
    m = np.random.default_rng(4).random((30, 12)) < 0.4
    rows, cols = np.nonzero(m)
    got = network.swap_pairs(rows, cols, np.random.default_rng(5), 300)
    s = np.zeros_like(m)
    s[rows, got] = True
    assert s.sum() == m.sum() and (s.sum(0) == m.sum(0)).all() and (s.sum(1) == m.sum(1)).all() and (s != m).any()
    w = m.T.astype(int) @ m
    for pending in (4_000_000, 50):
        network.PENDING = pending
        g = network.pairs_graph(rows, cols, 4)
        assert [g[i] for i in range(12)] == [{j: w[i, j] for j in range(12) if j != i and w[i, j] >= 4} for i in range(12)]
    network.PENDING = 4_000_000


def test_pair_rows_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.random((40, 23)) < 0.3
    m[0] = True
    p = spark.createDataFrame([(f"p{i}", f"s{j:02d}") for i, j in zip(*np.nonzero(m), strict=True)], "plot_id string, species_name string")
    w = m.T.astype(int) @ m
    for counts, added in ((1 << 20, 1 << 20), (50, 7)):
        monkeypatch.setattr(network, "COUNTS", counts)
        monkeypatch.setattr(network, "ADDED", added)
        got = {(r.src, r.dst): r.weight for r in network.all_pair_counts(p).collect()}
        assert got == {(f"s{i:02d}", f"s{j:02d}"): w[i, j] for i in range(23) for j in range(i + 1, 23)}
        got = {(r.src, r.dst): r for r in network.hypergeometric(p, 2).collect()}
        assert {k: (r.x, r.n_src, r.n_dst, r.n) for k, r in got.items()} == {
            (f"s{i:02d}", f"s{j:02d}"): (w[i, j], w[i, i], w[j, j], 40) for i in range(23) for j in range(i + 1, 23) if w[i, j] >= 2}
        assert all(abs(r.p - special.hypergeom_upper(r.x, 40, r.n_src, r.n_dst)) < 1e-12 for r in got.values())


def test_no_pairs_are_shuffled(spark):
    for name in ("all_pair_counts", "hypergeom_inputs", "hypergeom_tail", "significant_pairs"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "ArrowEvalPython" not in plan


def test_tails_of_many_at_once():
    rng = np.random.default_rng(7)
    n = 3000
    k, m = rng.integers(1, n + 1, 400), rng.integers(1, n + 1, 400)
    x = np.clip(k * m // n + rng.integers(-60, 60, 400), 0, np.minimum(k, m))
    got = special.hypergeom_tails(x, n, k, m, special.log_factorials(n))
    want = [special.hypergeom_upper(*map(int, r)) for r in zip(x, [n] * 400, k, m, strict=True)]
    assert np.allclose(got, want, rtol=1e-7, atol=1e-12)


def _graph(seed=11, n=60):
    m = np.random.default_rng(seed).random((25, n)) < np.linspace(0.02, 0.5, n)
    m[0] = True
    return network.pairs_graph(*np.nonzero(m), 2), m


def test_driver_makes_no_graph_for_the_null_model(spark, monkeypatch):
    from pyspark import TaskContext

    whole, (g, m) = network.pairs_graph, _graph()

    def guarded(*x):
        assert TaskContext.get() is not None, "a graph on the driver"
        return whole(*x)

    monkeypatch.setattr(network, "pairs_graph", guarded)
    r = network.null_modularity_pairs(spark, *np.nonzero(m), 2, 5).first()
    assert abs(r.q - network.graph_modularity(g, network.louvain(g))) < 1e-12


def test_pairs_graph_in_any_blocks(monkeypatch):
    _, m = _graph()
    w = m.T.astype(int) @ m
    for counts, pending in ((16 << 20, 1 << 20), (130, 7)):
        monkeypatch.setattr(network, "COUNTS", counts)
        monkeypatch.setattr(network, "PENDING", pending)
        g = network.pairs_graph(*np.nonzero(m), 3)
        assert [g[i] for i in range(60)] == [{j: w[i, j] for j in range(60) if j != i and w[i, j] >= 3} for i in range(60)]


def test_paths_do_not_look_past_the_last_level(monkeypatch):
    g, _ = _graph()
    looked = []
    neighbours = network._neighbours
    monkeypatch.setattr(network, "_neighbours", lambda near, v, size: looked.append(int(size.sum())) or neighbours(near, v, size))
    reach = network.component_sizes(g)
    looked.clear()
    got = sum(network.dependencies(g, s, int(reach[s])) for s in range(60))
    assert sum(looked) < 60 * len(g.to) / 2
    # By definition: shortest paths through v over all shortest paths.
    a = np.array([[j in g[i] for j in range(60)] for i in range(60)])
    dist, paths, walk = np.where(np.eye(60), 0.0, np.inf), np.eye(60), np.eye(60)
    for d in range(1, 60):
        walk = walk @ a
        new = np.isinf(dist) & (walk > 0)
        dist[new], paths[new] = d, walk[new]
    on = [sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(60) for t in range(60)
              if len({s, v, t}) == 3 and np.isfinite(dist[s, t]) and dist[s, v] + dist[v, t] == dist[s, t]) for v in range(60)]
    assert np.allclose(got, on)
