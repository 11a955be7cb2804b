import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from florascope.llm import pairs, terms


def _rows(seed, n=1500, plots=40, names=60):
    rng = random.Random(seed)
    pick = lambda k: int(k * rng.random() ** 2)
    rows = [("hot" if rng.random() < 0.33 else f"p{pick(plots)}", f"n{pick(names)}") for _ in range(n)]
    return rows + [(None, "n1"), ("p1", None), (None, None), *rows[:50]]


def brute_pairs(rows):
    per = {}
    for p, n in rows:
        if p is not None and n is not None:
            per.setdefault(p, set()).add(n)
    out = {}
    for s in per.values():
        for a, b in combinations(sorted(s), 2):
            out[a, b] = out.get((a, b), 0) + 1
    freq = {}
    for s in per.values():
        for a in s:
            freq[a] = freq.get(a, 0) + 1
    return out, freq, len(per)


@pytest.mark.parametrize("block", [512, 7])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = _rows(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "plot string, name string, id string")
    want, freq, n = brute_pairs(rows)
    got = pairs.pair_counts(df, "plot", "name").collect()
    assert {(r.name_a, r.name_b): r.n_ab for r in got} == want and len(got) == len(want)
    r = got[0]
    assert (r.n_a, r.n_b, r.n_baskets) == (freq[r.name_a], freq[r.name_b], n)
    assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
    c = [r.n_ab + 0.5, r.n_a - r.n_ab + 0.5, r.n_b - r.n_ab + 0.5, n - r.n_a - r.n_b + r.n_ab + 0.5]
    assert r.log_odds == pytest.approx(np.log(c[0] * c[3] / (c[1] * c[2])))
    few = {(r.name_a, r.name_b) for r in pairs.pair_counts(df, "plot", "name", 3, 2.0).collect()}
    assert few == {k for k, v in want.items() if v >= 3 and v * n >= 2 * freq[k[0]] * freq[k[1]]}


def test_pairs_edges(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "b")], "plot string, name string")
    assert pairs.pair_counts(df, "plot", "name").count() == 0
    assert pairs.pair_counts(df.limit(0), "plot", "name").count() == 0


def test_runs_pack_and_merge(monkeypatch):
    rng = np.random.default_rng(0)
    for v in (np.zeros(0, np.int64), np.array([2**62]), rng.integers(0, 2**40, 1000)):
        assert (pairs.unpack(pairs.pack(v), len(v)) == v).all()
    monkeypatch.setattr(pairs, "CHUNK", 16)
    monkeypatch.setattr(pairs, "PENDING", 40)
    runs = [rng.integers(0, 50, 300) << 32 | rng.integers(0, 50, 300) for _ in range(5)]
    rows = [x for r in runs for b in pairs._flush([r.copy()], 3) for x in b.to_pylist()]
    rows.sort(key=lambda r: (r["part"], r["first"]))
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)]
    got = [(r["code"], r["n"]) for b in pairs._merge(iter(batches)) for r in b.to_pylist()]
    codes, counts = np.unique(np.concatenate(runs), return_counts=True)
    assert len(got) == len(codes) and dict(got) == dict(zip(codes.tolist(), counts.tolist(), strict=True))


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_terms(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "MAX_TERMS", most)
    rows = [*_rows(2), ("p1", ""), ("p2", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "plot string, name string, term long")
    want = terms.brute_counts(pd.DataFrame(rows, columns=["plot", "name"]), "name", "plot")
    assert {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, "name", "plot").collect()} == want
    marks = {r.term: r.mark for r in terms.mark_terms(terms.term_counts(df, "name", "plot"), 41).collect()}
    assert all(marks[t] == ("rare" if n < 3 else "common" if 5 * n > 41 else None) for t, (_, n) in want.items())
    assert terms.term_counts(df.limit(0), "name", "plot").count() == 0


def test_last_seen_across_batches(monkeypatch):
    import pyarrow as pa

    for most in (1_000_000, 1):
        monkeypatch.setattr(terms, "MAX_TERMS", most)
        records = [f"r{i // 7:03d}" for i in range(200)]
        words = [f"t{(i * i) % 11}" for i in range(200)]
        table = pa.RecordBatch.from_pydict({"term": words, "record": records})
        batches = [table.slice(i, 13) for i in range(0, 200, 13)] + [table.slice(0, 0)]
        got: dict = {}
        for b in terms._count(iter(batches)):
            for r in b.to_pylist():
                o, n = got.get(r["term"], (0, 0))
                got[r["term"]] = o + r["occurrences"], n + r["records"]
        assert got == terms.brute_counts(pd.DataFrame({"w": words, "r": records}), "w", "r")


def test_one_large_basket_is_many_tiles(spark, monkeypatch):
    """A basket of 2,000 items among small ones: tiles are even, the counts those of brute force; hot items are numbered aside."""
    monkeypatch.setattr(pairs, "BLOCK", 64)
    monkeypatch.setattr(pairs, "HOT_ITEM", 50)
    monkeypatch.setattr(pairs, "BROADCAST_BYTES", 0)
    rows = [("big", f"i{k:04d}") for k in range(2000)] + [(f"s{b}", f"i{k:04d}") for b in range(100) for k in (1, 5, b)]
    df = spark.createDataFrame(rows, "basket string, item string")
    blocks = spark.createDataFrame([("big", b, 32, list(range(b * 64, b * 64 + 62))) for b in range(32)], "basket string, block int, blocks int, items array<int>")
    t = pairs.tiles(blocks).selectExpr("size(items) * greatest(size(others), 31) n").collect()
    assert len(t) == 32 * 33 // 2 and max(r.n for r in t) <= 0.004 * sum(r.n for r in t)
    got = pairs.pair_counts(df, "basket", "item")
    assert got.count() == 2000 * 1999 // 2
    n = {(r.name_a, r.name_b): r.n_ab for r in got.where("n_ab > 1").collect()}
    assert n["i0001", "i0005"] == 101 and n["i0001", "i0099"] == 2


def test_one_record_with_most_rows(spark):
    rows = [("huge", f"t{k % 3000}") for k in range(30_000)] + [(f"r{k}", f"t{k % 7}") for k in range(300)]
    df = spark.createDataFrame(rows, "record string, term string")
    n, total, largest = terms.record_sizes(df, "record")
    assert (n, total, largest) == (301, 30_300, 30_000)
    salts = terms.salts_for(total, largest, 200)
    assert salts >= 200 * largest / total
    parts = df.selectExpr(f"pmod(xxhash64(record, pmod(xxhash64(term), {salts})), 200) p").groupBy("p").count()
    assert max(r["count"] for r in parts.collect()) <= 0.05 * total
    got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, "term", "record").collect()}
    assert len(got) == 3000 and got["t0"] == (10 + 43, 1 + 43) and got["t2999"] == (10, 1)


@pytest.mark.parametrize("least", [2, 3, 5])
def test_a_basket_of_most_pairs_makes_none(spark, monkeypatch, least):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    rng = random.Random(least)
    baskets = {f"p{k}": rng.sample(range(60), 8) for k in range(80)} | {"all": list(range(60)), "most": list(range(50))}
    df = spark.createDataFrame([(k, f"i{x:02d}") for k, s in baskets.items() for x in s], "plot string, name string")
    want = Counter(p for s in baskets.values() for p in combinations(sorted(f"i{x:02d}" for x in s), 2))
    made, emit = spark.sparkContext.accumulator(0), pairs._emit

    def counted(batches, n):
        for b in emit(batches, n):
            made.add(sum(b.column("size").to_pylist()))
            yield b

    monkeypatch.setattr(pairs, "_emit", counted)
    got = {(r.name_a, r.name_b): r.n_ab for r in pairs.pair_counts(df, "plot", "name", least).collect()}
    assert got == {k: n for k, n in want.items() if n >= least}
    assert 0 < made.value <= 80 * 28 + (least == 2) * 50 * 49 / 2
