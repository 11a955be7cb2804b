from collections import Counter
from itertools import combinations

from florascope.llm import queries

SF = "/root/testdata/sf0.001"


def test_pairs_on_few_plots_are_there(spark):
    per = {}
    for r in queries._names(spark, SF).collect():
        if r.name:
            per.setdefault(r.plot, set()).add(r.name)
    want = Counter(p for s in per.values() for p in combinations(sorted(s), 2))
    got = {(r.name_a, r.name_b): r.n_ab for r in queries.QUERIES["p4_all_pairs"](spark, SF).collect()}
    assert min(want.values()) == 1 and got == want
    some = {(r.name_a, r.name_b): r.n_ab for r in queries.QUERIES["p4_pairs"](spark, SF).collect()}
    assert some == {k: n for k, n in want.items() if n >= 5}
