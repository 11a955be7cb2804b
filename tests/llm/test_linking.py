import random

import pytest

from florascope.llm import linking
from florascope.llm.linking import BINOMIAL, Rules, fold, keys_of, link_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


LISTED = ["Vautusus phaldymensis", "Cudaxum ceomeogifolia", "Stusiaphella xausiaxana", "Piarella brophaedata", "Piarella brophaedosa", "Queorbiasia sageostulata"]


@pytest.fixture(scope="module")
def reference(spark):
    rows = [(n, "scientific", i + 1) for i, n in enumerate(LISTED)] + [("Vautusus syntypa", "scientific", 1), ("Gulseldru dumbu", "local", 2), ("CUDACEO", "code", 2)]
    return spark.createDataFrame(rows, "name string, kind string, entry long")


@pytest.mark.parametrize(("typed", "entry"), [
    ("VAUTUSUS PHALDYMENSIS", 1), ("phaldymensis, Vautusus", 1), ("Vautususphaldymensis", 1), ("Vautusus_phaldymensis", 1), ("Vautusus phaldymensis ?", 1),
    ("12. Vautusus phaldymensis", 1), ("*Vautusus phaldymensis", 1), ("Vautusus cf. phaldymensis", 1), ("Vautusus phaldymensis var. minor", 1),
    ("Vautusus phaldymensis (Brind.) Osk.", 1), ("Vautusus phaldymensis (dead)", 1), ("Vautusus phaldymensis Quill. ex Varn.", 1), ("V. phaldymensis", 1),
    ("Vautusus syntypa", 1), ("Vautuus phaldymennsis", 1), ("Cúdaxum ceomeogifolia", 2), ("Cudaxum ceomeogifo1ia", 2), ("cudaceo", 2), ("GULSELDRU DUMBU", 2),
    ("Gulseldru dumb", 2), ("Piarella brophaedata", 4), ("Piarella brophaedatx", 4), ("Vautusus", None), ("Vautusus sp.", None), ("Vautusus sp. 3", None), ("Vautusus indet.", None),
    ("Vautusus ceomeogifolia", None), ("Vautuxxx phaldymensis", None), ("unknown fern", None), ("voucher 46623", None), ("-", None), ("", None), ("999", None), ("x" * 5000, None),
])
def test_spellings(spark, reference, typed, entry):
    _check(spark, reference, typed, entry)


_KNOWN: dict = {}


def _check(spark, reference, typed, entry):
    if not _KNOWN:
        mark = next(m for m in test_spellings.pytestmark if m.name == "parametrize")
        names = [(a,) for a, _ in mark.args[1]]
        _KNOWN.update({r.name: r.entry for r in link_names(spark.createDataFrame(names + names[:3] + [(None,)], "name string"), reference, rules=BINOMIAL).collect()})
    assert _KNOWN[typed] == entry


def test_against_brute_force(spark, reference):
    rng = random.Random(4)
    letters = "abcdeiostu"
    typed = set()
    for _ in range(250):
        s = list(rng.choice(LISTED))
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(1, len(s))
            op = rng.randrange(3)
            if op == 0:
                s.insert(k, rng.choice(letters))
            elif op == 1 and s[k] != " ":
                del s[k]
            elif s[k] != " ":
                s[k] = rng.choice(letters)
        typed.add("".join(s))
    keys = {n: fold(n).replace(" ", "") for n in [*LISTED, "Vautusus syntypa", "Gulseldru dumbu"]}
    entry = {n: i + 1 for i, n in enumerate(LISTED)} | {"Vautusus syntypa": 1, "Gulseldru dumbu": 2}
    got = {r.name: r for r in link_names(spark.createDataFrame([(t,) for t in typed], "name string"), reference, rules=BINOMIAL).collect()}
    for t in typed:
        best = min(distance(k, key) for k, kind in keys_of(t, BINOMIAL) if kind == "name" for key in keys.values())
        if best > 2:
            assert got[t].entry is None, t
        else:
            near = {entry[n] for n, key in keys.items() if any(distance(k, key) == best for k, kind in keys_of(t, BINOMIAL) if kind == "name")}
            assert got[t].slips == best and got[t].entry in near, t


def test_empty(spark, reference):
    one = spark.createDataFrame([("Vautusus phaldymensis",)], "name string")
    assert link_names(one.limit(0), reference).count() == 0
    assert [r.entry for r in link_names(one, reference.limit(0)).collect()] == [None]


def test_any_list(spark, monkeypatch):
    """Names of any number of words, with words that the rules of scientific names drop; the same when nothing can be broadcast."""
    listed = ["Big Red Pine", "senior software engineer", "New York City", "Paris", "Berlin", "species x near f", "São Paulo", "Москва"]
    ref = spark.createDataFrame([(n, "name", i) for i, n in enumerate(listed)], "name string, kind string, entry long")
    typed = {n: i for i, n in enumerate(listed)} | {"NEW YORK  CITY": 2, "new-york city": 2, "Senior Sofware Enginer": 1, "Sao Paulo": 6, "Berlim": 4, "Lisbon": None, "Porto Alegre": None}
    df = spark.createDataFrame([(t,) for t in typed], "name string")
    assert {r.name: r.entry for r in link_names(df, ref).collect()} == typed
    rows = link_names(df, ref, min_jaccard=0.6).collect()
    assert {r.name for r in rows if r.entry is not None} == {*listed, "NEW YORK  CITY", "new-york city", "Senior Sofware Enginer", "Sao Paulo"} and all(r.jaccard >= 0.6 for r in rows if r.entry is not None)
    assert {r.name: r.entry for r in link_names(df, ref, rules=Rules(cut=frozenset({"near"}))).collect()}["species x near f"] is None
    monkeypatch.setattr(linking, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linking, "broadcast_if_small", lambda df, rows, width: df)
    assert {r.name: r.entry for r in link_names(df, ref).collect()} == typed
