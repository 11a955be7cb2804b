import random

from florascope.llm import leakage
from florascope.llm.leakage import leaked_passages, near_passages


def brute(docs, items, run):
    import regex

    split = lambda t: [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    g = {i: grams(split(t)) for i, t in items}
    return {(d, i) for d, t in docs for i in g if d is not None and grams(split(t)) & g[i]}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = "the a of plot moss fern 12 7 in Österlund at by kept ས་ལ tree".split()
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, "the " * 14)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    for k in range(40):
        words = items[k % 12][1].split()
        at, n = rng.randrange(0, 15), rng.choice([11, 12, 13])
        part = rng.choice([", ", "\n> ", " ** ", "_"]).join(words[at : at + n])
        docs.append((100 + k, text(5) + " -- " + (part.upper() if k % 3 else part) + " -- " + text(5)))
    docs += [(200, None), (201, ""), (202, "the " * 40000), (202, "the " * 40000), (None, items[0][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items + items[:2]], "item_id long, item_text string, doc string")
    got = leaked_passages(d, "doc_id", "text", i, "item_id", "item_text").collect()
    want = brute(docs, items, 12)
    assert {(r.doc_id, r.item_id) for r in got} ^ want == set()
    assert len(got) == len({r[:2] for r in got})
    assert all(r.aligned_words >= r.longest_run >= 12 for r in got)
    assert leaked_passages(d.limit(0), "doc_id", "text", i, "item_id", "item_text").count() == 0
    assert leaked_passages(d, "doc_id", "text", i.limit(0), "item_id", "item_text").count() == 0


def test_gaps_and_salts(spark, monkeypatch):
    words = "moss covered the northern wall of an old lime kiln where seven ferns grew beside three tall larches".split()
    put_in = " ".join(words[:6] + ["very"] + words[6:12] + ["rather"] + words[12:])
    left_out = " ".join(words[:8] + words[9:])
    far = " ".join(words[:6] + ["one two three four five"] + words[6:12])
    docs = [(1, "x " + put_in), (2, left_out), (3, far), (4, "so " + " ".join(words) + " it said"), (5, " ".join(reversed(words)))]
    docs += [(100 + i, "moss covered the kiln") for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, item_text string")
    args = (d, "doc_id", "text", i, "item_id", "item_text")
    exact = {r.doc_id: r for r in leaked_passages(*args).collect()}
    assert set(exact) == {4} and exact[4].longest_run == exact[4].near_words == len(words)
    near = {r.doc_id: r for r in near_passages(*args).collect()}
    assert set(near) == {1, 2} and all(r.near_run >= 12 > r.longest_run for r in near.values())
    monkeypatch.setattr(leakage, "broadcast_if_small", lambda df, rows, width: df)
    assert {r.doc_id for r in leaked_passages(*args).collect()} == {4} and {r.doc_id for r in near_passages(*args).collect()} == {1, 2}
