"""Passages of held-out texts inside a corpus, by a distributed positional inverted index.

One pass over the corpus counts the terms that the held-out texts use; each window of held-out words is then known by its two rarest
terms. A second pass stores the index: for each of those terms and each document the list of positions, and nothing of the other,
frequent terms. The lists of the rarest term are joined first, moved by the term's offset in the item, and intersected with those of
the second one. What is left is an alignment (document, item, offset); the words of the candidate documents alone are read again and
each alignment is measured exactly.

An exact phrase is a run of item words that stand in the document one after the other. A proximity match lets every word stand up to GAP
places from where the alignment expects it, and asks for `run` such words among any run + GAP consecutive ones of the item, so a passage
with some words put in, left out or changed still holds together.

A word is a maximal run of letters and digits, case ignored; everything between words is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, dense_ids, spread, stage

WORD = r"[\p{L}\p{N}]+"
#: Places by which a word of a proximity match may be off.
GAP = 3
#: Parts a term's documents are spread over where the probes are too many to be sent to them.
SALTS = 16


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def _occurrences(docs: DataFrame, vocabulary: DataFrame, n_terms: int) -> DataFrame:
    """(doc, term, pos) of each occurrence of a term of vocabulary (word, term) in docs (doc, text)."""
    each = spread(docs).select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    each = each.select("doc", "pos", F.lower("word").alias("word"))
    return each.join(broadcast_if_small(vocabulary, n_terms, 60), "word").select("doc", "term", "pos")


def postings(docs: DataFrame, vocabulary: DataFrame, n_terms: int) -> DataFrame:
    """(term, doc, at): the index, one ascending list of positions for each term and document."""
    return _occurrences(docs, vocabulary, n_terms).groupBy("doc", "term").agg(F.sort_array(F.collect_list("pos")).alias("at"))


def _by_term(index: DataFrame, probes: DataFrame, n_probes: int) -> DataFrame:
    """index joined with probes on term; a frequent term's documents are spread over salts if the probes can't be broadcast."""
    small = broadcast_if_small(probes, n_probes, 64)
    if small is not probes:
        return index.join(small, "term")
    salted = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def _longest(hit: Column) -> Column:
    """Length of the longest run of true in an array of booleans."""
    step = lambda acc, x: F.struct(
        F.when(x, acc["run"] + 1).otherwise(0).alias("run"), F.greatest(acc["best"], F.when(x, acc["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(hit, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step)["best"]


def aligned_passages(
    corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, gap: int = GAP, slack: int = 0
) -> DataFrame:
    """(doc, item, longest_run, aligned_words, near_run, near_words) of every alignment that two rare terms of a window give.

    longest_run and aligned_words count item words that stand exactly where the alignment expects them; near_run and near_words those
    that stand at most gap places off; slack: places by which the second of the rare terms may be off (0 is enough for exact phrases: a
    window that stands in the document has both at their places). near_run is the most such words among any run + gap consecutive words of the item.
    """
    docs = corpus.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    asked = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("words")).where("item is not null").where(
        F.size("words") >= run
    ).dropDuplicates(["item", "words"])
    asked = stage(asked.withColumn("copy", F.xxhash64("words")), "items")
    n_items, longest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    vocab, n_terms = dense_ids(asked.select(F.explode("words").alias("word")).distinct(), "word", "term")
    vocab = vocab.select("word", F.col("term").cast("int").alias("term"))
    freq = stage(_occurrences(docs, vocab, n_terms).groupBy("term").agg(F.count("*").alias("n")), "freq")
    placed = asked.select("item", "copy", F.posexplode("words").alias("ipos", "word")).join(
        broadcast_if_small(vocab, n_terms, 60), "word"
    ).join(broadcast_if_small(freq, n_terms, 24), "term", "left")
    lists = placed.groupBy("item", "copy").agg(
        F.sort_array(F.collect_list(F.struct("ipos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("w")
    )
    # The two rarest different terms of each window; a term that the corpus hasn't leaves nothing of the window to find.
    by_rarity = lambda s: F.sort_array(F.transform(F.slice("w", s, run), lambda x: F.struct(x.n, x.term, x.ipos)))
    windows = lists.select("item", "copy", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (run - 1)), by_rarity)).alias("r"))
    first, other = F.element_at("r", 1), F.filter("r", lambda x: x.term != F.element_at("r", 1).term)
    second = F.when(F.size(other) > 0, F.get(other, F.lit(0))).otherwise(F.element_at("r", 1))
    probes = windows.where(first["n"] > 0).select(
        "item", "copy", first["term"].alias("term"), first["ipos"].alias("p1"), second["term"].alias("t2"), second["ipos"].alias("p2")
    ).distinct()
    probes = stage(probes, "probes")
    n_probes = probes.count()
    rare = stage(probes.select("term").union(probes.select("t2")).distinct().join(vocab, "term"), "rare")
    index = stage(postings(docs, rare, rare.count()), "postings")
    hits = _by_term(index, probes, n_probes).select(
        "doc", "item", "copy", F.col("t2").alias("term"), F.transform("at", lambda x: x - F.col("p1")).alias("d1"), "p2")
    met = hits.join(index, ["doc", "term"]).select(
        "doc", "item", "copy", F.explode(F.array_intersect("d1", F.flatten(F.transform(
            F.sequence(F.lit(-slack), F.lit(slack)), lambda g: F.transform("at", lambda x: x - F.col("p2") + g))))).alias("delta")
    )
    met = stage(met.distinct(), "met")
    asking = met.select("doc").distinct()
    texts = docs.join(broadcast_if_small(asking, asking.count(), 32), "doc", "left_semi").select("doc", words(F.col("text")).alias("dw"))
    texts = stage(texts, "candidates")
    # Each alignment takes along only the part of the document that its item can cover.
    w = broadcast_if_small(asked, n_items, 16 * longest)
    lo = F.greatest(F.col("delta") - gap, F.lit(0))
    x = met.join(w, ["item", "copy"]).join(texts, "doc").select(
        "doc", "item", F.col("words").alias("iw"), (lo - F.col("delta")).alias("skip"),
        # A generator, so that the part is cut once a row and not again for each word it is compared with.
        F.explode(F.array(F.slice("dw", lo + 1, F.greatest(F.size("words") + F.col("delta") + gap - lo, F.lit(0))))).alias("dw"))
    at = lambda i, g: F.coalesce(F.get("dw", i - F.col("skip") + g), F.lit(""))
    near = lambda word, i: F.exists(F.sequence(F.lit(-gap), F.lit(gap)), lambda g: at(i, g) == word)
    x = x.select(
        "doc", "item", F.transform("iw", lambda word, i: at(i, F.lit(0)) == word).alias("same"), F.transform("iw", near).alias("close"))
    yes = lambda c: F.size(F.filter(c, lambda b: b))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("close") - (run + gap - 1), F.lit(1))), lambda s: yes(F.slice("close", s, run + gap)))
    return x.select(
        "doc", "item", _longest(F.col("same")).alias("longest_run"), yes("same").alias("aligned_words"), F.array_max(parts).alias("near_run"), yes("close").alias("near_words"))


def leaked_passages(
    corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, gap: int = GAP
) -> DataFrame:
    """(doc_id, item_id, longest_run, aligned_words, near_words), one row for each document holding at least run consecutive words of an item.

    longest_run is the longest exact phrase; aligned_words counts all words that agree at the same offset, near_words those at most
    gap places off it, both at their best alignment that holds an exact phrase. Null and empty texts, and items of fewer than run
    words, match nothing; rows repeated as a whole do no harm (doc_id has to tell different texts apart). Other columns aren't read.
    """
    x = aligned_passages(corpus, doc_id, text, items, item_id, item_text, run, gap).where(F.col("longest_run") >= run)
    return x.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(
        F.max("longest_run").alias("longest_run"), F.max("aligned_words").alias("aligned_words"), F.max("near_words").alias("near_words"))


def near_passages(
    corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, gap: int = GAP
) -> DataFrame:
    """(doc_id, item_id, longest_run, near_run): documents without an exact phrase of run words, but with run words of an item,
    of any run + gap consecutive ones, at most gap places off."""
    x = aligned_passages(corpus, doc_id, text, items, item_id, item_text, run, gap, gap)
    x = x.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("longest_run").alias("longest_run"), F.max("near_run").alias("near_run"))
    return x.where((F.col("longest_run") < run) & (F.col("near_run") >= run))
