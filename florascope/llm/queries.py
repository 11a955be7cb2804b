"""Queries of the llm operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_name, trim_blanks
from ..session import broadcast_if_small, read, shuffle_partitions, spread, stage
from .bpe import encode_texts
from .leakage import leaked_passages, near_passages
from .linking import BINOMIAL, link_names
from .pairs import pair_counts
from .pii import find_personal, mask_personal
from .terms import mark_terms, record_sizes, salts_for, term_counts


def _names(spark: SparkSession, d: str) -> DataFrame:
    veg = spread(read(spark, d, "veg_long_csv").select("species_name", "plot_id"))
    return veg.select(clean_name(F.col("species_name")).alias("name"), trim_blanks(F.col("plot_id")).alias("plot")).dropna()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_counts(_names(spark, d), "plot", "name", 5, 6).select("name_a", "name_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair on at least five plots with its ratio to chance and its odds ratio."""
    x = pair_counts(_names(spark, d), "plot", "name", 5)
    return x.select("name_a", "name_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def p4_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """p4_pairs without its bound: every pair on one plot or more."""
    x = pair_counts(_names(spark, d), "plot", "name")
    return x.select("name_a", "name_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    n, rows, largest = record_sizes(names, "plot")
    salts = salts_for(rows, largest, shuffle_partitions(spark))
    return mark_terms(term_counts(names, "name", "plot", salts), n).withColumnRenamed("term", "species_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).where("mark is not null").select("species_name", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _p5(spark, d)
    return x.select("species_name", F.col("occurrences").alias("n_records"), F.col("records").alias("n_plots"), "mark")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The checklist's and the synonyms' names as (name, kind, entry)."""
    listed = read(spark, d, "species_checklist")
    kinds = (("species_name", "scientific"), ("species_code", "code"), ("local_name", "local"))
    parts = [listed.select(F.col(c).alias("name"), F.lit(k).alias("kind"), F.col("species_id").alias("entry")) for c, k in kinds]
    syn = read(spark, d, "species_synonyms")
    parts.append(syn.select(F.col("synonym").alias("name"), F.lit("scientific").alias("kind"), F.col("species_id").alias("entry")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """(name, entry, slips, jaccard) of every distinct spelling that is neither blank nor a checklist name as it is."""
    veg = read(spark, d, "veg_long_csv").select(F.col("species_name").alias("name"))
    listed = read(spark, d, "species_checklist").select(F.col("species_name").alias("name"))
    typed = veg.where(trim_blanks(F.col("name")) != "").distinct().join(broadcast_if_small(listed, listed.count(), 96), "name", "left_anti")
    return link_names(typed, _entries(spark, d), rules=BINOMIAL)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    linked = stage(_linked(spark, d).select(F.col("name").alias("species_name"), F.coalesce("entry", F.lit(0)).cast("long").alias("species_id")), "p6")
    veg = read(spark, d, "veg_long_csv").select("record_id", "species_name")
    return veg.join(broadcast_if_small(linked, linked.count(), 120), "species_name").select("record_id", "species_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entry and similarity; unmatched ones with entry null."""
    return _linked(spark, d).select("name", "entry", "slips", F.round("jaccard", 6).alias("jaccard"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(read(spark, d, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """The documents with the items they leak and how much of each."""
    return leaked_passages(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).select("doc_id", "item_id")


def _staff(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "field_staff").select(F.col("given_name").alias("given"), F.col("family_name").alias("family"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of an item that words were put into or left out of, so that no exact phrase is left."""
    return near_passages(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "item_text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(read(spark, d, "documents"), "doc_id", "text", names=_staff(spark, d))


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its personal items replaced by placeholders."""
    return mask_personal(read(spark, d, "documents"), "doc_id", "text", names=_staff(spark, d))


_NAMES = """
WITH t AS (
  SELECT trim(regexp_replace(lower(species_name), '[ \\t\u00a0]+', ' ', 'g')) AS name,
         regexp_replace(plot_id, '^[ \\t\u00a0]+|[ \\t\u00a0]+$', '', 'g') AS plot
  FROM veg_long_csv WHERE species_name IS NOT NULL AND plot_id IS NOT NULL),
tokens AS (SELECT name, plot FROM t WHERE name <> ''),
u AS (SELECT DISTINCT name, plot FROM tokens),
total AS (SELECT count(DISTINCT plot) AS n FROM u),
f AS (SELECT name, count(*) AS n FROM u GROUP BY name),
"""
_PAIRS = _NAMES + """
p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS n_ab
      FROM u a JOIN u b ON a.plot = b.plot AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 5),
x AS (SELECT name_a, name_b, fa.n AS n_a, fb.n AS n_b, n_ab, total.n AS nn
      FROM p JOIN f fa ON fa.name = name_a JOIN f fb ON fb.name = name_b, total)
"""
_MARK = "CASE WHEN count(DISTINCT plot) < 3 THEN 'rare' WHEN 5 * count(DISTINCT plot) > max(total.n) THEN 'common' END"

QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_all_pairs": p4_all_pairs, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_report": p6_report, "p7_ids": p7_ids, "p8_found": p8_found, "p8_report": p8_report, "p8_near": p8_near, "p9_found": p9_found, "p9_masked": p9_masked}
SQL = {
    "p4_found": _PAIRS + "SELECT name_a, name_b FROM x WHERE n_ab * nn >= 6 * n_a * n_b",
    "p4_pairs": _PAIRS + """SELECT name_a, name_b, n_a, n_b, n_ab, round(n_ab * nn::DOUBLE / (n_a * n_b), 6) AS lift,
      round(ln((n_ab + 0.5::DOUBLE) * (nn - n_a - n_b + n_ab + 0.5::DOUBLE)
               / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))), 6) AS log_odds FROM x""",
    "p5_found": _NAMES + f"y AS (SELECT name AS species_name, {_MARK} AS mark FROM tokens, total GROUP BY name) SELECT * FROM y WHERE mark IS NOT NULL",
    "p5_counts": _NAMES + f"y AS (SELECT name AS species_name, count(*) AS n_records, count(DISTINCT plot) AS n_plots, {_MARK} AS mark FROM tokens, total GROUP BY name) SELECT * FROM y",
    "p8_report": r"""
WITH d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(item_text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
dg AS (SELECT doc_id, s, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d)),
ig AS (SELECT item_id, s, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i)),
met AS (SELECT DISTINCT doc_id, item_id, dg.s - ig.s AS delta FROM dg JOIN ig USING (g)),
e AS (SELECT met.*, p, i.w[p] = coalesce(CASE WHEN p + delta > 0 THEN d.w[p + delta] END, '') AS same, list_contains(d.w[greatest(1, p + delta - 3):greatest(0, p + delta + 3)], i.w[p]) AS close
      FROM met JOIN d USING (doc_id) JOIN i USING (item_id), unnest(range(1, len(i.w) + 1)) AS u(p)),
runs AS (SELECT doc_id, item_id, delta, count(*) AS run FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, delta ORDER BY p) AS island FROM e WHERE same)
         GROUP BY doc_id, item_id, delta, island),
a AS (SELECT doc_id, item_id, delta, count(*) FILTER (same) AS aligned, count(*) FILTER (close) AS near FROM e GROUP BY 1, 2, 3)
SELECT doc_id, item_id, longest_run, aligned_words, near_words
FROM (SELECT doc_id, item_id, max(run) AS longest_run FROM runs GROUP BY 1, 2) JOIN (SELECT doc_id, item_id, max(aligned) AS aligned_words, max(near) AS near_words FROM a GROUP BY 1, 2) USING (doc_id, item_id)""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(item_text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d)),
ig AS (SELECT item_id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
