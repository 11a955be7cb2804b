"""Free-entered names brought to the entry of a reference list that they mean.

A set-similarity join with a prefix filter over character bigrams: names are cleaned into keys, each key is a set of numbered
bigrams in the order of their rarity over all keys, and only keys sharing one of their rarest bigrams meet. Two keys at most
`slips` single-letter changes apart share at least max(|r|, |s|) - 2 * slips bigrams, so the rarest 2 * slips + 1 of either one
are enough to find every such pair; the length and positional filters use the same bound. The Jaccard similarity of what is left
is computed exactly against the bound, then the slips themselves are counted, and the best entry is kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_BYTES, broadcast_if_small, stage



@dataclass(frozen=True)
class Rules:
    """How a name becomes a key. By default all its words do.

    parts: words that make the key, if not all; doubt: words that leave the entry as it is; at the first of cut everything after it is
    dropped too; in the place of the second word, those of open_ say that the entry isn't known. With parts, an initial may
    stand for the first word, and a single word is a code, or a name if it has joined letters or more.
    """

    parts: int | None = None
    doubt: frozenset[str] = frozenset()
    cut: frozenset[str] = frozenset()
    open_: frozenset[str] = frozenset()
    joined: int = 12


#: Two-part scientific names: words of doubt and of ranks below the species, fixed values.
BINOMIAL = Rules(
    2, frozenset({"cf", "aff", "nr", "near", "affinis", "confer"}),
    frozenset({"subsp", "ssp", "var", "f", "forma", "subvar", "cv", "subspecies", "varietas", "ex", "x"}),
    frozenset({"sp", "spp", "indet", "species", "ined", "undet", "unidentified", "unknown"}),
)
#: Parts the queries of a gram are spread over where the list is too long to be sent to them.
SALTS = 8
KEYS = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("grams", T.ArrayType(T.StringType())),
])


def fold(s: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", s).lower() if not unicodedata.combining(c))


def grams(key: str) -> list[str]:
    """Bigrams of the padded key, numbered where they repeat. l, i and 1 count as one letter, as scans confuse them."""
    k, seen, out = "^" + key.replace("1", "i").replace("l", "i") + "$", {}, []
    for i in range(len(k) - 1):
        g = k[i : i + 2]
        seen[g] = n = seen.get(g, -1) + 1
        out.append(f"{g}{n}" if n else g)
    return out


def keys_of(name: str, rules: Rules = Rules(), listed: str | None = None) -> list[tuple[str, str]]:
    """(key, kind) of what a name may be: kind 'name' (letters of its words), 'short' (initial and second word) or 'code'.

    The same for typed names and for those of the list; listed is the kind the list gives ('code' ones are codes only).
    """
    s = fold(name)
    if listed:
        words = re.findall(r"[^\W_]+", s)
        key = "".join(words)
        out = [(key, "code" if listed == "code" else "name")] if words else []
        if listed == "scientific" and rules.parts and len(words) > 1:
            out.append((words[0][0] + words[1], "short"))
        return out
    s = re.sub(r"\([^)]*\)?|\[[^\]]*\]?|\"", " ", s)
    s = re.sub(r"^[\s*?.\-]*(?:\d+\s*[.):]\s+)?[\s*?]*", "", s)
    if rules.parts and (m := re.fullmatch(r"\s*([^\W_]+)\s*,\s*([^\W_]+)[\s.?]*", s)):
        s = f"{m[2]} {m[1]}"
    words = []
    for w in re.findall(r"[^\W_]+", s):
        if w in rules.cut and words:
            break
        if w not in rules.doubt:
            words.append(w)
    if not words:
        return []
    if not rules.parts:
        key = "".join(words)
        return [(key, "name"), (key, "code")]
    out = []
    if len(words[0]) == 1:
        if len(words) > 1 and len(words[1]) > 3:
            out.append((words[0] + words[1], "short"))
        return out
    if re.fullmatch(r"[a-z]{5,}\d{0,3}", words[0]):
        out.append((words[0], "code"))
    if len(words) > 1 and words[1] not in rules.open_:
        out.append(("".join(words[: rules.parts]), "name"))
    if len(words[0]) >= rules.joined:
        out.append((words[0], "name"))
    return out


def _ordered(keys: DataFrame, freq: DataFrame, key_cols: list[str]) -> DataFrame:
    """Adds ranked (the grams from the rarest on) by one grouping on the key."""
    x = keys.select(*key_cols, F.explode("grams").alias("gram")).join(freq, "gram")
    return x.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g")).select(
        *key_cols, F.col("g.gram").alias("ranked")
    )


def jaccard_bound(nq: Column, nr: Column, slips: int) -> Column:
    """Least similarity of two keys of nq and nr bigrams that are at most slips letters apart: a slip changes two bigrams at most."""
    need = F.greatest(F.greatest(nq, nr) - 2 * slips, F.lit(0))
    return need / (nq + nr - need)


def link_names(names: DataFrame, reference: DataFrame, slips: int = 2, rules: Rules = Rules(), min_jaccard: float = 0.0) -> DataFrame:
    """(name, entry, slips, jaccard) for every distinct non-null value of names.name; entry is null if it means none.

    A hit is verified twice: its exact Jaccard similarity reaches jaccard_bound (and min_jaccard, where short keys must not be taken
    for each other), and its slips are counted. rules: how names become keys.

    reference: (name, kind, entry); kind is 'scientific', 'local' or 'code'. Codes have to be given letter for letter (case and
    signs don't matter); a key cut to its initial and epithet has to mean one entry only. Of several entries the one with the
    fewest slips is taken, then the most similar one, then the lowest. Blank names and names without a letter mean none. Repeated
    reference rows do no harm; an empty reference leaves every name unmatched.
    """
    distinct = names.select("name").dropna().distinct()
    # Keys, entries and exact hits are read by several joins each: they are written once, not parsed again for every one.

    def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, k, kind, grams(k)) for n in b["name"] for k, kind in keys_of(n, rules)]
            yield pd.DataFrame(rows, columns=["name", "key", "kind", "grams"])

    def _reference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, kind, grams(k), e) for n, listed, e in zip(b["name"], b["kind"], b["entry"], strict=True) for k, kind in keys_of(n, rules, listed)]
            yield pd.DataFrame(rows, columns=["key", "kind", "grams", "entry"])

    parsed = stage(distinct.mapInPandas(_parse, KEYS), "keys")
    ref = reference.select("name", "kind", F.col("entry").cast("long").alias("entry")).dropna().mapInPandas(
        _reference, T.StructType([*KEYS.fields[1:], T.StructField("entry", T.LongType())])
    )
    short = ref.where("kind = 'short'").groupBy("key").agg(F.min("entry").alias("entry"), F.max("entry").alias("e2"), F.first("grams").alias("grams"))
    ref = ref.where("kind <> 'short'").unionByName(
        short.where("entry = e2").select("key", F.lit("short").alias("kind"), "grams", "entry")
    ).dropDuplicates(["key", "kind", "entry"])
    ref = stage(ref, "reference")
    n_ref = ref.count()
    small_ref = n_ref * 400 <= BROADCAST_BYTES
    exact = parsed.join(broadcast_if_small(ref.drop("grams"), n_ref, 400), ["key", "kind"]).select(
        "name", "entry", F.lit(0).alias("slips"), F.lit(1.0).alias("jaccard")
    )
    exact = stage(exact, "exact")
    rest = stage(parsed.where("kind <> 'code'").join(exact.select("name").distinct(), "name", "left_anti"), "rest")
    q_keys = rest.select("key", "kind", "grams").dropDuplicates(["key", "kind"])
    r_keys = ref.where("kind <> 'code'")
    freq = q_keys.select("grams").unionByName(r_keys.select("grams")).select(F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count("*").alias("n")
    )
    n_freq = freq.count()
    freq = broadcast_if_small(freq, n_freq, 40)
    cut = 2 * slips
    prefix = lambda c: F.posexplode(F.slice(c, 1, cut + 1)).alias("pos", "gram")
    q = _ordered(q_keys, freq, ["key", "kind"]).select("key", "kind", F.col("ranked").alias("q_grams"), prefix("ranked"))
    r = _ordered(r_keys, freq, ["key", "kind", "entry"]).select(
        F.col("key").alias("r_key"), "kind", "entry", F.col("ranked").alias("r_grams"), prefix("ranked")
    ).withColumnRenamed("pos", "r_pos")
    nq, nr = F.size("q_grams"), F.size("r_grams")
    need = F.greatest(nq, nr) - cut
    # The prefixes are five rows a key; a list too long to be broadcast meets a frequent gram's queries in SALTS places.
    if small_ref:
        r = broadcast_if_small(r, 5 * n_ref, 80)
    else:
        q = q.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = q.join(r, ["gram", "kind"] if small_ref else ["gram", "kind", "salt"]).where(F.abs(nq - nr) <= slips).where(F.least(nq - F.col("pos"), nr - F.col("r_pos")) >= need)
    met = met.dropDuplicates(["key", "kind", "r_key", "entry"])
    shared = F.size(F.array_intersect("q_grams", "r_grams"))
    met = met.withColumn("shared", shared).withColumn("jaccard", F.col("shared") / (nq + nr - F.col("shared")))
    met = met.where((F.col("jaccard") >= jaccard_bound(nq, nr, slips) - 1e-12) & (F.col("jaccard") >= min_jaccard))
    like = lambda c: F.translate(c, "1l", "ii")
    edits = F.when(F.col("key").contains("1"), F.levenshtein(like(F.col("key")), like(F.col("r_key")), slips)).otherwise(
        F.levenshtein(F.col("key"), F.col("r_key"), slips)
    )
    close = met.withColumn("slips", edits).where(F.col("slips") >= 0).select(
        "key", "kind", "entry", "slips", "jaccard"
    )
    found = exact.unionByName(rest.join(close, ["key", "kind"]).select("name", "entry", "slips", "jaccard"))
    best = found.groupBy("name").agg(F.min(F.struct("slips", (-F.col("jaccard")).alias("j"), "entry")).alias("b"))
    best = best.select("name", F.col("b.entry").alias("entry"), F.col("b.slips").alias("slips"), (-F.col("b.j")).alias("jaccard"))
    return distinct.join(best, "name", "left")
