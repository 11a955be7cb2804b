"""Header and value cleaning, filters and quality tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Params
from ..functions.text import collapse_whitespace

NUMERIC = (T.NumericType,)


def normalize_header(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def standardize_columns(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Renames columns to canonical names: for each, the first wanted header that is there; names already canonical stay."""
    at = {}
    for c in df.columns:
        at.setdefault(normalize_header(c), c)
    renames = {}
    for canonical, wanted in params.headers.items():
        if canonical in df.columns:
            continue
        hit = next((at[normalize_header(w)] for w in wanted if normalize_header(w) in at), None)
        if hit and hit not in renames:
            renames[hit] = canonical
    df = df.withColumnsRenamed(renames)
    texts = [c for c in ("forest_type", "stratum") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else df


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(gone)}; there are {', '.join(df.columns)}")


def add_missing(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def collapse_all(df: DataFrame) -> DataFrame:
    """Collapses white space in every text column in one projection."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: collapse_whitespace(F.col(c)) for c in texts})


def title_case(c: Column) -> Column:
    """Upper case for the first letter of every run of letters, lower case for the rest (initcap only restarts at spaces)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    # Letters and spaces alone, as in nearly all names, need no more than initcap.
    plain = c.rlike(r"^[\p{L} ]*$")
    return F.when(plain, F.initcap(c)).otherwise(F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), ""))


def clean_species(c: Column) -> Column:
    return title_case(collapse_whitespace(c))


def to_number(c: Column) -> Column:
    """Number or null: unreadable text and not-a-number are null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def valid_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in columns]))


def valid_coordinates(lon: str = "longitude", lat: str = "latitude") -> Column:
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)


def inside_bbox(lon: str = "longitude", lat: str = "latitude", params: Params = DEFAULTS) -> Column:
    w, s, e, n = params.bbox
    return F.coalesce(F.col(lon).between(w, e) & F.col(lat).between(s, n) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def union_strata(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of several, stratum telling the source; columns that one of them lacks are null."""
    if not tables:
        raise ValueError("no stratum table was given")
    parts = [df.withColumn("stratum", F.lit(s)) for s, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations on more than one row, null keys too."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missingness(df: DataFrame) -> DataFrame:
    """(column, n_missing, n_rows, pct_missing) in one pass; empty texts and not-a-number are missing."""

    def gone(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return F.count_if(c.isNull() | (c == ""))
        return F.count_if(c.isNull() | F.isnan(c)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.count_if(c.isNull())

    one = df.agg(F.count("*").alias("_n"), *[gone(f).alias(f"_{i}") for i, f in enumerate(df.schema)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"_{i}").alias("n_missing")) for i, f in enumerate(df.schema)])
    return one.select("_n", F.explode(rows).alias("r")).select(
        "r.column", "r.n_missing", F.col("_n").alias("n_rows"), (F.col("r.n_missing") * 100.0 / F.greatest(F.col("_n"), F.lit(1))).alias("pct_missing")
    )


def numeric_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in leave_out]


def unpivot_numbers(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), to_number(F.col(c)).alias("value")) for c in columns])
    return df.select(*(keep or []), F.explode(rows).alias("r")).select(*(keep or []), "r.variable", "r.value")


def na_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return unpivot_numbers(df, columns).groupBy("variable").agg(F.avg(F.col("value").isNull().cast("double")).alias("na_rate"))


def iqr_outliers(df: DataFrame, columns: list[str], k: float = DEFAULTS.iqr_multiplier) -> DataFrame:
    """Quartiles by linear interpolation and how many values lie further than k interquartile ranges outside."""
    long = unpivot_numbers(df, columns).where("value is not null")
    q = long.groupBy("variable").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q = q.select("variable", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    q = q.withColumns({"lower": F.col("q1") - k * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + k * (F.col("q3") - F.col("q1"))})
    # One row a column of the table.
    out = long.join(F.broadcast(q), "variable").groupBy("variable", "q1", "q3", "lower", "upper")
    return out.agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are there; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    return F.when(spread, F.covar_pop(a, b) / F.when(spread, F.stddev_pop(a) * F.stddev_pop(b)))


def collinear_pairs(df: DataFrame, columns: list[str], flag: float = DEFAULTS.correlation_flag) -> DataFrame:
    """Pairs of columns with an absolute correlation of at least flag; one aggregation over the table for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    num = df.select(*[to_number(F.col(c)).alias(c) for c in columns])
    one = num.agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("p")).select("p.*").where(F.abs("r") >= flag)


def taxonomic_duplicates(names: DataFrame, counts: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs of names of one genus whose epithets differ by at most distance letters, with the plots of either one.

    names: (species_name); counts: (species_name, n). The genus is the blocking key; names of one word take no part.
    """
    words = F.split("species_name", " ")
    n = names.select("species_name").distinct().where(F.size(words) >= 2).select(
        "species_name", F.element_at(words, 1).alias("genus"), F.lower(F.array_join(F.slice(words, 2, 100), " ")).alias("epithet"))
    a, b = n.alias("a"), n.alias("b")
    close = F.levenshtein(F.col("a.epithet"), F.col("b.epithet"), distance)
    pairs = a.join(b, (F.col("a.genus") == F.col("b.genus")) & (F.col("a.species_name") < F.col("b.species_name"))).select(
        F.col("a.genus").alias("genus"), F.col("a.species_name").alias("species_1"), F.col("b.species_name").alias("species_2"), close.alias("edit_distance"))
    pairs = pairs.where("edit_distance >= 0")
    for s in ("1", "2"):
        c = counts.select(F.col("species_name").alias(f"species_{s}"), F.col("n").alias(f"n_{s}"))
        pairs = pairs.join(c, f"species_{s}", "left").withColumn(f"n_{s}", F.coalesce(f"n_{s}", F.lit(0)))
    return pairs


def usable_predictors(df: DataFrame, columns: list[str], max_na: float = 0.5) -> DataFrame:
    """(variable, na_rate, sd) of columns with less than max_na missing and some spread."""
    x = unpivot_numbers(df, columns).groupBy("variable").agg(
        F.avg(F.col("value").isNull().cast("double")).alias("na_rate"), F.stddev_samp("value").alias("sd"))
    return x.where((F.col("na_rate") < max_na) & (F.col("sd") > 0))


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Puts each column's median where it is null; the medians come from one aggregation and are joined as one row."""
    m = df.agg(*[F.percentile(to_number(F.col(c)), F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    # m is one row by construction.
    return df.join(F.broadcast(m)).withColumns({c: F.coalesce(to_number(F.col(c)), F.col(f"_m_{c}")) for c in columns}).drop(*m.columns)


def aspect_components(c: Column) -> tuple[Column, Column]:
    """Northness as the sine and eastness as the cosine of the angle."""
    return F.sin(F.radians(c)), F.cos(F.radians(c))


def autoscale(df: DataFrame, column: str, threshold: float = DEFAULTS.scale_threshold) -> DataFrame:
    """Divides a column by ten if the median of its absolute values is above threshold; adds scale and warn (largest over 60)."""
    v = to_number(F.col(column))
    m = df.agg(F.percentile(F.abs(v), F.lit(0.5)).alias("_median"), F.max(F.abs(v)).alias("_max"))
    scale = F.when(F.col("_median") > threshold, 0.1).otherwise(1.0)
    out = df.join(F.broadcast(m)).withColumns({column: F.when(F.col("_median") > threshold, v / 10).otherwise(v), "scale": scale})
    return out.withColumn("warn", F.coalesce(F.col("_max") * F.col("scale") > 60, F.lit(False))).drop("_median", "_max")


def variable_group(c: Column, params: Params = DEFAULTS) -> Column:
    """climate, topography, soil or other, by keywords within the column's name; the first group that fits holds."""
    out = F.lit("other")
    for group, words in reversed(params.variable_groups):
        out = F.when(F.lower(c).rlike("|".join(words)), group).otherwise(out)
    return out


def ambiguous_taxon(c: Column) -> Column:
    return c.rlike(r"(?i)(unknown|not.?listed|unidentified|indet)")
