"""One quantity recorded in several units: what each row or source says about its unit, a classifier for those that say nothing,
and the conversion into degrees Celsius.

The row's own words go first, if they leave the value possible; then the words of its source. For sources that say nothing, a
calibrated random forest, trained on rows whose unit is told, gives each row's probability of each unit from its magnitude and
the fields beside it. A source delivers in one unit, so its rows' evidence is added up; but its rows are alike, and the sum is
weighed down to an effective number of rows. How much, and how often sources of a size are decided rightly, is measured on told
sources that the forest hasn't seen: no assignment is surer than that. Assignments below CONFIDENT go to review.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage

UNITS = ("C", "C10", "F", "K", "K10")
#: Possible annual means, degrees Celsius.
LOW, HIGH = -30.0, 45.0
#: Rows the forests are trained on, at most. Each of FOLDS forests leaves out the told sources of its fold, which calibrate it.
TRAIN_ROWS = 50_000
FOLDS = 2
#: Sizes of held-out groups of rows of one source, and likenesses of a source's rows, that the calibration looks at.
SIZES = (1, 4, 16, 64, 1 << 30)
LIKENESS = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: Least probability of a source's unit.
CONFIDENT = 0.9


def to_celsius(value: Column, unit: str | Column) -> Column:
    forms = {"C": value, "C10": value / 10, "F": (value - 32) * 5 / 9, "K": value - 273.15, "K10": value / 10 - 273.15}
    if isinstance(unit, str):
        return forms[unit]
    out = F.lit(None).cast("double")
    for u, f in forms.items():
        out = F.when(unit == u, f).otherwise(out)
    return out


#: Ends of the possible range in each unit, as stored.
RANGE = {"C": (-30.0, 45.0), "C10": (-300.0, 450.0), "F": (-22.0, 113.0), "K": (243.15, 318.15), "K10": (2431.5, 3181.5)}


def possible(value: Column, unit: str | Column) -> Column:
    """Whether the value lies within LOW..HIGH when read in unit; false for null."""
    if isinstance(unit, str):
        return F.coalesce(value.between(*RANGE[unit]), F.lit(False))
    out = F.lit(False)
    for u in UNITS:
        out = F.when(unit == u, possible(value, u)).otherwise(out)
    return out


def missing_temperature(value: Column) -> Column:
    """Null, not-a-number, or outside the possible range in every unit."""
    fits = F.lit(False)
    for u in UNITS:
        fits = fits | possible(value, u)
    return value.isNull() | F.isnan(value) | ~fits


_TENTHS = (
    r"tenth|zehntel|dixi[eè]me|\bdeci-|x ?10\b|× ?10|\* ?10\b|\b10 ?x\b|times (?:ten|10)|mal (?:10|zehn)|por (?:10|diez)|par (?:10|dix)|"
    r"0[.,]1\b|/ ?10\b|\bd[ck]\b|\b[ckt]x?10\b|multiplied by (?:10|ten)|d[eé]cimas\b"
)
_KELVIN = r"kelvin|absolute temp|temp[a-z]* absol|absolute temperatur|(?<![a-z])d?k(?![a-z])"
_FAHRENHEIT = r"fahrenheit|degf\b|(?<![a-z])f(?![a-z])"
_CELSIUS = r"celsius|centigrad|zentigrad|grado c|degc\b|(?<![a-z])d?c(?![a-z])"


def stated_unit(text: Column) -> Column:
    """Unit code told by a free text, null if it tells none (or more than one)."""
    t = F.lower(text)
    k, f, c = t.rlike(_KELVIN), t.rlike(_FAHRENHEIT), t.rlike(_CELSIUS)
    ten = t.rlike(_TENTHS)
    kind = F.when(k & ~f & ~c, F.when(ten, "K10").otherwise("K")).when(c & ~f & ~k, F.when(ten, "C10").otherwise("C"))
    return kind.when(f & ~c & ~k, "F")


def told_units(df: DataFrame, value: str, own: list[str], source_text: str, stated: Callable[[Column], Column] = stated_unit) -> DataFrame:
    """Adds own_unit (the first possible one of the row's own texts), source_unit (the source's, if told) and told (what holds)."""
    v = F.col(value)
    mine = F.coalesce(*[F.when(possible(v, stated(F.col(c))), stated(F.col(c))) for c in own], F.lit(None).cast("string"))
    df = df.withColumn("own_unit", mine).withColumn("source_unit", stated(F.col(source_text)))
    return df.withColumn("told", F.coalesce("own_unit", F.when(possible(v, F.col("source_unit")), F.col("source_unit"))))


def _features(df: DataFrame, value: str, neighbours: list[str], driver: str, line: tuple[float, float, float]) -> tuple[DataFrame, list[str]]:
    """Magnitude, whether it is whole, the fields beside it, and for each unit how far its reading is from what driver suggests."""
    slope, base, mean = line
    v = F.col(value)
    expected = F.coalesce(F.when(~F.isnan(driver), F.col(driver) * slope + base), F.lit(mean))
    cols = {"x_value": v, "x_log": F.log1p(F.abs(v)), "x_whole": (v == F.floor(v)).cast("double")}
    cols |= {f"x_off_{u}": F.least(F.abs(to_celsius(v, u) - expected), F.lit(1e4)) for u in UNITS}
    cols |= {f"x_{n}": F.coalesce(F.when(~F.isnan(n), F.col(n).cast("double")), F.lit(-999.0)) for n in neighbours}
    return df.withColumns(cols), list(cols)


def _scores(forest: RandomForestClassificationModel, rows: DataFrame, inputs: list[str], keep: list[str]) -> DataFrame:
    """keep and p, the probability of each of UNITS (classes the forest doesn't know have none)."""
    p = vector_to_array("probability")
    x = forest.transform(VectorAssembler(inputCols=inputs, outputCol="x", handleInvalid="keep").transform(rows))
    return x.select(*keep, F.array(*[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(len(UNITS))]).alias("p"))


def _evidence(value: str, rate: list[float]) -> list[Column]:
    """Log of the calibrated probability of each unit in which the value is possible."""
    table = F.array(*map(F.lit, rate))
    q = lambda k: F.element_at(table, F.least(F.floor(F.element_at("p", k + 1) * len(rate)), F.lit(len(rate) - 1)).cast("int") + 1)
    return [F.log(F.greatest(F.when(possible(F.col(value), u), q(k)).otherwise(0.0), F.lit(1e-4))).alias(f"e{k}") for k, u in enumerate(UNITS)]


@dataclass(frozen=True)
class Calibration:
    """likeness of a source's rows (0: each is evidence of its own, 1: all say the same), and by size of the source (SIZES) the
    held-out groups and how many of them were decided rightly."""

    likeness: float
    groups: tuple[int, ...]
    right: tuple[int, ...]

    def bound(self) -> list[float]:
        """By size: the share of rightly decided groups, half a group added to either side."""
        return [(k + 0.5) / (n + 1) for k, n in zip(self.right, self.groups, strict=True)]


def _calibrate(held: DataFrame) -> Calibration:
    """held: (src, label, u, e0..), told rows by forests that haven't seen their source. Groups of each size are cut by the hash u."""
    size = held.groupBy("src", "label").agg(F.count("*").alias("rows"))
    parts = F.array(*[F.struct(F.lit(i).alias("size"), F.pmod("u", F.greatest(F.ceil(F.col("rows") / n), F.lit(1))).alias("part")) for i, n in enumerate(SIZES)])
    x = held.join(size, ["src", "label"]).select("src", "label", F.explode(parts).alias("g"), *[f"e{k}" for k in range(len(UNITS))])
    x = x.groupBy("src", "label", "g.size", "g.part").agg(F.count("*").alias("n"), *[F.sum(f"e{k}").alias(f"s{k}") for k in range(len(UNITS))])
    true = F.element_at(F.array(*[f"s{k}" for k in range(len(UNITS))]), F.col("label").cast("int") + 1)
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(UNITS))])
    loss = [F.sum((true - top) / (1 + (F.col("n") - 1) * r) - F.log(_mass(1 + (F.col("n") - 1) * r))).alias(f"l{i}") for i, r in enumerate(LIKENESS)]
    rows = x.groupBy("size").agg(F.count("*").alias("n"), F.sum((true == top).cast("int")).alias("right"), *loss).collect()
    by = {r["size"]: r for r in rows}
    total = [sum(r[f"l{i}"] for r in rows) for i in range(len(LIKENESS))]
    # Of equally likely ones the most cautious.
    likeness = max(zip(total, LIKENESS, strict=True), key=lambda t: (round(t[0], 3), t[1]))[1] if rows else 1.0
    count = lambda i, c: by[i][c] if i in by else 0
    return Calibration(likeness, tuple(count(i, "n") for i in range(len(SIZES))), tuple(count(i, "right") for i in range(len(SIZES))))


def _mass(weight: Column | float) -> Column:
    """Sum of exp((s - top) / weight)."""
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(UNITS))])
    return sum((F.exp((F.col(f"s{k}") - top) / weight) for k in range(1, len(UNITS))), F.exp((F.col("s0") - top) / weight))


def _source(source: str, row_id: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))


@dataclass
class Fitted:
    """A forest on all told sources, its inputs' line, the rates of its probabilities and the calibration of its decisions."""

    forest: RandomForestClassificationModel
    line: tuple[float, float, float]
    rate: list[float]
    calibration: Calibration


def fit_units(rows: DataFrame, row_id: str, value: str, source: str, neighbours: list[str], driver: str) -> Fitted | None:
    """Fits on the told ones of rows (staged, with told_units); None if no row is told."""
    told = rows.where("told is not null")
    c, d = to_celsius(F.col(value), F.col("told")), F.col(driver)
    slope, base, mean, n = told.select(c.alias("c"), F.when(~F.isnan(d), d).alias("d")).agg(
        F.try_divide(F.covar_samp("c", "d"), F.var_samp(F.when(F.col("c").isNotNull(), F.col("d")))), F.avg("d"), F.avg("c"), F.count("c")).first()
    if not n:
        return None
    slope = slope or 0.0
    line = (slope, mean - slope * (base or 0.0), mean)
    labelled, inputs = _features(told, value, neighbours, driver, line)
    label = F.array_position(F.array(*map(F.lit, UNITS)), F.col("told")) - 1
    shares = {r.told: min(1.0, TRAIN_ROWS / len(UNITS) / r.n) for r in told.groupBy("told").agg(F.count("*").alias("n")).collect()}
    cut = F.lit(0.0)
    for u, s in shares.items():
        cut = F.when(F.col("told") == u, s).otherwise(cut)
    u = F.pmod(F.xxhash64(row_id, F.lit("s")), F.lit(1_000_000))
    src = _source(source, row_id)
    chosen = labelled.where(u < cut * 1_000_000).select(
        value, src.alias("src"), label.cast("double").alias("label"), u.alias("u"), F.pmod(F.xxhash64(src, "told", F.lit(5)), F.lit(FOLDS)).alias("fold"), *inputs)
    sample = stage(chosen, "train")
    grow = lambda x: RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=24, maxDepth=7, subsamplingRate=0.6, seed=42).fit(
        VectorAssembler(inputCols=inputs, outputCol="x", handleInvalid="keep").transform(x).select("x", "label"))
    unseen = []
    for k in range(FOLDS):
        rest = sample.where(F.col("fold") != k)
        if rest.limit(1).count():
            unseen.append(_scores(grow(rest), sample.where(F.col("fold") == k), inputs, [value, "src", "label", "u"]))
    flat = [(b + 0.5) / 20 for b in range(20)]
    if not unseen:
        return Fitted(grow(sample), line, flat, Calibration(1.0, (0,) * len(SIZES), (0,) * len(SIZES)))
    held = stage(reduce(DataFrame.unionByName, unseen), "held")
    # By bins of probability: how often a unit given such a one is the row's unit.
    bins = held.select("label", F.posexplode("p").alias("k", "p")).groupBy(F.least(F.floor(F.col("p") * 20), F.lit(19)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum((F.col("label") == F.col("k")).cast("int")).alias("hits")).collect()
    rate = list(flat)
    for r in bins:
        rate[r.bin] = (r.hits + 20 * flat[r.bin]) / (r.n + 20)
    return Fitted(grow(sample), line, rate, _calibrate(held.select("src", "label", "u", *_evidence(value, rate))))


def _told_rows(df: DataFrame, row_id: str, value: str, own: list[str], source: str, source_text: str, neighbours: list[str], driver: str, stated: Callable) -> DataFrame:
    keep = list(dict.fromkeys([row_id, value, *own, source, source_text, *neighbours, driver]))
    rows = told_units(df.select(*keep).where(~missing_temperature(F.col(value))), value, own, source_text, stated)
    return stage(rows.drop(*[c for c in (*own, source_text) if c not in neighbours]), "units")


def unit_reliability(
    df: DataFrame, row_id: str, value: str, own: list[str], source: str, source_text: str, neighbours: list[str], driver: str, stated: Callable[[Column], Column] = stated_unit
) -> DataFrame:
    """(rows_up_to, n_groups, n_right, share, bound, likeness): how the forest alone decides told sources whose words and rows it hasn't seen."""
    fit = fit_units(_told_rows(df, row_id, value, own, source, source_text, neighbours, driver, stated), row_id, value, source, neighbours, driver)
    schema = "rows_up_to long, n_groups long, n_right long, share double, bound double, likeness double"
    c = fit.calibration if fit else None
    out = [(n, g, k, k / g if g else None, b, c.likeness) for n, g, k, b in zip(SIZES, c.groups, c.right, c.bound(), strict=True)] if c else []
    return df.sparkSession.createDataFrame(out, schema)


def infer_units(
    df: DataFrame, row_id: str, value: str, own: list[str], source: str, source_text: str, neighbours: list[str], driver: str,
    stated: Callable[[Column], Column] = stated_unit,
) -> DataFrame:
    """(row_id, unit, celsius, basis, confidence) for every row whose value isn't missing.

    basis: 'row' or 'source' if told, 'model' if assigned with at least CONFIDENT, else 'review' (unit and celsius null there).
    own: the row's texts in order of weight; source: its source's key; source_text: the source's description, already joined;
    neighbours: numeric fields beside the value; driver: the one of them that the quantity follows most closely (elevation); stated:
    reads the unit code from a text. A null source is one of its own for each row. With no told row there is no model and everything
    untold goes to review. Rows repeated in the table are repeated in the result. An empty table gives no rows.
    """
    rows = _told_rows(df, row_id, value, own, source, source_text, neighbours, driver, stated)
    told = rows.where("told is not null").select(
        row_id, F.col("told").alias("unit"), to_celsius(F.col(value), F.col("told")).alias("celsius"),
        F.when(F.col("own_unit").isNotNull(), "row").otherwise("source").alias("basis"), F.lit(1.0).alias("confidence"),
    )
    untold = rows.where("told is null")
    fit = fit_units(rows, row_id, value, source, neighbours, driver)
    if fit is None:
        return told.unionByName(untold.select(
            row_id, F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("celsius"), F.lit("review").alias("basis"), F.lit(0.0).alias("confidence")))
    silent, inputs = _features(untold, value, neighbours, driver, fit.line)
    given = _scores(fit.forest, silent.withColumn("src", _source(source, row_id)), inputs, [row_id, value, "src"])
    given = stage(given.select(row_id, value, "src", *_evidence(value, fit.rate)), "given")
    sums = given.groupBy("src").agg(F.count("*").alias("n"), *[F.sum(f"e{k}").alias(f"s{k}") for k in range(len(UNITS))])
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(UNITS))])
    unit = F.coalesce(*[F.when(F.col(f"s{k}") == top, F.lit(u)) for k, u in enumerate(UNITS)])
    bound = F.lit(0.0)
    for n, b in reversed(list(zip(SIZES, fit.calibration.bound(), strict=True))):
        bound = F.when(F.col("n") <= n, b).otherwise(bound)
    alike = 1 + (F.col("n") - 1) * fit.calibration.likeness
    sums = sums.select("src", unit.alias("unit"), (bound * F.try_divide(F.lit(1.0), _mass(alike))).alias("confidence"))
    sure = (F.col("confidence") >= CONFIDENT) & possible(F.col(value), F.col("unit"))
    # A source with a third of all rows is one key here: few sources are sent to the rows instead.
    modelled = given.join(broadcast_if_small(sums, sums.count(), 64), "src").select(
        row_id, F.when(sure, F.col("unit")).alias("unit"), F.when(sure, to_celsius(F.col(value), F.col("unit"))).alias("celsius"),
        F.when(sure, "model").otherwise("review").alias("basis"), "confidence")
    return told.unionByName(modelled)
