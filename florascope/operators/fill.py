"""Missing numbers and classes filled from similar records by label propagation.

Records hang on hubs: the same plot, the same place, the same height in the same district. A hub passes the average of its
members' values (for classes: their distribution) to the members, each record takes the weighted average of its hubs, and so on
for some rounds; observed values never change. Work grows with records times hubs, as no two records are ever paired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage

#: Weight of a record's estimate against an observed value when hubs average their members.
ESTIMATE = 0.25
#: Missing values that may ask one hub before it is taken out of the shuffled join.
HOT_HUB = 50_000


@dataclass(frozen=True)
class Hub:
    """Records with the same non-null key hang together for these fields."""

    name: str
    key: Column
    fields: tuple[str, ...]
    weight: float


def _long(df: DataFrame, row_id: str, values: dict[str, Column], classes: dict[str, Column]) -> DataFrame:
    """(id, field, label, value): a number has the empty label, a class has itself as label and 1 as value; missing: value null."""
    parts = [F.struct(F.lit(f).alias("field"), F.lit("").alias("label"), c.cast("double").alias("value")) for f, c in values.items()]
    parts += [
        F.struct(F.lit(f).alias("field"), F.coalesce(c, F.lit("")).alias("label"), F.when(c.isNotNull(), 1.0).cast("double").alias("value"))
        for f, c in classes.items()
    ]
    return df.select(F.col(row_id).alias("id"), F.explode(F.array(*parts)).alias("x")).select("id", "x.*")


def propagate_fill(
    df: DataFrame, row_id: str, values: dict[str, Column], classes: dict[str, Column], hubs: list[Hub], rounds: int = 3
) -> DataFrame:
    """(row_id, field, value, label, was_filled, confidence) for each row and field: value of numbers, label of classes.

    values and classes give each field's observed value, null where it is missing; not-a-number says that there is a value but none
    that can be averaged (it comes out as null, not marked). was_filled marks the missing ones. confidence, of filled ones only, is
    the share of the class among its hubs, or the weight W of a number's hubs as W / (W + 1). Where no hub has an observed member, the
    whole table's average or commonest class is put in with confidence 0; a field without any observed value stays null and marked.
    Ties between classes go to the lowest. row_id has to be unique; an empty table gives no rows; columns of df that aren't named
    don't matter.

    A hub that more than HOT_HUB missing values ask is sent to the askers' partitions instead of being a key of the join.
    """
    # What is read many times is written once: values, classes and hub keys, not the plan that makes them.
    named = {f"v{i}": c.cast("double") for i, c in enumerate(values.values())} | {f"c{i}": c for i, c in enumerate(classes.values())}
    named |= {f"h{i}": h.key.cast("string") for i, h in enumerate(hubs)}
    rec = stage(df.select(F.col(row_id).alias("id"), *[c.alias(n) for n, c in named.items()]), "records")
    long = _long(rec, "id", {f: F.col(f"v{i}") for i, f in enumerate(values)}, {f: F.col(f"c{i}") for i, f in enumerate(classes)})
    present, missing = long.where("value is not null"), long.where("value is null").select("id", "field")
    observed = present.where(~F.isnan("value"))
    is_class = F.col("field").isin(*classes) if classes else F.lit(False)
    keys = F.array(*[
        F.struct(F.lit(f).alias("field"), F.concat(F.lit(h.name + ":"), F.col(f"h{i}")).alias("hub"), F.lit(h.weight).alias("w"))
        for i, h in enumerate(hubs) for f in h.fields
    ])
    edges = rec.select("id", F.explode(keys).alias("e")).select("id", "e.*").where("hub is not null")
    wanting = edges.join(missing, ["id", "field"], "left_semi")
    asked = stage(wanting.groupBy("field", "hub").agg(F.count("*").alias("asks")), "asked")
    hot = asked.where(F.col("asks") > HOT_HUB).select("field", "hub")
    n_hot = hot.count()
    hot = broadcast_if_small(hot.withColumn("hot", F.lit(True)), n_hot, 80)
    wanting = stage(wanting.join(hot, ["field", "hub"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "wanting")
    # Of each hub that some missing value hangs on: sum and number of its observed members, for classes by label.
    seen = edges.join(observed, ["id", "field"]).groupBy("field", "hub", "label").agg(F.sum("value").alias("s"), F.count("*").cast("double").alias("n"))
    seen = stage(seen.join(asked.select("field", "hub"), ["field", "hub"], "left_semi"), "seen")
    totals, estimate = seen, None
    for r in range(rounds):
        if estimate is not None:
            passed = wanting.join(estimate, ["id", "field"]).select(
                "field", "hub", "label", (F.col("value") * ESTIMATE).alias("s"), (F.when(is_class, F.col("value")).otherwise(1.0) * ESTIMATE).alias("n"))
            totals = seen.unionByName(passed).groupBy("field", "hub", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        hub = Window.partitionBy("field", "hub")
        summed = totals.select("field", "hub", "label", "s", F.sum("n").over(hub).alias("n"), (F.col("label") == F.min("label").over(hub)).alias("first"))
        # The row without a label carries the hub's weight itself.
        means = summed.select("field", "hub", F.explode(F.array(
            F.struct(F.col("label"), (F.col("s") / F.col("n")).alias("mean")),
            F.struct(F.lit(None).cast("string").alias("label"), F.when(F.col("first"), 1.0).alias("mean")),
        )).alias("m")).select("field", "hub", "m.*").where("mean is not null")
        cold = wanting.where("not hot").join(means, ["field", "hub"]).select("id", "field", "label", (F.col("w") * F.col("mean")).alias("v"))
        if n_hot:
            of_hot = stage(means.join(hot, ["field", "hub"], "left_semi"), "hot")
            warm = wanting.where("hot").join(broadcast_if_small(of_hot, of_hot.count(), 120), ["field", "hub"])
            cold = cold.unionByName(warm.select("id", "field", "label", (F.col("w") * F.col("mean")).alias("v")))
        given = cold.groupBy("id", "field", "label").agg(F.sum("v").alias("v"))
        total = F.max(F.when(F.col("label").isNull(), F.col("v"))).over(Window.partitionBy("id", "field"))
        given = given.withColumn("weight", total).where("label is not null")
        estimate = given.select("id", "field", "label", (F.col("v") / F.col("weight")).alias("value"), "weight")
        estimate = stage(estimate, f"round{r}")
    best = estimate.groupBy("id", "field").agg(F.min(F.struct((-F.col("value")).alias("v"), "label", "weight")).alias("b")).select(
        "id", "field", (-F.col("b.v")).alias("value"), F.col("b.label").alias("label"), F.col("b.weight").alias("weight"))
    whole = observed.groupBy("field", "label").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    whole = whole.groupBy("field").agg(F.min(F.struct((-F.col("n")).alias("n"), "label", "mean")).alias("b")).select(
        "field", F.col("b.label").alias("all_label"), F.col("b.mean").alias("all_mean"))
    sure = F.when(is_class, F.col("value")).otherwise(F.col("weight") / (F.col("weight") + 1))
    # One row a field: as many rows as the caller has named fields.
    filled = missing.join(best, ["id", "field"], "left").join(F.broadcast(whole), "field", "left").select(
        "id", "field", F.coalesce("value", "all_mean").alias("value"), F.coalesce("label", "all_label").alias("label"), F.lit(True).alias("was_filled"),
        F.coalesce(sure, F.lit(0.0)).alias("confidence"))
    kept = F.when(~F.isnan("value"), F.col("value")).alias("value")
    out = present.select("id", "field", kept, "label", F.lit(False).alias("was_filled"), F.lit(None).cast("double").alias("confidence")).unionByName(filled)
    return out.select(
        F.col("id").alias(row_id), "field", F.when(~is_class, F.col("value")).alias("value"), F.when(is_class, F.col("label")).alias("label"),
        "was_filled", "confidence")
