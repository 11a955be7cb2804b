"""The analysis as a graph of stages: order, levels, caching by content, dry runs, manifests and the command line.

A stage is a function from (spark, context) to named DataFrames. Each one is written as a table and read again by the stages
after it, so lineage ends between stages and a rerun can skip what hasn't changed. Stages of a level run as concurrent jobs of
one session under a fair scheduler pool each.
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import inspect
import json
import logging
import os
import re
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULTS, Params
from .monitor import check_result, check_setup, check_table, module_logger, progress
from .operators import clean, distances, diversity, indicators, network, ordination, ranks, raster, regions, replicates, stats, trend
from .plans import views
from .session import dense_ids
from .session import stage as stage_table
from .sources.readers import file_inventory
from .sources.sinks import read_json, write_json, write_table, write_text

log = logging.getLogger("florascope")


@dataclass
class Context:
    """Where a run reads and writes, and under which parameters."""

    spark: SparkSession
    source: str
    out: str
    params: Params = DEFAULTS

    def table(self, stage_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.out, stage_id, name))


@dataclass(frozen=True)
class Stage:
    id: str
    name: str
    deps: tuple[str, ...]
    run: Callable[[Context], dict[str, DataFrame]]
    tables: tuple[str, ...]
    inputs: tuple[str, ...] = ()
    #: Seconds it is taken to need before a run has told.
    estimate: float = 1.0


@dataclass
class Result:
    id: str
    status: str
    outputs: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0


def inspection(c: Context) -> dict[str, DataFrame]:
    return {"files": file_inventory(c.spark, [f"{c.source}/{t}.parquet" for t in ("veg_long_csv", "env_master_csv", "plot_points_gpkg", "soil_map_vector")])}


def cleaning(c: Context) -> dict[str, DataFrame]:
    veg = views.veg(c.spark, c.source)
    points = veg.where(clean.valid_coordinates()).select("plot_id", "longitude", "latitude").distinct()
    return {"veg_long": veg, "abundance": diversity.abundance(veg), "points": points}


def qc_cleaning(c: Context) -> dict[str, DataFrame]:
    v = c.table("01", "veg_long")
    return {
        "duplicates": clean.duplicate_groups(v, ["plot_id", "species_name", "stratum"]), "missing": clean.missingness(v),
        "richness": v.groupBy("plot_id").agg(F.count_distinct("species_name").alias("n_species")),
        "bbox": c.table("01", "points").withColumn("inside_bbox", clean.inside_bbox(params=c.params)),
    }


def environment(c: Context) -> dict[str, DataFrame]:
    """The plots' environment with the soil unit that holds each one or, outside all units, the nearest; a stored class only where the map knows none."""
    e = stage_table(views.env(c.spark, c.source), "env")
    soils = c.spark.read.parquet(f"{c.source}/soil_map_vector.parquet")
    units = regions.nearest_regions(e.where(clean.valid_coordinates()), "plot_id", "longitude", "latitude", soils, "unit_id", "geometry_wkt", "unit_id")
    vector = e.select("plot_id").join(units.join(soils.select("unit_id", "soil_type"), "unit_id").select("plot_id", "unit_id", "dist", "soil_type"), "plot_id", "left")
    vector = stage_table(vector, "soils")
    typed = c.spark.read.parquet(f"{c.source}/env_master_csv.parquet").where("plot_id is not null").groupBy("plot_id").agg(F.max_by("soil_type", "extracted_at").alias("soil_type"))
    soil = regions.with_fallback(vector, typed, "plot_id", "soil_type").withColumnRenamed("source", "soil_source")
    return {"env_master": e.join(soil, "plot_id", "left").join(vector.select("plot_id", F.col("unit_id").alias("soil_unit"), F.col("dist").alias("soil_distance")), "plot_id", "left")}


def qc_environment(c: Context) -> dict[str, DataFrame]:
    e = c.table("02", "env_master")
    cols = clean.numeric_columns(e, ("longitude", "latitude", "soil_distance"))
    return {"na_rates": clean.na_rates(e, cols), "outliers": clean.iqr_outliers(e, cols, c.params.iqr_multiplier), "collinear": clean.collinear_pairs(e, cols, c.params.correlation_flag)}


def alpha(c: Context) -> dict[str, DataFrame]:
    a = diversity.alpha_diversity(c.table("01", "abundance")).join(diversity.stratum_richness(c.table("01", "veg_long"), c.params), "plot_id", "left")
    full = diversity.guarded_left_join(a, c.table("02", "env_master"), "plot_id")
    banded = full.withColumn("band", diversity.band(F.col("elevation"), c.params))
    return {"alpha": full, "bands": diversity.band_summary(full, "richness", c.params), "kruskal": stats.kruskal_wallis(banded, "band", "richness"), "dunn": stats.dunn(banded, "band", "richness")}


def _groups(c: Context) -> DataFrame:
    return c.table("02", "env_master").select("plot_id", F.col("forest_type").alias("grp"))


def _cells(c: Context, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells (i, species_name, abund) of the plots of ids, ids with i)."""
    ids, _ = dense_ids(ids, "plot_id", "i")
    return c.table("01", "abundance").where("abund > 0").join(ids.select("plot_id", "i"), "plot_id").select("i", "species_name", "abund"), ids


def _grouped_cells(c: Context, ids: DataFrame) -> tuple[DataFrame, list[str]]:
    cells, ids = _cells(c, ids.where("grp is not null"))
    return stage_table(cells, "cells"), [x.grp for x in ids.select("i", "grp").orderBy("i").collect()]


#: Tables of stage 04 that need the plots' whole matrix, with the columns they have where it exceeds replicates.MATRIX_BYTES and they stay empty.
_DENSE = {
    "scores": "plot_id string, NMDS1 double, NMDS2 double, stress double, PCo1 double, PCo2 double", "permdisp": "f double, p double", "anosim": "r double, p double", "mantel": "r double, p double",
}


def _dense(c: Context, grouped: DataFrame) -> dict[str, DataFrame]:
    """NMDS and PCoA scores joined to the environment, PERMDISP, ANOSIM and Mantel tests; grouped: (plot_id, grp) of plots with abundance."""
    spark, n = c.spark, grouped.count()
    if n < 4 or 2 * n * n * 8 > replicates.MATRIX_BYTES:
        module_logger("04").warning("%d plots: no whole matrix; scores, permdisp, anosim and mantel stay empty", n)
        return {name: spark.createDataFrame([], schema) for name, schema in _DENSE.items()}
    e = grouped.join(c.table("02", "env_master").select("plot_id", "longitude", "latitude"), "plot_id", "left").orderBy("plot_id").toPandas()
    ids, labels = e["plot_id"].tolist(), e["grp"].tolist()
    m = replicates.distance_matrix(distances.bray_curtis(c.table("01", "abundance").join(grouped.select("plot_id"), "plot_id", "left_semi")), ids)
    x, stress = ordination.nmds(spark, m, ids, 2, seed=c.params.seed)
    deep, _ = ordination.pcoa(spark, m, ids, min(10, n - 1))
    scores = x.withColumn("stress", F.lit(float(stress))).join(deep.select("plot_id", "PCo1", "PCo2"), "plot_id").join(c.table("02", "env_master"), "plot_id", "left")
    placed = e[["longitude", "latitude"]].notna().all(axis=1).to_numpy()
    km = distances.haversine_pairs(spark.createDataFrame(e.loc[placed, ["plot_id", "longitude", "latitude"]]), "plot_id", "longitude", "latitude")
    coords = deep.orderBy("plot_id").toPandas().drop(columns="plot_id").to_numpy()
    k, seed = c.params.permutations, c.params.seed
    return {
        "scores": scores, "permdisp": replicates.permdisp_test(spark, coords, labels, k, seed), "anosim": replicates.anosim_test(spark, m, labels, k, seed),
        "mantel": replicates.mantel_test(spark, m[np.ix_(placed, placed)], replicates.distance_matrix(km, e.loc[placed, "plot_id"].tolist(), "km"), k, seed),
    }


def beta(c: Context) -> dict[str, DataFrame]:
    present = c.table("01", "abundance").where("abund > 0").select("plot_id").distinct()
    grouped = _groups(c).join(present, "plot_id", "left_semi")
    cells, labels = _grouped_cells(c, grouped)
    # Only pairs that share species are kept; the others are at distance 1.
    return {
        "bray_curtis": distances.bray_curtis(c.table("01", "abundance"), dense=False),
        "permanova": replicates.permanova_blocks(cells, labels, c.params.permutations, c.params.seed),
        **_dense(c, grouped.where("grp is not null")),
    }


def _predictors(c: Context) -> tuple[DataFrame, list[str]]:
    """Environment of all plots with abundance and its usable predictors: aspect by its components, medians where nothing is known."""
    north, east = clean.aspect_components(F.col("aspect"))
    plots = c.table("01", "abundance").where("abund > 0").select("plot_id").distinct()
    e = plots.join(c.table("02", "env_master"), "plot_id", "left").withColumns({"aspect_northness": north, "aspect_eastness": east})
    every = clean.numeric_columns(e, ("longitude", "latitude", "aspect", "soil_distance"))
    usable = {x.variable for x in clean.usable_predictors(e, every).collect()}
    cols = [x for x in every if x in usable]
    return stage_table(clean.median_impute(e, cols).select("plot_id", *cols), "predictors"), cols


def ordinations(c: Context) -> dict[str, DataFrame]:
    e, cols = _predictors(c)
    fit = ordination.cca(c.table("01", "abundance"), e, cols)
    rows = [(i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(fit["eigenvalues"], fit["share_total"], strict=True))]
    species = fit["species"].iloc[:, :2].reset_index()
    species.columns = ["species_name", *[f"CCA{k + 1}" for k in range(species.shape[1] - 1)]]
    cells, ids = _cells(c, e)
    x = ids.orderBy("i").toPandas()[cols].to_numpy(float)
    sites = stage_table(ordination.site_scores(e, cols, fit), "sites")
    groups: dict[str, list[str]] = {}
    for col in cols:
        groups.setdefault(next((g for g, words in c.params.variable_groups if any(w in col for w in words)), "other"), []).append(col)
    return {
        "axes": c.spark.createDataFrame(rows, "axis int, eigenvalue double, pct_total double"), "sites": sites,
        "display": ordination.display_scaled(sites, [x for x in sites.columns if x.startswith("CCA")]),
        "species": c.spark.createDataFrame(species), "vif": ordination.vif(e, cols),
        "permutation": ordination.cca_test_cells(stage_table(cells, "cells"), x, c.params.permutations, seed=c.params.seed),
        "partition": ordination.variance_partition_cells(c.table("01", "abundance").where("abund > 0"), e, groups),
    }


def indicator(c: Context) -> dict[str, DataFrame]:
    p = c.table("01", "abundance").where("abund > 0").select("plot_id", "species_name").distinct()
    x = indicators.indval(p, _groups(c))
    tested = replicates.indval_cells(*_grouped_cells(c, _groups(c)), c.params.permutations, c.params.seed)
    x = stage_table(x.join(tested.select("species_name", "p", "p_adj"), "species_name"), "indval")
    return {"indval": x, "top": indicators.top_per_group(x)}


def cooccurrence(c: Context) -> dict[str, DataFrame]:
    p = c.table("01", "abundance").where("abund > 0").select("plot_id", "species_name").distinct().where(~clean.ambiguous_taxon(F.col("species_name")))
    p = stage_table(p.join(network.frequent_species(p, c.params.min_species_occurrence).select("species_name"), "species_name", "left_semi"), "presence")
    e = stage_table(network.edges(p, c.params.min_species_occurrence), "edges")
    rows, _ = dense_ids(p.select("plot_id").distinct(), "plot_id", "i")
    cols, _ = dense_ids(p.select("species_name").distinct(), "species_name", "j")
    t = p.join(rows, "plot_id").join(cols, "species_name").select("i", "j").orderBy("i", "j").toArrow()
    nodes = stage_table(network.degrees(e).join(network.node_table(c.spark, e, c.params.seed).drop("degree"), "species_name"), "nodes")
    summary = nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("community").alias("n_communities"), F.avg("degree").alias("mean_degree"), F.max("betweenness").alias("top_betweenness"))
    # Two tables of one row.
    summary = summary.join(F.broadcast(e.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))))
    return {
        "edges": e, "nodes": nodes, "hubs": network.hubs(nodes), "summary": summary.join(F.broadcast(network.modularity(e, nodes.select("species_name", "community")).withColumnRenamed("q", "modularity"))),
        "null_model": network.null_modularity_pairs(c.spark, t["i"].to_numpy(), t["j"].to_numpy(), c.params.min_species_occurrence, c.params.null_permutations, c.params.seed),
        "pairs": network.significant_pairs(p, c.params.significance),
    }


def trends(c: Context) -> dict[str, DataFrame]:
    ts = views.series(c.spark, c.source)
    mk = trend.mann_kendall(ts)
    t = trend.theil_sen(ts).join(mk, "pixel").withColumn("p", trend.mk_p(F.col("tau"), F.col("n")))
    t = t.withColumn("trend_class", trend.trend_class(F.col("slope"), F.col("p"), c.params.significance))
    t = stage_table(t, "trends")
    adjusted = ranks.bh_adjust(t, "p")
    return {
        "trends": t, "areas": raster.area_statistics(t, "slope", "p", 0.0625, c.params.significance),
        "areas_fdr": raster.area_statistics(adjusted, "slope", "p_adj", 0.0625, c.params.significance),
    }


def _sensitivity(s: DataFrame, parts: list[str]) -> DataFrame:
    """(component_dropped, rho, p, interpretation): rank correlation of the index with the one that lacks a component."""
    out = []
    for x in parts:
        left = sum((F.coalesce(f"z_{y}", F.lit(0.0)) for y in parts if y != x), F.lit(0.0))
        out.append(stats.spearman(s.withColumn("_left", left), "sci_index", "_left").select(F.lit(x).alias("component_dropped"), "rho", "p"))
    rho = F.col("rho")
    label = F.when(rho >= 0.95, "robust (r ≥ 0.95)").when(rho >= 0.9, "moderate sensitivity (0.90 ≤ r < 0.95)").when(rho.isNotNull(), "sensitive (r < 0.90)")
    return reduce(DataFrame.unionByName, out).withColumn("interpretation", label)


def index(c: Context) -> dict[str, DataFrame]:
    a = c.table("03", "alpha")
    parts = ["richness", "shannon", "simpson", *[x for x in a.columns if x.startswith("richness_")]]
    s = diversity.sci_index(a, parts)
    s = stage_table(s, "sci")
    return {"sci": s, "groups": diversity.group_summary(s, "forest_type", "sci_index"), "sensitivity": _sensitivity(s, parts)}


def _optional(c: Context, left: DataFrame, stage_id: str, name: str, columns: dict[str, str]) -> DataFrame:
    """left with columns of another stage's table by plot; as it is where that table is missing, or lacks the plot or a column."""
    try:
        right = c.table(stage_id, name)
    except AnalysisException:
        return left
    if not {"plot_id", *columns} <= set(right.columns):
        return left
    return left.join(right.select("plot_id", *[F.col(a).alias(b) for a, b in columns.items()]), "plot_id", "left")


def mapping(c: Context) -> dict[str, DataFrame]:
    a = c.table("03", "alpha").select("plot_id", "longitude", "latitude", "richness", "shannon", "simpson", "forest_type")
    for stage_id, name, columns in (("09", "sci", {"sci_index": "sci_index"}), ("04", "scores", {"NMDS1": "nmds_axis"}), ("08", "trends", {"trend_class": "trend_class"})):
        a = _optional(c, a, stage_id, name, columns)
    points = stage_table(a.where(clean.valid_coordinates()), "map")
    values = [x for x in points.columns if x not in ("plot_id", "longitude", "latitude", "forest_type", "trend_class")]
    rows = [points.agg(F.lit(x).alias("value"), F.min(x).cast("double").alias("low"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).cast("double").alias("high")) for x in values]
    return {"map_points": points, "ranges": reduce(DataFrame.unionByName, rows)}


def reporting(c: Context) -> dict[str, DataFrame]:
    s = c.table("09", "sci")
    g = s.groupBy("forest_type").agg(F.count("*").alias("n_plots"), F.avg("richness").alias("mean_richness"), F.avg("shannon").alias("mean_shannon"), F.avg("sci_index").alias("mean_sci"))
    g, top = stage_table(g, "groups"), stage_table(c.table("06", "indval").orderBy("group", F.desc("stat"), "species_name").limit(20), "top20")
    line = lambda r: ", ".join(f"{k} {v:.4g}" if isinstance(v, float) else f"{k} {v}" for k, v in r.asDict().items())
    read = lambda i, t, n=10: [line(r) for r in c.table(i, t).limit(n).collect()]
    for stage_id, title, parts in (
        ("04", "Beta diversity", {"permanova": read("04", "permanova"), "permdisp": read("04", "permdisp"), "anosim": read("04", "anosim"), "mantel": read("04", "mantel")}),
        ("05", "Ordination", {"axes": read("05", "axes"), "axis tests": read("05", "permutation"), "partition": read("05", "partition", 20), "inflation": [line(r) for r in c.table("05", "vif").orderBy(F.desc("vif")).limit(10).collect()]}),
        ("07", "Co-occurrence", {"network": read("07", "summary"), "null model": read("07", "null_model")}),
        ("08", "Trends", {"areas": read("08", "areas"), "areas after correction": read("08", "areas_fdr")}),
        ("11", "Groups", {"groups": [line(r) for r in g.orderBy("forest_type").collect()], "indicators": [line(r) for r in top.collect()]}),
    ):
        write_text(os.path.join(c.out, "reports", f"{stage_id}.txt"), title, {k: v or ["none"] for k, v in parts.items()})
    write_json(os.path.join(c.out, "reports", "manifest.json"), {"reports": ["04", "05", "07", "08", "11"], "written": time.strftime("%Y-%m-%d %H:%M:%S")})
    return {"group_summary": g, "top20": top}


REGISTRY: dict[str, Stage] = {s.id: s for s in (
    Stage("00", "data_inspection", (), inspection, ("files",), ("veg_long_csv", "env_master_csv"), 0.1),
    Stage("01", "data_cleaning", ("00",), cleaning, ("veg_long", "abundance", "points"), ("veg_long_csv",), 2.0),
    Stage("01b", "qc_after_cleaning", ("01",), qc_cleaning, ("duplicates", "missing", "richness", "bbox"), (), 0.5),
    Stage("02", "env_extraction", ("01",), environment, ("env_master",), ("env_master_csv", "soil_map_vector"), 20.0),
    Stage("02b", "qc_after_env_extraction", ("02",), qc_environment, ("na_rates", "outliers", "collinear"), (), 0.5),
    Stage("03", "alpha_diversity", ("02",), alpha, ("alpha", "bands", "kruskal", "dunn"), (), 1.5),
    Stage("04", "beta_diversity", ("03",), beta, ("bray_curtis", "permanova", *_DENSE), (), 3.0),
    Stage("05", "cca_ordination", ("02",), ordinations, ("axes", "sites", "display", "species", "vif", "permutation", "partition"), (), 2.0),
    Stage("06", "indicator_species", ("03",), indicator, ("indval", "top"), (), 2.0),
    Stage("07", "co_occurrence", ("03",), cooccurrence, ("edges", "nodes", "hubs", "summary", "null_model", "pairs"), (), 2.0),
    Stage("08", "evi_spatial_analysis", ("03", "09"), trends, ("trends", "areas", "areas_fdr"), ("events",), 1.0),
    Stage("09", "sci_index", ("03",), index, ("sci", "groups", "sensitivity"), (), 1.0),
    Stage("10", "spatial_mapping", ("03", "04", "08", "09"), mapping, ("map_points", "ranges"), (), 5.0),
    Stage("11", "reporting", ("03", "04", "05", "06", "07", "08", "09", "10"), reporting, ("group_summary", "top20"), (), 2.0),
)}


def normalize_id(x: str) -> str:
    """'1b' and '01B' are '01b'; what isn't a number with an optional letter stays as it is, in lower case."""
    m = re.fullmatch(r"(\d+)([a-z]?)", x.strip().lower())
    return f"{int(m[1]):02d}{m[2]}" if m else x.strip().lower()


def with_dependencies(ids: list[str], registry: dict[str, Stage] = REGISTRY) -> list[str]:
    """The stages and all they need, each after what it needs; a stage that isn't known raises."""
    out: dict[str, None] = {}

    def visit(i: str, above: tuple[str, ...] = ()) -> None:
        if i not in registry:
            raise ValueError(f"unknown stage {i}")
        if i in above:
            raise ValueError("Circular dependency: " + " -> ".join([*above, i]))
        if i not in out:
            for d in registry[i].deps:
                visit(d, (*above, i))
            out[i] = None

    for i in ids:
        visit(i)
    return list(out)


def levels(ids: list[str], registry: dict[str, Stage] = REGISTRY) -> list[list[str]]:
    """Stages by the earliest level they can run in; a circle, or a dependency outside the list, raises."""
    if gone := {d for i in ids for d in registry[i].deps} - set(ids):
        raise ValueError(f"Circular dependency or stages that aren't in the list: {', '.join(sorted(gone))}")
    t = TopologicalSorter({i: registry[i].deps for i in ids})
    try:
        t.prepare()
    except CycleError as e:
        raise ValueError(f"Circular dependency: {' -> '.join(e.args[1])}") from e
    out = []
    while t.is_active():
        ready = sorted(t.get_ready(), key=ids.index)
        out.append(ready)
        t.done(*ready)
    return out


def select(stages: list[str] | None = None, first: str | None = None, last: str | None = None, registry: dict[str, Stage] = REGISTRY) -> list[str]:
    """Named stages, or those from first to last in registry order, or all."""
    every = list(registry)
    if stages:
        ids = [normalize_id(s) for s in stages]
    else:
        a = every.index(normalize_id(first)) if first else 0
        b = every.index(normalize_id(last)) if last else len(every) - 1
        ids = every[a : b + 1]
    return with_dependencies(ids, registry)


@lru_cache(maxsize=1)
def _package() -> str:
    """Hash of the sources of everything that stages call."""
    h, root = hashlib.sha256(), Path(__file__).parent
    for f in sorted([root / "config.py", root / "session.py", *(p for d in ("functions", "operators", "plans", "sources") for p in (root / d).glob("*.py"))]):
        h.update(f.read_bytes())
    return h.hexdigest()


def fingerprint(stage: Stage, c: Context, done: dict[str, str]) -> str:
    """Hash of the stage's code and all the package's operators, the parameters, the state of its input files (path, size, time: their
    contents may be terabytes) and the fingerprints of the stages before it."""
    h = hashlib.sha256(inspect.getsource(stage.run).encode())
    h.update(_package().encode())
    h.update(json.dumps(dataclasses.asdict(c.params), sort_keys=True, default=str).encode())
    for r in file_inventory(c.spark, [f"{c.source}/{t}.parquet" for t in stage.inputs]).collect() if stage.inputs else []:
        h.update(repr(tuple(r)).encode())
    for d in stage.deps:
        h.update(done.get(d, "?").encode())
    return h.hexdigest()


#: Columns that tables of other stages and users rely on.
CONTRACT: dict[tuple[str, str], tuple[str, ...]] = {
    ("01", "veg_long"): ("plot_id", "species_name", "stratum", "abundance"), ("01", "abundance"): ("plot_id", "species_name", "abund"), ("02", "env_master"): ("plot_id", "longitude", "latitude", "elevation", "forest_type", "soil_type"),
    ("03", "alpha"): ("plot_id", "richness", "shannon", "simpson"), ("04", "permanova"): ("f", "p"), ("05", "axes"): ("axis", "eigenvalue"), ("06", "indval"): ("species_name", "group", "stat", "p", "p_adj"),
    ("07", "edges"): ("src", "dst", "weight"), ("07", "nodes"): ("species_name", "degree", "betweenness", "community"), ("08", "trends"): ("pixel", "slope", "p", "trend_class"), ("09", "sci"): ("plot_id", "sci_index"),
    ("10", "map_points"): ("plot_id", "longitude", "latitude"), ("11", "group_summary"): ("forest_type", "n_plots"),
}


def validate(stage: Stage, c: Context) -> list[str]:
    """What is wrong with the stage's tables: missing or empty ones, and columns of CONTRACT that they lack."""
    out = []
    for t in stage.tables:
        try:
            df = c.table(stage.id, t)
        except Exception as e:  # noqa: BLE001 - a table that can't be read is a finding, not a failure
            out.append(f"{t} can't be read: {type(e).__name__}")
            continue
        found = check_table(df, CONTRACT.get((stage.id, t), ())) if df.columns else ["no columns"]
        out += [f"{t} is empty" if x.startswith("0 rows") else f"{t}: {x}" for x in found]
    return out


def _there(stage: Stage, c: Context) -> bool:
    return not any("can't be read" in w for w in validate(stage, c))


def run_stage(stage: Stage, c: Context, cache: dict[str, str] | None = None, done: dict[str, str] | None = None) -> Result:
    """Runs one stage; an exception becomes a failed result, findings of the validation become warnings."""
    began, done = time.time(), {} if done is None else done
    key = fingerprint(stage, c, done)
    if cache is not None and cache.get(stage.id) == key and _there(stage, c):
        done[stage.id] = key
        return Result(stage.id, "cached", [f"{stage.id}/{t}" for t in stage.tables])
    c.spark.sparkContext.setLocalProperty("spark.scheduler.pool", stage.id)
    try:
        for name, df in stage.run(c).items():
            write_table(df, os.path.join(c.out, stage.id, name))
    except Exception as e:  # noqa: BLE001 - reported, and the run decides what follows
        module_logger(stage.id).exception("stage %s failed", stage.name)
        return Result(stage.id, "failed", [], [f"{type(e).__name__}: {str(e)[:500]}"], time.time() - began)
    done[stage.id] = key
    if cache is not None:
        cache[stage.id] = key
    result = Result(stage.id, "ok", [f"{stage.id}/{t}" for t in stage.tables], validate(stage, c), time.time() - began)
    result.warnings += check_result(result)
    return result


def run(
    c: Context, stages: list[str] | None = None, first: str | None = None, last: str | None = None, workers: int = 4,
    go_on: bool = False, use_cache: bool = True, registry: dict[str, Stage] = REGISTRY,
) -> list[Result]:
    """Runs level by level with up to `workers` stages at once (1: one after the other).

    After a failure the run ends; with go_on, stages that need the failed one, directly or through others, are skipped and the
    rest runs. A manifest with inputs, results and times is written in any case.
    """
    ids = select(stages, first, last, registry)
    cache_file = os.path.join(c.out, "cache.json")
    cache = read_json(cache_file) if use_cache else None
    results: dict[str, Result] = {}
    done: dict[str, str] = {}
    began = time.time()
    for level in levels(ids, registry):
        bad = {i for i, x in results.items() if x.status in ("failed", "skipped")}
        if bad and not go_on:
            break
        ready = []
        for i in level:
            if bad & set(registry[i].deps):
                results[i] = Result(i, "skipped", [], ["a stage it needs failed"])
            else:
                ready.append(i)
        with ThreadPoolExecutor(max(1, min(workers, len(ready) or 1))) as pool:
            for x in progress(pool.map(lambda i: run_stage(registry[i], c, cache, done), ready), len(ready), "level"):
                results[x.id] = x
                log.info("%s %s in %.1f s", x.id, x.status, x.seconds)
    if cache is not None:
        write_json(cache_file, cache)
    snapshot = [r.asDict() for r in file_inventory(c.spark, [f"{c.source}/{t}.parquet" for s in registry.values() for t in s.inputs]).distinct().collect()]
    write_json(os.path.join(c.out, "manifest.json"), {
        "finished": time.strftime("%Y-%m-%d %H:%M:%S"), "seconds": time.time() - began, "inputs": snapshot, "params": dataclasses.asdict(c.params),
        "results": [dataclasses.asdict(x) for x in results.values()],
    })
    write_text(os.path.join(c.out, "report.txt"), "Run report", {
        "stages": [f"{x.id} {registry[x.id].name}: {x.status}, {x.seconds:.1f} s" for x in results.values()],
        "warnings": [f"{x.id}: {w}" for x in results.values() for w in x.warnings] or ["none"],
        "slowest": [f"{x.id}: {x.seconds:.1f} s" for x in bottlenecks(list(results.values()))] or ["none"],
    })
    return list(results.values())


def bottlenecks(results: list[Result], percent: float = 10.0) -> list[Result]:
    """Stages that took at least percent of all stages' time, slowest first."""
    total = sum(x.seconds for x in results) or 1.0
    return sorted((x for x in results if 100 * x.seconds / total >= percent), key=lambda x: -x.seconds)


def dry_run(c: Context, stages: list[str] | None = None, first: str | None = None, last: str | None = None, registry: dict[str, Stage] = REGISTRY) -> dict:
    """Levels, missing inputs and estimated seconds in sequence and in parallel, from the last manifest or the stages' estimates."""
    ids = select(stages, first, last, registry)
    known = {x["id"]: x["seconds"] for x in read_json(os.path.join(c.out, "manifest.json")).get("results", []) if x["status"] == "ok"}
    cost = {i: known.get(i, registry[i].estimate) for i in ids}
    plan = levels(ids, registry)
    files = [f"{c.source}/{t}.parquet" for i in ids for t in registry[i].inputs]
    missing = [r.path for r in file_inventory(c.spark, files).where("not found").distinct().collect()] if files else []
    one, side = sum(cost.values()), sum(max(cost[i] for i in lv) for lv in plan)
    return {"levels": plan, "missing_inputs": missing, "sequential_s": one, "parallel_s": side, "speed_up": one / side if side else 1.0}


def clear_cache(out: str) -> None:
    write_json(os.path.join(out, "cache.json"), {})


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="florascope", description="Runs the inventory analysis as a graph of Spark stages.")
    p.add_argument("source", help="folder of the input tables")
    p.add_argument("out", help="folder of the results")
    p.add_argument("--stages", nargs="*", help="stages to run, with all they need")
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    p.add_argument("--sequential", action="store_true")
    p.add_argument("--workers", type=int, default=4)
    p.add_argument("--continue-on-error", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--clear-cache", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--list", action="store_true")
    p.add_argument("--check-setup", action="store_true")
    p.add_argument("--log-level", default="INFO")
    a = p.parse_args(args)
    logging.basicConfig(level=a.log_level, format="%(asctime)s %(levelname)s %(message)s")
    if a.list:
        print("\n".join(f"{s.id} {s.name} <- {', '.join(s.deps) or '-'}" for s in REGISTRY.values()))
        return 0
    from .session import get_spark

    c = Context(SparkSession.getActiveSession() or get_spark(), a.source, a.out)
    log.info("Spark %s", c.spark.version)
    if a.check_setup:
        said = check_setup(c.spark, a.source, sorted({t for s in REGISTRY.values() for t in s.inputs}))
        print(json.dumps(said, indent=2))
        return int(not said["ok"])
    if a.clear_cache:
        clear_cache(a.out)
    if a.dry_run:
        print(json.dumps(dry_run(c, a.stages, a.first, a.last), indent=2))
        return 0
    got = run(c, a.stages, a.first, a.last, 1 if a.sequential else a.workers, a.continue_on_error, not a.no_cache)
    return int(any(x.status != "ok" and x.status != "cached" for x in got))


if __name__ == "__main__":
    sys.exit(main())
