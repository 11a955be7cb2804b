"""Ordinations, permutation tests and graph iterations. No SQL says the same; results are tested by invariants and small cases.

They run on the plots themselves, over sparse tables or rows of distances.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, distances, network, ordination, replicates, stats
from ..session import broadcast_if_small, dense_ids, stage, staged_batches
from . import views as v
from .community import r

QUERIES: dict = {}
PREDICTORS = ["elevation", "slope", "bio12", "northness", "eastness"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def plots(spark, d) -> tuple[DataFrame, DataFrame]:
    """(abundance by plot and species, environment of the same plots with grp; what isn't known is null), both staged."""
    north, east = clean.aspect_components(F.col("aspect"))
    e = v.env(spark, d).withColumns({"northness": north, "eastness": east}).withColumnRenamed("forest_type", "grp")
    a = stage(v.abund(spark, d).where("abund > 0"), "abund")
    return a, stage(a.select("plot_id").distinct().join(e.select("plot_id", "grp", *PREDICTORS, "longitude", "latitude"), "plot_id", "left"), "env")


def _imputed(spark, d) -> tuple[DataFrame, DataFrame]:
    a, e = plots(spark, d)
    return a, stage(clean.median_impute(e, PREDICTORS), "env")


def _cells(a, e) -> tuple[DataFrame, DataFrame]:
    """(cells (i, species_name, abund), e with i) of the plots of e, numbered from 0."""
    e, n = dense_ids(e, "plot_id", "i")
    return stage(a.join(broadcast_if_small(e.select("plot_id", "i"), n, 40), "plot_id").select("i", "species_name", "abund"), "cells"), e.orderBy("i")


def _dist(spark, d, where="true"):
    """The dense matrix of the plots that pass, their ids and environment."""
    a, e = plots(spark, d)
    pdf = e.where(where).orderBy("plot_id").toPandas()
    ids = pdf["plot_id"].tolist()
    a = a.join(e.where(where).select("plot_id"), "plot_id", "left_semi")
    return replicates.distance_matrix(distances.bray_curtis(a), ids), ids, pdf


def _nmds(spark, d, dims):
    cells, e = _cells(*plots(spark, d))
    ids = [x.plot_id for x in e.select("i", "plot_id").orderBy("i").collect()]
    x, stress = ordination.nmds_cells(cells, len(ids), dims, starts=20)
    return ordination._frame(spark, ids, x, "NMDS"), stress


@query
def nmds_2d(spark, d):
    x, stress = _nmds(spark, d, 2)
    return x.withColumn("stress", F.lit(float(stress)))


@query
def nmds_3d(spark, d):
    return _nmds(spark, d, 3)[0]


@query
def pcoa_eigen(spark, d):
    a, e = plots(spark, d)
    # The driver's solution takes some more matrices of this size.
    if 32 * e.count() ** 2 <= replicates.MATRIX_BYTES:
        m, ids, _ = _dist(spark, d)
        x, share = ordination.pcoa(spark, m, ids)
    else:
        cells, e = _cells(a, e)
        ids = [x.plot_id for x in e.select("i", "plot_id").orderBy("i").collect()]
        x, share = ordination.pcoa_whole(cells, len(ids))
        x = ordination._frame(spark, ids, x, "PCo")
    return x.withColumns({"share_1": F.lit(float(share[0])), "share_2": F.lit(float(share[1]))})


@query
def pcoa_smacof(spark, d):
    """Metric scaling of the same distances; the axes' shares are those of the two coordinates' variance."""
    a, e = plots(spark, d)
    if 8 * e.count() ** 2 <= replicates.MATRIX_BYTES:
        m, ids, _ = _dist(spark, d)
        x = ordination.nmds(spark, m, ids, 2, starts=4, metric=True)[0].select("MDS1", "MDS2").toPandas().to_numpy()
    else:
        # The same steps, a pass over the rows of distances each.
        cells, e = _cells(a, e)
        ids = [x.plot_id for x in e.select("i", "plot_id").orderBy("i").collect()]
        x, _ = ordination.metric_rows(cells, len(ids))
    share = ordination.axis_shares(x)
    out = spark.createDataFrame([(p, *map(float, r)) for p, r in zip(ids, x, strict=True)], "plot_id string, MDS1 double, MDS2 double")
    return out.withColumns({"pct_1": F.lit(float(share[0])), "pct_2": F.lit(float(share[1]))})


@query
def permanova_p(spark, d):
    a, e = plots(spark, d)
    cells, e = _cells(a, e.where("grp is not null"))
    return replicates.permanova_blocks(cells, [x.grp for x in e.select("i", "grp").orderBy("i").collect()])


@query
def anosim_p(spark, d):
    a, e = plots(spark, d)
    cells, e = _cells(a, e.where("grp is not null"))
    return replicates.anosim_blocks(cells, [x.grp for x in e.select("i", "grp").orderBy("i").collect()])


@query
def mantel_p(spark, d):
    a, e = plots(spark, d)
    cells, e = _cells(a, e.where("longitude is not null and latitude is not null"))
    at = e.select("i", "longitude", "latitude").orderBy("i").toPandas()
    return replicates.mantel_p_blocks(cells, at["longitude"].to_numpy(float), at["latitude"].to_numpy(float))


@query
def permdisp(spark, d):
    a, e = plots(spark, d)
    cells, e = _cells(a, e.where("grp is not null"))
    labels = [x.grp for x in e.select("i", "grp").orderBy("i").collect()]
    return replicates.permdisp_test(spark, ordination.pcoa_cells(cells, len(labels), 10), labels)


@query
def cca_axes(spark, d):
    c = ordination.cca(*_imputed(spark, d), PREDICTORS)
    rows = [(i + 1, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(c["eigenvalues"], c["share_constrained"], c["share_total"], strict=True))]
    return spark.createDataFrame(rows, "axis int, eigenvalue double, pct_constrained double, pct_total double")


@query
def cca_site_scores(spark, d):
    a, e = _imputed(spark, d)
    return ordination.site_scores(e, PREDICTORS, ordination.cca(a, e, PREDICTORS))


@query
def cca_species_scores(spark, d):
    x = ordination.cca(*_imputed(spark, d), PREDICTORS)["species"].iloc[:, :2]
    x.columns = ["CCA1", "CCA2"]
    return spark.createDataFrame(x.reset_index())


@query
def cca_permutation(spark, d):
    cells, e = _cells(*_imputed(spark, d))
    return ordination.cca_test_cells(cells, e.select("i", *PREDICTORS).orderBy("i").toPandas()[PREDICTORS].to_numpy(float))


@query
def variance_partition(spark, d):
    return ordination.variance_partition_cells(*_imputed(spark, d), {"climate": ["bio12"], "topography": ["elevation", "slope", "northness", "eastness"]})


@query
def vif(spark, d):
    """Over all plots: sums of products only."""
    n, e = clean.aspect_components(F.col("aspect"))
    return ordination.vif(v.env(spark, d).withColumns({"northness": n, "eastness": e}), PREDICTORS).orderBy(F.desc("vif"))


@query
def indval_permutation(spark, d):
    e = v.env(spark, d).where("forest_type is not null").select("plot_id", F.col("forest_type").alias("grp"))
    cells, e = _cells(v.abund(spark, d).where("abund > 0"), e)
    return replicates.indval_cells(cells, [x.grp for x in e.select("i", "grp").orderBy("i").collect()])


def _present(spark, d):
    """Presence of the species on at least three plots, all of them."""
    p = stage(v.presence(spark, d), "presence")
    return p.join(network.frequent_species(p).select("species_name"), "species_name", "left_semi")


def _edges(spark, d):
    return stage(network.edges(_present(spark, d), 3), "edges")


@query
def network_nodes(spark, d):
    return network.node_table(spark, _edges(spark, d))


@query
def betweenness(spark, d):
    return network.betweenness(spark, *network.adjacency(_edges(spark, d)))


@query
def louvain(spark, d):
    names, near = network.adjacency(_edges(spark, d))
    label = network.louvain(near)
    return spark.createDataFrame([(n, int(c)) for n, c in zip(names, label, strict=True)], "species_name string, community int")


@query
def null_modularity(spark, d):
    p = _present(spark, d)
    rows, _ = dense_ids(p.select("plot_id").distinct(), "plot_id", "i")
    cols, _ = dense_ids(p.select("species_name").distinct(), "species_name", "j")
    t = stage(p.join(rows, "plot_id").join(cols, "species_name").select(F.col("i").cast("int"), F.col("j").cast("int")).orderBy("i", "j"), "places")
    i, j = (np.concatenate([np.zeros(0, np.int32), *(b.column(0).to_numpy() for b in staged_batches(t, [c]))]) for c in "ij")
    return network.null_modularity_pairs(spark, i, j, 3, 99)


@query
def bootstrap_ci(spark, d):
    x = v.alpha_env(spark, d).where("elevation is not null").select("plot_id", "elevation", "richness").orderBy("plot_id").toPandas()
    return replicates.bootstrap_line(spark, x["elevation"].to_numpy(float), x["richness"].to_numpy(float))


@query
def kruskal_p(spark, d):
    from ..operators import diversity

    x = v.alpha_env(spark, d).withColumn("band", diversity.band(F.col("elevation")))
    return stats.kruskal_wallis(x, "band", "richness").select(r("h"), "k", "n", "p")


@query
def spearman_p(spark, d):
    return stats.spearman(v.alpha_env(spark, d), "richness", "elevation")
