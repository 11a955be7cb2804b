"""Domain views over the test tables, as DataFrames and, word for word the same, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_blanks
from ..operators.clean import clean_species, to_number
from ..operators.diversity import abundance, alpha_diversity, stratum_richness
from ..session import read, spread

B = "[ \\t\u00a0]"
_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '')"
_SPACE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def sql_title(x: str) -> str:
    return _TITLE.format(x)


def sql_space(x: str) -> str:
    return _SPACE.format(x)


def veg(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned inventory: records with a plot and a species; strata in their four spellings, numbers or null."""
    cols = ["record_id", "plot_id", "species_name", "stratum", "abundance", "longitude", "latitude", "forest_type"]
    v = spread(read(spark, d, "veg_long_csv").select(*cols))
    s = F.lower(F.trim("stratum"))
    stratum = F.when(s.startswith("tree"), "Trees").when(s.startswith("shrub"), "Shrubs").when(s.startswith("herb"), "Herbs").when(s.startswith("regen"), "Regeneration")
    return v.select(
        "record_id", trim_blanks(F.col("plot_id")).alias("plot_id"), clean_species(F.col("species_name")).alias("species_name"), stratum.alias("stratum"),
        to_number(F.col("abundance")).alias("abundance"), to_number(F.col("longitude")).alias("longitude"), to_number(F.col("latitude")).alias("latitude"), "forest_type",
    ).where("plot_id <> '' and species_name <> ''")


def env(spark: SparkSession, d: str) -> DataFrame:
    """One row a plot: its latest extraction; impossible elevations are null."""
    w = Window.partitionBy("plot_id").orderBy(F.desc("extracted_at"), F.desc("env_id"))
    e = read(spark, d, "env_master_csv").where("plot_id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    h = to_number(F.col("elevation"))
    nums = {c: to_number(F.col(c)) for c in ("longitude", "latitude", "slope", "aspect", "bio1", "bio12")}
    # Stored values that no unit makes a temperature are null.
    b = nums["bio1"]
    nums["bio1"] = F.when(b.between(-300, 450) | b.between(2431.5, 3181.5), b)
    return e.withColumns({**nums, "elevation": F.when(h.between(90, 7600), h)}).select(
        "plot_id", "longitude", "latitude", "elevation", "slope", "aspect", "bio1", "bio12", "forest_type", "dzongkhag", "geog_name")


V = rf"""
V AS (SELECT * FROM (SELECT record_id, regexp_replace(plot_id, '^{B}+|{B}+$', '', 'g') AS plot_id, {sql_title(sql_space('species_name'))} AS species_name,
  CASE WHEN lower(trim(stratum)) LIKE 'tree%' THEN 'Trees' WHEN lower(trim(stratum)) LIKE 'shrub%' THEN 'Shrubs'
       WHEN lower(trim(stratum)) LIKE 'herb%' THEN 'Herbs' WHEN lower(trim(stratum)) LIKE 'regen%' THEN 'Regeneration' END AS stratum,
  CASE WHEN NOT isnan(abundance) THEN abundance END AS abundance, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude,
  CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, forest_type FROM veg_long_csv) WHERE plot_id <> '' AND species_name <> '')"""
E = """
E AS (SELECT plot_id, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude,
  CASE WHEN NOT isnan(elevation) AND elevation BETWEEN 90 AND 7600 THEN elevation END AS elevation, CASE WHEN NOT isnan(slope) THEN slope END AS slope,
  CASE WHEN NOT isnan(aspect) THEN aspect END AS aspect, CASE WHEN bio1 BETWEEN -300 AND 450 OR bio1 BETWEEN 2431.5 AND 3181.5 THEN bio1 END AS bio1, CASE WHEN NOT isnan(bio12) THEN bio12 END AS bio12,
  forest_type, dzongkhag, geog_name FROM (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY extracted_at DESC NULLS LAST, env_id DESC) AS rn
  FROM env_master_csv WHERE plot_id IS NOT NULL) WHERE rn = 1)"""
AB = "AB AS (SELECT plot_id, species_name, sum(coalesce(abundance, 1.0::DOUBLE)) AS abund FROM V GROUP BY 1, 2)"
AL = """
SH AS (SELECT plot_id, abund / sum(abund) OVER (PARTITION BY plot_id) AS p FROM AB WHERE abund > 0),
AL AS (SELECT plot_id, coalesce(richness, 0) AS richness, coalesce(shannon, 0::DOUBLE) AS shannon, coalesce(simpson, 0::DOUBLE) AS simpson
  FROM (SELECT DISTINCT plot_id FROM AB) LEFT JOIN
  (SELECT plot_id, count(*) AS richness, -sum(p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson FROM SH GROUP BY 1) USING (plot_id))"""
SR = """
SR AS (SELECT plot_id, count(DISTINCT species_name) FILTER (WHERE stratum = 'Trees') AS "richness_Trees", count(DISTINCT species_name) FILTER (WHERE stratum = 'Shrubs') AS "richness_Shrubs",
  count(DISTINCT species_name) FILTER (WHERE stratum = 'Herbs') AS "richness_Herbs", count(DISTINCT species_name) FILTER (WHERE stratum = 'Regeneration') AS "richness_Regeneration"
  FROM V WHERE stratum IS NOT NULL GROUP BY 1)"""
AE = 'AE AS (SELECT AL.*, E.* EXCLUDE (plot_id) FROM AL LEFT JOIN E USING (plot_id))'
PR = "PR AS (SELECT DISTINCT plot_id, species_name FROM AB WHERE abund > 0)"
BAND = """CASE WHEN elevation >= 0 AND elevation < 500 THEN '<500 m' WHEN elevation >= 500 AND elevation < 1000 THEN '500–1k m' WHEN elevation >= 1000 AND elevation < 1500 THEN '1k–1.5k m'
  WHEN elevation >= 1500 AND elevation < 2000 THEN '1.5k–2k m' WHEN elevation >= 2000 AND elevation < 2500 THEN '2k–2.5k m' WHEN elevation >= 2500 AND elevation < 3000 THEN '2.5k–3k m'
  WHEN elevation >= 3000 AND elevation < 3500 THEN '3k–3.5k m' WHEN elevation >= 3500 AND elevation < 4000 THEN '3.5k–4k m' WHEN elevation >= 4000 AND elevation < 6000 THEN '>4k m' END"""
TS = "TS AS (SELECT user_id AS pixel, dayofmonth(ts) AS t, avg(value) AS value FROM events GROUP BY 1, 2)"
GR = 'GR AS (SELECT vec_id AS "row", i - 1 AS col, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))'


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def abund(spark: SparkSession, d: str) -> DataFrame:
    return abundance(veg(spark, d))


def alpha(spark: SparkSession, d: str) -> DataFrame:
    return alpha_diversity(abund(spark, d))


def alpha_env(spark: SparkSession, d: str) -> DataFrame:
    return alpha(spark, d).join(env(spark, d), "plot_id", "left")


def strata(spark: SparkSession, d: str) -> DataFrame:
    return stratum_richness(veg(spark, d))


def presence(spark: SparkSession, d: str) -> DataFrame:
    return abund(spark, d).where("abund > 0").select("plot_id", "species_name").distinct()


def series(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("user_id").alias("pixel"), F.dayofmonth("ts").alias("t")).agg(F.avg("value").alias("value"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return e.select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
