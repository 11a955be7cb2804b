"""Queries p1 to p3: positions, missing values and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..operators.fill import Hub, propagate_fill
from ..operators.nearby import containing_regions, near_pairs
from ..operators.units import infer_units, missing_temperature, unit_reliability
from ..session import broadcast_if_small, read

WINDOW = "longitude between 88.7 and 92.2 and latitude between 26.7 and 28.4 and not isnan(longitude) and not isnan(latitude)"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "plot_points_gpkg").where(WINDOW).select("plot_id", "longitude", "latitude").distinct()
    near = near_pairs(points, "plot_id", "longitude", "latitude", 50.0).select(F.lit("near").alias("relation"), "key_a", "key_b")
    soil = containing_regions(points, "longitude", "latitude", read(spark, d, "soil_map_vector"), "unit_id", "geometry_wkt", "unit_id")
    soil = soil.select(F.lit("soil").alias("relation"), F.col("plot_id").alias("key_a"), F.col("unit_id").alias("key_b")).distinct()
    return near.unionByName(soil).where("key_a is not null")


_UNIT_ARGS = ("env_id", "bio1", ["bio1_unit", "remarks"], "climate_layer", "layer_text", ["elevation", "latitude", "bio12"], "elevation")


def _with_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = read(spark, d, "climate_layers").select("climate_layer", F.col("description").alias("layer_text"))
    return read(spark, d, "env_master_csv").join(broadcast_if_small(layers, layers.count(), 512), "climate_layer", "left")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return infer_units(_with_layers(spark, d), *_UNIT_ARGS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where("unit <> 'C'").select("env_id", F.col("unit").alias("unit_code"))


def p3_celsius(spark: SparkSession, d: str) -> DataFrame:
    """Every value in degrees Celsius with how its unit is known; 'review' where no unit is sure."""
    return _units(spark, d).select("env_id", "unit", F.round("celsius", 4).alias("celsius"), "basis", F.round("confidence", 6).alias("confidence"))


def p3_told(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose unit the row itself or its source tells, in degrees Celsius."""
    return _units(spark, d).where("basis in ('row', 'source')").select("env_id", "unit", F.round("celsius", 4).alias("celsius"), "basis")


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    """How often the forest alone decides told sources rightly that it hasn't seen, by their number of rows."""
    return unit_reliability(_with_layers(spark, d), *_UNIT_ARGS)


def soil_key(c: Column) -> Column:
    """A class name without case, blanks and underscores."""
    return F.regexp_replace(F.lower(c), f"(?:{BLANK}|_)+", "")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    env = read(spark, d, "env_master_csv").drop("unit", "celsius")
    classes = read(spark, d, "soil_map_vector").select("soil_type").distinct().select(soil_key(F.col("soil_type")).alias("soil_key"), F.col("soil_type").alias("class"))
    classes = classes.groupBy("soil_key").agg(F.min("class").alias("class"))
    classes = broadcast_if_small(classes, classes.count(), 128)
    celsius = _units(spark, d).select("env_id", "celsius")
    rows = env.withColumn("soil_key", soil_key(F.col("soil_type"))).join(classes, "soil_key", "left").join(celsius, "env_id", "left")
    rows = rows.select("env_id", "plot_id", "longitude", "latitude", "dzongkhag", "geog_name", "climate_layer", "class", "celsius", "elevation", "bio1")
    high = F.when((F.col("elevation") >= 90) & (F.col("elevation") <= 7600) & ~F.isnan("elevation"), F.col("elevation"))
    # A bio1 whose unit is under review isn't missing: it stands as 'observed' and takes no part in averages.
    temp = F.when(~missing_temperature(F.col("bio1")), F.coalesce("celsius", F.lit(float("nan"))))
    sane = lambda c: F.when(F.col(c).between(-180, 180) & ~F.isnan(c), F.col(c))
    place = lambda size: F.concat_ws("/", F.floor(sane("longitude") / size), F.floor(sane("latitude") / size))
    at = lambda size: F.when(sane("longitude").isNotNull() & sane("latitude").isNotNull(), place(size))
    plot = F.trim("plot_id")
    band = F.floor(high / 100)
    every = ("elevation", "bio1", "soil_type")
    hubs = [
        Hub("plot", F.when(plot != "", plot), every, 1000.0), Hub("near", at(0.005), every, 60.0), Hub("around", at(0.03), ("soil_type", "elevation"), 6.0),
        Hub("band", F.concat_ws("/", "dzongkhag", band), ("bio1",), 20.0), Hub("height", band, ("bio1",), 2.0),
        Hub("block", F.col("geog_name"), every, 0.5), Hub("district", F.col("dzongkhag"), every, 0.05),
    ]
    return propagate_fill(rows, "env_id", {"elevation": high, "bio1": temp}, {"soil_type": F.col("class")}, hubs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The filled fields of the propagated table, by their confidence (0 where only the whole table's average could be put in)."""
    return _filled(spark, d).where(F.col("was_filled") & (F.col("confidence") >= 0)).select("env_id", F.col("field").alias("field_name"))


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """The complete fields: one row a record and field, filled ones marked; bio1 in degrees Celsius."""
    return _filled(spark, d).select(
        "env_id", F.col("field").alias("field_name"), F.round("value", 4).alias("value"), "label", "was_filled", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_filled": p2_filled, "p3_found": p3_found, "p3_celsius": p3_celsius, "p3_told": p3_told, "p3_reliability": p3_reliability}


def _unit(x: str) -> str:
    """Unit told by a text, as SQL."""
    x = f"lower({x})"
    word = lambda w: f"(^|[^a-z]){w}([^a-z]|$)"
    k = f"regexp_matches({x}, 'kelvin|absolute temp|{word('d?k')}')"
    f = f"regexp_matches({x}, 'fahrenheit|degf|{word('f')}')"
    c = f"regexp_matches({x}, 'celsius|centigrad|degc|{word('d?c')}')"
    ten = f"regexp_matches({x}, 'tenth|zehntel|deci-|x ?10|[*] ?10|times (ten|10)|0[.,]1|/ ?10|{word('d[ck]')}')"
    return (
        f"CASE WHEN {k} AND NOT {f} AND NOT {c} THEN CASE WHEN {ten} THEN 'K10' ELSE 'K' END "
        f"WHEN {c} AND NOT {f} AND NOT {k} THEN CASE WHEN {ten} THEN 'C10' ELSE 'C' END WHEN {f} AND NOT {c} AND NOT {k} THEN 'F' END"
    )


def _celsius(u: str, v: str = "v") -> str:
    return f"CASE {u} WHEN 'C' THEN {v} WHEN 'C10' THEN {v} / 10 WHEN 'F' THEN ({v} - 32) * 5 / 9 WHEN 'K' THEN {v} - 273.15::DOUBLE WHEN 'K10' THEN {v} / 10 - 273.15::DOUBLE END"


def _fits(u: str) -> str:
    return f"CASE {u} WHEN 'C' THEN v BETWEEN -30 AND 45 WHEN 'C10' THEN v BETWEEN -300 AND 450 WHEN 'F' THEN v BETWEEN -22 AND 113 WHEN 'K' THEN v BETWEEN 243.15 AND 318.15 WHEN 'K10' THEN v BETWEEN 2431.5 AND 3181.5 END"


# The silent sources' units by another way than the forest: the unit whose readings lie closest to the line of the told ones on height.
_P3 = f"""
WITH r AS (SELECT env_id, bio1 AS v, CASE WHEN NOT isnan(elevation) THEN elevation END AS h, climate_layer AS layer, {_unit('bio1_unit')} AS a, {_unit('remarks')} AS b, {_unit('description')} AS l
  FROM env_master_csv LEFT JOIN climate_layers USING (climate_layer) WHERE bio1 BETWEEN -300 AND 450 OR bio1 BETWEEN 2431.5 AND 3181.5),
t AS (SELECT *, CASE WHEN {_fits('a')} THEN a WHEN {_fits('b')} THEN b WHEN {_fits('l')} THEN l END AS told FROM r),
line AS (SELECT regr_slope(c, h) AS s, regr_intercept(c, h) AS i, avg(c) AS m FROM (SELECT {_celsius('told')} AS c, h FROM t WHERE told IS NOT NULL)),
g AS (SELECT layer, u, avg(least(50.0::DOUBLE, abs({_celsius('u')} - coalesce(i + s * h, m)))) AS off FROM t, line, (SELECT unnest(['C', 'C10', 'F', 'K', 'K10']) AS u) WHERE told IS NULL GROUP BY 1, 2),
best AS (SELECT layer, arg_min(u, off) AS u FROM g GROUP BY 1)
SELECT env_id, coalesce(told, best.u) AS unit_code FROM t LEFT JOIN best USING (layer) WHERE coalesce(told, best.u) <> 'C'"""

_P3_TOLD = _P3[: _P3.index("line AS")].rstrip().rstrip(",") + f"""
SELECT env_id, told AS unit, round({_celsius('told')}, 4) AS celsius,
       CASE WHEN {_fits('a')} OR {_fits('b')} THEN 'row' ELSE 'source' END AS basis FROM t WHERE told IS NOT NULL"""


def _p2(rounds: int = 3) -> str:
    """The fill as SQL: edges to hubs, sums of the observed members, and the rounds one after the other."""
    hubs = [
        ("plot", "nullif(trim(plot_id), '')", "e,b,s", 1000.0), ("near", "near", "e,b,s", 60.0), ("around", "around", "s,e", 6.0), ("band", "concat_ws('/', dzongkhag, band::VARCHAR)", "b", 20.0),
        ("height", "band::VARCHAR", "b", 2.0), ("block", "geog_name", "e,b,s", 0.5), ("district", "dzongkhag", "e,b,s", 0.05),
    ]
    field = {"e": "elevation", "b": "bio1", "s": "soil_type"}
    edges = " UNION ALL ".join(
        f"SELECT env_id AS id, '{field[f]}' AS field, '{name}:' || ({key}) AS hub, {w}::DOUBLE AS w FROM rec WHERE ({key}) IS NOT NULL"
        for name, key, fs, w in hubs for f in fs.split(",")
    )
    cell = lambda size: f"CASE WHEN longitude BETWEEN -180 AND 180 AND latitude BETWEEN -180 AND 180 THEN floor(longitude / {size}::DOUBLE)::BIGINT || '/' || floor(latitude / {size}::DOUBLE)::BIGINT END"
    steps = []
    for r in range(rounds):
        if r:
            steps.append(f"""h{r} AS (SELECT field, hub, label, sum(s) AS s, sum(n) AS n FROM (SELECT * FROM h0 UNION ALL
              SELECT field, hub, label, 0.25::DOUBLE * value, 0.25::DOUBLE * CASE WHEN field = 'soil_type' THEN value ELSE 1 END FROM wanting JOIN x{r - 1} USING (id, field)) GROUP BY 1, 2, 3)""")
        steps.append(f"""c{r} AS (SELECT field, hub, sum(n) AS n FROM h{r} GROUP BY 1, 2),
            w{r} AS (SELECT id, field, sum(w) AS total FROM wanting JOIN c{r} USING (field, hub) GROUP BY 1, 2),
            x{r} AS (SELECT id, field, label, sum(w * s / c{r}.n) / any_value(total) AS value, any_value(total) AS weight
                     FROM wanting JOIN h{r} USING (field, hub) JOIN c{r} USING (field, hub) JOIN w{r} USING (id, field) GROUP BY 1, 2, 3)""")
    return _P3[: _P3.rindex("SELECT env_id")].rstrip() + f""",
cel AS (SELECT env_id, CASE WHEN {_fits('coalesce(told, best.u)')} THEN {_celsius('coalesce(told, best.u)')} END AS celsius FROM t LEFT JOIN best USING (layer)),
k AS (SELECT regexp_replace(lower(soil_type), '[ \\t\\x{{a0}}_]+', '', 'g') AS k, min(soil_type) AS class FROM soil_map_vector GROUP BY 1),
rec AS MATERIALIZED (SELECT env_id, plot_id, dzongkhag, geog_name, class, CASE WHEN elevation BETWEEN 90 AND 7600 THEN elevation END AS high, floor(high / 100)::BIGINT AS band,
       {cell(0.005)} AS near, {cell(0.03)} AS around,
       CASE WHEN bio1 BETWEEN -300 AND 450 OR bio1 BETWEEN 2431.5 AND 3181.5 THEN coalesce(celsius, 'nan'::DOUBLE) END AS temp
       FROM env_master_csv LEFT JOIN cel USING (env_id) LEFT JOIN k ON k.k = regexp_replace(lower(env_master_csv.soil_type), '[ \\t\\x{{a0}}_]+', '', 'g')),
long AS MATERIALIZED (SELECT env_id AS id, 'elevation' AS field, '' AS label, high AS value FROM rec UNION ALL SELECT env_id, 'bio1', '', temp FROM rec
       UNION ALL SELECT env_id, 'soil_type', coalesce(class, ''), CASE WHEN class IS NOT NULL THEN 1.0::DOUBLE END FROM rec),
missing AS (SELECT id, field FROM long WHERE value IS NULL),
observed AS (SELECT * FROM long WHERE value IS NOT NULL AND NOT isnan(value)),
edges AS MATERIALIZED ({edges}),
wanting AS MATERIALIZED (SELECT * FROM edges SEMI JOIN missing USING (id, field)),
h0 AS (SELECT field, hub, label, sum(value) AS s, count(*)::DOUBLE AS n FROM edges JOIN observed USING (id, field) GROUP BY 1, 2, 3),
{", ".join(steps)},
top AS (SELECT id, field, value, label, weight FROM x{rounds - 1} QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY value DESC, label) = 1),
every AS (SELECT field, label AS all_label, mean AS all_mean FROM (SELECT field, label, avg(value) AS mean, count(*) AS n FROM observed GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, label) = 1),
done AS (SELECT id, field, CASE WHEN NOT isnan(value) THEN value END AS value, label, false AS was_filled, NULL::DOUBLE AS confidence FROM long WHERE value IS NOT NULL
       UNION ALL SELECT id, field, coalesce(value, all_mean), coalesce(label, all_label), true,
       coalesce(CASE WHEN field = 'soil_type' THEN value ELSE weight / (weight + 1) END, 0) FROM missing LEFT JOIN top USING (id, field) LEFT JOIN every USING (field))
SELECT id AS env_id, field AS field_name, CASE WHEN field <> 'soil_type' THEN round(value, 4) END AS value, CASE WHEN field = 'soil_type' THEN label END AS label,
       was_filled, round(confidence, 4) AS confidence FROM done"""


SQL = {
    "p3_found": _P3,
    "p3_told": _P3_TOLD,
    "p2_filled": _p2(),
    "p1_found": r"""
WITH p AS (SELECT DISTINCT plot_id, longitude AS x, latitude AS y FROM plot_points_gpkg
           WHERE longitude BETWEEN 88.7 AND 92.2 AND latitude BETWEEN 26.7 AND 28.4 AND plot_id IS NOT NULL),
rings AS (SELECT unit_id, row_number() OVER () AS ring, string_split(r, ',') AS v
          FROM (SELECT unit_id, unnest(regexp_extract_all(geometry_wkt, '\(([^()]+)\)', 1)) AS r FROM soil_map_vector)),
pts AS (SELECT unit_id, ring, i, split_part(trim(v[i]), ' ', 1)::DOUBLE AS x, split_part(trim(v[i]), ' ', 2)::DOUBLE AS y
        FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM rings)),
e AS (SELECT a.unit_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pts a JOIN pts b ON a.ring = b.ring AND b.i = a.i + 1),
s AS (SELECT plot_id, p.x, p.y, unit_id FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1
      GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)
SELECT DISTINCT 'near' AS relation, a.plot_id AS key_a, b.plot_id AS key_b FROM p a JOIN p b ON a.plot_id < b.plot_id
WHERE 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin((radians(b.y) - radians(a.y)) / 2), 2)
      + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2))) <= 50
UNION ALL SELECT DISTINCT 'soil', plot_id, unit_id FROM s""",
    "p2_found": r"""
WITH k AS (SELECT DISTINCT regexp_replace(lower(soil_type), '[ \t\x{a0}_]+', '', 'g') AS k FROM soil_map_vector),
e AS (SELECT env_id, elevation AS h, bio1 AS t, regexp_replace(lower(soil_type), '[ \t\x{a0}_]+', '', 'g') AS s FROM env_master_csv)
SELECT env_id, 'elevation' AS field_name FROM e WHERE h IS NULL OR isnan(h) OR h < 90 OR h > 7600
UNION ALL SELECT env_id, 'bio1' FROM e WHERE t IS NULL OR isnan(t) OR NOT (t BETWEEN -300 AND 450 OR t BETWEEN 2431.5 AND 3181.5)
UNION ALL SELECT env_id, 'soil_type' FROM e WHERE s IS NULL OR s NOT IN (SELECT k FROM k)""",
}
