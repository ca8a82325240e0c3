"""Queries over the result cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import binding, oracle
from ..operators import cube
from ..session import scratch_folder
from .registry import query

PULL = "SELECT sky, point, view, max(CASE WHEN metric = 'F' THEN value END) AS \"F\", max(CASE WHEN metric = 'O' THEN value END) AS \"O\" FROM b_result"


def result(spark, sf_dir):
    return binding(spark, sf_dir, "b_result")


@query(oracle(f"{PULL} GROUP BY sky, point, view", "b_result"))
def rs01_pull(spark, sf_dir):
    return cube.pull(result(spark, sf_dir), "metric", ["F", "O"])


@query(oracle("SELECT point, sky, " + ", ".join(f"max(CASE WHEN view = '{v}' AND metric = '{m}' THEN value END) AS \"{v}_{m}\"" for v in "ANR" for m in "FO") + " FROM b_result GROUP BY point, sky", "b_result"))
def rs01_pull_axes(spark, sf_dir):
    """Two kept axes as columns, rows labelled by the others, point before sky."""
    order = cube.pull_axes(result(spark, sf_dir), "view", "metric", "point", labels={"view": ["A", "N", "R"], "metric": ["F", "O"]}, preserve=2)
    return order.select("point", "sky", *(f"{v}_{m}" for v in "ANR" for m in "FO"))


@query(oracle(f"{PULL} WHERE sky BETWEEN 23940 AND 23960 GROUP BY sky, point, view", "b_result"))
def rs02_pull_zonal(spark, sf_dir):
    return cube.pull_zonal(result(spark, sf_dir), "metric", ["F", "O"], sky=(23940, 23960))


@query(oracle("SELECT 'sky' AS axis, 0 AS number, count(DISTINCT sky) AS n FROM b_result UNION ALL SELECT 'point', 1, count(DISTINCT point) FROM b_result UNION ALL SELECT 'view', 2, count(DISTINCT view) FROM b_result UNION ALL SELECT 'metric', 3, count(DISTINCT metric) FROM b_result", "b_result"))
def rs03_axes(spark, sf_dir):
    counts = result(spark, sf_dir).agg(*(F.countDistinct(cube.axis(i)).alias(cube.axis(i)) for i in range(4)))
    return counts.unpivot([], list(cube.AXES), "axis", "n").select("axis", (F.array_position(F.array(*map(F.lit, cube.AXES)), F.col("axis")) - 1).cast("int").alias("number"), "n")


@query(oracle("SELECT sky, CAST((sky - 1) // 12 AS INT) AS year, CAST((sky - 1) % 12 + 1 AS INT) AS month, point, round(sum(value), 6) AS value FROM b_result GROUP BY sky, point", "b_result"))
def rs04_time_labels(spark, sf_dir):
    times = result(spark, sf_dir).select("sky").distinct().select("sky", F.floor((F.col("sky") - 1) / 12).cast("int").alias("year"), ((F.col("sky") - 1) % 12 + 1).cast("int").alias("month"))
    return result(spark, sf_dir).groupBy("sky", "point").agg(F.round(F.sum("value"), 6).alias("value")).join(times, "sky")


@query(oracle("SELECT t, pt_id * 100 + sensor_id AS point, round(sum(coef*value), 6) AS value FROM b_sky JOIN b_contrib USING (patch) GROUP BY t, pt_id, sensor_id", "b_sky", "b_contrib"))
def rs05_sensor_points(spark, sf_dir):
    """Sensors become points: one join over (point, sensor) rows, no evaluation per sensor."""
    from ..operators.integrate import coefficient_product

    found = coefficient_product(binding(spark, sf_dir, "b_sky"), binding(spark, sf_dir, "b_contrib"), ["pt_id", "sensor_id"])
    return found.select("t", (F.col("pt_id") * 100 + F.col("sensor_id")).alias("point"), F.round("value", 6).alias("value"))


@query(oracle("SELECT * FROM b_result WHERE sky BETWEEN 23940 AND 23950 AND view IN ('A', 'R') AND metric = 'F'", "b_result"))
def fl12_axis_filter(spark, sf_dir):
    return cube.axis_filter(result(spark, sf_dir), sky=(23940, 23950), view=["A", "R"], metric="F", point=[])


@query(oracle("SELECT * FROM b_result WHERE sky IN (SELECT t FROM b_sun WHERE sun_rad > 400) AND point IN (SELECT pt_id FROM b_points WHERE level = 1)", "b_result", "b_sun", "b_points"))
def fl13_named_filters(spark, sf_dir):
    kept = cube.sky_filter(cube.metric_filter(result(spark, sf_dir), ["F", -1]), binding(spark, sf_dir, "b_sun").where("sun_rad > 400"))
    return cube.filter_by(kept, "point", binding(spark, sf_dir, "b_points").where("level = 1").select("pt_id"))


MERGED = "SELECT * FROM b_result UNION ALL SELECT * FROM b_result2 WHERE sky NOT IN (SELECT sky FROM b_result)"


@query(oracle(MERGED, "b_result", "b_result2"))
def st01_merge(spark, sf_dir):
    return cube.merge(result(spark, sf_dir), binding(spark, sf_dir, "b_result2"), along="sky")


@query(oracle("SELECT * FROM b_result UNION ALL SELECT * FROM (SELECT sky, point + 50 AS point, view, metric, value FROM b_result2) WHERE point NOT IN (SELECT point FROM b_result)", "b_result", "b_result2"))
def st02_merge_zonal(spark, sf_dir):
    return cube.merge(result(spark, sf_dir), binding(spark, sf_dir, "b_result2").withColumn("point", F.col("point") + 50), along="point")


@query(oracle("SELECT sky, point, view, metric, value FROM b_result UNION ALL SELECT sky + 1000, point, view, metric, value FROM b_result2", "b_result", "b_result2"))
def st05_concatenate(spark, sf_dir):
    """Two chunks of skies as one cube."""
    later = binding(spark, sf_dir, "b_result2").withColumn("sky", F.col("sky") + 1000)
    return cube.concatenated([result(spark, sf_dir), later])


_CLOSE = "a AS (SELECT DISTINCT sky + 1e-7 AS v, CAST(sky + 1e-7 AS VARCHAR) AS l FROM b_result), b AS (SELECT DISTINCT CAST(sky AS DOUBLE) AS v FROM b_result2)"


@query(oracle("SELECT 'sky' AS axis, CAST(CAST(v AS INT) AS INT) AS label, side FROM (SELECT v, 'left' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE abs(a.v - b.v) <= 1e-5*greatest(abs(a.v), abs(b.v), 1)) UNION ALL SELECT v, 'right' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE abs(a.v - b.v) <= 1e-5*greatest(abs(a.v), abs(b.v), 1)))", "b_result", "b_result2", ctes=_CLOSE))
def jn25_axis_mismatches(spark, sf_dir):
    """Skies of the left cube are off by less than the tolerance; only those far from every sky of the other are listed."""
    left = result(spark, sf_dir).withColumn("sky", F.col("sky") + 1e-7)
    found = cube.axis_mismatches(left, binding(spark, sf_dir, "b_result2").withColumn("sky", F.col("sky").cast("double")), "point", 1e-5)
    return found.select("axis", F.col("label").cast("double").cast("int").alias("label"), "side")


@query(oracle("SELECT point, view, level, round(value, 6) AS value FROM (SELECT point, view, unnest([0.1, 0.5, 0.95]) AS level, unnest([quantile_cont(value, 0.1), quantile_cont(value, 0.5), quantile_cont(value, 0.95)]) AS value FROM b_result WHERE metric = 'O' GROUP BY point, view)".replace("[0.1, 0.5, 0.95]", "[CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.95 AS DOUBLE)]"), "b_result"))
def ag11_sky_percentiles(spark, sf_dir):
    return cube.percentiles(result(spark, sf_dir), "O", [0.1, 0.5, 0.95]).select("point", "view", "level", F.round("value", 6).alias("value"))


@query(oracle("SELECT s.t AS sky, o.point, o.view, o.metric, coalesce(r.value, 0) AS value FROM (SELECT DISTINCT t FROM b_sky) s CROSS JOIN (SELECT DISTINCT point, view, metric FROM b_result) o LEFT JOIN b_result r ON r.sky = s.t AND r.point = o.point AND r.view = o.view AND r.metric = o.metric", "b_sky", "b_result"))
def jn17_pad_times(spark, sf_dir):
    return cube.pad(result(spark, sf_dir), binding(spark, sf_dir, "b_sky").select(F.col("t").alias("sky")))


@query(oracle("SELECT c.view, c.metric, round(avg(abs(CASE WHEN c.metric = 'O' THEN (c.value - r.value)/r.value ELSE c.value - r.value END)), 6) AS mae, round(avg(CASE WHEN c.metric = 'O' THEN (c.value - r.value)/r.value ELSE c.value - r.value END), 6) AS msd FROM b_result c JOIN b_result2 r USING (sky, point, view, metric) WHERE r.value BETWEEN 25 AND 75 GROUP BY c.view, c.metric", "b_result", "b_result2"))
def ag09_accuracy(spark, sf_dir):
    reference = binding(spark, sf_dir, "b_result2").where("value between 25 and 75")
    found = cube.deviation(result(spark, sf_dir), reference, "O")
    return found.select("view", "metric", F.round("mae", 6).alias("mae"), F.round("msd", 6).alias("msd"))


@query(oracle("SELECT sky, point, view, CASE WHEN f IS NULL THEN '' ELSE printf('%.4e', f) END AS \"F\", CASE WHEN o IS NULL THEN '' ELSE printf('%.4e', o) END AS \"O\" FROM (SELECT sky, point, view, max(CASE WHEN metric = 'F' THEN value END) AS f, max(CASE WHEN metric = 'O' THEN value END) AS o FROM b_result GROUP BY sky, point, view)", "b_result"))
def io14_printed(spark, sf_dir):
    return cube.printed(result(spark, sf_dir), "metric", ["F", "O"])


@query(oracle("SELECT sky, point, view, printf('%.4e', coalesce(f, 0)) AS \"F\", printf('%.4e', coalesce(o, 0)) AS \"O\" FROM (SELECT s.t AS sky, p.point, p.view, max(CASE WHEN metric = 'F' THEN value END) AS f, max(CASE WHEN metric = 'O' THEN value END) AS o FROM (SELECT DISTINCT t FROM b_sky) s CROSS JOIN (SELECT DISTINCT point, view FROM b_result) p LEFT JOIN b_result r ON r.sky = s.t AND r.point = p.point AND r.view = p.view GROUP BY ALL)", "b_sky", "b_result"))
def io14_printed_year(spark, sf_dir):
    """Padded to all times, written as TSV with a header and read again."""
    path = scratch_folder(spark, "tsv")
    cube.write_tsv(cube.printed(result(spark, sf_dir), "metric", ["F", "O"], times=binding(spark, sf_dir, "b_sky").select(F.col("t").alias("sky"))), path)
    return spark.read.option("sep", "\t").option("header", True).schema("sky int, point long, view string, F string, O string").csv(path)


@query(oracle("SELECT printf('%04d', sky) AS file_label, point, view, CASE WHEN f IS NULL THEN NULL ELSE printf('%.4e', f) END AS \"F\", CASE WHEN o IS NULL THEN NULL ELSE printf('%.4e', o) END AS \"O\" FROM (SELECT sky, point, view, max(CASE WHEN metric = 'F' THEN value END) AS f, max(CASE WHEN metric = 'O' THEN value END) AS o FROM b_result GROUP BY ALL)", "b_result"))
def io15_print_serial(spark, sf_dir):
    """A TSV table per sky; the cube is ragged, so each repeats the labels of its own points."""
    path = scratch_folder(spark, "serial")
    cube.write_serial(result(spark, sf_dir), "metric", ["F", "O"], "sky", path)
    read = spark.read.option("sep", "\t").option("header", True).schema("point long, view string, F string, O string, file_label string")
    return read.csv(path).select("file_label", "point", "view", "F", "O")


def _info_sql() -> str:
    parts = []
    for name in cube.AXES:
        limit = 100 if name == "metric" else 20
        parts.append(f"SELECT '{name}' AS axis, n, label FROM (SELECT CAST({name} AS VARCHAR) AS label, count(*) OVER () AS n, row_number() OVER (ORDER BY {name}) AS k FROM (SELECT DISTINCT {name} FROM b_result)) WHERE n <= {limit} OR k <= 5 OR k > n - 5")
    return oracle(" UNION ALL ".join(parts), "b_result")


@query(_info_sql())
def io17_info(spark, sf_dir):
    return cube.info(result(spark, sf_dir))


@query(oracle("SELECT sky, point, view, metric, value, printf('%04d_%04d', sky, point) AS file_label, concat_ws(chr(9), CAST(sky AS VARCHAR), CAST(point AS VARCHAR), view) AS row_label FROM b_result", "b_result"))
def io18_labels(spark, sf_dir):
    return cube.labels(result(spark, sf_dir))


@query(oracle("SELECT pt_id, printf('%05.2f_%05.2f_%05.2f', x, y, z) AS label FROM b_points", "b_points"))
def io18_tuple_labels(spark, sf_dir):
    return binding(spark, sf_dir, "b_points").select("pt_id", cube.formatted("tuple", F.array("x", "y", "z")).alias("label"))


@query(oracle("SELECT label, CAST(k AS INT) AS index FROM (SELECT view AS label, row_number() OVER (ORDER BY view) - 1 AS k FROM (SELECT DISTINCT view FROM b_result)) WHERE label IN ('N', 'R')", "b_result"))
def io18_label_lookup(spark, sf_dir):
    return cube.axis_index(result(spark, sf_dir), "view", ["R", "N"])


@query(oracle("SELECT sky, point, view, metric, value FROM b_result WHERE metric = 'O'", "b_result"))
def io12_result_partitions(spark, sf_dir):
    """The cube stored by metric; a reader of one metric scans its folder only."""
    path = scratch_folder(spark, "cube")
    cube.write_result(result(spark, sf_dir), path)
    return cube.axis_filter(cube.read_result(spark, path), metric="O")


@query(oracle("SELECT CAST(t // 24 AS INT) AS day, CAST(23 - t % 24 AS INT) AS row, round(value, 6) AS value FROM (SELECT CAST((day - 1)*24 + hour - 0.5 AS INT) AS t, avg(dir_norm) AS value FROM b_weather GROUP BY day, hour)", "b_weather"))
def wn07_heat_map(spark, sf_dir):
    hourly = binding(spark, sf_dir, "b_weather").groupBy(((F.col("day") - 1) * 24 + F.col("hour") - 0.5).cast("int").alias("t")).agg(F.avg("dir_norm").alias("value"))
    return cube.heat_map(hourly, 24).select("day", "row", F.round("value", 6).alias("value"))
