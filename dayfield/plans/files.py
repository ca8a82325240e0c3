"""Queries through files: tables are written in a source's format to the shared folder and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import binding, oracle
from ..functions import directions as d
from ..functions import sky
from ..operators import cube, suns
from ..session import scratch_folder
from ..sources import tables, weather
from . import skies as suns_plan
from . import sqltext as q
from .registry import query, r, rounded
from .skies import _SUN, HELD, LAT, LON, MERIDIAN, RING

KEYS = ("month", "day", "hour")


@query(oracle("SELECT month, day, hour, count(*) AS n, round(sum(dir_norm), 6) AS dir_norm, round(sum(dif_horiz), 6) AS dif_horiz FROM b_weather GROUP BY month, day, hour", "b_weather"))
def io01_weather_scan(spark, sf_dir):
    """WEA files of every station, scanned in one job."""
    path = scratch_folder(spark, "wea")
    rows = binding(spark, sf_dir, "b_weather")
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in (*KEYS, "dir_norm", "dif_horiz")))
    rows.select("station", line.alias("value")).repartition("station").write.partitionBy("station").text(path)
    found = weather.read_weather(spark, f"{path}/*")
    return found.groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.sum("dir_norm"), 6).alias("dir_norm"), F.round(F.sum("dif_horiz"), 6).alias("dif_horiz"))


@query(oracle("SELECT CAST(month AS DOUBLE) AS month, CAST(day AS DOUBLE) AS day, hour - 0.5 AS hour, round(sum(dir_norm), 6) AS dir_norm, 0E0 AS note FROM b_weather GROUP BY month, day, hour", "b_weather"))
def io02_epw_scan(spark, sf_dir):
    """EPW lines of 35 fields; the note is 0 and the hour is less one half."""
    path = scratch_folder(spark, "epw")
    rows = binding(spark, sf_dir, "b_weather")
    fields = {n: F.lit("1") for n in weather.EPW_COLUMNS} | {c: F.col(c).cast("string") for c in (*KEYS, "dir_norm", "dif_horiz")}
    rows.select(F.concat_ws(",", *fields.values()).alias("value")).write.text(path)
    found = weather.read_epw(spark, path, ["month", "day", "hour", "dir_norm", "note"])
    return found.groupBy("month", "day", "hour", "note").agg(F.round(F.sum("dir_norm"), 6).alias("dir_norm"))


@query(oracle("SELECT DISTINCT 's' || station AS name, 46.25E0 + station AS lat, -6.13E0 AS lon, -15E0 AS meridian, 400E0 + station AS elevation FROM b_weather", "b_weather"))
def io03_station_headers(spark, sf_dir):
    path = scratch_folder(spark, "headers")
    stations = binding(spark, sf_dir, "b_weather").select("station").distinct()
    lines = F.array(
        F.concat(F.lit("place s"), "station"), F.concat(F.lit("latitude "), (F.col("station") + 46.25).cast("string")), F.lit("longitude -6.13"),
        F.lit("time_zone -15"), F.concat(F.lit("site_elevation "), (F.col("station") + 400.0).cast("string")), F.lit("weather_data_file_units 1"),
    )
    stations.select("station", F.explode(lines).alias("value")).repartition("station").write.partitionBy("station").text(path)
    return weather.stations(spark, f"{path}/*").select("name", "lat", "lon", "meridian", "elevation")


@query(oracle("SELECT level, pt_id, x, y, z FROM b_points", "b_points"))
def io05_point_scan(spark, sf_dir):
    path = scratch_folder(spark, "points")
    rows = binding(spark, sf_dir, "b_points")
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("level", "pt_id", "x", "y", "z")))
    rows.select("level", line.alias("value")).repartition("level").write.partitionBy("level").text(path)
    return tables.read_points(spark, f"{path}/*").select("level", "pt_id", "x", "y", "z")


def _stored(spark, sf_dir):
    path = scratch_folder(spark, "rays")
    tables.write_rays(binding(spark, sf_dir, "b_rays").withColumn("zone", F.lit("a")), path)
    return path


@query(oracle("SELECT src, pt_id, count(*) AS n, round(sum(lum*omega), 6) AS energy FROM b_rays GROUP BY src, pt_id", "b_rays"))
def io07_ray_store(spark, sf_dir):
    found = tables.read_rays(spark, _stored(spark, sf_dir))
    return found.groupBy("src", "pt_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("lum") * F.col("omega")), 6).alias("energy"))


@query(oracle("SELECT src, pt_id, ray_id, round(lum, 6) AS lum FROM b_rays WHERE src = 1 AND pt_id IN (SELECT pt_id FROM b_points WHERE level = 1)", "b_rays", "b_points"))
def io08_keyed_rays(spark, sf_dir):
    """Rays of listed (source, point) keys; other folders are not read."""
    keys = binding(spark, sf_dir, "b_points").where("level = 1").select(F.lit("a").alias("zone"), F.lit(1).alias("src"), "pt_id")
    return tables.read_rays(spark, _stored(spark, sf_dir), keys).select("src", "pt_id", "ray_id", F.round("lum", 6).alias("lum"))


@query(oracle("SELECT src, sensor_id, count(*) AS n, round(sum(value), 6) AS value FROM (SELECT *, CAST(pt_id % 3 AS INT) AS src FROM b_contrib) GROUP BY src, sensor_id", "b_contrib"))
def io10_sensor_store(spark, sf_dir):
    path = scratch_folder(spark, "sensors")
    tables.write_sensors(binding(spark, sf_dir, "b_contrib").withColumn("zone", F.lit("a")).withColumn("src", (F.col("pt_id") % 3).cast("int")), path)
    return spark.read.parquet(path).groupBy("src", "sensor_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query(oracle("SELECT sky, count(*) AS n, round(sum(value), 6) AS value FROM b_result WHERE view = 'A' GROUP BY sky", "b_result"))
def io13_zonal_store(spark, sf_dir):
    """A ragged cube stored by view; reading one view prunes the others."""
    path = scratch_folder(spark, "zonal")
    cube.write_result(binding(spark, sf_dir, "b_result"), path, "view")
    return cube.read_result(spark, path).where("view = 'A'").groupBy("sky").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query(oracle("SELECT station, CAST(month AS INT) AS month, CAST(k AS INT) AS k, round(sx, 5) + 0.0 AS sx, round(sz, 5) + 0.0 AS sz FROM sxyz WHERE sz > 0", ctes="b_weather AS (SELECT station, CAST(m AS INT) AS month, 21 AS day, k, k/12.0 AS hour FROM (SELECT DISTINCT CAST(user_id % 3 AS INT) AS station FROM events), (VALUES (6), (12)) v(m), range(288) r(k)), " + _SUN))
def gr02_solstice_tracks(spark, sf_dir):
    stations = binding(spark, sf_dir, "b_weather").select("station").distinct().withColumns({"lat": F.lit(LAT), "lon": F.lit(LON), "meridian": F.lit(MERIDIAN)})
    return rounded(sky.solstice_tracks(stations), "sx", "sz", digits=5).select("station", "month", "k", "sx", "sz")


@query(oracle("SELECT station, CAST(k AS INT) AS k, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM ring", ctes=RING))
def gr02_solar_boundary(spark, sf_dir):
    """The polygon between both solstice tracks of every station, closed through far points."""
    ring = suns_plan.boundary(spark, sf_dir).select("station", F.posexplode("ring").alias("k", "p"))
    return ring.select("station", "k", r("p.x", 5).alias("x"), r("p.y", 5).alias("y"))


@query(oracle(f"SELECT 'sun' AS grid, CAST(c AS INT) AS cell, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(cz, 6) + 0.0 AS z, round(acos(cz)/(pi()/2)*cx/greatest(sqrt(cx*cx+cy*cy), 1e-12), 6) + 0.0 AS ax FROM ({q.from_uv('SELECT c, (c // 8 + 0.5)/8 AS u, (c % 8 + 0.5)/8 AS v FROM range(64) r(c)')}) JOIN (SELECT DISTINCT CAST(i*8 + j AS INT) AS c FROM held) USING (c) UNION ALL SELECT 'plan', CAST(pt_id AS INT), 0, 0, round(x, 6), round(y, 6), round(z, 6), 0 FROM b_points", "b_weather", "b_points", ctes=f"{_SUN}, {HELD}"))
def io20_candidate_table(spark, sf_dir):
    """The sun grid with xyz, angular and square coordinates, and the plan points with xyz."""
    found = suns.sun_grid(spark, 8, held=suns.sun_cells(suns_plan.risen(spark, sf_dir), 8))
    ax, _ = d.to_angular(d.Xyz(F.col("sx"), F.col("sy"), F.col("sz")))
    sun_rows = found.select(F.lit("sun").alias("grid"), (F.col("i") * 8 + F.col("j")).cast("int").alias("cell"), "u", "v", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), ax.alias("ax"))
    plan_rows = binding(spark, sf_dir, "b_points").select(F.lit("plan").alias("grid"), F.col("pt_id").cast("int").alias("cell"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), "x", "y", "z", F.lit(0.0).alias("ax"))
    return rounded(sun_rows.unionByName(plan_rows), "u", "v", "x", "y", "z", "ax")


@query(oracle("SELECT src, pt_id, ray_id, round(dz, 6) + 0.0 AS dz, CAST(row_number() OVER (PARTITION BY src, pt_id ORDER BY ray_id) AS INT) AS place FROM b_rays", "b_rays"))
def tk04_ordered_output(spark, sf_dir):
    """Rows in the order of their keys: sorting is left to the output."""
    from pyspark.sql import Window

    rows = binding(spark, sf_dir, "b_rays").withColumn("place", F.row_number().over(Window.partitionBy("src", "pt_id").orderBy("ray_id")))
    return rows.select("src", "pt_id", "ray_id", r("dz").alias("dz"), "place").orderBy("src", "pt_id", "ray_id")


@query(oracle("SELECT pt_id, CAST(k AS INT) AS k, round(x + k*0.1, 6) AS x FROM b_points, range(5) r(k) WHERE k <= level + 1", "b_points"))
def ud04_table_expansion(spark, sf_dir):
    found = binding(spark, sf_dir, "b_points").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("level") + 1)))
    return found.select("pt_id", "k", F.round(F.col("x") + F.col("k") * 0.1, 6).alias("x"))


@query(oracle("SELECT patch, n, round(asin(greatest(least(z, 1), -1)), 6) + 0.0 AS alt FROM (SELECT patch, count(*) AS n, avg(dz) AS z FROM (SELECT CASE WHEN dz < 0 THEN 1 ELSE 0 END AS patch, dz FROM b_dirs) GROUP BY patch)", "b_dirs"))
def sc06_hemispheres(spark, sf_dir):
    rows = binding(spark, sf_dir, "b_dirs").withColumn("patch", F.when(d.sky_patch(d.xyz(), 1) == 1, 1).otherwise(0))
    return rows.groupBy("patch").agg(F.count("*").alias("n"), F.avg("dz").alias("z")).select("patch", "n", r(F.asin(d.clip(F.col("z"), -1.0, 1.0))).alias("alt"))
