"""Queries over directions, points and zones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import binding, oracle
from ..functions import directions as d
from ..functions import glare, sky
from ..operators import grid, nearest, zones
from . import sqltext as q
from .registry import query, r, rounded

SIDE = 8
RINGS = [("a", 0, [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]), ("l", 1, [(0.0, 0.0), (6.0, 0.0), (6.0, 3.0), (3.0, 3.0), (3.0, 6.0), (0.0, 6.0)])]
INSIDE = "((zone = 'a' AND x > 1 AND x <= 9 AND y > 1 AND y <= 9) OR (zone = 'l' AND ((x > 0 AND x <= 6 AND y > 0 AND y <= 3) OR (x > 0 AND x <= 3 AND y > 0 AND y <= 6))))"


def zone_table(spark: SparkSession) -> DataFrame:
    """The two zones of the fixtures: a square and an L."""
    return spark.createDataFrame([(z, i, ring, 1.2, 0.0) for z, i, ring in RINGS], "zone string, ring_id int, ring array<struct<x:double,y:double>>, z double, rotation double")


def views(spark: SparkSession, angle: float = 180.0) -> DataFrame:
    rows = [(0, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 0.0, 0.0, 1.0)]
    return spark.createDataFrame([(*v, angle) for v in rows], "view int, vx double, vy double, vz double, angle_deg double")


@query(oracle(f"SELECT ray_id, {q.r('degrees(asin(dz))')} AS alt, {q.r('degrees(atan2(-dx, -dy))')} AS az, {q.r('acos(dz)')} AS theta, {q.r('atan2(dy, dx)')} AS phi, {q.r('acos(dz)/(pi()/2)*cos(atan2(dy, dx))')} AS ax, {q.r('acos(dz)/(pi()/2)*sin(atan2(dy, dx))')} AS ay, {q.r('u')} AS u, {q.r('v')} AS v FROM ({q.uv('SELECT * FROM b_dirs')})", "b_dirs"))
def sc01_transform(spark, sf_dir):
    v = d.xyz()
    (alt, az), (theta, phi), (ax, ay), (u, w) = d.to_alt_az(v), d.to_theta_phi(v), d.to_angular(v), d.to_uv(v)
    return binding(spark, sf_dir, "b_dirs").select("ray_id", *(r(c).alias(n) for n, c in zip(("alt", "az", "theta", "phi", "ax", "ay", "u", "v"), (alt, az, theta, phi, ax, ay, u, w), strict=True)))


@query(oracle(f"SELECT ray_id, {q.r('u')} AS u, {q.r('v')} AS v, {q.r('dx')} AS bx, {q.r('dy')} AS by, {q.r('dz')} AS bz FROM ({q.uv('SELECT * FROM b_dirs')})", "b_dirs"))
def sc01_there_and_back(spark, sf_dir):
    """Vectors of length 3 to square coordinates and back to unit vectors."""
    rows = binding(spark, sf_dir, "b_dirs").withColumns({c: F.col(c) * 3 for c in nearest.DXYZ})
    there = d.transform(rows, list(nearest.DXYZ), "uv", ["u", "v"])
    back = d.transform(there, ["u", "v"], "uv2xyz", ["bx", "by", "bz"])
    return rounded(back, "u", "v", "bx", "by", "bz").select("ray_id", "u", "v", "bx", "by", "bz")


@query(oracle("SELECT pt_id, round(-sin(radians(b))*cos(radians(a)), 6) + 0.0 AS x, round(-cos(radians(b))*cos(radians(a)), 6) + 0.0 AS y, round(sin(radians(a)), 6) + 0.0 AS z, round(sin(radians(a))*cos(radians(b)), 6) + 0.0 AS tx, round(sin(radians(a))*sin(radians(b)), 6) + 0.0 AS ty, round(cos(radians(a)), 6) + 0.0 AS tz FROM (SELECT pt_id, x * 9 - 20 AS a, y * 36 - 170 AS b FROM b_points)", "b_points"))
def sc02_from_angles(spark, sf_dir):
    p = binding(spark, sf_dir, "b_points").select("pt_id", (F.col("x") * 9 - 20).alias("a"), (F.col("y") * 36 - 170).alias("b"))
    v, t = d.from_alt_az(F.col("a"), F.col("b")), d.from_theta_phi(F.radians("a"), F.radians("b"))
    return p.select("pt_id", *(r(c).alias(n) for n, c in zip(("x", "y", "z", "tx", "ty", "tz"), (*v, *t), strict=True)))


@query(oracle("SELECT pt_id, round(x/sqrt(x*x+y*y+z*z), 6) + 0.0 AS nx, round(y/sqrt(x*x+y*y+z*z), 6) + 0.0 AS ny, round(z/sqrt(x*x+y*y+z*z), 6) + 0.0 AS nz FROM b_points", "b_points"))
def sc03_normalise(spark, sf_dir):
    v = d.norm(d.Xyz(F.col("x"), F.col("y"), F.col("z")))
    return binding(spark, sf_dir, "b_points").select("pt_id", r(v.x).alias("nx"), r(v.y).alias("ny"), r(v.z).alias("nz"))


@query(oracle("SELECT ray_id, round(2*sin(acos(dz)/2), 6) + 0.0 AS chord, round(2*asin(least(sqrt((1-dz)*2)/2, 1)), 6) + 0.0 AS angle FROM b_dirs", "b_dirs"))
def sc04_chord_angle(spark, sf_dir):
    return binding(spark, sf_dir, "b_dirs").select("ray_id", r(d.chord(F.acos("dz"))).alias("chord"), r(d.angle_of_chord(F.sqrt((1 - F.col("dz")) * 2))).alias("angle"))


@query(oracle(f"SELECT ray_id, code, round((code // {SIDE} + 0.5)/{SIDE}, 6) AS cu, round((code % {SIDE} + 0.5)/{SIDE}, 6) AS cv FROM (SELECT ray_id, CAST(least(floor(u*{SIDE}), {SIDE - 1})*{SIDE} + least(floor(v*{SIDE}), {SIDE - 1}) AS INT) AS code FROM ({q.uv('SELECT * FROM b_dirs WHERE dz >= 0')}))", "b_dirs"))
def sc05_grid_codes(spark, sf_dir):
    u, v = d.to_uv(d.xyz())
    rows = binding(spark, sf_dir, "b_dirs").where("dz >= 0").select("ray_id", d.grid_bin(u, v, SIDE).alias("code"))
    cu, cv = d.bin_uv(F.col("code"), SIDE)
    return rows.select("ray_id", "code", F.round(cu, 6).alias("cu"), F.round(cv, 6).alias("cv"))


@query(oracle(f"SELECT pt_id, pt_id % 64 AS code, round((pt_id % 64 // 8 + {q.uniform(5, 'pt_id')})/8, 9) AS u, round((pt_id % 8 + {q.uniform(6, 'pt_id')})/8, 9) AS v FROM b_points", "b_points"))
def sc05_jittered_cells(spark, sf_dir):
    """A flat index as a place inside its cell."""
    rows = binding(spark, sf_dir, "b_points").select("pt_id", (F.col("pt_id") % 64).alias("code"))
    u, v = d.jittered_uv(F.col("code"), 8, 5, "pt_id")
    return rows.select("pt_id", "code", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


@query(oracle(f"SELECT patch, count(*) AS n, {q.r('sum(lum)', 2)} AS lum FROM ({q.patch('SELECT * FROM b_dirs', SIDE)}) GROUP BY patch", "b_dirs"))
def sc06_sky_patch(spark, sf_dir):
    rows = binding(spark, sf_dir, "b_dirs").withColumn("patch", d.sky_patch(d.xyz(), SIDE))
    return rows.groupBy("patch").agg(F.count("*").alias("n"), r(F.sum("lum"), 2).alias("lum"))


@query(oracle("SELECT pt_id, zone, round(((x-cx)*cos(radians(-30)) - (y-cy)*sin(radians(-30)) + cx - x0)/side, 6) + 0.0 AS u, round(((x-cx)*sin(radians(-30)) + (y-cy)*cos(radians(-30)) + cy - y0)/side, 6) + 0.0 AS v FROM b_points, (VALUES ('a', 1.0, 1.0, 5.0, 5.0, 8.0), ('l', 0.0, 0.0, 3.0, 3.0, 6.0)) z(zone, x0, y0, cx, cy, side)", "b_points"))
def sc07_plan_uv(spark, sf_dir):
    zs = zone_table(spark).withColumn("rotation", F.lit(30.0))
    points = binding(spark, sf_dir, "b_points").crossJoin(zs.select("zone"))
    return zones.uv_of(points, zs).select("pt_id", "zone", r("u").alias("u"), r("v").alias("v"))


@query(oracle("SELECT ray_id, round(dx*cos(radians(35)) - dy*sin(radians(35)), 6) + 0.0 AS sx, round(dx*sin(radians(35)) + dy*cos(radians(35)), 6) + 0.0 AS sy, round(dz, 6) + 0.0 AS sz FROM b_dirs", "b_dirs"))
def sc08_rotate_suns(spark, sf_dir):
    x, y = d.rotate_z(F.col("dx"), F.col("dy"), 35.0)
    return binding(spark, sf_dir, "b_dirs").select("ray_id", r(x).alias("sx"), r(y).alias("sy"), r("dz").alias("sz"))


@query(oracle(f"SELECT ray_id, view, round(dx - 2*k*vx, 6) + 0.0 AS x, round(dy - 2*k*vy, 6) + 0.0 AS y, round(dz - 2*k*vz, 6) + 0.0 AS z FROM (SELECT *, dx*vx + dy*vy + dz*vz AS k FROM b_rays, {q.VIEWS}) WHERE k < 0", "b_rays"))
def sc09_reflect(spark, sf_dir):
    pairs = binding(spark, sf_dir, "b_rays").crossJoin(F.broadcast(views(spark))).where(d.dot(d.xyz(), d.xyz("v")) < 0)
    v = d.reflect(d.xyz(), d.xyz("v"))
    return pairs.select("ray_id", "view", r(v.x).alias("x"), r(v.y).alias("y"), r(v.z).alias("z"))


@query(oracle("SELECT ray_id, round(0.265*lum + 0.670*omega + 0.065*abs(dz), 6) AS rad FROM b_dirs", "b_dirs"))
def sc10_radiance(spark, sf_dir):
    return binding(spark, sf_dir, "b_dirs").select("ray_id", F.round(d.radiance(F.col("lum"), F.col("omega"), F.abs("dz")), 6).alias("rad"))


@query(oracle("SELECT pt_id, light, round(2*degrees(atan(0.5*size/dist)), 6) AS apparent, CASE WHEN degrees(2*atan(0.5*size/dist)) >= 22.5 THEN 0 WHEN degrees(2*atan(0.5*size/dist)) >= 11.25 THEN 1 WHEN degrees(2*atan(0.5*size/dist)) >= 5.625 THEN 2 ELSE 3 END AS level FROM (SELECT pt_id, light, size, sqrt((x-lx)*(x-lx)+(y-ly)*(y-ly)+(z-lz)*(z-lz)) AS dist FROM b_points, (VALUES (0, 2.0, 2.0, 3.0, 0.5), (1, 7.0, 5.0, 2.8, 1.5)) l(light, lx, ly, lz, size))", "b_points"))
def sc20_apparent_size(spark, sf_dir):
    lights = spark.createDataFrame([(0, 2.0, 2.0, 3.0, 0.5), (1, 7.0, 5.0, 2.8, 1.5)], "light int, lx double, ly double, lz double, size double")
    pairs = binding(spark, sf_dir, "b_points").crossJoin(F.broadcast(lights))
    dist = F.sqrt((F.col("x") - F.col("lx")) ** 2 + (F.col("y") - F.col("ly")) ** 2 + (F.col("z") - F.col("lz")) ** 2)
    apparent = 2 * F.degrees(F.atan(0.5 * F.col("size") / dist))
    ladder = F.when(apparent >= 22.5, 0).when(apparent >= 11.25, 1).when(apparent >= 5.625, 2).otherwise(3)
    return pairs.select("pt_id", "light", F.round(apparent, 6).alias("apparent"), ladder.alias("level"))


@query(oracle("SELECT ray_id, round(w, 6) AS omega_new, round(lum*omega/w, 4) AS lum_new FROM (SELECT *, pi()*radians(degrees(sqrt(omega/pi())) + least(greatest(0.183333/2*sqrt(greatest(log10(greatest(lum, 1.0)), 0)), 0), 1.5))*radians(degrees(sqrt(omega/pi())) + least(greatest(0.183333/2*sqrt(greatest(log10(greatest(lum, 1.0)), 0)), 0), 1.5)) AS w FROM b_dirs)", "b_dirs"))
def sc21_point_spread(spark, sf_dir):
    omega, lum = glare.spread_source(F.col("omega"), F.col("lum"))
    return binding(spark, sf_dir, "b_dirs").select("ray_id", F.round(omega, 6).alias("omega_new"), F.round(lum, 4).alias("lum_new"))


@query(oracle(f"SELECT ray_id, view, round(pos, 4) AS pos FROM ({q.position(f'SELECT * FROM b_rays, {q.VIEWS} WHERE dx*vx + dy*vy + dz*vz > 0.05')})", "b_rays"))
def sc23_position_index(spark, sf_dir):
    pairs = binding(spark, sf_dir, "b_rays").crossJoin(F.broadcast(views(spark))).where(d.dot(d.xyz(), d.xyz("v")) > 0.05)
    return pairs.select("ray_id", "view", F.round(glare.position_index(d.xyz(), d.xyz("v")), 4).alias("pos"))


@query(oracle("SELECT level, n, round((0.1 - 0.25)/2*level + 0.25, 6) AS threshold FROM (SELECT level, count(*) AS n FROM b_points GROUP BY level)", "b_points"))
def sc24_thresholds(spark, sf_dir):
    ladder = spark.createDataFrame([(i, grid.threshold(i, 3)) for i in range(3)], "level int, threshold double")
    return binding(spark, sf_dir, "b_points").groupBy("level").agg(F.count("*").alias("n")).join(ladder, "level").select("level", "n", F.round("threshold", 6).alias("threshold"))


@query(oracle("SELECT pt_id, sensor_id, round(sum(value), 6) AS value FROM b_contrib GROUP BY pt_id, sensor_id", "b_contrib"))
def sc25_unit_sky(spark, sf_dir):
    unit = sky.unit_sky(spark, 4).withColumn("t", F.lit(0))
    from ..operators.integrate import coefficient_product

    return coefficient_product(unit, binding(spark, sf_dir, "b_contrib"), ["pt_id", "sensor_id"]).select("pt_id", "sensor_id", F.round("value", 6).alias("value"))


_ZONED = "SELECT zone, pt_id, x, y FROM b_points, (VALUES ('a'), ('l')) z(zone)"


@query(oracle(f"SELECT zone, pt_id FROM ({_ZONED}) WHERE {INSIDE}", "b_points"))
def fl05_in_zone(spark, sf_dir):
    shifted = binding(spark, sf_dir, "b_points").crossJoin(zone_table(spark).select("zone"))
    # a point on the lower or left edge is outside and one on the upper or right edge inside, as both engines see it after this shift
    nudged = shifted.withColumns({c: F.col(c) - 1e-9 for c in ("x", "y")})
    return zones.in_zone(nudged, zone_table(spark)).select("zone", "pt_id")


@query(oracle(f"SELECT zone, pt_id FROM ({_ZONED}) WHERE {INSIDE} AND floor(x - 1e-9) * 100 + floor(y - 1e-9) IN (SELECT floor(x) * 100 + floor(y) FROM b_queries)", "b_points", "b_queries"))
def fl06_masked_zone(spark, sf_dir):
    """Cells of one unit that a queried point lies in; points just inside their upper edges, as both engines see it."""
    points = binding(spark, sf_dir, "b_points").crossJoin(zone_table(spark).select("zone"))
    nudged = points.withColumns({c: F.col(c) - 1e-9 for c in ("x", "y")})
    valid = binding(spark, sf_dir, "b_queries").withColumns({c: F.floor(c) + 0.5 for c in ("x", "y")})
    shifted = valid.withColumns({c: F.col(c) - 1e-9 for c in ("x", "y")})
    kept = zones.masked_zone(nudged.withColumns({f"_{c}0": F.col(c) for c in "xy"}), zone_table(spark), shifted, 1.0)
    return kept.select("zone", "pt_id")


@query(oracle(f"SELECT view, ray_id, round(dx*vx + dy*vy + dz*vz, 6) + 0.0 AS cosine FROM b_dirs, {q.VIEWS} WHERE dx*vx + dy*vy + dz*vz >= cos(radians(15)) - 1e-12", "b_dirs"))
def fl09_view_cone(spark, sf_dir):
    from ..operators.metrics import in_view

    return in_view(binding(spark, sf_dir, "b_dirs"), views(spark, 30.0)).select("view", "ray_id", r("cos").alias("cosine"))


@query(oracle("SELECT ray_id FROM b_dirs d WHERE NOT EXISTS (SELECT 1 FROM b_rays s WHERE s.omega > 0.02 AND (d.dx-s.dx)*(d.dx-s.dx)+(d.dy-s.dy)*(d.dy-s.dy)+(d.dz-s.dz)*(d.dz-s.dz) <= 0.05*0.05)", "b_dirs", "b_rays"))
def fl10_outside_sources(spark, sf_dir):
    rays = binding(spark, sf_dir, "b_dirs")
    sources = binding(spark, sf_dir, "b_rays").where("omega > 0.02").withColumnRenamed("ray_id", "sv_id")
    return nearest.within_some(rays.select("ray_id", *nearest.DXYZ), sources, "ray_id", "sv_id", 0.05, some=False).select("ray_id")


@query(oracle(f"SELECT ray_id, view, round(CASE WHEN acos(greatest(least(c, 1), -1)) <= pi()/12 + sqrt(omega/pi()) THEN omega ELSE 0 END, 6) AS omega, round(CASE WHEN acos(greatest(least(c, 1), -1)) <= pi()/12 + sqrt(omega/pi()) THEN lum ELSE 0 END, 6) AS lum FROM (SELECT *, dx*vx + dy*vy + dz*vz AS c FROM b_rays, {q.VIEWS})", "b_rays"))
def fl11_source_in_view(spark, sf_dir):
    pairs = binding(spark, sf_dir, "b_rays").crossJoin(F.broadcast(views(spark)))
    seen = F.acos(d.clip(d.dot(d.xyz(), d.xyz("v")), -1.0, 1.0)) <= math.pi / 12 + glare.source_radius(F.col("omega"))
    return pairs.select("ray_id", "view", F.round(F.when(seen, F.col("omega")).otherwise(0.0), 6).alias("omega"), F.round(F.when(seen, F.col("lum")).otherwise(0.0), 6).alias("lum"))


_THIN = f"zoned AS (SELECT zone, pt_id, x, y FROM (SELECT zone, pt_id, x, y FROM b_points, (VALUES ('a'), ('l')) z(zone)) WHERE {INSIDE}), kept AS (SELECT * FROM zoned p WHERE NOT EXISTS (SELECT 1 FROM zoned o WHERE o.zone = p.zone AND o.pt_id < p.pt_id AND (o.x-p.x)*(o.x-p.x)+(o.y-p.y)*(o.y-p.y) <= 0.25))"


@query(oracle("SELECT zone, pt_id, round(x, 6) AS x, round(y, 6) AS y, -1.0 AS area FROM kept UNION ALL SELECT 'far', -1, 51.0, 50.5, 2.0", "b_points", ctes=_THIN))
def fl14_thin_points(spark, sf_dir):
    """Every zone's own points; a zone without any has its centre and area."""
    far = spark.createDataFrame([("far", 2, [(50.0, 50.0), (52.0, 50.0), (52.0, 51.0), (50.0, 51.0)], 1.2, 0.0)], "zone string, ring_id int, ring array<struct<x:double,y:double>>, z double, rotation double")
    zs = zone_table(spark).unionByName(far)
    points = binding(spark, sf_dir, "b_points").withColumns({c: F.col(c) - 1e-9 for c in ("x", "y")}).crossJoin(zone_table(spark).select("zone"))
    found = zones.fixed_points(points, zs, 0.5, 0.5)
    return rounded(found, "x", "y").select("zone", "pt_id", "x", "y", F.coalesce("area", F.lit(-1.0)).alias("area"))


@query(oracle("SELECT zone, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, (min(x) + max(x))/2 AS cx, (min(y) + max(y))/2 AS cy FROM (SELECT level AS zone, x, y FROM b_points) GROUP BY zone", "b_points"))
def ag13_zone_extent(spark, sf_dir):
    points = binding(spark, sf_dir, "b_points").withColumn("zone", F.col("level"))
    return zones.box_of(points).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).select("zone", "x0", "y0", "x1", "y1", "cx", "cy")


@query(oracle("SELECT zone, round(CASE WHEN sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) >= sqrt((sx-wx)*(sx-wx)+(sy-wy)*(sy-wy)) THEN degrees(atan2(ey-sy, ex-sx)) ELSE degrees(atan2(sy-wy, sx-wx)) END, 6) + 0.0 AS rotation FROM (SELECT level AS zone, arg_min(x, y*1000+x) AS sx, arg_min(y, y*1000+x) AS sy, arg_max(x, x*1000+y) AS ex, arg_max(y, x*1000+y) AS ey, arg_min(x, x*1000+y) AS wx, arg_min(y, x*1000+y) AS wy FROM b_points GROUP BY level)", "b_points"))
def ag14_long_axis(spark, sf_dir):
    return zones.long_axis_of(binding(spark, sf_dir, "b_points").withColumn("zone", F.col("level"))).select("zone", r("rotation").alias("rotation"))


_HULL = """p AS (SELECT DISTINCT level AS zone, x + a AS x, y + b AS y FROM b_points, (VALUES (-0.5), (0.5)) a(a), (VALUES (-0.5), (0.5)) b(b)),
edge AS (SELECT a.zone, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM p a JOIN p b ON a.zone = b.zone AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.zone = a.zone AND (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < -1e-9)),
ends AS (SELECT DISTINCT zone, ax AS x, ay AS y FROM edge)"""


@query(oracle("SELECT zone, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM ends e WHERE NOT EXISTS (SELECT 1 FROM edge g WHERE g.zone = e.zone AND abs((g.bx-g.ax)*(e.y-g.ay) - (g.by-g.ay)*(e.x-g.ax)) <= 1e-9 AND (e.x-g.ax)*(e.x-g.bx) + (e.y-g.ay)*(e.y-g.by) < -1e-9)", "b_points", ctes=_HULL))
def ag15_zone_border(spark, sf_dir):
    """Corners of the convex hull of each level's points, widened by a square; in SQL every pair is tested against all points."""
    points = binding(spark, sf_dir, "b_points").withColumnRenamed("level", "zone")
    return zones.border(points, 0.5).select("zone", F.explode("ring").alias("p")).select("zone", r("p.x").alias("x"), r("p.y").alias("y"))


@query(oracle("SELECT zone, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(x0 + (i + 0.5)*0.5, 6) AS x, round(y0 + (j + 0.5)*0.5, 6) AS y FROM (SELECT level AS zone, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM b_points GROUP BY level), range(100) a(i), range(100) b(j) WHERE i < ceil(round((x1-x0)/0.5, 9)) AND j < ceil(round((y1-y0)/0.5, 9)) AND x0 + (i + 0.5)*0.5 < x1 AND y0 + (j + 0.5)*0.5 < y1", "b_points"))
def gr03_plan_grid(spark, sf_dir):
    """Cells of level 1 over each level's own hull box, one zone per point level."""
    return rounded(zones.plan_grid(_boxes(spark, sf_dir), 1.0, 1), "x", "y").select("zone", "i", "j", "x", "y")


def _boxes(spark, sf_dir):
    box = zones.box_of(binding(spark, sf_dir, "b_points").withColumnRenamed("level", "zone"))
    corners = F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    return box.select("zone", corners.alias("ring"), "z")


_SNAPPED = "box AS (SELECT level AS zone, floor(round(min(x)/0.7, 9))*0.7 AS x0, floor(round(min(y)/0.7, 9))*0.7 AS y0, max(x) AS x1, max(y) AS y1 FROM b_points GROUP BY level)"


@query(oracle("SELECT zone, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(x0 + (i + 0.5)*0.7, 6) AS x, round(y0 + (j + 0.5)*0.7, 6) AS y FROM box, range(100) a(i), range(100) b(j) WHERE zone <> 0 AND i < ceil(round((x1-x0)/0.7, 9)) AND j < ceil(round((y1-y0)/0.7, 9)) UNION ALL SELECT level, CAST(floor((x - x0)/0.7) AS INT), CAST(floor((y - y0)/0.7) AS INT), round(x, 6), round(y, 6) FROM b_points JOIN box ON level = zone WHERE level = 0", "b_points", ctes=_SNAPPED))
def gr03_static_points(spark, sf_dir):
    """Snapped cells; the points of level 0 are static and take the place of their zone's cells."""
    static = binding(spark, sf_dir, "b_points").where("level = 0").withColumnRenamed("level", "zone").select("zone", "x", "y", "z")
    return rounded(zones.plan_grid(_boxes(spark, sf_dir), 0.7, 0, masked=False, snap=True, static=static), "x", "y").select("zone", "i", "j", "x", "y")
