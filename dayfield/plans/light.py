"""Queries of integration and metrics."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import binding, oracle
from ..functions import directions as d
from ..operators import evaluation, grid, integrate, metrics
from ..session import scratch_folder
from ..sources import tables
from . import sqltext as q
from .geometry import views
from .registry import query, r, rounded

PRODUCT = "SELECT t, pt_id, sensor_id, sum(coef*value) AS value FROM {sky} JOIN {contrib} USING (patch) GROUP BY t, pt_id, sensor_id"


def sky(spark, sf_dir):
    return binding(spark, sf_dir, "b_sky")


def sun(spark, sf_dir):
    return binding(spark, sf_dir, "b_sun")


def contrib(spark, sf_dir):
    return binding(spark, sf_dir, "b_contrib")


@query(oracle(f"SELECT t, pt_id, sensor_id, round(value, 6) AS value FROM ({PRODUCT.format(sky='b_sky', contrib='b_contrib')})", "b_sky", "b_contrib"))
def jn15_coef_product(spark, sf_dir):
    return integrate.coefficient_product(sky(spark, sf_dir), contrib(spark, sf_dir), ["pt_id", "sensor_id"]).select("t", "pt_id", "sensor_id", F.round("value", 6).alias("value"))


@query(oracle(f"SELECT t, pt_id, sensor_id, round(coalesce(value, 0), 6) AS value FROM (SELECT DISTINCT t FROM b_sky) CROSS JOIN (SELECT DISTINCT pt_id, sensor_id FROM b_contrib) LEFT JOIN ({PRODUCT.format(sky='b_sky', contrib='b_contrib')}) USING (t, pt_id, sensor_id)", "b_sky", "b_contrib"))
def jn15_dense_product(spark, sf_dir):
    coefs = integrate.as_arrays(sky(spark, sf_dir), ["t"], "coef", 16, "coefs")
    lums = integrate.as_arrays(contrib(spark, sf_dir), ["pt_id", "sensor_id"], "value", 16, "lums")
    return integrate.dense_product(coefs, lums, ["pt_id", "sensor_id"]).select("t", "pt_id", "sensor_id", F.round("value", 6).alias("value"))


SKYSUN = "skysun AS (SELECT t, patch, sum(coef) AS coef FROM (SELECT t, patch, coef FROM b_sky UNION ALL SELECT t, patch, patch_rad FROM b_sun) GROUP BY t, patch)"
DIRECT = "direct AS (SELECT pt_id, sensor_id, patch, value*0.8 AS value FROM b_contrib WHERE patch % 3 <> 0), difference AS (SELECT c.pt_id, c.sensor_id, c.patch, greatest(c.value - coalesce(d.value, 0), 0) AS value FROM b_contrib c LEFT JOIN direct d USING (pt_id, sensor_id, patch))"
REALSUN = "realsun AS (SELECT t, CAST((patch + 1) % 16 AS INT) AS patch, patch_rad AS coef FROM b_sun)"
SUNPATCH = "sunpatch AS (SELECT t, patch, sum(patch_rad) AS coef FROM b_sun GROUP BY t, patch), sunrad AS (SELECT t, patch, sun_rad AS coef FROM b_sun)"


@query(oracle("SELECT t, patch, round(coef, 6) AS coef FROM skysun", "b_sky", "b_sun", ctes=SKYSUN))
def jn14_sun_patch(spark, sf_dir):
    return rounded(integrate.with_sun_patch(sky(spark, sf_dir), sun(spark, sf_dir)), "coef").select("t", "patch", "coef")


@query(oracle("SELECT plane, t, patch, round(coef, 6) AS coef FROM (SELECT 'sky' AS plane, t, patch, coef FROM b_sky UNION ALL SELECT 'sun', t, patch, sun_rad FROM b_sun UNION ALL SELECT 'patch', t, patch, coef FROM sunpatch UNION ALL SELECT 'all', t, patch, coef FROM skysun)", "b_sky", "b_sun", ctes=f"{SKYSUN}, {SUNPATCH}"))
def jn13_coefficients(spark, sf_dir):
    """The coefficients of every kind of plane; "all" is the sky plane of a model without a sun plane."""
    k, s = sky(spark, sf_dir), sun(spark, sf_dir)
    parts = [integrate.coefficients(k, s, plane, has).withColumn("plane", F.lit(name)) for name, plane, has in (("sky", "sky", True), ("sun", "sun", True), ("patch", "patch", True), ("all", "sky", False))]
    return rounded(reduce(DataFrame.unionByName, parts), "coef").select("plane", "t", "patch", "coef")


def direct(spark, sf_dir):
    return contrib(spark, sf_dir).where("patch % 3 <> 0").withColumn("value", F.col("value") * 0.8)


@query(oracle("SELECT pt_id, sensor_id, patch, round(value, 10) AS value FROM difference", "b_contrib", ctes=DIRECT))
def jn21_direct_difference(spark, sf_dir):
    found = integrate.direct_difference(contrib(spark, sf_dir), direct(spark, sf_dir), ["pt_id", "sensor_id"])
    return rounded(found, "value", digits=10).select("pt_id", "sensor_id", "patch", "value")


def _planes(spark, sf_dir):
    suns = contrib(spark, sf_dir).withColumn("value", F.col("value") * 0.1)
    return {"sky": contrib(spark, sf_dir), "direct": direct(spark, sf_dir), "sun": suns, "views": suns.where("patch % 2 = 0"), "lamp": contrib(spark, sf_dir).where("patch = 3")}


def _sim_sql(*terms: tuple[str, str]) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM ({PRODUCT.format(sky=s, contrib=c)})" for s, c in terms)
    return oracle(f"SELECT t, pt_id, sensor_id, round(sum(value)*179, 4) AS illum FROM ({union}) GROUP BY t, pt_id, sensor_id", "b_sky", "b_sun", "b_contrib", ctes=f"{SKYSUN}, {DIRECT}, {SUNPATCH}, {REALSUN}, suncon AS (SELECT pt_id, sensor_id, patch, value*0.1 AS value FROM b_contrib), viewcon AS (SELECT * FROM suncon WHERE patch % 2 = 0)")


def _simulate(spark, sf_dir, name):
    real = sun(spark, sf_dir).withColumn("patch", ((F.col("patch") + 1) % 16).cast("int"))
    return rounded(integrate.simulate(name, sky(spark, sf_dir), sun(spark, sf_dir), _planes(spark, sf_dir), real_sun=real), "illum", digits=4).select("t", "pt_id", "sensor_id", "illum")


@query(oracle("SELECT t, pt_id, sensor_id, round(v*179, 4) AS illum FROM (SELECT DISTINCT t FROM b_sky), (SELECT pt_id, sensor_id, sum(value) AS v FROM b_contrib WHERE patch = 3 GROUP BY pt_id, sensor_id)", "b_sky", "b_contrib"))
def in01_fixed_source(spark, sf_dir):
    return _simulate(spark, sf_dir, "lamp")


@query(_sim_sql(("skysun", "b_contrib")))
def in02_one_component(spark, sf_dir):
    return _simulate(spark, sf_dir, "1comp")


@query(_sim_sql(("b_sky", "b_contrib")))
def in02_sky_only(spark, sf_dir):
    return _simulate(spark, sf_dir, "skyonly")


@query(_sim_sql(("sunpatch", "b_contrib")))
def in02_sun_patch(spark, sf_dir):
    return _simulate(spark, sf_dir, "sunpatch")


@query(_sim_sql(("b_sky", "b_contrib"), ("sunrad", "suncon")))
def in03_two_components(spark, sf_dir):
    return _simulate(spark, sf_dir, "2comp")


@query(_sim_sql(("b_sky", "b_contrib"), ("sunpatch", "difference"), ("sunrad", "suncon")))
def in04_three_components(spark, sf_dir):
    return _simulate(spark, sf_dir, "3comp")


@query(_sim_sql(("b_sky", "b_contrib"), ("realsun", "difference"), ("sunrad", "viewcon")))
def in05_direct_views(spark, sf_dir):
    return _simulate(spark, sf_dir, "1compdv")


@query(_sim_sql(("sunrad", "viewcon")))
def in06_direct_view_only(spark, sf_dir):
    return _simulate(spark, sf_dir, "directview")


@query(_sim_sql(("sunrad", "suncon")))
def in06_sun_only(spark, sf_dir):
    return _simulate(spark, sf_dir, "sunonly")


@query(_sim_sql(("sunpatch", "direct")))
def in06_direct_patch(spark, sf_dir):
    return _simulate(spark, sf_dir, "directpatch")


@query(oracle("SELECT t, pt_id, sensor_id, round(sum(v)*179, 4) AS illum FROM (SELECT t, pt_id, sensor_id, coef*value AS v FROM b_sky JOIN b_contrib USING (patch) UNION ALL SELECT t, pt_id, sensor_id, -coef*value FROM sunpatch JOIN direct USING (patch) UNION ALL SELECT t, pt_id, sensor_id, coef*value*0.1 FROM sunrad JOIN b_contrib USING (patch)) GROUP BY t, pt_id, sensor_id", "b_sky", "b_sun", "b_contrib", ctes=f"{DIRECT}, {SUNPATCH}"))
def in09_sensor_sum(spark, sf_dir):
    p = _planes(spark, sf_dir)
    found = integrate.sensor_sum([("sky", p["sky"], 1.0), ("patch", p["direct"], -1.0), ("sun", p["sun"], 1.0)], sky(spark, sf_dir), sun(spark, sf_dir))
    return rounded(found, "illum", digits=4).select("t", "pt_id", "sensor_id", "illum")


@query(oracle("SELECT t, sensor_id, round(sum(v*area)/sum(area), 6) AS value FROM (SELECT t, pt_id, sensor_id, sum(coef*value) AS v FROM b_sky JOIN b_contrib USING (patch) GROUP BY ALL) JOIN (SELECT pt_id, 1E0 + pt_id % 4 AS area, level FROM b_points) USING (pt_id) WHERE (t % 2 = 0 AND level = 0) OR (t % 2 = 1 AND level > 0) GROUP BY t, sensor_id", "b_sky", "b_contrib", "b_points"))
def in10_zonal_sensors(spark, sf_dir):
    """Each time has its own points and areas; sums are weighted by area."""
    points = binding(spark, sf_dir, "b_points").withColumn("area", 1.0 + F.col("pt_id") % 4)
    times = sky(spark, sf_dir).select("t").distinct().withColumn("sun_rad", (F.col("t") % 2).cast("double"))
    chosen = times.where("sun_rad > 0").select("t").crossJoin(points.where("level > 0")).withColumn("error_deg", F.lit(0.0))
    zonal = integrate.zonal_points(times, chosen, points.where("level = 0")).join(points.select("pt_id", "area"), "pt_id").select("t", "pt_id", "area")
    product = integrate.coefficient_product(sky(spark, sf_dir), contrib(spark, sf_dir), ["pt_id", "sensor_id"])
    return product.join(zonal, ["t", "pt_id"]).groupBy("t", "sensor_id").agg(F.round(F.sum(F.col("value") * F.col("area")) / F.sum("area"), 6).alias("value"))


VIEWED = f"viewed AS (SELECT r.*, view, vx, vy, vz, dx*vx + dy*vy + dz*vz AS cosine FROM (SELECT * FROM b_dirs) r, {q.VIEWS} WHERE dx*vx + dy*vy + dz*vz >= -1e-12), marked AS (SELECT *, lum*179 > 3000000 AS is_src, cosine >= cos(radians(15)) AS task FROM ({q.position('SELECT * FROM viewed')}))"
PARTS = "parts AS (SELECT pt_id, view, sum(lum*omega*cosine)*179 AS illum, sum(lum*omega)*179 AS flux, sum(lum*lum*omega)*179*179 AS flux2, sum(omega) AS area, count(*) AS n, sum(lum)*179 AS slum, coalesce(sum(CASE WHEN is_src THEN lum*omega*cosine END), 0)*179 AS srcillum, coalesce(sum(CASE WHEN is_src THEN omega END), 0) AS srcarea, max(lum)*179 AS maxlum, coalesce(sum(CASE WHEN is_src THEN lum*lum*omega*179*179/(pos*pos) END), 0) AS pwsl2, sum(CASE WHEN task THEN lum*omega END)*179 AS tflux, sum(CASE WHEN task THEN omega END) AS tarea, sum(CASE WHEN NOT is_src THEN lum*omega END)*179 AS bflux, sum(CASE WHEN NOT is_src THEN omega END) AS barea FROM marked GROUP BY pt_id, view)"
_DGP = "least((CASE WHEN illum < {low} THEN exp(0.024*illum - 4)/(1 + exp(0.024*illum - 4)) ELSE 1 END)*(5.87e-5*illum + 9.18e-2*log10(1 + pwsl2/pow(illum, 1.87)) + 0.16), 1)"


def viewed(spark, sf_dir):
    return metrics.in_view(binding(spark, sf_dir, "b_dirs"), views(spark))


def _metrics(spark, sf_dir, names, digits):
    found = metrics.evaluate(viewed(spark, sf_dir), ("pt_id", "view"), list(names), 3000000.0)
    return found.select("pt_id", "view", *(r(n, k).alias(n) for n, k in zip(names, digits, strict=True)))


@query(oracle("SELECT pt_id, view, round(illum, 2) + 0.0 AS illum, round(flux/area, 2) + 0.0 AS avglum, round(slum/n, 2) + 0.0 AS avgraylum, round((flux2/area)/pow(flux/area, 2), 6) + 0.0 AS gcr, round(area, 6) + 0.0 AS view_area, round(n/area, 4) + 0.0 AS density, round(maxlum, 2) + 0.0 AS maxlum FROM parts", "b_dirs", ctes=f"{VIEWED}, {PARTS}"))
def mt01_energy_metrics(spark, sf_dir):
    """MT-01..04 and 07: illum, avglum, avgraylum, gcr, view_area, density, and the maximum."""
    return _metrics(spark, sf_dir, ("illum", "avglum", "avgraylum", "gcr", "view_area", "density", "maxlum"), (2, 2, 2, 6, 6, 4, 2))


@query(oracle("SELECT pt_id, view, round(tflux/tarea, 2) + 0.0 AS tasklum, round((illum - srcillum)/pi(), 2) + 0.0 AS backlum, round(bflux/barea, 2) + 0.0 AS backlum_true, round(srcillum, 2) + 0.0 AS srcillum, round(srcarea, 6) + 0.0 AS srcarea FROM parts", "b_dirs", ctes=f"{VIEWED}, {PARTS}"))
def mt09_source_metrics(spark, sf_dir):
    """MT-08 and 09: the split at a threshold and what lies on both sides."""
    return _metrics(spark, sf_dir, ("tasklum", "backlum", "backlum_true", "srcillum", "srcarea"), (2, 2, 2, 2, 6))


@query(oracle("SELECT pt_id, view, round(log10(1 + pwsl2), 5) + 0.0 AS log_pwsl2 FROM parts", "b_dirs", ctes=f"{VIEWED}, {PARTS}"))
def mt10_pwsl2(spark, sf_dir):
    found = metrics.evaluate(viewed(spark, sf_dir), ("pt_id", "view"), ["pwsl2"], 3000000.0)
    return found.select("pt_id", "view", r(F.log10(1 + F.col("pwsl2")), 5).alias("log_pwsl2"))


@query(oracle(f"SELECT pt_id, view, round(5.87e-5*illum, 4) + 0.0 AS dgp_t1, round(log10(1 + pwsl2/pow(illum, 1.87)), 6) + 0.0 AS log_gc, round(9.18e-2*log10(1 + pwsl2/pow(illum, 1.87)), 6) + 0.0 AS dgp_t2, round({_DGP.format(low=500)}, 6) + 0.0 AS dgp FROM parts", "b_dirs", ctes=f"{VIEWED}, {PARTS}"))
def mt11_dgp(spark, sf_dir):
    return _metrics(spark, sf_dir, ("dgp_t1", "log_gc", "dgp_t2", "dgp"), (4, 6, 6, 6))


@query(oracle("SELECT pt_id, view, round(u, 4) + 0.0 AS ugr, round(pow(1 + 2.0/7*pow(10, -(u + 5)/40), -10), 6) + 0.0 AS ugp FROM (SELECT *, greatest(CASE WHEN pwsl2 > 0 AND illum - srcillum > 0 THEN 8*log10(0.25*pwsl2/((illum - srcillum)/pi())) ELSE 0 END, 0) AS u FROM parts)", "b_dirs", ctes=f"{VIEWED}, {PARTS}"))
def mt12_ugr_ugp(spark, sf_dir):
    return _metrics(spark, sf_dir, ("ugr", "ugp"), (4, 6))


@query(oracle(f"SELECT pt_id, view, round({_DGP.format(low=500)}, 6) + 0.0 AS dgp FROM (SELECT pt_id, view, sum(illum)/1000 AS illum, sum(pwsl2)/1000 AS pwsl2 FROM (SELECT pt_id, src, view, sum(lum*omega*cosine)*179 AS illum, coalesce(sum(CASE WHEN is_src THEN lum*lum*omega*179*179/(pos*pos) END), 0) AS pwsl2 FROM marked GROUP BY pt_id, src, view) GROUP BY pt_id, view)", "b_dirs", ctes=VIEWED))
def mt13_rebuilt_after_sum(spark, sf_dir):
    """Additive parts per source, summed over sources, then dgp anew."""
    parts = metrics.evaluate(viewed(spark, sf_dir), ("pt_id", "src", "view"), ["illum", "backlum", "pwsl2"], 3000000.0)
    summed = parts.groupBy("pt_id", "view").agg(*((F.sum(c) / 1000).alias(c) for c in ("illum", "backlum", "pwsl2")))
    return metrics.rebuilt(summed).select("pt_id", "view", r("dgp").alias("dgp"))


@query(oracle("SELECT pt_id, view, metric, round(value, 2) + 0.0 AS value FROM (SELECT pt_id, view, 'illum' AS metric, illum AS value FROM parts UNION ALL SELECT pt_id, view, 'avglum', flux/area FROM parts)", "b_dirs", ctes=f"{VIEWED}, {PARTS}"))
def mt20_metric_selection(spark, sf_dir):
    wide = metrics.evaluate(viewed(spark, sf_dir), ("pt_id", "view"), ["illum", "avglum"], 3000000.0)
    return rounded(metrics.unpivoted(wide, ("pt_id", "view")), "value", digits=2)


@query(oracle("SELECT pt_id, round(ln(s2*s0/(s1*s1))/8, 6) + 0.0 AS loggcr FROM (SELECT pt_id, sum(greatest(lum, 1E-4)*greatest(lum, 1E-4)*omega) AS s2, sum(greatest(lum, 1E-4)*omega) AS s1, sum(omega) AS s0 FROM b_dirs GROUP BY pt_id)", "b_dirs"))
def mt05_log_gcr(spark, sf_dir):
    return rounded(metrics.log_gcr(binding(spark, sf_dir, "b_dirs"), ("pt_id",)), "loggcr")


@query(oracle("SELECT pt_id, round(1 - acos(greatest(least(x/sqrt(x*x+y*y+z*z), 1), -1))/pi(), 6) + 0.0 AS xpeak, round(1 - acos(greatest(least(y/sqrt(x*x+y*y+z*z), 1), -1))/pi(), 6) + 0.0 AS ypeak FROM (SELECT pt_id, sum(dx*lum*omega) AS x, sum(dy*lum*omega) AS y, sum(dz*lum*omega) AS z FROM (SELECT *, max(lum) OVER (PARTITION BY pt_id) AS top FROM b_dirs) WHERE lum > 0.9*top GROUP BY pt_id)", "b_dirs"))
def mt06_peak_direction(spark, sf_dir):
    return rounded(metrics.peak_direction(binding(spark, sf_dir, "b_dirs"), ("pt_id",)), "xpeak", "ypeak")


@query(oracle("SELECT pt_id, round(x/m, 6) + 0.0 AS avg_x, round(y/m, 6) + 0.0 AS avg_y, round(z/m, 6) + 0.0 AS avg_z, round(m, 2) + 0.0 AS avg_mag, round(px*pl, 4) + 0.0 AS peak_x FROM (SELECT *, sqrt(x*x+y*y+z*z) AS m FROM (SELECT pt_id, sum(dx*lum*omega)*179/sum(omega) AS x, sum(dy*lum*omega)*179/sum(omega) AS y, sum(dz*lum*omega)*179/sum(omega) AS z FROM b_dirs GROUP BY pt_id)) JOIN (SELECT pt_id, dx AS px, lum AS pl FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY lum DESC, ray_id) AS k FROM b_dirs) WHERE k = 1) USING (pt_id)", "b_dirs"))
def mt14_field_vectors(spark, sf_dir):
    found = metrics.field(binding(spark, sf_dir, "b_dirs"), ("pt_id",))
    return rounded(rounded(rounded(found, "avg_x", "avg_y", "avg_z"), "avg_mag", digits=2), "peak_x", digits=4).select("pt_id", "avg_x", "avg_y", "avg_z", "avg_mag", "peak_x")


@query(oracle("SELECT pt_id, ray_id, lum FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY lum DESC, ray_id) AS k FROM b_dirs) WHERE k = 1", "b_dirs"))
def tk05_brightest_ray(spark, sf_dir):
    return binding(spark, sf_dir, "b_dirs").groupBy("pt_id").agg(F.max_by("ray_id", F.struct("lum", -F.col("ray_id"))).alias("ray_id"), F.max("lum").alias("lum"))


_EQ = "eq AS (SELECT CAST(k AS INT) AS k, k*2*pi()/8 AS phi, cos(k*2*pi()/8) AS ex, sin(k*2*pi()/8) AS ey FROM range(8) r(k))"
_GAP = "abs(atan2(sin(atan2(dy, dx) - phi), cos(atan2(dy, dx) - phi)))"


@query(oracle(f"SELECT pt_id, k, round(eq_lum, 4) + 0.0 AS eq_lum, round(e*179, 2) + 0.0 AS eq_illum, round(e2*a/(e*e), 6) + 0.0 AS eq_gcr, round(log10(1 + e2*179*179/pow(e*179, 1.87)), 6) + 0.0 AS eq_loggc, round({_DGP.format(low=1000).replace('illum', '(e*179)').replace('pwsl2', '(e2*179*179)')}, 6) + 0.0 AS eq_dgp FROM (SELECT pt_id, k, sum(w*lum)/sum(w) AS eq_lum, sum(lum*omega*c) AS e, sum(lum*lum*omega*c) AS e2, sum(omega*c) AS a FROM (SELECT *, greatest(dx*ex + dy*ey, 0) AS c, exp(-{_GAP}*{_GAP}/(2*radians(10)*radians(10)))*sqrt(greatest(1 - dz*dz, 0))*omega AS w FROM b_dirs, eq) GROUP BY pt_id, k)", "b_dirs", ctes=_EQ))
def mt18_equator_metrics(spark, sf_dir):
    """MT-15, 16 and 18: equator angles, gaussian luminance, illuminance, contrast and glare per direction."""
    found = metrics.around(binding(spark, sf_dir, "b_dirs"), metrics.equator(spark, 8), ("pt_id",))
    return rounded(rounded(rounded(found, "eq_gcr", "eq_loggc", "eq_dgp"), "eq_illum", digits=2), "eq_lum", digits=4)


@query(oracle("SELECT pt_id, k, round(avg(exp(-0.5*((phi - a)/h)*((phi - a)/h))/(h*sqrt(2*pi())))*3, 6) + 0.0 AS eq_density FROM (SELECT pt_id, a, stddev_samp(a) OVER (PARTITION BY pt_id)*0.3/3 AS h FROM (SELECT pt_id, atan2(dy, dx) + s*2*pi() AS a FROM b_rays, (VALUES (-1), (0), (1)) v(s))), eq GROUP BY pt_id, k", "b_rays", ctes=_EQ))
def mt17_azimuth_density(spark, sf_dir):
    return rounded(metrics.azimuth_density(binding(spark, sf_dir, "b_rays"), metrics.equator(spark, 8), ("pt_id",)), "eq_density")


_OCC = "big AS (SELECT pt_id, dx AS sx, dy AS sy, dz AS sz, omega AS so FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY ray_id) AS k FROM b_rays WHERE omega > 0.00027 AND src = 0) WHERE k = 1), run AS (SELECT r.*, so, sum(omega) OVER w AS run, row_number() OVER w AS rn FROM (SELECT r.*, so, r.dx*sx + r.dy*sy + r.dz*sz AS c FROM b_rays r LEFT JOIN big USING (pt_id) WHERE src <> 0) r WINDOW w AS (PARTITION BY pt_id ORDER BY c DESC, ray_id)), counted AS (SELECT *, sum(CASE WHEN run <= so THEN 1 ELSE 0 END) OVER (PARTITION BY pt_id) AS n FROM run)"


@query(oracle("SELECT pt_id, ray_id FROM counted WHERE so IS NULL OR rn > greatest(n - 1, 0) UNION ALL SELECT pt_id, ray_id FROM b_rays WHERE src = 0", "b_rays", ctes=_OCC))
def wn01_occlusion(spark, sf_dir):
    rays = binding(spark, sf_dir, "b_rays")
    return metrics.occluded(rays.where("src <> 0"), rays.where("src = 0")).select("pt_id", "ray_id")


_SEEN = VIEWED.split(", marked")[0]
_EVAL = "sums AS (SELECT t, pt_id, view, src, sum(coef*lum*omega*cosine) AS e, sum(coef*lum*omega) AS f, sum(coef*coef*lum*lum*omega) AS g FROM viewed v JOIN b_sky s ON s.patch = v.ray_id % 16 GROUP BY ALL), areas AS (SELECT pt_id, view, sum(omega) AS a FROM viewed GROUP BY ALL), lit AS (SELECT t, pt_id, view, sum(e)*179 AS illum, sum(f)*179/any_value(a) AS avglum, sum(g)*any_value(a)/(sum(f)*sum(f)) AS gcr FROM sums JOIN areas USING (pt_id, view) GROUP BY ALL)"
_ZONED = "zoned AS (SELECT t, pt_id, x, y, z, area FROM (SELECT DISTINCT t FROM b_sky), (SELECT pt_id, x, y, z, 1E0 + pt_id % 4 AS area, level FROM b_points) WHERE level = (t // 12) % 3)"


def _seen(spark, sf_dir):
    return viewed(spark, sf_dir).withColumn("patch", (F.col("ray_id") % 16).cast("int"))


@query(oracle("SELECT t AS sky, pt_id AS point, view, metric, CASE WHEN metric = 'gcr' THEN round(value, 6) ELSE round(value, 0) END + 0.0 AS value FROM (SELECT t, pt_id, view, unnest(['illum', 'avglum', 'gcr']) AS metric, unnest([illum, avglum, gcr]) AS value FROM lit)", "b_sky", "b_dirs", ctes=f"{_SEEN}, {_EVAL}"))
def in07_evaluate(spark, sf_dir):
    """All skies x points x views, as long rows."""
    found = evaluation.evaluate(sky(spark, sf_dir), _seen(spark, sf_dir), ["illum", "avglum", "gcr"])
    return found.withColumn("value", F.when(F.col("metric") == "gcr", r("value")).otherwise(r("value", 0)))


@query(oracle("SELECT t AS sky, pt_id AS point, view, metric, round(value, 0) + 0.0 AS value FROM (SELECT t, pt_id, view, 'illum' AS metric, sum(e)*179 AS value FROM sums WHERE src = 0 GROUP BY ALL UNION ALL SELECT t, q.pt_id, view, unnest(['sky_err', 'sky_pt']), unnest([0E0, CAST(q.pt_id AS DOUBLE)]) FROM (SELECT DISTINCT t FROM b_sky), (SELECT DISTINCT pt_id, view FROM viewed) q JOIN b_points USING (pt_id))", "b_sky", "b_dirs", "b_points", ctes=f"{_SEEN}, {_EVAL}"))
def in07_sources_only(spark, sf_dir):
    """Only rays of the first source, with the plane point and its distance as further metrics."""
    seen = _seen(spark, sf_dir).withColumn("is_src", F.col("src") == 0)
    points = binding(spark, sf_dir, "b_points")
    grid_of = integrate.time_by_point(sky(spark, sf_dir).select("t").distinct(), points.withColumnRenamed("pt_id", "q_id"), {"sky": points}, own=True)
    return rounded(evaluation.evaluate(sky(spark, sf_dir), seen, ["illum"], grid=grid_of, planes=("sky",), src_only=True), "value", digits=0)


@query(oracle("SELECT t AS sky, pt_id AS point, view, metric, round(value, 0) + 0.0 AS value FROM (SELECT t, pt_id, view, unnest(['x', 'y', 'z', 'area', 'illum']) AS metric, unnest([x, y, z, area, illum]) AS value FROM lit JOIN zoned USING (t, pt_id))", "b_sky", "b_dirs", "b_points", ctes=f"{_SEEN}, {_EVAL}, {_ZONED}"))
def in08_zonal_evaluate(spark, sf_dir):
    """Points and areas per sky; x, y, z and area lead the metrics."""
    points = binding(spark, sf_dir, "b_points").withColumn("area", 1.0 + F.col("pt_id") % 4)
    zonal = sky(spark, sf_dir).select("t", (F.floor(F.col("t") / 12) % 3).cast("int").alias("level")).distinct().join(points, "level")
    return rounded(evaluation.evaluate(sky(spark, sf_dir), _seen(spark, sf_dir), ["illum"], zonal=zonal), "value", digits=0)


_LIT = "lamps AS (SELECT v.*, d.t, lum*coalesce(coef, 0)*1E-4 AS lux, coef, cosine >= cos(radians(15)) AS task FROM ({seen}) v CROSS JOIN (SELECT DISTINCT t FROM b_sky) d LEFT JOIN b_sky s ON s.t = d.t AND s.patch = v.ray_id % 16), means AS (SELECT t, pt_id, view, {factor}*sum(CASE WHEN task THEN lux*omega END)*179/sum(CASE WHEN task THEN omega END) AS edge FROM lamps GROUP BY ALL), glared AS (SELECT t, pt_id, view, sum(lux*omega*cosine)*179 AS illum, coalesce(sum(CASE WHEN lux*179 > edge THEN lux*omega*cosine END), 0)*179 AS srcillum, coalesce(sum(CASE WHEN lux*179 > edge THEN lux*lux*omega*179*179/(pos*pos) END), 0) AS pwsl2 FROM lamps JOIN means USING (t, pt_id, view) GROUP BY ALL HAVING count(coef) > 0), rated AS (SELECT *, greatest(CASE WHEN pwsl2 > 0 AND illum - srcillum > 0 THEN 8*log10(0.25*pwsl2/((illum - srcillum)/pi())) ELSE 0 END, 0) AS ugr, {dgp} AS dgp FROM glared)"
_RATED = "SELECT t AS sky, pt_id AS point, view, metric, round(value, 5) + 0.0 AS value FROM (SELECT t, pt_id, view, unnest(['dgp', 'ugp', 'ugr', 'log_gc']) AS metric, unnest([dgp, pow(1 + 2.0/7*pow(10, -(ugr + 5)/40), -10), ugr, log10(1 + pwsl2/pow(illum, 1.87))]) AS value FROM rated)"
GLARE = ["dgp", "ugp", "ugr", "log_gc"]


def _glared(seen: str, factor: float) -> str:
    return _LIT.format(seen=q.position(seen), factor=factor, dgp=_DGP.format(low=500))


def _dim(spark, sf_dir):
    """Skies dark enough that glare is not certain."""
    return sky(spark, sf_dir).withColumn("coef", F.col("coef") * 1e-4)


@query(oracle(_RATED, "b_sky", "b_dirs", ctes=f"{_SEEN}, {_glared('SELECT * FROM viewed', 3.0)}"))
def in07_glare(spark, sf_dir):
    """Glare of all skies x points x views: a ray glares where it has three times the task zone's mean of that sky."""
    found = evaluation.evaluate(_dim(spark, sf_dir), _seen(spark, sf_dir), GLARE, threshold=3.0)
    return rounded(found, "value", digits=5)


@query(oracle(_RATED.replace("FROM rated", "FROM rated JOIN zoned USING (t, pt_id)").replace("unnest(['dgp', 'ugp', 'ugr', 'log_gc'])", "unnest(['x', 'y', 'z', 'area', 'dgp', 'ugp'])").replace("unnest([dgp, pow(1 + 2.0/7*pow(10, -(ugr + 5)/40), -10), ugr, log10(1 + pwsl2/pow(illum, 1.87))])", "unnest([x, y, z, area, dgp, pow(1 + 2.0/7*pow(10, -(ugr + 5)/40), -10)])"), "b_sky", "b_dirs", "b_points", ctes=f"{_SEEN}, {_glared('SELECT * FROM viewed', 3.0)}, zoned AS (SELECT t, pt_id, x, y, z, 1E0 + pt_id % 4 AS area FROM (SELECT DISTINCT t FROM b_sky), b_points WHERE level = CASE WHEN t % 3 = 0 THEN 0 ELSE 1 + t % 2 END)"))
def in08_zonal_glare(spark, sf_dir):
    """The points follow from each time's sun by itself: those chosen for it, or the fixed ones where none is up."""
    points = binding(spark, sf_dir, "b_points").withColumn("area", 1.0 + F.col("pt_id") % 4)
    times = sky(spark, sf_dir).select("t").distinct().withColumn("sun_rad", (F.col("t") % 3).cast("double"))
    chosen = times.join(points, points["level"] == 1 + times["t"] % 2).select("t", "pt_id", "x", "y", "z", F.lit(0.0).alias("error_deg"))
    rays = binding(spark, sf_dir, "b_dirs").withColumn("patch", (F.col("ray_id") % 16).cast("int"))
    found = evaluation.evaluate_model(_dim(spark, sf_dir), rays, views(spark), ["dgp", "ugp"], sun=times, chosen=chosen, fixed=points.where("level = 0"), areas=points, threshold=3.0)
    return rounded(found, "value", digits=5)


@query(oracle(_RATED, "b_sky", "b_rays", ctes=f"{_OCC}, held AS (SELECT pt_id, ray_id, src, dx, dy, dz, lum, omega FROM counted WHERE so IS NULL OR rn > greatest(n - 1, 0) UNION ALL SELECT pt_id, ray_id, src, dx, dy, dz, lum, omega FROM b_rays WHERE src = 0), {_SEEN.replace('b_dirs', 'held')}, {_glared('SELECT * FROM viewed', 1.5)}"))
def in07_occluded_glare(spark, sf_dir):
    """Rays behind a large source are left out before glare is found."""
    rays = binding(spark, sf_dir, "b_rays").withColumn("patch", (F.col("ray_id") % 16).cast("int"))
    points = rays.select("pt_id").distinct()
    found = evaluation.evaluate_model(_dim(spark, sf_dir), rays.where("src <> 0"), views(spark), GLARE, points=points, sources=rays.where("src = 0"), threshold=1.5)
    return rounded(found, "value", digits=5)


@query(oracle("SELECT t AS sky, pt_id AS point, view, 'illum' AS metric, round(illum, 0) + 0.0 AS value FROM lit", "b_sky", "b_dirs", ctes=f"{_SEEN}, {_EVAL}"))
def in11_point_all_suns(spark, sf_dir):
    """All sources of every point apart, then their sum per view."""
    found = evaluation.evaluate(sky(spark, sf_dir), _seen(spark, sf_dir), ["illum"], keys=("src",), summed=True)
    return rounded(found, "value", digits=0).select("sky", "point", "view", "metric", "value")


@query(oracle("SELECT t AS sky, pt_id AS point, view, src, round(e*179, 0) + 0.0 AS value FROM sums", "b_sky", "b_dirs", ctes=f"{_SEEN}, {_EVAL}"))
def in11_sources_apart(spark, sf_dir):
    """The combined form: a row per source."""
    apart = evaluation.evaluate(sky(spark, sf_dir), _seen(spark, sf_dir), ["illum"], keys=("src",))
    return rounded(apart, "value", digits=0).select("sky", "point", "view", "src", "value")


@query(oracle(f"SELECT pt_id, count(*) AS n, round(sum(omega), 6) AS omega, round(sum(energy), 3) AS energy FROM (SELECT pt_id, cell, step, sum(omega) AS omega, sum(omega*lum) AS energy FROM (SELECT *, patch AS cell, floor(ln(greatest(lum, 1E-9))/ln(1.2)) AS step FROM ({q.patch('SELECT * FROM b_dirs', 8)})) GROUP BY pt_id, cell, step) GROUP BY pt_id", "b_dirs"))
def ag07_compress(spark, sf_dir):
    """Rays after compression: their number, and the solid angle and energy that stay."""
    small = grid.compressed(binding(spark, sf_dir, "b_dirs"), ["pt_id"], d.sky_patch(d.xyz(), 8))
    return small.groupBy("pt_id").agg(F.count("*").alias("n"), F.round(F.sum("omega"), 6).alias("omega"), F.round(F.sum(F.col("omega") * F.col("lum")), 3).alias("energy"))


@query(oracle("SELECT pt_id, src, round(x/sqrt(x*x+y*y+z*z), 6) + 0.0 AS dx, round(lum, 4) + 0.0 AS lum, round(share, 6) + 0.0 AS share, round(al*share, 6) + 0.0 AS omega, round(sqrt(al*share/pi()), 6) + 0.0 AS radius FROM (SELECT pt_id, src, avg(CASE WHEN lum > 30000 THEN dx END) AS x, avg(CASE WHEN lum > 30000 THEN dy END) AS y, avg(CASE WHEN lum > 30000 THEN dz END) AS z, avg(CASE WHEN lum > 30000 THEN lum END) AS lum, avg(CASE WHEN lum > 30000 THEN 1.0E0 ELSE 0E0 END) AS share, sum(omega) AS al, max(lum) AS top FROM b_dirs GROUP BY pt_id, src) WHERE top > 40000", "b_dirs"))
def ag08_source_views(spark, sf_dir):
    found = grid.source_views(binding(spark, sf_dir, "b_dirs"), ["pt_id", "src"], 30000.0, 40000.0)
    return rounded(rounded(found, "dx", "share", "omega", "radius"), "lum", digits=4).select("pt_id", "src", "dx", "lum", "share", "omega", "radius")


@query(oracle("SELECT pt_id, src, round(radius, 6) AS radius, round(om*hit, 6) AS omega FROM (SELECT pt_id, src, sqrt(sum(omega)/pi()) AS radius, sum(omega) AS om, avg(CASE WHEN lum > 30000 THEN 1E0 ELSE 0E0 END) AS hit FROM b_dirs GROUP BY pt_id, src)", "b_dirs"))
def sc22_source_size(spark, sf_dir):
    hit = F.avg((F.col("lum") > 30000).cast("double"))
    return binding(spark, sf_dir, "b_dirs").groupBy("pt_id", "src").agg(F.round(F.sqrt(F.sum("omega") / math.pi), 6).alias("radius"), F.round(F.sum("omega") * hit, 6).alias("omega"))


@query(oracle("SELECT CAST(pt_id % 3 AS INT) AS level, pt_id, sensor_id, count(*) AS n, round(sum(value), 6) AS value FROM b_contrib GROUP BY ALL", "b_contrib"))
def io09_sensor_scan(spark, sf_dir):
    """A sensor plane from text: level, point, sensor, patch and value; the level is the leading column."""
    path = scratch_folder(spark, "sensors")
    rows = contrib(spark, sf_dir).select((F.col("pt_id") % 3).alias("level"), "pt_id", "sensor_id", "patch", "value")
    rows.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns)).alias("value")).write.text(path)
    found = tables.read_sensors(spark, path)
    return found.groupBy("level", "pt_id", "sensor_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query(oracle("SELECT pt_id, month, round(sum(v)*179, 4) AS illum FROM (SELECT pt_id, CAST((t - 1) % 12 + 1 AS INT) AS month, coef*value AS v FROM b_sky JOIN b_contrib USING (patch)) GROUP BY pt_id, month", "b_sky", "b_contrib"))
def flagship_illuminance(spark, sf_dir):
    """Illuminance per point and month of the year."""
    rows = sky(spark, sf_dir).withColumn("month", ((F.col("t") - 1) % 12 + 1).cast("int")).groupBy("month", "patch").agg(F.sum("coef").alias("coef")).withColumnRenamed("month", "t")
    per_point = contrib(spark, sf_dir).groupBy("pt_id", "patch").agg(F.sum("value").alias("value"))
    found = integrate.coefficient_product(rows, per_point, ["pt_id"])
    return found.select("pt_id", F.col("t").alias("month"), F.round(F.col("value") * 179, 4).alias("illum"))


def _one_metric(name: str, sql: str, digits: int):
    """A query of one metric over the shared plan."""
    oracle_sql = oracle(f"SELECT pt_id, view, round({sql}, {digits}) + 0.0 AS {name} FROM parts", "b_dirs", ctes=f"{VIEWED}, {PARTS}")

    def run(spark, sf_dir):
        return _metrics(spark, sf_dir, (name,), (digits,))

    return oracle_sql, run


for _id, _name, _sql, _digits in (
    ("mt02", "avglum", "flux/area", 2),
    ("mt03", "avgraylum", "slum/n", 2),
    ("mt04", "gcr", "(flux2/area)/pow(flux/area, 2)", 6),
    ("mt07", "density", "n/area", 4),
    ("mt08", "srcarea", "srcarea", 6),
):
    _oracle, _run = _one_metric(_name, _sql, _digits)
    _run.__name__ = f"{_id}_{_name}"
    query(_oracle)(_run)


@query(oracle("SELECT pt_id, CAST(k AS INT) AS k, round(k*2*pi()/n, 6) AS phi, round(cos(k*2*pi()/n), 6) + 0.0 AS ex, round(sin(k*2*pi()/n), 6) + 0.0 AS ey FROM (SELECT pt_id, 3 + pt_id % 5 AS n FROM (SELECT DISTINCT pt_id FROM b_rays)), range(9) r(k) WHERE k <= n", "b_rays"))
def mt15_equator_angles(spark, sf_dir):
    """Closed equator angles, as many as each point asks for: the last is the first again."""
    points = binding(spark, sf_dir, "b_rays").select("pt_id", (3 + F.col("pt_id") % 5).alias("n")).distinct()
    return rounded(metrics.equator_of(points, "n", closed=True), "phi", "ex", "ey").select("pt_id", "k", "phi", "ex", "ey")


@query(oracle(f"SELECT pt_id, k, round(sum(w*lum)/sum(w), 4) + 0.0 AS eq_lum FROM (SELECT *, exp(-{_GAP}*{_GAP}/(2*radians(20)*radians(20)))*sqrt(greatest(1 - dz*dz, 0))*omega AS w FROM b_dirs, eq) GROUP BY pt_id, k", "b_dirs", ctes=_EQ))
def mt16_equator_luminance(spark, sf_dir):
    found = metrics.around(binding(spark, sf_dir, "b_dirs"), metrics.equator(spark, 8), ("pt_id",), 20.0)
    return rounded(found, "eq_lum", digits=4).select("pt_id", "k", "eq_lum")
