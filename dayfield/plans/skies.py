"""Queries of the chain from weather to sky."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..bindings import binding, oracle
from ..functions import sky
from ..operators import interpolate, suns
from ..session import scratch_folder
from ..sources import tables, weather
from . import sqltext as q
from .registry import query, r, rounded

LAT, LON, MERIDIAN = 46.25, -6.13, -15.0


def hours(spark, sf_dir):
    """Weather rows with a station; every station lies at one place."""
    rows = binding(spark, sf_dir, "b_weather")
    return rows.withColumns({"lat": F.lit(LAT), "lon": F.lit(LON), "meridian": F.lit(MERIDIAN)})


def sunny(spark, sf_dir):
    return sky.sun_position(sky.to_utc(sky.timestamps(hours(spark, sf_dir))))


_TS = "ts AS (SELECT *, TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(date_diff('day', DATE '2020-01-01', make_date(2020, month, day)) AS INT)) + to_minutes(CAST(round(hour*60) AS BIGINT)) AS ts FROM b_weather)"
_SUN = f"""{_TS}, s0 AS (SELECT *, epoch(ts + to_minutes(-60)) AS sec FROM ts), s1 AS (SELECT *, (sec/86400.0 + 2440587.5 - 2451545.0)/36525.0 AS tt FROM s0),
s2 AS (SELECT *, radians(280.46646 + tt*(36000.76983 + 0.0003032*tt)) AS l, radians(357.52911 + tt*(35999.05029 - 0.0001537*tt)) AS m, 0.016708634 - tt*(0.000042037 + 0.0000001267*tt) AS e, radians(125.04 - 1934.136*tt) AS o FROM s1),
s3 AS (SELECT *, l + radians(sin(m)*(1.914602 - tt*(0.004817 + 0.000014*tt)) + sin(2*m)*(0.019993 - 0.000101*tt) + sin(3*m)*0.000289 - 0.00569 - 0.00478*sin(o)) AS lam, radians(23 + (26 + (21.448 - tt*(46.815 + tt*(0.00059 - 0.001813*tt)))/60)/60 + 0.00256*cos(o)) AS eps FROM s2),
s4 AS (SELECT *, asin(sin(eps)*sin(lam)) AS dec, tan(eps/2)*tan(eps/2) AS y FROM s3),
s5 AS (SELECT *, radians(((sec % 86400)/60.0 + 4*degrees(y*sin(2*l) - 2*e*sin(m) + 4*e*y*sin(m)*cos(2*l) - 0.5*y*y*sin(4*l) - 1.25*e*e*sin(2*m)) - 4*{LON})/4 - 180) AS ha FROM s4),
s6 AS (SELECT *, degrees(asin(sin(radians({LAT}))*sin(dec) + cos(radians({LAT}))*cos(dec)*cos(ha))) AS alt0 FROM s5),
sunny AS (SELECT *, alt0 + (CASE WHEN alt0 > 85 THEN 0 WHEN alt0 > 5 THEN 58.1/tan(radians(alt0)) - 0.07/pow(tan(radians(alt0)), 3) + 0.000086/pow(tan(radians(alt0)), 5) WHEN alt0 > -0.575 THEN 1735 + alt0*(-518.2 + alt0*(103.4 + alt0*(-12.79 + alt0*0.711))) ELSE -20.774/tan(radians(alt0)) END)/3600 AS sun_alt,
  degrees(atan2(sin(ha), cos(ha)*sin(radians({LAT})) - tan(dec)*cos(radians({LAT})))) AS sun_az FROM s6),
sxyz AS (SELECT *, -sin(radians(sun_az))*cos(radians(sun_alt)) AS sx, -cos(radians(sun_az))*cos(radians(sun_alt)) AS sy, sin(radians(sun_alt)) AS sz FROM sunny)"""


@query(oracle("SELECT station, month, day, hour, CAST(ts AS VARCHAR) AS ts FROM ts", "b_weather", ctes=_TS))
def sc11_timestamps(spark, sf_dir):
    return sky.timestamps(binding(spark, sf_dir, "b_weather")).select("station", "month", "day", "hour", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(oracle("SELECT station, month, day, hour, CAST(ts + to_minutes(-60) AS VARCHAR) AS utc FROM ts", "b_weather", ctes=_TS))
def sc12_utc(spark, sf_dir):
    return sky.to_utc(sky.timestamps(hours(spark, sf_dir))).select("station", "month", "day", "hour", F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(oracle("SELECT station, month, day, hour, round(sun_alt, 5) + 0.0 AS sun_alt, round(sun_az, 5) + 0.0 AS sun_az, round(sx, 6) + 0.0 AS sx, round(sy, 6) + 0.0 AS sy, round(sz, 6) + 0.0 AS sz FROM sxyz", "b_weather", ctes=_SUN))
def sc13_sun_position(spark, sf_dir):
    return rounded(rounded(sunny(spark, sf_dir), "sun_alt", "sun_az", digits=5), "sx", "sy", "sz").select("station", "month", "day", "hour", "sun_alt", "sun_az", "sx", "sy", "sz")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)


_DAYS = "[" + ", ".join(map(str, sky.MONTH_DAYS)) + "]"
_CAT = "cat AS (SELECT * FROM (VALUES " + _values([(i, *map(float, sky.COEFFICIENTS[i]), *map(float, sky.DIFFUSE_EFFICACY[i]), *map(float, sky.DIRECT_EFFICACY[i])) for i in range(8)]) + ") c(category, " + ", ".join([f"{k}{j}" for k in "abcde" for j in range(4)] + [f"f{j}" for j in range(4)] + [f"g{j}" for j in range(4)]) + "))"
_STATE = f"""{_SUN}, up AS (SELECT *, pi()/2 - asin(sz) AS sunz, 2*pi()*({_DAYS}[month] + day - 1)/365 AS da FROM sxyz WHERE sz > 0.0348994967025),
st AS (SELECT *, greatest(least(dif_horiz*(1/(cos(sunz) + 0.15*exp(-ln(93.885 - degrees(sunz))*1.253)))/(1367.0*(1.00011 + 0.034221*cos(da) + 0.00128*sin(da) + 0.000719*cos(2*da) + 0.000077*sin(2*da))), 0.6), 0.01) AS bright0,
  greatest(least(((dif_horiz + dir_norm)/dif_horiz + 1.041*pow(sunz, 3))/(1 + 1.041*pow(sunz, 3)), 12.099), 1.0) AS clearness FROM up WHERE dif_horiz > 0),
state AS (SELECT *, CASE WHEN clearness >= 6.2 THEN 7 WHEN clearness >= 4.5 THEN 6 WHEN clearness >= 2.8 THEN 5 WHEN clearness >= 1.95 THEN 4 WHEN clearness >= 1.5 THEN 3 WHEN clearness >= 1.23 THEN 2 WHEN clearness >= 1.065 THEN 1 ELSE 0 END AS category,
  CASE WHEN clearness > 1.065 AND clearness < 2.8 THEN greatest(bright0, 0.2) ELSE bright0 END AS b FROM st), {_CAT},
lit AS (SELECT s.*, dir_norm*greatest(g0 + g1*exp(0.07*{sky.DEW_POINT} - 0.075) + g2*exp(5.73*sunz - 5) + g3*bright0, 0) AS dir_lum, dif_horiz*(f0 + f1*exp(0.07*{sky.DEW_POINT} - 0.075) + f2*cos(sunz) + f3*ln(bright0)) AS dif_lum,
  a0 + a1*sunz + b*(a2 + a3*sunz) AS ca, b0 + b1*sunz + b*(b2 + b3*sunz) AS cb,
  CASE WHEN s.category = 0 THEN exp(pow(b*(c0 + c1*sunz), c2)) - c3 ELSE c0 + c1*sunz + b*(c2 + c3*sunz) END AS cc,
  CASE WHEN s.category = 0 THEN -exp(b*(d0 + d1*sunz)) + d2 + b*d3 ELSE d0 + d1*sunz + b*(d2 + d3*sunz) END AS cd,
  e0 + e1*sunz + b*(e2 + e3*sunz) AS ce FROM state s JOIN cat USING (category))"""
_TREG = "treg AS (SELECT radians(t) AS th, radians(360.0*i/n) AS ph FROM (VALUES (84.0, 30), (72.0, 30), (60.0, 24), (48.0, 24), (36.0, 18), (24.0, 12), (12.0, 6), (0.0, 1)) v(t, n), range(30) r(i) WHERE i < n)"
_PEREZ = f"""{_STATE}, {_TREG},
norms AS (SELECT station, month, day, hour, sum((1 + ca*exp(cb/greatest(cos(th), 0.01)))*(1 + cc*exp(cd*acos(greatest(least(cg, 1), -1))) + ce*cg*cg)*cos(th))*2*pi()/145 AS norm FROM (SELECT *, cos(sunz)*cos(th) + sin(sunz)*sin(th)*cos(ph) AS cg FROM lit, treg) GROUP BY station, month, day, hour),
perez AS (SELECT *, 0.2*((1 + ca*exp(cb))*(1 + cc*exp(cd*acos(cos(sunz))) + ce*cos(sunz)*cos(sunz))*diff_norm*factor + CASE WHEN clearness > 1 THEN 6.8e-5/pi()*solar_rad*sz ELSE 0 END) AS ground_br FROM (
 SELECT *, CASE WHEN clearness = 1 THEN 0.777778 WHEN clearness <= 6 THEN (3.5556 - 2.7152*x - 1.3081*x*x + 1.0660*x*x*x + 0.60227*x*x*x*x)/((2.739 + 0.9891*sin(0.3119 + 2.6*(pi()/2 - sunz)))*exp(-sunz*(0.4441 + 1.48*(pi()/2 - sunz))))/pi() ELSE (2.766521 + 0.547665*x - 0.369832*x*x + 0.009237*x*x*x + 0.059229*x*x*x*x)/(0.274*(0.91 + 10*exp(-3*sunz) + 0.45*sz*sz))/pi() END AS factor FROM (
 SELECT l.*, dif_lum/norm/179 AS diff_norm, dir_lum/(2*pi()*(1 - cos(radians(0.2665))))/179 AS solar_rad, (pi()/4 - sunz)/(pi()/4) AS x FROM lit l JOIN norms USING (station, month, day, hour))))"""


def day_rows(spark, sf_dir):
    return sunny(spark, sf_dir).where("sz > 0.0348994967025 and dif_horiz > 0").withColumn("dew_pt", F.lit(None).cast("double")).withColumn("t", F.struct("station", "month", "day", "hour"))


KEYS = ("station", "month", "day", "hour")


@query(oracle("SELECT station, month, day, hour, round(bright0, 6) + 0.0 AS brightness, round(clearness, 6) + 0.0 AS clearness, category FROM state", "b_weather", ctes=_STATE))
def sc14_sky_state(spark, sf_dir):
    return rounded(sky.sky_state(day_rows(spark, sf_dir)), "brightness", "clearness").select(*KEYS, "brightness", "clearness", "category")


@query(oracle("SELECT station, month, day, hour, round(ca, 6) + 0.0 AS c_a, round(cb, 6) + 0.0 AS c_b, round(cc, 6) + 0.0 AS c_c, round(cd, 6) + 0.0 AS c_d, round(ce, 6) + 0.0 AS c_e FROM lit", "b_weather", ctes=_STATE))
def sc15_luminance_coefficients(spark, sf_dir):
    found = sky.luminance_coefficients(sky.sky_state(day_rows(spark, sf_dir)))
    return rounded(found, *(f"c_{k}" for k in "abcde")).select(*KEYS, *(f"c_{k}" for k in "abcde"))


@query(oracle("SELECT station, month, day, hour, round(dir_lum, 3) + 0.0 AS dir_lum, round(dif_lum, 3) + 0.0 AS dif_lum FROM lit", "b_weather", ctes=_STATE))
def sc16_efficacy(spark, sf_dir):
    return rounded(sky.efficacy_before_floor(day_rows(spark, sf_dir)), "dir_lum", "dif_lum", digits=3).select(*KEYS, "dir_lum", "dif_lum")


@query(oracle("SELECT station, month, day, hour, round((1 + ca*exp(cb/0.5))*(1 + cc*exp(cd*acos(greatest(least(g, 1), -1))) + ce*g*g), 5) + 0.0 AS east FROM (SELECT *, 0.8660254037844386*sx + 0.5*sz AS g FROM sxyz JOIN lit USING (station, month, day, hour))".replace("0.8660254037844386*sx + 0.5*sz", "0.8660254037844386*sxyz.sx + 0.5*sxyz.sz"), "b_weather", ctes=_STATE))
def sc17_relative_luminance(spark, sf_dir):
    """Relative luminance of the direction 30 degrees up in the east."""
    g = math.sqrt(3) / 2 * F.col("sx") + 0.5 * F.col("sz")
    return sky.efficacy_before_floor(day_rows(spark, sf_dir)).select(*KEYS, r(sky.relative_luminance(g, F.lit(0.5)), 5).alias("east"))


@query(oracle("SELECT station, month, day, hour, round(diff_norm, 5) + 0.0 AS diff_norm, round(ground_br, 5) + 0.0 AS ground_br, round(solar_rad, 1) + 0.0 AS solar_rad FROM perez", "b_weather", ctes=_PEREZ))
def sc18_perez(spark, sf_dir):
    found = sky.perez(day_rows(spark, sf_dir))
    return rounded(rounded(found, "diff_norm", "ground_br", digits=5), "solar_rad", digits=1).select(*KEYS, "diff_norm", "ground_br", "solar_rad")


@query(oracle(f"SELECT station, month, day, hour, round(solar_rad*{sky.patch_share(4)!r}, 4) + 0.0 AS patch_rad FROM perez", "b_weather", ctes=_PEREZ))
def sc19_patch_share(spark, sf_dir):
    return sky.perez(day_rows(spark, sf_dir)).select(*KEYS, r(F.col("solar_rad") * sky.patch_share(4), 4).alias("patch_rad"))


@query(oracle("SELECT station, month, day, hour, (sz > sin(radians(2)) AND dif_horiz > 5 AND dir_norm >= 0) AS is_day FROM sxyz", "b_weather", ctes=_SUN))
def fl01_daylight_mask(spark, sf_dir):
    return sky.daylight_mask(sunny(spark, sf_dir)).select(*KEYS, "is_day")


_DAY = "days AS (SELECT *, row_number() OVER (ORDER BY station, month, day, hour) - 1 AS n FROM sxyz WHERE sz > sin(radians(2)) AND dif_horiz > 5)"


@query(oracle("SELECT station, month, day, hour FROM days WHERE day % 2 = 0", "b_weather", ctes=f"{_SUN}, {_DAY}"))
def fl02_user_mask(spark, sf_dir):
    rows = sky.daylight_mask(sunny(spark, sf_dir)).withColumn("t", F.concat_ws(":", *KEYS))
    return weather.user_mask(rows, rows.where("day % 2 = 0").select("t"), "rows").select(*KEYS)


@query(oracle("SELECT station, CAST(k AS INT) AS masked, t FROM (SELECT station, t, row_number() OVER (PARTITION BY station ORDER BY t) - 1 AS k FROM (SELECT station, CAST(month*100000 + day*1000 + hour*10 AS INT) AS t, day FROM b_weather)) WHERE t % 7 = 0", "b_weather"))
def fl03_masked_index(spark, sf_dir):
    t = binding(spark, sf_dir, "b_weather").select("station", (F.col("month") * 100000 + F.col("day") * 1000 + F.col("hour") * 10).cast("int").alias("t"))
    return weather.masked_index(t, t.where("t % 7 = 0")).select("station", "masked", "t")


@query(oracle("SELECT c.t, c.month, c.day, c.hour, w.month IS NOT NULL AS in_mask FROM (SELECT CAST(i AS INT) AS t, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, hour(ts) + 0.5E0 AS hour FROM (SELECT i, TIMESTAMP '2021-01-01' + to_hours(i) AS ts FROM range(8760) r(i))) c LEFT JOIN (SELECT DISTINCT month, day, hour FROM b_weather) w ON c.month = w.month AND c.day = w.day AND c.hour = w.hour", "b_weather"))
def fl04_calendar_mask(spark, sf_dir):
    """Hours of the year that any station has."""
    found = weather.calendar_mask(weather.calendar(spark), binding(spark, sf_dir, "b_weather"))
    return found.select("t", "month", "day", "hour", "in_mask")


@query(oracle("SELECT station, month, day, hour, round(sx, 6) + 0.0 AS sx, round(sz, 6) + 0.0 AS sz FROM sxyz WHERE sz > 0 AND dir_norm > 0", "b_weather", ctes=_SUN))
def fl08_candidate_suns(spark, sf_dir):
    """Weather rows as candidates: the layout of five columns, whose suns are computed."""
    rows = binding(spark, sf_dir, "b_weather")
    found = suns.candidates(rows, ["month", "day", "hour", "dir_norm", "dif_horiz"], (LAT, LON, MERIDIAN))
    return rounded(found, "sx", "sz").select(*KEYS, "sx", "sz")


@query(oracle("SELECT 2 AS layout, ray_id, round(-sin(radians(b))*cos(radians(a)), 6) + 0.0 AS sx FROM (SELECT ray_id, degrees(asin(dz)) AS a, CAST(ray_id % 360 AS DOUBLE) AS b FROM b_rays) WHERE a > 0 UNION ALL SELECT 3, ray_id, round(dx, 6) + 0.0 FROM b_rays WHERE dz > 0 UNION ALL SELECT 4, ray_id, round(dx, 6) + 0.0 FROM b_rays WHERE dz > 0 AND lum - 500 > 0", "b_rays"))
def fl08_candidate_layouts(spark, sf_dir):
    """Angles, vectors, and vectors with direct normal."""
    rays = binding(spark, sf_dir, "b_rays").withColumns({"a": F.degrees(F.asin("dz")), "b": (F.col("ray_id") % 360).cast("double"), "n": F.col("lum") - 500})
    kinds = (["a", "b"], ["dx", "dy", "dz"], ["dx", "dy", "dz", "n"])
    parts = [suns.candidates(rays, k).select(F.lit(len(k)).alias("layout"), "ray_id", r("sx").alias("sx")) for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def risen(spark, sf_dir):
    """Suns above the horizon with a number each."""
    rows = sunny(spark, sf_dir).where("sz > 0")
    return rows.withColumn("sun_id", (((F.col("station") * 100 + F.col("month")) * 100 + F.col("day")) * 100 + F.floor("hour")).cast("long"))


def boundary(spark, sf_dir):
    stations = binding(spark, sf_dir, "b_weather").select("station").distinct().withColumns({"lat": F.lit(LAT), "lon": F.lit(LON), "meridian": F.lit(MERIDIAN)})
    return sky.solar_boundary(stations)


_UVS = q.uv("SELECT *, sx AS dx, sy AS dy, sz AS dz FROM sxyz WHERE sz > 0")
HELD = f"placed AS (SELECT * FROM ({_UVS})), held AS (SELECT DISTINCT CAST(least(floor(u*8), 7) AS INT) AS i, CAST(least(floor(v*8), 7) AS INT) AS j FROM placed)"
RING = "b_weather AS (SELECT station, CAST(m AS INT) AS month, 21 AS day, k, k/12.0 AS hour FROM (SELECT DISTINCT CAST(user_id % 3 AS INT) AS station FROM events), (VALUES (6), (12)) v(m), range(288) r(k)), " + _SUN + """,
ring AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY part, o) - 1 AS k, x, y FROM (
  SELECT station, 1 AS part, k AS o, sx AS x, sy AS y FROM sxyz WHERE sz > 0 AND month = 6 UNION ALL SELECT station, 3, -k, sx, sy FROM sxyz WHERE sz > 0 AND month = 12
  UNION ALL SELECT DISTINCT station, 0, 0, 1000.0, 0.0 FROM sxyz UNION ALL SELECT DISTINCT station, 2, 0, -1000.0, 0.0 FROM sxyz)),
sides AS (SELECT station, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM ring WINDOW w AS (PARTITION BY station ORDER BY k))"""
_CORNERS = "spots AS (SELECT c, how, a, b, (c // 8 + a)/8 AS u, (c % 8 + b)/8 AS v FROM range(64) r(c), (VALUES ('center', 0.5, 0.5), ('any', 0.01, 0.01), ('any', 0.01, 0.99), ('any', 0.99, 0.01), ('any', 0.99, 0.99)) h(how, a, b)), dirs AS (" + q.from_uv("SELECT * FROM spots", out="p") + "), hits AS (SELECT c, how, a, b, bool_or(odd) AS inside FROM (SELECT c, how, a, b, station, sum(CASE WHEN (y0 > py) <> (y1 > py) AND px < (x1 - x0)*(py - y0)/(y1 - y0) + x0 THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM dirs, sides GROUP BY ALL) GROUP BY ALL)"


@query(oracle("SELECT i, j FROM held", "b_weather", ctes=f"{_SUN}, {HELD}"))
def fl07_sun_cells(spark, sf_dir):
    """Cells of the sun grid that hold a candidate."""
    return suns.sun_grid(spark, 8, held=suns.sun_cells(risen(spark, sf_dir), 8)).select("i", "j")


@query(oracle("SELECT 'center' AS how, CAST(c // 8 AS INT) AS i, CAST(c % 8 AS INT) AS j FROM hits WHERE how = 'center' AND inside UNION ALL SELECT 'any', CAST(c // 8 AS INT), CAST(c % 8 AS INT) FROM hits WHERE how = 'any' GROUP BY c HAVING bool_or(inside) UNION ALL SELECT 'all', CAST(c // 8 AS INT), CAST(c % 8 AS INT) FROM hits WHERE how = 'any' GROUP BY c HAVING bool_and(inside)", ctes=f"{RING}, {_CORNERS}"))
def fl07_solar_bounds(spark, sf_dir):
    """Cells inside the solar boundary by their centre, by any corner and by all corners."""
    ring = boundary(spark, sf_dir)
    parts = [suns.sun_grid(spark, 8, boundary=ring, include=how).select(F.lit(how).alias("how"), "i", "j") for how in ("center", "any", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(oracle(f"SELECT i, j, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(cx, 6) + 0.0 AS sx, round(cz, 6) + 0.0 AS sz FROM ({q.from_uv('SELECT i, j, (i + 0.5)/8 AS u, (j + 0.5)/8 AS v FROM held')})", "b_weather", ctes=f"{_SUN}, {HELD}"))
def gr01_sun_grid(spark, sf_dir):
    found = suns.sun_grid(spark, 4, 1, held=suns.sun_cells(risen(spark, sf_dir), 8))
    return rounded(found, "u", "v", "sx", "sz").select("i", "j", "u", "v", "sx", "sz")


@query(oracle(f"SELECT CAST(c // 8 AS INT) AS i, CAST(c % 8 AS INT) AS j, round((c // 8 + {q.uniform(3, 'c')})/8, 9) AS u, round((c % 8 + {q.uniform(4, 'c')})/8, 9) AS v FROM hits WHERE how = 'center' AND inside", ctes=f"{RING}, {_CORNERS}"))
def gr01_jittered_grid(spark, sf_dir):
    """Cells inside the boundary, each with a place drawn from the seed and the cell."""
    found = suns.sun_grid(spark, 8, jitter=3, boundary=boundary(spark, sf_dir))
    return found.select("i", "j", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


_ALL64 = "SELECT CAST(c // 8 AS INT) AS i, CAST(c % 8 AS INT) AS j FROM range(64) r(c)"
_GAPS = "gaps AS (SELECT CAST(least(floor(u*8), 7) AS INT) AS i, CAST(least(floor(v*8), 7) AS INT) AS j, CAST(((station*100 + month)*100 + day)*100 + floor(hour) AS BIGINT) AS sun_id, sqrt((u*8 - least(floor(u*8), 7) - 0.5)*(u*8 - least(floor(u*8), 7) - 0.5) + (v*8 - least(floor(v*8), 7) - 0.5)*(v*8 - least(floor(v*8), 7) - 0.5)) AS gap FROM placed)"


@query(oracle(f"SELECT i, j, coalesce(b.s, -1) AS sun_id, round(coalesce(b.g, -1), 5) + 0.0 AS gap FROM ({_ALL64}) LEFT JOIN (SELECT i, j, min({{'g': round(gap, 9), 's': sun_id}}) AS b FROM gaps GROUP BY i, j) USING (i, j)", "b_weather", ctes=f"{_SUN}, {HELD}, {_GAPS}"))
def ag16_candidate_per_cell(spark, sf_dir):
    """The sun nearest the centre of each cell; -1 where a cell has none."""
    found = suns.candidate_per_cell(risen(spark, sf_dir), 8, "sun_id")
    return found.select("i", "j", "sun_id", r(F.coalesce("gap", F.lit(-1.0)), 5).alias("gap"))


@query(oracle(f"SELECT i, j, coalesce(s, -1) AS sun_id FROM ({_ALL64}) LEFT JOIN (SELECT i, j, arg_min(sun_id, -ln(greatest({q.uniform(9, 'sun_id')}, 1e-12))/greatest(gap, 1e-9)) AS s FROM gaps GROUP BY i, j) USING (i, j)", "b_weather", ctes=f"{_SUN}, {HELD}, {_GAPS}"))
def ag16_random_candidate(spark, sf_dir):
    """One sun per cell, drawn with a chance in proportion to its distance from the centre."""
    return suns.candidate_per_cell(risen(spark, sf_dir), 8, "sun_id", seed=9).select("i", "j", "sun_id")


_MATRIX = "subs AS (" + q.from_uv("SELECT c, CAST(c // 16 // 4 * 4 + c % 16 // 4 AS INT) AS patch, (c // 16 + 0.5)/16 AS u, (c % 16 + 0.5)/16 AS v FROM range(256) r(c)") + """), lum AS (
 SELECT station, month, day, hour, patch, avg((pow(cz + 1.01, 10)*diff_norm*(1 + ca*exp(cb/greatest(cz, 0.01)))*(1 + cc*exp(cd*acos(greatest(least(g, 1), -1))) + ce*g*g) + pow(cz + 1.01, -10)*ground_br)/(pow(cz + 1.01, 10) + pow(cz + 1.01, -10))) AS coef
 FROM (SELECT p.*, s.patch, s.cz, s.cx*sx + s.cy*sy + s.cz*sz AS g FROM perez p, subs s) GROUP BY ALL)"""


@query(oracle("SELECT station, month, day, hour, patch, round(ln(coef), 3) + 0.0 AS ln_coef, round(ln(coef*CASE WHEN patch < 16 THEN 0.9 WHEN patch = 16 THEN 0.5 ELSE 1 END), 3) + 0.0 AS ln_red FROM (SELECT station, month, day, hour, patch, coef FROM lum UNION ALL SELECT station, month, day, hour, 16, ground_br FROM perez UNION ALL SELECT station, month, day, hour, 17, solar_rad FROM perez) WHERE coef > 0", "b_weather", ctes=f"{_PEREZ}, {_MATRIX}"))
def ag03_sky_matrix(spark, sf_dir):
    """Patch coefficients, ground and sun of every day hour of all stations, and a second channel."""
    found = sky.sky_matrix(sky.perez(day_rows(spark, sf_dir)), 4, with_sun=True, colors={"red": (0.9, 0.5, 1.0)}).where("coef > 0")
    return found.select(*(f"t.{k}" for k in KEYS), "patch", r(F.log("coef"), 3).alias("ln_coef"), r(F.log("coef_red"), 3).alias("ln_red"))


@query(oracle("SELECT station, t, round(dir_norm, 6) + 0.0 AS dir_norm FROM (SELECT q.station, q.t, a.v + (q.t - a.t)*(b.v - a.v)/(b.t - a.t) AS dir_norm FROM (SELECT DISTINCT station, day*24 + hour + 0.25 AS t FROM b_weather WHERE hour < 23 AND day < 30) q JOIN (SELECT station, day*24 + hour AS t, dir_norm AS v, lead(day*24 + hour) OVER (PARTITION BY station ORDER BY day*24 + hour) AS nt FROM b_weather) a ON a.station = q.station AND a.t <= q.t AND a.nt > q.t JOIN (SELECT station, day*24 + hour AS t, dir_norm AS v FROM b_weather) b ON b.station = q.station AND b.t = a.nt)", "b_weather"))
def jn20_time_interpolation(spark, sf_dir):
    series = binding(spark, sf_dir, "b_weather").select("station", (F.col("day") * 24 + F.col("hour")).alias("t"), "dir_norm")
    wanted = binding(spark, sf_dir, "b_weather").where("hour < 23 and day < 30").select("station", (F.col("day") * 24 + F.col("hour") + 0.25).alias("t")).distinct()
    return rounded(interpolate.time_linear(series, wanted, ["dir_norm"]), "dir_norm")


@query()
def jn20_time_cubic(spark, sf_dir):
    """Natural cubic splines per station; pytest holds them against the nodes."""
    series = binding(spark, sf_dir, "b_weather").select("station", (F.col("day") * 24 + F.col("hour")).alias("t"), "dir_norm")
    wanted = series.select("station", (F.col("t") + 0.25).alias("t"))
    return rounded(interpolate.time_cubic(series, wanted, ["dir_norm"]), "dir_norm")


@query(oracle("SELECT station*1000000 + month*100000 + day*1000 + CAST(hour*10 AS INT) AS t, round(dir_norm, 6) AS dir_norm, month, CAST(10.9735311509 AS DOUBLE) AS dew_pt FROM b_weather", "b_weather"))
def io04_sky_input(spark, sf_dir):
    rows = binding(spark, sf_dir, "b_weather").withColumn("t", F.col("station") * 1000000 + F.col("month") * 100000 + F.col("day") * 1000 + (F.col("hour") * 10).cast("int"))
    named = rows.select("t", F.col("month").alias("c1"), F.col("day").alias("c2"), F.col("hour").alias("c3"), F.col("dir_norm").alias("c4"), F.col("dif_horiz").alias("c5"))
    return weather.sky_input(named).select("t", F.round("dir_norm", 6).alias("dir_norm"), "month", "dew_pt")


@query(oracle("SELECT t, patch, round(coef, 6) AS coef, round(sun_rad, 6) AS sun_rad, 4 AS side FROM b_sky LEFT JOIN (SELECT t, sun_rad FROM b_sun) USING (t)", "b_sky", "b_sun"))
def io11_sky_table(spark, sf_dir):
    """Coefficients, suns and times written as one folder and read again; the side comes from the ground patch."""
    path = scratch_folder(spark, "sky")
    matrix = binding(spark, sf_dir, "b_sky")
    tables.write_sky(matrix, binding(spark, sf_dir, "b_sun"), matrix.select("t").distinct(), path)
    patches, suns, times, side = tables.read_sky(spark, path)
    rows = times.join(patches, "t").join(suns.select("t", "sun_rad"), "t", "left")
    return rounded(rows, "coef", "sun_rad").select("t", "patch", "coef", "sun_rad", F.lit(side).alias("side"))


_LINES = "grid AS (SELECT p.patch, s.t, coalesce(coef, 0)*1.000003E0 AS coef FROM (SELECT DISTINCT patch FROM b_sky) p CROSS JOIN (SELECT DISTINCT t FROM b_sky) s LEFT JOIN b_sky k ON k.patch = p.patch AND k.t = s.t UNION ALL SELECT 16, s.t, coalesce(sun_rad, 0)*1.000003E0 FROM (SELECT DISTINCT t FROM b_sky) s LEFT JOIN b_sun u ON u.t = s.t)"


@query(oracle("SELECT CAST(patch AS INT) AS patch, string_agg(printf('%.5e', coef) || chr(9) || printf('%.5e', coef), chr(9) ORDER BY t) AS line FROM grid GROUP BY patch", "b_sky", "b_sun", ctes=_LINES))
def io16_sky_text(spark, sf_dir):
    """Rows of the text export for two channels: one per patch and one of the sun, over all times."""
    matrix = binding(spark, sf_dir, "b_sky").withColumn("coef", F.col("coef") * 1.000003)
    return tables.sky_text(matrix, 2, binding(spark, sf_dir, "b_sun").withColumn("sun_rad", F.col("sun_rad") * 1.000003))


@query(oracle("SELECT station, month, day, hour, printf('%02d-%02d %05.2f', month, day, hour) AS label, CAST(row_number() OVER w - 1 AS INT) AS idx, CASE WHEN up THEN CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER w - 1 AS INT) ELSE -1 END AS masked FROM (SELECT *, sz > sin(radians(2)) AND dif_horiz > 5 AND dir_norm >= 0 AS up FROM sxyz) WINDOW w AS (PARTITION BY station ORDER BY month, day, hour ROWS UNBOUNDED PRECEDING)", "b_weather", ctes=_SUN))
def io19_sky_view(spark, sf_dir):
    """All rows with label, original index and, by day, masked index (-1 outside the mask)."""
    return weather.indexed(sky.daylight_mask(sunny(spark, sf_dir)), "is_day").select(*KEYS, "label", "idx", F.coalesce("masked", F.lit(-1)).alias("masked"))
