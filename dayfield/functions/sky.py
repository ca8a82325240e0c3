"""Weather to sky: sun position, all-weather sky state and luminance, patch coefficients.

The stages follow the all-weather sky model of Perez, Seals and Michalsky (1993) as the public program gendaylit computes it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import directions as d

PI = math.pi
# Fixed values of the sky model: clearness bins, luminance coefficients (8 categories x a..e x 4), efficacy coefficients of
# diffuse and direct light (8 categories x 4), ground factors for overcast and clear skies, days before each month.
CLEARNESS = (1, 1.065, 1.23, 1.50, 1.95, 2.80, 4.50, 6.20)
COEFFICIENTS = (
    (1.3525, -0.2576, -0.2690, -1.4366, -0.7670, 0.0007, 1.2734, -0.1233, 2.8000, 0.6004, 1.2375, 1.000, 1.8734, 0.6297, 0.9738, 0.2809, 0.0356, -0.1246, -0.5718, 0.9938),
    (-1.2219, -0.7730, 1.4148, 1.1016, -0.2054, 0.0367, -3.9128, 0.9156, 6.9750, 0.1774, 6.4477, -0.1239, -1.5798, -0.5081, -1.7812, 0.1080, 0.2624, 0.0672, -0.2190, -0.4285),
    (-1.1000, -0.2515, 0.8952, 0.0156, 0.2782, -0.1812, -4.5000, 1.1766, 24.7219, -13.0812, -37.7000, 34.8438, -5.0000, 1.5218, 3.9229, -2.6204, -0.0156, 0.1597, 0.4199, -0.5562),
    (-0.5484, -0.6654, -0.2672, 0.7117, 0.7234, -0.6219, -5.6812, 2.6297, 33.3389, -18.3000, -62.2500, 52.0781, -3.5000, 0.0016, 1.1477, 0.1062, 0.4659, -0.3296, -0.0876, -0.0329),
    (-0.6000, -0.3566, -2.5000, 2.3250, 0.2937, 0.0496, -5.6812, 1.8415, 21.000, -4.7656, -21.5906, 7.2492, -3.5000, -0.1554, 1.4062, 0.3988, 0.0032, 0.0766, -0.0656, -0.1294),
    (-1.0156, -0.3670, 1.0078, 1.4051, 0.2875, -0.5328, -3.8500, 3.3750, 14.0000, -0.9999, -7.1406, 7.5469, -3.4000, -0.1078, -1.075, 1.5702, -0.0672, 0.4016, 0.3017, -0.4844),
    (-1.00, 0.0211, 0.5025, -0.5119, -0.3, 0.1922, 0.7023, -1.6317, 19.0, -5.0, 1.2438, -1.9094, -4.0000, 0.0250, 0.3844, 0.2656, 1.0468, -0.3788, -2.4517, 1.4656),
    (-1.0500, 0.0289, 0.4260, 0.3590, -0.325, 0.1156, 0.7781, 0.0025, 31.0625, -14.5, -46.1148, 55.375, -7.2312, 0.405, 13.35, 0.6234, 1.5, -0.6426, 1.8564, 0.5636),
)
DIFFUSE_EFFICACY = ((97.24, -0.46, 12.0, -8.91), (107.22, 1.15, 0.59, -3.95), (104.97, 2.96, -5.53, -8.77), (102.39, 5.59, -13.95, -13.90), (100.71, 5.94, -22.75, -23.74), (106.42, 3.83, -36.15, -28.83), (141.88, 1.90, -53.24, -14.03), (152.23, 0.35, -45.27, -7.98))
DIRECT_EFFICACY = ((57.20, -4.55, -2.98, 117.12), (98.99, -3.46, -1.21, 12.38), (109.83, -4.90, -1.71, -8.81), (110.34, -5.84, -1.99, -4.56), (106.36, -3.97, -1.75, -6.16), (107.19, -1.25, -1.51, -26.73), (105.75, 0.77, -1.26, -34.44), (101.18, 1.58, -1.10, -8.29))
GROUND_FACTORS = ((2.766521, 0.547665, -0.369832, 0.009237, 0.059229), (3.5556, -2.7152, -1.3081, 1.0660, 0.60227))
MONTH_DAYS = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
SOLAR_CONSTANT, HALF_SUN_DEG, DEW_POINT = 1367.0, 0.2665, 10.9735311509
#: Altitude rows of the 145 sky directions: (zenith angle, number of azimuths).
TREGENZA = ((84, 30), (72, 30), (60, 24), (48, 24), (36, 18), (24, 12), (12, 6), (0, 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it (plans stay small when filters are pushed down)."""
    return F.get(F.transform(F.array(value), use), 0)


def categories(spark: SparkSession) -> DataFrame:
    """The model's constants, one row for each of the 8 clearness categories: (category, cp, fd, ed)."""
    rows = [(i, list(map(float, COEFFICIENTS[i])), list(map(float, DIFFUSE_EFFICACY[i])), list(map(float, DIRECT_EFFICACY[i]))) for i in range(8)]
    return spark.createDataFrame(rows, "category int, cp array<double>, fd array<double>, ed array<double>")


def sky_directions(spark: SparkSession) -> DataFrame:
    """(theta, phi) in degrees of the 145 directions."""
    rows = [(float(t), 360.0 * i / n) for t, n in TREGENZA for i in range(n)]
    return spark.createDataFrame(rows, "theta double, phi double")


def timestamps(rows: DataFrame, year: int = 2020) -> DataFrame:
    """Adds ``ts``: month, day and hour to the minute in one year; a minute that rounds to 60 carries over."""
    minutes = F.round(F.col("hour") * 60).cast("int")
    day = F.make_timestamp_ntz(F.lit(year), F.col("month"), F.col("day"), F.lit(0), F.lit(0), F.lit(0))
    return rows.withColumn("ts", day + F.make_dt_interval(mins=minutes))


def to_utc(rows: DataFrame) -> DataFrame:
    """Adds ``utc`` from ``ts`` and the meridian (degrees, west positive): 4 minutes a degree."""
    return rows.withColumn("utc", F.col("ts") + F.make_dt_interval(mins=F.round(F.col("meridian") * 4).cast("int")))


def sun_position(rows: DataFrame, rotation: float = 0.0) -> DataFrame:
    """Adds sun_alt, sun_az (degrees; south 0, west positive, less ``rotation``) and sx, sy, sz.

    Needs utc, lat and lon (west positive). Low-precision solar coordinates after Meeus as NOAA publishes them, with its standard
    refraction."""
    rad, sin, cos = F.radians, F.sin, F.cos
    phi = rad("lat")

    def orbit(s: Column) -> Column:
        t = s["t"]
        return F.struct(
            s["sec"].alias("sec"), t.alias("t"),
            rad(280.46646 + t * (36000.76983 + 0.0003032 * t)).alias("l"), rad(357.52911 + t * (35999.05029 - 0.0001537 * t)).alias("m"),
            (0.016708634 - t * (0.000042037 + 0.0000001267 * t)).alias("e"), rad(125.04 - 1934.136 * t).alias("o"),
        )

    def ecliptic(s: Column) -> Column:
        t, m, o = s["t"], s["m"], s["o"]
        centre = sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289
        eps = rad(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - 0.001813 * t))) / 60) / 60 + 0.00256 * cos(o))
        return F.struct(*(s[k].alias(k) for k in ("sec", "l", "m", "e")), (s["l"] + rad(centre - 0.00569 - 0.00478 * sin(o))).alias("lam"), eps.alias("eps"))

    def hour_angle(s: Column) -> Column:
        l, m, e = s["l"], s["m"], s["e"]  # noqa: E741
        return let(F.pow(F.tan(s["eps"] / 2), F.lit(2)), lambda y: F.struct(
            F.asin(sin(s["eps"]) * sin(s["lam"])).alias("dec"),
            rad((F.pmod(s["sec"], F.lit(86400)) / 60.0 + 4 * F.degrees(y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l) - 0.5 * y * y * sin(4 * l) - 1.25 * e * e * sin(2 * m)) - 4 * F.col("lon")) / 4 - 180).alias("ha"),
        ))

    def angles(s: Column) -> Column:
        dec, ha = s["dec"], s["ha"]
        alt = F.degrees(F.asin(d.clip(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(ha), -1.0, 1.0)))
        return F.struct(alt.alias("alt"), (F.degrees(F.atan2(sin(ha), cos(ha) * sin(phi) - F.tan(dec) * cos(phi))) - rotation).alias("az"))

    def refracted(s: Column) -> Column:
        alt = s["alt"]
        tan = F.tan(rad(alt))
        bend = F.when(alt > 85, 0.0).when(alt > 5, F.try_divide(F.lit(58.1), tan) - F.try_divide(F.lit(0.07), F.pow(tan, F.lit(3))) + F.try_divide(F.lit(0.000086), F.pow(tan, F.lit(5)))).when(alt > -0.575, 1735 + alt * (-518.2 + alt * (103.4 + alt * (-12.79 + alt * 0.711)))).otherwise(F.try_divide(F.lit(-20.774), tan))
        return F.struct((alt + bend / 3600).alias("alt"), s["az"].alias("az"))

    def direction(s: Column) -> Column:
        v = d.from_alt_az(s["alt"], s["az"])
        return F.struct(s["alt"].alias("sun_alt"), s["az"].alias("sun_az"), v.x.alias("sx"), v.y.alias("sy"), v.z.alias("sz"))

    seconds = F.unix_seconds(F.col("utc").cast("timestamp"))
    sun = F.struct(seconds.alias("sec"), ((seconds / 86400.0 + 2440587.5 - 2451545.0) / 36525.0).alias("t"))
    for stage in (orbit, ecliptic, hour_angle, angles, refracted, direction):
        sun = let(sun, stage)
    return rows.withColumn("_sun", sun).select(*rows.columns, *(F.col(f"_sun.{c}").alias(c) for c in ("sun_alt", "sun_az", "sx", "sy", "sz")))


def sky_state(rows: DataFrame) -> DataFrame:
    """Adds sunz (radians), brightness, clearness and category to rows with sz, dir_norm, dif_horiz, month and day.

    A null month stands for an unknown date (day number 0). Clearness needs diffuse light: 0 gives nulls."""
    days = F.element_at(F.array(*map(F.lit, MONTH_DAYS)), F.col("month").cast("int"))
    angle = 2 * PI * (F.coalesce(days + F.col("day"), F.lit(0)) - 1) / 365
    out = rows.withColumn("sunz", PI / 2 - F.asin(d.clip(F.col("sz"), -1.0, 1.0))).withColumn("_a", angle)
    a, z = F.col("_a"), F.col("sunz")
    orbit = 1.00011 + 0.034221 * F.cos(a) + 0.00128 * F.sin(a) + 0.000719 * F.cos(2 * a) + 0.000077 * F.sin(2 * a)
    mass = 1 / (F.cos(z) + 0.15 * F.exp(-F.log(93.885 - F.degrees(z)) * 1.253))
    cube = 1.041 * F.pow(z, F.lit(3))
    bright = d.clip(F.col("dif_horiz") * mass / (SOLAR_CONSTANT * orbit), 0.01, 0.6)
    clear = d.clip((F.try_divide(F.col("dif_horiz") + F.col("dir_norm"), F.col("dif_horiz")) + cube) / (1 + cube), 1.0, 12.099)
    out = out.withColumn("brightness", bright).withColumn("clearness", F.when(F.col("dif_horiz") > 0, clear)).drop("_a")
    step = F.lit(0)
    for edge in CLEARNESS[1:]:
        step = step + F.when(F.col("clearness") >= edge, 1).otherwise(0)
    return out.withColumn("category", F.when(F.col("clearness").isNotNull(), step))


def luminance_coefficients(rows: DataFrame) -> DataFrame:
    """Adds a..e (luminance) and joins the category constants; brightness is at least .2 for clearness in 1.065..2.8."""
    out = rows.join(F.broadcast(categories(rows.sparkSession)), "category")
    out = out.withColumn("brightness", F.when((F.col("clearness") > 1.065) & (F.col("clearness") < 2.8), F.greatest("brightness", F.lit(0.2))).otherwise(F.col("brightness")))
    k = lambda i, j: F.get("cp", F.lit(4 * i + j))
    z, b, lowest = F.col("sunz"), F.col("brightness"), F.col("category") == 0
    plain = [k(i, 0) + k(i, 1) * z + b * (k(i, 2) + k(i, 3) * z) for i in range(5)]
    plain[2] = F.when(lowest, F.exp(F.pow(b * (k(2, 0) + k(2, 1) * z), k(2, 2))) - k(2, 3)).otherwise(plain[2])
    plain[3] = F.when(lowest, -F.exp(b * (k(3, 0) + k(3, 1) * z)) + k(3, 2) + b * k(3, 3)).otherwise(plain[3])
    return out.withColumns({f"c_{n}": x for n, x in zip("abcde", plain, strict=True)})


def efficacy(rows: DataFrame) -> DataFrame:
    """Adds dir_lum and dif_lum (luminous direct and diffuse); direct efficacy is not below 0. dew_pt may be null."""
    water = F.exp(0.07 * F.coalesce(F.col("dew_pt"), F.lit(DEW_POINT)) - 0.075)
    f, e = (lambda n, i: F.get(n, F.lit(i))), F.col("brightness")
    direct = f("ed", 0) + f("ed", 1) * water + f("ed", 2) * F.exp(5.73 * F.col("sunz") - 5) + f("ed", 3) * e
    diffuse = f("fd", 0) + f("fd", 1) * water + f("fd", 2) * F.cos("sunz") + f("fd", 3) * F.log(e)
    return rows.withColumn("dir_lum", F.col("dir_norm") * F.greatest(direct, F.lit(0.0))).withColumn("dif_lum", F.col("dif_horiz") * diffuse)


def relative_luminance(cos_gamma: Column, z: Column) -> Column:
    """Relative luminance of a direction from c_a..c_e; z is floored at .01."""
    a, b, c, e, f = (F.col(f"c_{n}") for n in "abcde")
    up = F.greatest(z, F.lit(0.01))
    return (1 + a * F.exp(b / up)) * (1 + c * F.exp(e * F.acos(d.clip(cos_gamma, -1.0, 1.0))) + f * cos_gamma * cos_gamma)


def perez(rows: DataFrame, ground: float = 0.2) -> DataFrame:
    """Adds diff_norm, ground_br and solar_rad to rows (t, month, day, sx, sy, sz, dir_norm, dif_horiz, dew_pt).

    The norm sums relative luminance over 145 fixed directions inside each row, so nothing is shuffled."""
    out = efficacy_before_floor(rows)
    thetas = [(math.radians(t), math.radians(360.0 * i / n)) for t, n in TREGENZA for i in range(n)]
    parts = F.array(*(F.struct(F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s"), F.lit(math.cos(p)).alias("p")) for t, p in thetas))
    cos_of = lambda x: F.cos("sunz") * x["c"] + F.sin("sunz") * x["s"] * x["p"]
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + relative_luminance(cos_of(x), x["c"]) * x["c"])
    out = out.withColumn("diff_norm", F.col("dif_lum") / (total * 2 * PI / 145) / 179)
    out = out.withColumn("solar_rad", F.col("dir_lum") / (2 * PI * (1 - math.cos(math.radians(HALF_SUN_DEG)))) / 179)
    alt, clear = PI / 2 - F.col("sunz"), F.col("clearness") <= 6
    x = (alt - PI / 4) / (PI / 4)
    series = lambda k: sum((F.lit(c) * F.pow(x, F.lit(i)) for i, c in enumerate(k)), F.lit(0.0))
    f2 = F.when(clear, (2.739 + 0.9891 * F.sin(0.3119 + 2.6 * alt)) * F.exp(-(PI / 2 - alt) * (0.4441 + 1.48 * alt))).otherwise(0.274 * (0.91 + 10 * F.exp(-3 * (PI / 2 - alt)) + 0.45 * F.col("sz") * F.col("sz")))
    factor = F.when(F.col("clearness") == 1, 0.777778).otherwise(F.when(clear, series(GROUND_FACTORS[1])).otherwise(series(GROUND_FACTORS[0])) / f2 / PI)
    zenith = relative_luminance(F.cos("sunz"), F.lit(1.0)) * F.col("diff_norm")
    sun_part = F.when(F.col("clearness") > 1, 6.8e-5 / PI * F.col("solar_rad") * F.col("sz")).otherwise(0.0)
    return out.withColumn("ground_br", ground * (zenith * factor + sun_part)).drop("cp", "fd", "ed")


def efficacy_before_floor(rows: DataFrame) -> DataFrame:
    """State, efficacy and luminance coefficients; efficacy uses the brightness before its floor, as the model does."""
    state = sky_state(rows).join(F.broadcast(categories(rows.sparkSession)), "category")
    return luminance_coefficients(efficacy(state).drop("cp", "fd", "ed"))


def patch_directions(spark: SparkSession, side: int, jn: int = 4) -> DataFrame:
    """(patch, x, y, z) of jn * jn sub-samples of each of side * side patches."""
    n = side * jn
    rows = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"))
    v = d.from_uv((F.col("a") + 0.5) / n, (F.col("b") + 0.5) / n)
    return rows.select((F.floor(F.col("a") / jn) * side + F.floor(F.col("b") / jn)).cast("int").alias("patch"), v.x.alias("x"), v.y.alias("y"), v.z.alias("z"))


def sky_matrix(states: DataFrame, side: int, jn: int = 4, blend: bool = True, with_sun: bool = False, colors: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(t, patch, coef): mean luminance of each patch, and the ground as patch side * side; ``with_sun`` adds the sun's radiance as the
    patch after it. ``colors`` gives channels (sky, ground and sun factors by name) as columns coef_<name> beside coef.

    ``states`` is the result of ``perez`` with a key t. The directions are (side * jn)^2 rows, a size that the arguments fix,
    so they are broadcast; with ``blend``, sky and ground mix near the horizon by (z + 1.01)^10 and its inverse."""
    spark = states.sparkSession
    pairs = states.crossJoin(F.broadcast(patch_directions(spark, side, jn)))
    gamma = F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz")
    sky = F.col("diff_norm") * relative_luminance(gamma, F.col("z"))
    up, down = F.pow(F.col("z") + 1.01, F.lit(10)), F.pow(F.col("z") + 1.01, F.lit(-10))
    mixed = (up * sky + down * F.col("ground_br")) / (up + down) if blend else F.when(F.col("z") >= 0, sky).otherwise(F.col("ground_br"))
    patches = pairs.groupBy("t", "patch").agg(F.avg(mixed).alias("coef"))
    out = patches.unionByName(states.select("t", F.lit(side * side).alias("patch"), F.col("ground_br").alias("coef")))
    if with_sun:
        out = out.unionByName(states.select("t", F.lit(side * side + 1).alias("patch"), F.col("solar_rad").alias("coef")))
    place = F.when(F.col("patch") < side * side, 0).when(F.col("patch") == side * side, 1).otherwise(2)
    return out.withColumns({f"coef_{name}": F.col("coef") * F.get(F.array(*map(F.lit, map(float, factors))), place) for name, factors in (colors or {}).items()})


def patch_share(side: int) -> float:
    """Share of the sun's radiance when it is spread over one patch."""
    return (HALF_SUN_DEG * PI * side / 180) ** 2 / 2


def unit_sky(spark: SparkSession, side: int) -> DataFrame:
    """Every patch 1, ground included: evaluates raw contributions."""
    return spark.range(side * side + 1).select(F.col("id").cast("int").alias("patch"), F.lit(1.0).alias("coef"))


def daylight_mask(rows: DataFrame, min_alt: float = 2.0, min_dif: float = 5.0, min_dir: float = 0.0) -> DataFrame:
    """Adds is_day: sun above ``min_alt`` and diffuse above ``min_dif`` (both strict), direct at least ``min_dir``."""
    return rows.withColumn("is_day", (F.col("sz") > math.sin(math.radians(min_alt))) & (F.col("dif_horiz") > min_dif) & (F.col("dir_norm") >= min_dir))


def solstice_tracks(stations: DataFrame) -> DataFrame:
    """(stations.., month, k, sx, sy, sz): the sun every five minutes of both solstice days while it is up."""
    spark = stations.sparkSession
    times = spark.range(576).select(F.when(F.col("id") < 288, 6).otherwise(12).alias("month"), F.lit(21).alias("day"), (F.col("id") % 288).cast("int").alias("k"), (F.col("id") % 288 / 12).alias("hour"))
    tracks = sun_position(to_utc(timestamps(stations.crossJoin(F.broadcast(times)))))
    return tracks.where("sz > 0").select(*stations.columns, "month", "k", "sx", "sy", "sz")


def solar_boundary(stations: DataFrame, rotation: float = 0.0, far: float = 1000.0) -> DataFrame:
    """(stations.., ring): both tracks in plan as one polygon, closed through far points west and east; where the sun does not rise on a
    solstice, a far point to the south (December) or north (June) stands for its track."""
    tracks = solstice_tracks(stations)
    x, y = d.rotate_z(F.col("sx"), F.col("sy"), rotation)
    listed = tracks.groupBy(*stations.columns).agg(*(F.array_sort(F.collect_list(F.when(F.col("month") == m, F.struct("k", x.alias("x"), y.alias("y"))))).alias(n) for m, n in ((6, "jun"), (12, "dec"))))
    a = math.radians(rotation)
    spot = lambda px, py: F.struct(F.lit(px * math.cos(a) - py * math.sin(a)).alias("x"), F.lit(px * math.sin(a) + py * math.cos(a)).alias("y"))
    plain = lambda c: F.transform(c, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    jun = F.when(F.size("jun") > 0, plain("jun")).otherwise(F.array(spot(0.0, far)))
    dec = F.when(F.size("dec") > 0, F.reverse(plain("dec"))).otherwise(F.array(spot(0.0, -far)))
    return listed.select(*stations.columns, F.concat(F.array(spot(far, 0.0)), jun, F.array(spot(-far, 0.0)), dec).alias("ring"))
