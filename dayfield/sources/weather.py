"""Weather files: one Spark job over any number of station files, whatever mix of EPW and WEA they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import directions as d
from ..functions import sky

#: The 35 columns of an EPW line.
EPW_COLUMNS = (
    "year", "month", "day", "hour", "minute", "note", "dry_bulb", "dew_pt", "rel_humidity", "pressure", "ext_horiz", "ext_norm", "ir_sky",
    "glo_horiz", "dir_norm", "dif_horiz", "glo_horiz_ill", "dir_norm_ill", "dif_horiz_ill", "zenith_lum", "wind_dir", "wind_speed", "sky_cover",
    "opaque_cover", "visibility", "ceiling", "weather_obs", "weather_codes", "precip_water", "aerosol", "snow_depth", "last_snow", "albedo", "rain", "rain_time",
)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def read_weather(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, month, day, hour, dir_norm, dif_horiz): lines that begin with a digit; more than 23 fields are EPW (hour - 0.5), else WEA."""
    parts = _lines(spark, paths).where(F.rlike("value", F.lit("^[0-9]"))).select("file", F.split(F.rtrim("value"), r"[\s,]+").alias("f"))
    epw = F.size("f") > 23
    pick = lambda i, j: F.when(epw, F.get("f", F.lit(i))).otherwise(F.get("f", F.lit(j)))
    return parts.select(
        "file",
        pick(1, 0).cast("int").alias("month"), pick(2, 1).cast("int").alias("day"),
        F.when(epw, F.get("f", F.lit(3)).cast("double") - 0.5).otherwise(F.get("f", F.lit(2)).cast("double")).alias("hour"),
        pick(14, 3).cast("double").alias("dir_norm"), pick(15, 4).cast("double").alias("dif_horiz"),
    )


def read_epw(spark: SparkSession, paths: str | list[str], columns: list[str | int] | None = None) -> DataFrame:
    """The chosen EPW columns by name or index (default all): note is 0, hour is less 0.5. An unknown column is an error."""
    names = [EPW_COLUMNS[c] if isinstance(c, int) and 0 <= c < len(EPW_COLUMNS) else c for c in (columns if columns is not None else EPW_COLUMNS)]
    if unknown := [n for n in names if n not in EPW_COLUMNS]:
        raise ValueError(f"unknown columns: {unknown}")
    parts = _lines(spark, paths).where(F.rlike("value", F.lit("^[0-9]"))).select("file", F.split(F.rtrim("value"), ",").alias("f"))

    def column(name: str):
        value = F.get("f", F.lit(EPW_COLUMNS.index(name)))
        return (F.lit(0.0) if name == "note" else value.cast("double") - 0.5 if name == "hour" else value.try_cast("double")).alias(name)

    return parts.select("file", *map(column, names))


def stations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, lat, lon, meridian, elevation), lon west positive: from an EPW LOCATION line or WEA header lines.

    Elevation defaults to 0; a file whose latitude, longitude or zone cannot be read is an error when its row is used."""
    lines = _lines(spark, paths)
    epw = F.split("value", ",")
    is_epw = F.startswith("value", F.lit("LOCATION,"))
    wea = lambda key: F.when(F.rlike("value", F.lit(f"^{key}\\b")), F.regexp_extract("value", rf"^{key}\s+(.+?)\s*$", 1))
    at = lambda i: F.when(is_epw, F.get(epw, F.lit(i)))
    pick = lambda a: F.max(a)
    rows = lines.groupBy("file").agg(
        pick(F.coalesce(at(1), wea("place"))).alias("name"),
        pick(F.coalesce(at(6), wea("latitude")).try_cast("double")).alias("lat"),
        pick(F.coalesce(-at(7).try_cast("double"), wea("longitude").try_cast("double"))).alias("lon"),
        pick(F.coalesce(at(8).try_cast("double") * -15, wea("time_zone").try_cast("double"))).alias("meridian"),
        F.coalesce(pick(F.coalesce(at(9), wea("site_elevation")).try_cast("double")), F.lit(0.0)).alias("elevation"),
    )
    sound = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("meridian").isNotNull()
    return rows.withColumn("lat", F.when(sound, F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("no station header in "), "file")).cast("double")))


def sky_input(rows: DataFrame, layout: str = "auto") -> DataFrame:
    """One form for sky inputs of 4 (alt, az, dir, dif), 5 (dx, dy, dz or month, day, hour; dir, dif) or 6 columns (and dew point).

    Adds to (t, c1..c6): sx, sy, sz, month, day, hour, dir_norm, dif_horiz, dew_pt; unknown parts are null, the dew point has
    its default. ``auto`` takes 5 or 6 columns as dates if any second number is over 2. Dates need ``sun_position`` next."""
    names = [c for c in rows.columns if c.startswith("c") and c[1:].isdigit()]
    n = len(names)
    if n not in (4, 5, 6):
        raise ValueError("sky inputs have 4, 5 or 6 columns")
    if layout == "auto":
        layout = "angles" if n == 4 else "dates" if (rows.agg(F.max("c2")).first()[0] or 0) > 2 else "vectors"
    c = lambda i: F.col(f"c{i}").cast("double")
    none = F.lit(None).cast("double")
    if layout == "angles":
        v = d.from_alt_az(c(1), c(2))
        sun, date, light = [v.x, v.y, v.z], [none] * 3, [c(3), c(4)]
    elif layout == "vectors":
        v = d.norm(d.Xyz(c(1), c(2), c(3)))
        sun, date, light = [v.x, v.y, v.z], [none] * 3, [c(4), c(5)]
    else:
        sun, date, light = [none] * 3, [c(1), c(2), c(3)], [c(4), c(5)]
    dew = F.coalesce(c(6) if n == 6 else none, F.lit(sky.DEW_POINT))
    kinds = ["sx", "sy", "sz", "month", "day", "hour", "dir_norm", "dif_horiz", "dew_pt"]
    made = [x.cast("int") if k in ("month", "day") else x for k, x in zip(kinds, [*sun, *date, *light, dew], strict=True)]
    return rows.select("t", *(x.alias(k) for k, x in zip(kinds, made, strict=True)))


def calendar(spark: SparkSession, year: int = 2021) -> DataFrame:
    """(t, month, day, hour) of the 8760 half hours of a year without a leap day."""
    start = F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    hours = spark.range(8760).select(F.col("id").cast("int").alias("t"), (start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    return hours.select("t", F.month("ts").alias("month"), F.day("ts").alias("day"), (F.hour("ts") + 0.5).alias("hour"))


def calendar_mask(times: DataFrame, wanted: DataFrame) -> DataFrame:
    """``times`` with in_mask: whether (month, day, hour) is in the list."""
    marked = wanted.select("month", "day", "hour").distinct().withColumn("_in", F.lit(True))
    return times.join(marked, ["month", "day", "hour"], "left").withColumn("in_mask", F.coalesce("_in", F.lit(False))).drop("_in")


def user_mask(times: DataFrame, mask: DataFrame | None, mode: str) -> DataFrame:
    """Day rows of ``times`` (t, is_day) that a mask keeps. Modes: ``rows`` (a list of t), ``all`` (t, keep over all rows), ``day``
    (n, keep over day rows counted from 0), ``none``."""
    day = times.where("is_day")
    if mode == "none" or mask is None:
        return day
    if mode == "rows":
        return day.join(mask.select("t").distinct(), "t", "left_semi")
    if mode == "all":
        return day.join(mask.where("keep").select("t"), "t", "left_semi")
    if mode == "day":
        return _numbered(day, "n").join(mask.where("keep").select("n"), "n", "left_semi").drop("n")
    raise ValueError(f"unknown mask mode {mode!r}")


def _numbered(times: DataFrame, name: str) -> DataFrame:
    """Row numbers by t from 0, per station where there is one (a station's year is a small window)."""
    by = [c for c in ("station",) if c in times.columns]
    return times.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("t")) - 1)


def masked_index(masked: DataFrame, rows: DataFrame) -> DataFrame:
    """([station,] t, masked): the place of original rows among the masked ones; rows outside the mask drop out."""
    on = [c for c in ("station", "t") if c in masked.columns and c in rows.columns]
    return _numbered(masked, "masked").select(*on, "masked").join(rows.select(*on), on)


def indexed(rows: DataFrame, mask: str, key: str = "station") -> DataFrame:
    """Adds label, idx (the row's place among all of its station) and masked (its place among the rows of the mask, null outside)."""
    order = Window.partitionBy(key).orderBy("month", "day", "hour").rowsBetween(Window.unboundedPreceding, 0)
    label = F.format_string("%02d-%02d %05.2f", "month", "day", "hour")
    masked = F.when(F.col(mask), (F.sum(F.when(F.col(mask), 1).otherwise(0)).over(order) - 1).cast("int"))
    return rows.withColumns({"label": label, "idx": F.row_number().over(Window.partitionBy(key).orderBy("month", "day", "hour")) - 1, "masked": masked})
