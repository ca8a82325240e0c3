"""Point, ray, sensor and sky tables: text scans and partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, level, pt_id, x, y, z) of blank-separated text: 3 columns are xyz, 4 idx + xyz, 5 level + idx + xyz.

    A missing level is 0, a missing idx the row's number in its file. Lines with an idx are an ordinary, splittable scan; only files
    that have lines without one are read whole (a row of the scan is then a file), since their rows must be counted from its start."""
    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.text(paths).select(file, F.split(F.trim("value"), r"\s+").alias("f")).where("f[0] <> ''")
    listed = lines.where("size(f) >= 4").withColumn("row", F.lit(None).cast("long"))
    unlisted = lines.where("size(f) < 4").select("file").distinct()
    files = spark.read.text(paths, wholetext=True).select("value", file).join(unlisted, "file", "left_semi")
    counted = files.select("file", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    counted = counted.select("file", F.split(F.trim("line"), r"\s+").alias("f"), F.col("row").cast("long").alias("row")).where("size(f) < 4")
    parts = listed.unionByName(counted).withColumn("n", F.size("f"))
    tail = lambda k: F.element_at("f", k).cast("double")
    idx = F.when(F.col("n") >= 4, F.element_at("f", -4).cast("double").cast("long")).otherwise(F.col("row"))
    level = F.when(F.col("n") >= 5, F.element_at("f", -5).cast("double").cast("int")).otherwise(0)
    return parts.select("file", level.alias("level"), idx.alias("pt_id"), tail(-3).alias("x"), tail(-2).alias("y"), tail(-1).alias("z"))


def sun_points(spark: SparkSession, glob: str, suns: DataFrame, pattern: str = r"sun_(\d+)_points") -> DataFrame:
    """(sun_id, sx, sy, sz, sun_level, pt_id, level, x, y, z): the point files of all suns in one read; the id is in the file name."""
    points = read_points(spark, glob).withColumn("sun_id", F.regexp_extract("file", pattern, 1).cast("long")).drop("file")
    return points.join(suns.select("sun_id", "sx", "sy", "sz", F.col("level").alias("sun_level")), "sun_id")


def write_rays(rays: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rays by zone and source: reading one source or zone prunes folders."""
    rays.repartition("zone", "src", "pt_id").sortWithinPartitions("pt_id", "ray_id").write.mode(mode).partitionBy("zone", "src").parquet(path)


def read_rays(spark: SparkSession, path: str, points: DataFrame | None = None) -> DataFrame:
    """All rays, or those of the (zone, src, pt_id) rows in ``points``."""
    rays = spark.read.parquet(path)
    return rays.join(points.select("zone", "src", "pt_id").distinct(), ["zone", "src", "pt_id"], "left_semi") if points is not None else rays


def append_rays(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The stored rays and new ones, with solid angles reset (null) for a later ``solid_angles``."""
    return spark.read.parquet(path).unionByName(new).withColumn("omega", F.lit(None).cast("double"))


def write_sensors(contrib: DataFrame, path: str) -> None:
    contrib.write.mode("overwrite").partitionBy("zone", "src").parquet(path)


def read_sensors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(level, pt_id, sensor_id, patch, value) of blank-separated text; without a leading level column the level is 0."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).where(F.trim("value") != "").select(f.alias("f"))
    at = lambda k, kind: F.element_at("f", k).cast(kind)
    level = F.when(F.size("f") >= 5, at(-5, "int")).otherwise(0)
    return rows.select(level.alias("level"), at(-4, "long").alias("pt_id"), at(-3, "int").alias("sensor_id"), at(-2, "int").alias("patch"), at(-1, "double").alias("value"))


def write_sky(matrix: DataFrame, suns: DataFrame, times: DataFrame, path: str) -> None:
    """Coefficients, suns and times as three tables of one folder."""
    for name, df in (("matrix", matrix), ("suns", suns), ("times", times)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_sky(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(matrix, suns, times, side): the side comes from the number of patches."""
    matrix, suns, times = (spark.read.parquet(f"{path}/{n}") for n in ("matrix", "suns", "times"))
    ground = matrix.agg(F.max("patch")).first()[0]
    return matrix, suns, times, round((ground or 0) ** 0.5)


def sky_text(matrix: DataFrame, repeat: int = 1, sun: DataFrame | None = None) -> DataFrame:
    """(patch, line): a row per patch with one value per time in order, repeated per channel, as the text export has them.

    With ``sun`` (t, sun_rad) a last row, one patch beyond the others, holds the sun. A line is a row's whole text by definition."""
    times = matrix.select("t").distinct()
    patches = matrix.select("patch").distinct()
    values = patches.crossJoin(times).join(matrix, ["patch", "t"], "left").select("patch", "t", F.coalesce("coef", F.lit(0.0)).alias("coef"))
    if sun is not None:
        last = matrix.agg((F.max("patch") + 1).cast(matrix.schema["patch"].dataType).alias("patch"))
        values = values.unionByName(times.crossJoin(last).join(sun.select("t", "sun_rad"), "t", "left").select("patch", "t", F.coalesce("sun_rad", F.lit(0.0)).alias("coef")))
    text = F.array_join(F.array_repeat(F.format_string("%.5e", "coef"), repeat), "\t")
    return values.groupBy("patch").agg(F.array_sort(F.collect_list(F.struct("t", text.alias("s")))).alias("a")).select("patch", F.array_join(F.transform("a", lambda x: x["s"]), "\t").alias("line"))
