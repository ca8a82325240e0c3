"""Candidate suns and the grid of sun directions: layouts, solar boundary, cells and their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import directions as d
from ..functions import sky
from ..functions.draws import uniform, weighted_key
from . import zones

#: Columns of candidate tables by their number: what is sun direction, direct normal and so on.
LAYOUTS = {2: ("alt", "az"), 3: ("sx", "sy", "sz"), 4: ("sx", "sy", "sz", "dir_norm"), 5: ("month", "day", "hour", "dir_norm", "dif_horiz")}


def candidates(rows: DataFrame, columns: list[str], place: tuple[float, float, float] | None = None) -> DataFrame:
    """Suns above the horizon with sx, sy, sz and, where the layout has it, positive direct normal.

    The number of ``columns`` names the layout: 2 alt, az; 3 xyz; 4 xyz and direct normal; 5 month, day, hour, direct normal and
    diffuse, whose suns are computed for ``place`` (lat, lon, meridian). Another number is an error."""
    if len(columns) not in LAYOUTS:
        raise ValueError(f"no layout of {len(columns)} columns")
    named = rows.withColumns({n: F.col(c) for n, c in zip(LAYOUTS[len(columns)], columns, strict=True)})
    if len(columns) == 2:
        v = d.from_alt_az(F.col("alt"), F.col("az"))
        named = named.withColumns({"sx": v[0], "sy": v[1], "sz": v[2]})
    if len(columns) == 5:
        if place is None:
            raise ValueError("weather rows need a place")
        named = sky.sun_position(sky.to_utc(sky.timestamps(named.withColumns(dict(zip(("lat", "lon", "meridian"), map(F.lit, place), strict=True))))))
    kept = named.where("sz > 0")
    return kept.where("dir_norm > 0") if len(columns) >= 4 else kept


def sun_cells(suns: DataFrame, n: int) -> DataFrame:
    """``suns`` with i, j: cells of the square map of the upper hemisphere."""
    u, v = d.to_uv(d.Xyz(F.col("sx"), F.col("sy"), F.col("sz")))
    return suns.withColumn("i", d.cell(u, n)).withColumn("j", d.cell(v, n))


def in_solar_bounds(cells: DataFrame, boundary: DataFrame, n: int, include: str = "center") -> DataFrame:
    """Cells (i, j) of the n * n map that lie inside any ring of ``boundary``: by their centre, any corner or all corners.

    Corners are taken at a hundredth of the cell from its edge. ``boundary`` has a ring in plan (x, y) per station and is small:
    two solstice tracks each."""
    spots = {"center": [(0.5, 0.5)], "any": [(a, b) for a in (0.01, 0.99) for b in (0.01, 0.99)], "all": [(a, b) for a in (0.01, 0.99) for b in (0.01, 0.99)]}[include]
    asked = cells.select("i", "j").distinct().withColumn("_s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spots))))
    v = d.from_uv((F.col("i") + F.col("_s.a")) / n, (F.col("j") + F.col("_s.b")) / n)
    placed = asked.withColumn("_x", v.x).withColumn("_y", v.y)
    inside = placed.join(boundary.select("ring"), zones.in_ring(F.col("_x"), F.col("_y"), F.col("ring")), "left").groupBy("i", "j", "_s").agg((F.count("ring") > 0).alias("_in"))
    rule = F.bool_and("_in") if include == "all" else F.bool_or("_in")
    return cells.join(inside.groupBy("i", "j").agg(rule.alias("_in")).where("_in").select("i", "j"), ["i", "j"], "left_semi")


def sun_grid(spark: SparkSession, resolution: int, level: int = 0, jitter: int | None = None, held: DataFrame | None = None, boundary: DataFrame | None = None, include: str = "center") -> DataFrame:
    """(i, j, u, v, sx, sy, sz): cells of the square map with resolution * 2^level cells a side, at their centres or jittered by a seed;
    masked by candidates (``held``, with i and j) or by the solar boundary."""
    n = resolution * 2**level
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.col("id").cast("int").alias("code"))
    if held is not None:
        cells = cells.join(held.select("i", "j").distinct(), ["i", "j"], "left_semi")
    if boundary is not None:
        cells = in_solar_bounds(cells, boundary, n, include)
    u, v = d.bin_uv(F.col("code"), n) if jitter is None else d.jittered_uv(F.col("code"), n, jitter, "code")
    at = d.from_uv(F.col("u"), F.col("v"))
    return cells.withColumn("u", u).withColumn("v", v).select("i", "j", "u", "v", at.x.alias("sx"), at.y.alias("sy"), at.z.alias("sz"))


def candidate_per_cell(suns: DataFrame, n: int, sun_id: str, seed: int | None = None, invalid: int = -1) -> DataFrame:
    """(i, j, sun_id, gap): one candidate of each cell of the map, the nearest to its centre (in cells) or, with a seed, one drawn
    with a chance in proportion to that distance; cells without any have ``invalid`` and a null gap."""
    u, v = d.to_uv(d.Xyz(F.col("sx"), F.col("sy"), F.col("sz")))
    placed = sun_cells(suns, n).withColumn("_u", u * n - F.col("i") - 0.5).withColumn("_v", v * n - F.col("j") - 0.5)
    placed = placed.withColumn("gap", F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")))
    order = F.col("gap") if seed is None else weighted_key(uniform(seed, sun_id), F.greatest("gap", F.lit(1e-9)))
    best = placed.groupBy("i", "j").agg(F.min_by(F.struct(sun_id, "gap"), F.struct(order, sun_id)).alias("b"))
    cells = suns.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    return cells.join(best, ["i", "j"], "left").select("i", "j", F.coalesce(F.col(f"b.{sun_id}"), F.lit(invalid).cast(suns.schema[sun_id].dataType)).alias(sun_id), F.col("b.gap").alias("gap"))
