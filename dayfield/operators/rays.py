"""Rays of light points: solid angles, rasters, source views, and thinning of rasters over levels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import directions as d
from ..functions import glare
from ..session import scratch_folder
from . import grid
from .nearest import DXYZ, knn


def hemisphere_cells(spark, n: int, sphere: bool = False) -> DataFrame:
    """(cell, dx, dy, dz): centres of n * n equal-area cells of the upper hemisphere, or of 2 * n * n of the sphere."""
    cells = spark.range(n * n * (2 if sphere else 1)).select(F.col("id").alias("cell"))
    u, v = d.bin_uv(F.col("cell"), n)
    at = d.from_uv(u, v)
    return cells.select("cell", at.x.alias("dx"), at.y.alias("dy"), at.z.alias("dz"))


def view_cells(views: DataFrame, n: int) -> DataFrame:
    """(view, cell, dx, dy, dz): the square map of n * n equal-area pixels around each view direction (vx, vy, vz)."""
    pairs = views.select("view", "vx", "vy", "vz").crossJoin(F.broadcast(hemisphere_cells(views.sparkSession, n)))
    flat = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    rx, ry = F.coalesce(F.try_divide(-F.col("vy"), flat), F.lit(1.0)), F.coalesce(F.try_divide(F.col("vx"), flat), F.lit(0.0))
    ux, uy, uz = -F.col("vz") * ry, F.col("vz") * rx, F.col("vx") * ry - F.col("vy") * rx
    x = F.col("dx") * rx + F.col("dy") * ux + F.col("dz") * F.col("vx")
    y = F.col("dx") * ry + F.col("dy") * uy + F.col("dz") * F.col("vy")
    z = F.col("dy") * uz + F.col("dz") * F.col("vz")
    return pairs.select("view", "cell", x.alias("_x"), y.alias("_y"), z.alias("_z")).select("view", "cell", F.col("_x").alias("dx"), F.col("_y").alias("dy"), F.col("_z").alias("dz"))


def _cells_by_point(rays: DataFrame, n: int, sphere: bool = False) -> DataFrame:
    """Each point's cells with their nearest ray."""
    asked = rays.select("pt_id").distinct().crossJoin(F.broadcast(hemisphere_cells(rays.sparkSession, n, sphere)))
    return knn(asked, rays, "cell", "ray_id", DXYZ, 1, 2.0, ("pt_id",))


def solid_angles(rays: DataFrame, n: int = 64, few: int = 100, sphere: bool = False) -> DataFrame:
    """Rays with omega: the view's solid angle (2 pi, or 4 pi of the sphere) over N where a point has under ``few`` rays, else
    equal-area cells counted at their nearest ray. The sum over a point is the view's solid angle; the error of one ray shrinks
    with the cells; a repeated direction gets 0 but for the smallest id."""
    whole = 4 * math.pi if sphere else 2 * math.pi
    counted = rays.withColumn("_n", F.count("*").over(Window.partitionBy("pt_id")))
    area = 2 * math.pi / (n * n)
    many = counted.where(F.col("_n") >= few)
    cells = _cells_by_point(many, n, sphere).groupBy("pt_id", "ray_id").agg((F.count("*") * area).alias("omega"))
    shared = many.join(cells, ["pt_id", "ray_id"], "left").withColumn("omega", F.coalesce("omega", F.lit(0.0)))
    return counted.where(F.col("_n") < few).withColumn("omega", whole / F.col("_n")).unionByName(shared).drop("_n")


def view_raster(rays: DataFrame, views: DataFrame, n: int, sky: DataFrame | None = None, k: int = 1) -> DataFrame:
    """([sky,] pt_id, view, i, j, lum): each pixel's luminance from the point's nearest ray, or the mean of the k nearest weighted by
    exp(-d^2 / (2 mean d^2)).

    Neighbours are found once per (point, view, pixel); with ``sky`` (t, patch, coef) every ray (with its patch) then takes the
    coefficient of its patch at each time."""
    asked = rays.select("pt_id").distinct().crossJoin(view_cells(views, n)).withColumn("pixel", F.col("view") * n * n + F.col("cell"))
    near = knn(asked, rays, "pixel", "ray_id", DXYZ, k, 2.0, ("pt_id",))
    over = Window.partitionBy("pt_id", "pixel")
    d2 = F.col("dist") * F.col("dist")
    near = near.withColumn("w", F.coalesce(F.exp(-F.try_divide(d2, 2 * F.avg(d2).over(over))), F.lit(1.0)))
    lit = near.join(rays.select("pt_id", "ray_id", "lum", *(["patch"] if sky is not None else [])), ["pt_id", "ray_id"])
    keys = ["pt_id", "pixel"]
    if sky is not None:
        lit = lit.join(sky.select(F.col("t").alias("sky"), "patch", "coef"), "patch").withColumn("lum", F.col("lum") * F.col("coef"))
        keys = ["sky", *keys]
    mean = lit.groupBy(*keys).agg((F.sum(F.col("w") * F.col("lum")) / F.sum("w")).alias("lum"))
    cell = F.col("pixel") % (n * n)
    return mean.select(*keys[:-1], F.floor(F.col("pixel") / (n * n)).cast("int").alias("view"), F.floor(cell / n).cast("int").alias("i"), (cell % n).cast("int").alias("j"), "lum")


def pixel_rays(pixels: DataFrame, n: int) -> DataFrame:
    """Square-map pixels as rays of a zenith view: direction, omega, cos."""
    v = d.from_uv((F.col("i") + 0.5) / n, (F.col("j") + 0.5) / n)
    out = pixels.withColumns({"dx": v.x, "dy": v.y, "dz": v.z, "omega": F.lit(2 * math.pi / (n * n)), "cos": v.z})
    return out.withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0), "vz": F.lit(1.0)})


def peak_corrected(pixels: DataFrame, keys: list[str], area: float, blur: bool = False) -> DataFrame:
    """Pixels with the peak set to an expected solid angle: the brightest pixels whose running omega stays within ``area`` (one at
    least) take their common mean luminance, so energy stays; with ``blur`` they are then spread by the eye's point spread."""
    order = Window.partitionBy(*keys).orderBy(F.col("lum").desc(), "i", "j")
    run = pixels.withColumn("_run", F.sum("omega").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(order))
    run = run.withColumn("_peak", (F.col("_run") <= area * (1 + 1e-9)) | (F.col("_k") == 1))
    over = Window.partitionBy(*keys, "_peak")
    mean = F.sum(F.col("lum") * F.col("omega")).over(over) / F.sum("omega").over(over)
    out = run.withColumn("lum", F.when(F.col("_peak"), mean).otherwise(F.col("lum")))
    if blur:
        omega, lum = glare.spread_source(F.col("omega"), F.col("lum"))
        out = out.withColumn("_o", F.when(F.col("_peak"), omega).otherwise(F.col("omega"))).withColumn("_l", F.when(F.col("_peak"), lum).otherwise(F.col("lum")))
        out = out.withColumn("omega", F.col("_o")).withColumn("lum", F.col("_l")).drop("_o", "_l")
    return out.drop("_run", "_k", "_peak")


def cluster_vector(rays: DataFrame, dist: float, lerr: float) -> DataFrame:
    """Adds sx, sy, sz, the direction of the ray's source at its point (mean of its rays weighted by lum * omega), and wl: min-max
    luminance of the point's rays times dist / lerr."""
    over = Window.partitionBy("pt_id")
    lo, hi = F.min("lum").over(over), F.max("lum").over(over)
    w = F.col("lum") * F.col("omega")
    mean = rays.groupBy("pt_id", "src").agg(*(F.sum(F.col(f"d{c}") * w).alias(f"_{c}") for c in "xyz"))
    size = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    mean = mean.select("pt_id", "src", *(F.try_divide(F.col(f"_{c}"), size).alias(f"s{c}") for c in "xyz"))
    return rays.join(mean, ["pt_id", "src"]).withColumn("wl", F.when(hi > lo, (F.col("lum") - lo) / (hi - lo)).otherwise(F.col("lum")) * dist / lerr)


def appended(rays: DataFrame, new: DataFrame) -> DataFrame:
    """Rays and new rays; solid angles are reset."""
    return rays.unionByName(new).withColumn("omega", F.lit(None).cast("double"))


def new_directions(new: DataFrame, known: DataFrame, digits: int = 6) -> DataFrame:
    """Directions that are not among the known ones to ``digits`` decimals."""
    key = [F.round(c, digits).alias(f"_{c}") for c in DXYZ]
    return new.select("*", *key).join(known.select(*key).distinct(), [f"_{c}" for c in DXYZ], "left_anti")


def with_source_views(views: DataFrame, new: DataFrame, default: int = -1) -> DataFrame:
    """Source views with further ones; a missing source index is the default (-1, the last source)."""
    return views.unionByName(new.withColumn("src", F.coalesce("src", F.lit(default))))


def thin_raster(pixels: DataFrame, keys: list[str], levels: int, factor: int = 2, seed: int | None = None, values: DataFrame | None = None) -> DataFrame:
    """(keys, level, i, j, value): pixels that refinement asks for, coarse to fine.

    Level k sees the raster averaged over factor^(levels - 1 - k) pixels and keeps cells whose detail exceeds the level's threshold (on
    values normalised per raster); at level 0 all cells are kept. With a ``seed`` cells are drawn by detail instead. ``values`` (one raster
    i, j, value) replaces the averages by a bilinear look-up at the cells' centres. One job per level over all rasters; every
    level reads the pixels, so no level depends on another's state."""
    normed = grid.normalised(pixels, keys).select(*keys, "i", "j", F.col("norm").alias("value"))
    out = None
    for level in range(levels):
        step = factor ** (levels - 1 - level)
        coarse = normed.groupBy(*keys, F.floor(F.col("i") / step).cast("int").alias("i"), F.floor(F.col("j") / step).cast("int").alias("j")).agg(F.avg("value").alias("value"))
        limit = grid.threshold(level, levels)
        found = grid.detail(coarse, keys) if level else coarse
        kept = found if level == 0 else (grid.draw(found, keys, limit) if seed is None else grid.draw_weighted(found, keys, limit, seed=seed + level)).drop("detail")
        if values is not None:
            at = kept.select(*keys, "i", "j", F.concat_ws(":", *keys, "i", "j").alias("q_id"))
            centre = at.select("q_id", ((F.col("i") + 0.5) * step - 0.5).alias("i"), ((F.col("j") + 0.5) * step - 0.5).alias("j"))
            kept = at.join(grid.bilinear(centre, values), "q_id")
        kept = kept.withColumn("level", F.lit(level)).select(*keys, "level", "i", "j", "value")
        out = kept if out is None else out.unionByName(kept)
    return out


def _there(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def refine(pixels: DataFrame, keys: list[str], levels: int, size: int, factor: int = 2, seed: int | None = None, folder: str | None = None) -> DataFrame:
    """(keys, level, i, j, value): the refinement loop over rasters (keys, i, j, value) of ``size`` * ``size`` pixels, coarse to fine.

    Level 0 samples every cell. Each further level lifts the weights of the one before, draws the cells whose detail exceeds the level's
    threshold (by detail at random with a ``seed``), samples only these, by bilinear look-up at their centres in the raster normalised per
    key, and writes what it found into the weights; it ends early where nothing is drawn. So a level depends on what the level before kept.
    Samples and weights of each level are written to ``folder`` (a new shared one if not given), with a mark when they are complete: a run that
    is started again on the folder reads complete levels and goes on from there. A cell with a missing pixel takes the border's median."""
    spark = pixels.sparkSession
    folder = folder or scratch_folder(spark, "levels")
    normed = grid.normalised(pixels, keys).select(*keys, "i", "j", F.col("norm").alias("value"))
    weights, out = None, []
    for level in range(levels):
        at = f"{folder}/level-{level}"
        if _there(spark, f"{at}/complete") is None:
            step = factor ** (levels - 1 - level)
            if level == 0:
                cell = F.explode(F.sequence(F.lit(0), F.lit(size // step - 1)))
                lifted = normed.select(*keys).distinct().withColumn("i", cell).withColumn("j", cell).withColumn("value", F.lit(1.0))
                drawn = lifted
            else:
                lifted = grid.lift(weights, keys, factor)
                found, limit = grid.detail(lifted, keys), grid.threshold(level, levels)
                drawn = grid.draw(found, keys, limit) if seed is None else grid.draw_weighted(found, keys, limit, seed=seed + level)
            asked = drawn.select(*keys, F.struct("i", "j").alias("_cell"), ((F.col("i") + 0.5) * step - 0.5).alias("i"), ((F.col("j") + 0.5) * step - 0.5).alias("j"))
            seen = grid.bilinear(asked, normed, "_cell", keys).select(*keys, F.lit(level).alias("level"), F.col("_cell.i").cast("int").alias("i"), F.col("_cell.j").cast("int").alias("j"), "value")
            seen.write.mode("overwrite").parquet(f"{at}/samples")
            grid.updated(lifted, spark.read.parquet(f"{at}/samples"), keys).write.mode("overwrite").parquet(f"{at}/weights")
            spark.range(1).write.mode("overwrite").parquet(f"{at}/complete")
        samples, weights = spark.read.parquet(f"{at}/samples"), spark.read.parquet(f"{at}/weights")
        if not samples.limit(1).count():
            break
        out.append(samples)
    return reduce(DataFrame.unionByName, out) if out else normed.select(*keys, F.lit(0).alias("level"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value").limit(0)


def refined_rays(samples: DataFrame, key: str, levels: int, size: int, factor: int = 2, cells: int = 64, few: int = 100) -> DataFrame:
    """(pt_id, ray_id, dx, dy, dz, lum, omega): the samples of ``refine`` as rays of the hemisphere at their cells' centres, with their
    solid angles; ray_id is the level and the cell in one number."""
    n = F.lit(size) / F.pow(F.lit(float(factor)), F.lit(levels - 1) - F.col("level"))
    v = d.from_uv((F.col("i") + 0.5) / n, (F.col("j") + 0.5) / n)
    at = samples.select(F.col(key).alias("pt_id"), ((F.col("level").cast("long") * size + F.col("i")) * size + F.col("j")).alias("ray_id"), v.x.alias("dx"), v.y.alias("dy"), v.z.alias("dz"), F.col("value").alias("lum"))
    return solid_angles(at, cells, few)
