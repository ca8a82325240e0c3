"""Zones in plan: containment, extents, borders, grids and area shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import directions as d
from ..functions.draws import uniform
from .nearest import nearest


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over array<struct<x, y>>; an edge counts where it crosses the ray to the right of the point."""
    n = F.size(ring)
    edges = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(ring, (i + 1) % n)["x"].alias("x1"), F.get(ring, (i + 1) % n)["y"].alias("y1")))
    crosses = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * F.try_divide(y - e["y0"], e["y1"] - e["y0"]) + e["x0"])
    return F.aggregate(edges, F.lit(0), lambda s, e: s + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


def in_zone(points: DataFrame, zones: DataFrame, how: str = "left_semi") -> DataFrame:
    """Points inside any ring of their zone. ``zones`` is (zone, ring_id, ring); a box test goes before the crossing count."""
    boxed = zones.select(
        "zone", "ring",
        F.array_min(F.transform("ring", lambda p: p["x"])).alias("_lox"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("_hix"),
        F.array_min(F.transform("ring", lambda p: p["y"])).alias("_loy"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("_hiy"),
    )
    box = F.col("x").between(F.col("_lox"), F.col("_hix")) & F.col("y").between(F.col("_loy"), F.col("_hiy"))
    same = points["zone"] == boxed["zone"]
    return points.join(boxed, same & box & in_ring(F.col("x"), F.col("y"), F.col("ring")), how)


def extents(zones: DataFrame) -> DataFrame:
    """(zone, x0, y0, x1, y1, cx, cy, z): box, centre and median height of all vertices."""
    return box_of(zones.select("zone", "z", F.explode("ring").alias("p")).select("zone", "p.x", "p.y", "z"))


def box_of(points: DataFrame) -> DataFrame:
    """``extents`` of the points (zone, x, y, z) themselves."""
    return points.groupBy("zone").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.percentile_approx("z", 0.5).alias("z")).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def long_axis(zones: DataFrame) -> DataFrame:
    """(zone, rotation): angle in degrees of the edge from the lowest to the rightmost vertex, or from the leftmost to the lowest, whichever is longer."""
    return long_axis_of(zones.select("zone", F.explode("ring").alias("p")).select("zone", "p.x", "p.y"))


def long_axis_of(points: DataFrame) -> DataFrame:
    """``long_axis`` of the points (zone, x, y) themselves."""
    ends = points.groupBy("zone").agg(F.min_by(F.struct("x", "y"), F.struct("y", "x")).alias("s"), F.max_by(F.struct("x", "y"), F.struct("x", "y")).alias("e"), F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("w"))
    east = F.hypot(F.col("e.x") - F.col("s.x"), F.col("e.y") - F.col("s.y"))
    west = F.hypot(F.col("s.x") - F.col("w.x"), F.col("s.y") - F.col("w.y"))
    turn = lambda a, b: F.degrees(F.atan2(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x")))
    return ends.select("zone", F.when(east >= west, turn("s", "e")).otherwise(turn("w", "s")).alias("rotation"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains; points on an edge are left out."""
    xy, chains = np.unique(xy, axis=0), []
    if len(xy) < 3:
        return xy
    for rows in (xy, xy[::-1]):
        chain: list = []
        for p in rows:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 1e-9:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def border(points: DataFrame, offset: float, parts: int = 64) -> DataFrame:
    """(zone, ring): convex hull of the points widened by a square of ``offset``; fewer than four points work the same way.

    Each zone's points are dealt into ``parts`` groups, each group gives its own hull, and the zone's hull is that of all these
    vertices, so no group holds a whole zone's points."""
    kind = points.schema["zone"].dataType.simpleString()

    def part_hull(group: pd.DataFrame) -> pd.DataFrame:
        found = _hull(group[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"zone": [group["zone"].iloc[0]] * len(found), "x": found[:, 0], "y": found[:, 1]})

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        xy = group[["x", "y"]].to_numpy()
        found = _hull(np.concatenate([xy + (sx * offset, sy * offset) for sx in (-1, 1) for sy in (-1, 1)]))
        return pd.DataFrame({"zone": [group["zone"].iloc[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in found]]})

    dealt = points.select("zone", "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).alias("_part"))
    vertices = dealt.groupBy("zone", "_part").applyInPandas(part_hull, f"zone {kind}, x double, y double")
    return vertices.groupBy("zone").applyInPandas(hull, f"zone {kind}, ring array<struct<x:double,y:double>>")


def masked_zone(points: DataFrame, zones: DataFrame, valid: DataFrame, size: float) -> DataFrame:
    """Points inside their zone whose grid cell is one of the cells that the points of ``valid`` (x, y) fall in."""
    cell = lambda: [F.floor(F.col(c) / size).alias(f"_{c}") for c in "xy"]
    return in_zone(points, zones).select("*", *cell()).join(valid.select(*cell()).distinct(), ["_x", "_y"], "left_semi").drop("_x", "_y")


def plan_grid(zones: DataFrame, resolution: float, level: int = 0, jitter: int | None = None, masked: bool = True, snap: bool = False, static: DataFrame | None = None) -> DataFrame:
    """(zone, i, j, x, y, z): cell centres of size resolution / 2^level over each zone's box, kept inside the zone if ``masked``.

    ``jitter`` is a seed: each point lies anywhere in its cell. ``snap`` starts the cells at multiples of their size instead of the
    box. ``static`` (zone, x, y, z) takes the place of the cells at level 0 in the zones that it has points for."""
    size = resolution / 2**level
    box = extents(zones)
    if snap:
        box = box.withColumns({f"{c}0": F.floor(F.round(F.col(f"{c}0") / size, 9)) * size for c in "xy"})
    count = lambda c: F.greatest(F.ceil(F.round((F.col(f"{c}1") - F.col(f"{c}0")) / size, 9)), F.lit(1)).cast("int")
    cells = box.withColumn("i", F.explode(F.sequence(F.lit(0), count("x") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), count("y") - 1)))
    shift = (lambda k: uniform(jitter + k, "zone", "i", "j")) if jitter is not None else (lambda k: F.lit(0.5))
    out = cells.select("zone", "i", "j", (F.col("x0") + (F.col("i") + shift(0)) * size).alias("x"), (F.col("y0") + (F.col("j") + shift(1)) * size).alias("y"), "z")
    out = in_zone(out, zones) if masked else out
    if static is not None and level == 0:
        at = static.join(box.select("zone", "x0", "y0"), "zone").select("zone", *(F.floor((F.col(c) - F.col(f"{c}0")) / size).cast("int").alias(n) for c, n in (("x", "i"), ("y", "j"))), "x", "y", "z")
        out = out.join(static.select("zone").distinct(), "zone", "left_anti").unionByName(at)
    return out


def uv_of(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds u, v: position in the zone's box after turning it back by its rotation."""
    box = extents(zones).join(zones.select("zone", "rotation").distinct(), "zone")
    turned = points.join(box.select("zone", "x0", "y0", "x1", "y1", "cx", "cy", "rotation"), "zone")
    x, y = d.rotate_z(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), -F.col("rotation"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return turned.withColumn("u", (x + F.col("cx") - F.col("x0")) / side).withColumn("v", (y + F.col("cy") - F.col("y0")) / side).drop("x0", "y0", "x1", "y1", "cx", "cy", "rotation")


def area_shares(points: DataFrame, zones: DataFrame, resolution: float) -> DataFrame:
    """(zone, pt_id, area): zone cells counted at their nearest point times the cell area; areas add up to the zone's cells."""
    cells = plan_grid(zones, resolution).withColumn("cell_id", F.concat_ws(":", "zone", "i", "j"))
    one = cells.select("zone").distinct()
    near = nearest(cells, points, "cell_id", "pt_id", ("x", "y"))
    counted = cells.select("zone", "cell_id").join(near, "cell_id").groupBy("zone", "pt_id").agg((F.count("*") * resolution * resolution).alias("area"))
    return one.crossJoin(points.select("pt_id")).join(counted, ["zone", "pt_id"], "left").select("zone", "pt_id", F.coalesce("area", F.lit(0.0)).alias("area"))


def thin(points: DataFrame, zones: DataFrame, tolerance: float) -> DataFrame:
    """Points inside the zone with near-duplicates dropped: of two points within ``tolerance`` the one with the smaller id stays."""
    from .nearest import within

    inside = in_zone(points, zones).select(*points.columns)
    keyed = inside.withColumn("_k", F.struct("zone", "pt_id"))
    close = within(keyed, keyed.withColumnRenamed("_k", "_o"), "_k", "_o", tolerance, ("x", "y", "z")).where("_o.zone = _k.zone and _o.pt_id < _k.pt_id")
    return inside.join(close.select("_k.zone", "_k.pt_id").distinct(), ["zone", "pt_id"], "left_anti")


def fixed_points(points: DataFrame, zones: DataFrame, tolerance: float, resolution: float) -> DataFrame:
    """(zone, pt_id, x, y, z, area): ``thin`` points of each zone with a null area; a zone that none is left for has one point with
    id -1, its centre, and the zone's area (by cells of ``resolution``)."""
    kept = thin(points, zones, tolerance).select("zone", "pt_id", "x", "y", "z", F.lit(None).cast("double").alias("area"))
    cells = plan_grid(zones, resolution).groupBy("zone").agg((F.count("*") * resolution * resolution).alias("area"))
    centre = extents(zones).select("zone", F.lit(-1).cast("long").alias("pt_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "z").join(cells, "zone")
    return kept.unionByName(centre.join(kept.select("zone").distinct(), "zone", "left_anti"))
