"""Integration: sky coefficients times stored contributions, per time and point, over the simulation types."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearest import XYZ, knn, nearest

SCALE = 179.0


def coefficient_product(sky: DataFrame, contrib: DataFrame, keys: list[str], value: str = "value", out: str = "value", channel: str | None = None, count: str | None = None) -> DataFrame:
    """(t, keys, [channel,] out[, count]): sum over patches of coef * value, for every pair of a time and a key that share a patch.

    A block product: keys and times are dealt into blocks by hash, blocks meet as (key block, time block), and each pair of blocks
    is one matrix product over the patches. A contribution is copied once per time block and a coefficient once per key block, so no
    row per (time, key, patch) exists before the sum, and there are as many tasks as block pairs, however few patches there are.
    Repeated rows of one patch add up; null keys are keys; null values and patches are left out. ``count`` names a column for the number of pairs of a coefficient and a
    contribution, which counts null values too; where all are null, so is the sum."""
    on = [channel] if channel else []
    keys = [k for k in keys if k not in on]
    time_blocks, key_blocks = _blocks(sky, ["t"]), _blocks(contrib, keys)
    known = lambda name: F.lit(True) if count else F.col(name).isNotNull()
    coefs = sky.where("patch is not null").where(known("coef")).select("t", "patch", F.col("coef").cast("double").alias("_v"), *on).withColumn("_tb", F.pmod(F.xxhash64("t"), F.lit(time_blocks)).cast("int"))
    rows = contrib.where("patch is not null").select(*keys, *on, "patch", F.col(value).cast("double").alias("_v")).where(known("_v"))
    rows = rows.withColumn("_kb", F.pmod(F.xxhash64(*keys), F.lit(key_blocks)).cast("int"))
    left = rows.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(time_blocks - 1))))
    right = coefs.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(key_blocks - 1))))
    schema = ", ".join([f"`t` {sky.schema['t'].dataType.simpleString()}", *(f"`{k}` {contrib.schema[k].dataType.simpleString()}" for k in [*keys, *on]), f"`{out}` double", *([f"`{count}` long"] if count else [])])
    return left.groupBy("_kb", "_to", *on).cogroup(right.groupBy("_of", "_tb", *on)).applyInArrow(lambda x, y: _product(x, y, keys, on, out, count), schema)


#: Times and keys in one block, about.
BLOCK = 2048


def _blocks(rows: DataFrame, keys: list[str]) -> int:
    return max(1, -(-(rows.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] or 0) // BLOCK))


def _coded(table: pa.Table, names: list[str]) -> tuple[np.ndarray, pa.Table]:
    """(code of each row, the distinct rows of ``names`` by code)."""
    codes = np.zeros(table.num_rows, np.int64)
    for n in names:
        part = table.column(n).combine_chunks().dictionary_encode(null_encoding="encode")
        part = part.chunk(0) if isinstance(part, pa.ChunkedArray) else part
        codes = np.unique(codes * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, table.select(names).take(pa.array(first))


def _product(left: pa.Table, right: pa.Table, keys: list[str], on: list[str], out: str, count: str | None = None) -> pa.Table:
    """Keys x patches times patches x times; pairs without a common patch give no row."""
    if not left.num_rows or not right.num_rows:
        left, right = left.slice(0, 0), right.slice(0, 0)
    patches = np.union1d(left.column("patch").to_numpy(), right.column("patch").to_numpy())
    row, named = _coded(left, keys)
    column, times = _coded(right, ["t"])
    a, b = np.zeros((named.num_rows, len(patches))), np.zeros((len(patches), times.num_rows))
    p, q = np.searchsorted(patches, left.column("patch").to_numpy()), np.searchsorted(patches, right.column("patch").to_numpy())
    (one, known), (two, met) = ((pc.fill_null(t.column("_v"), 0.0).to_numpy(), pc.is_valid(t.column("_v")).to_numpy()) for t in (left, right))
    np.add.at(a, (row, p), one)
    np.add.at(b, (q, column), two)
    has_a, has_b = np.zeros(a.shape, np.float32), np.zeros(b.shape, np.float32)
    has_a[row[known], p[known]], has_b[q[met], column[met]] = 1, 1
    has = has_a @ has_b
    if count:
        all_a, all_b = np.zeros(a.shape), np.zeros(b.shape)
        np.add.at(all_a, (row, p), 1)
        np.add.at(all_b, (q, column), 1)
        pairs = all_a @ all_b
    i, j = np.nonzero(pairs if count else has)
    values = pa.array((a @ b)[i, j], mask=has[i, j] == 0)
    columns = {"t": times.column("t").take(pa.array(j))} | {k: named.column(k).take(pa.array(i)) for k in keys}
    columns |= {c: pa.array([left.column(c)[0].as_py()] * len(i), left.column(c).type) if left.num_rows else left.column(c) for c in on}
    return pa.table(columns | {out: values} | ({count: pa.array(pairs[i, j].astype(np.int64))} if count else {}))


def dense_product(sky_arrays: DataFrame, ray_arrays: DataFrame, keys: list[str]) -> DataFrame:
    """The same over array columns: ``coefs`` per time and ``lums`` per key, both ordered by patch. A row per time and key by definition."""
    pairs = sky_arrays.crossJoin(ray_arrays)
    return pairs.select("t", *keys, F.aggregate(F.zip_with("coefs", "lums", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("value"))


def as_arrays(rows: DataFrame, keys: list[str], value: str, n: int, out: str) -> DataFrame:
    """Dense arrays of ``n`` patches per key, 0 where there is no row."""
    found = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("patch", value))).alias("m"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias(out))


def with_sun_patch(sky: DataFrame, sun: DataFrame, include_sky: bool = True) -> DataFrame:
    """Sky coefficients with the sun's share added to its patch, or the sun's share alone."""
    share = sun.select("t", "patch", F.col("patch_rad").alias("coef"))
    return (sky.select("t", "patch", "coef").unionByName(share) if include_sky else share).groupBy("t", "patch").agg(F.sum("coef").alias("coef"))


def coefficients(sky: DataFrame, sun: DataFrame, plane: str, has_sun: bool = True) -> DataFrame:
    """(t, patch, coef): the coefficients that a plane takes over the grid: ``sky``, ``sun`` (disc radiance on the sun's patch), ``patch``
    (the sun's share of its patch), or sky and patch together (``sky`` where there is no sun plane)."""
    if plane == "sky":
        return sky.select("t", "patch", "coef") if has_sun else with_sun_patch(sky, sun)
    if plane == "sun":
        return sun.select("t", "patch", F.col("sun_rad").alias("coef"))
    if plane == "patch":
        return with_sun_patch(sky, sun, False)
    raise ValueError(f"no coefficients for a plane {plane!r}")


def sun_lookups(sun: DataFrame, least: float = 0.0) -> DataFrame:
    """Times with an active sun: only these look up sun planes."""
    return sun.where(F.col("sun_rad") > least)


def direct_difference(contrib_sky: DataFrame, contrib_direct: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, patch, value): max(sky - direct, 0) per patch; a missing direct contribution is 0."""
    direct = contrib_direct.select(*keys, "patch", F.col("value").alias("direct"))
    return contrib_sky.join(direct, [*keys, "patch"], "left").select(*keys, "patch", F.greatest(F.col("value") - F.coalesce("direct", F.lit(0.0)), F.lit(0.0)).alias("value"))


def time_by_point(times: DataFrame, points: DataFrame, planes: dict[str, DataFrame], sun: DataFrame | None = None, own: bool = False) -> DataFrame:
    """(t, q_id, <plane>_pt..): every time with every point, and the point's nearest row in each plane, found once per point.

    Ties go to the smaller id; with ``own``, ids of points and planes mean the same, and a point that is itself a row of the plane takes itself
    where others share its place.

    With ``sun`` (t, patch), direct views get the patch of the time's sun as ``sun_patch``; null where no sun is up."""
    found = points
    if sun is not None:
        times = times.join(sun_lookups(sun).select("t", F.col("patch").alias("sun_patch")), "t", "left")
    for name, plane in planes.items():
        near = nearest(points, plane, "q_id", "pt_id", XYZ, 10.0).select("q_id", F.col("pt_id").alias(f"{name}_pt"), F.col("dist").alias(f"{name}_err"))
        if own:
            itself = points.select("q_id", *XYZ).join(plane.select(F.col("pt_id").alias("q_id"), *XYZ), ["q_id", *XYZ], "left_semi").select("q_id", F.lit(True).alias("_own")).distinct()
            kind = plane.schema["pt_id"].dataType
            near = near.join(itself, "q_id", "left").select("q_id", F.when(F.col("_own"), F.col("q_id").cast(kind)).otherwise(F.col(f"{name}_pt")).alias(f"{name}_pt"), f"{name}_err")
        found = found.join(near, "q_id")
    return times.crossJoin(found)


def summed_products(terms: list[tuple[DataFrame, DataFrame]], keys: list[str]) -> DataFrame:
    """(t, keys, value): the sum of the products of (coefficients, contributions).

    The patches of each term are numbered apart, so one product sums over terms as it does over patches, and no row per time and key is grouped again."""
    apart = lambda i: (F.col("patch").cast("long") * len(terms) + i).alias("patch")
    coefs = reduce(DataFrame.unionByName, [sky.select("t", apart(i), F.col("coef").cast("double").alias("coef")) for i, (sky, _) in enumerate(terms)])
    rows = reduce(DataFrame.unionByName, [contrib.select(*keys, apart(i), F.col("value").cast("double").alias("value")) for i, (_, contrib) in enumerate(terms)])
    return coefficient_product(coefs, rows, keys)


#: Terms of each simulation type: (plane, coefficients).
SIMTYPES: dict[str, tuple[tuple[str, str], ...]] = {
    "1comp": (("sky", "sky+sun"),),
    "skyonly": (("sky", "sky"),),
    "sunpatch": (("sky", "sun patch"),),
    "2comp": (("sky", "sky"), ("sun", "sun")),
    "3comp": (("sky", "sky"), ("difference", "sun patch"), ("sun", "sun")),
    "1compdv": (("sky", "sky"), ("difference", "real sun patch"), ("views", "sun")),
    "directview": (("views", "sun"),),
    "sunonly": (("sun", "sun"),),
    "directpatch": (("direct", "sun patch"),),
}


def simulate(simtype: str, sky: DataFrame, sun: DataFrame, planes: dict[str, DataFrame], scale: float = SCALE, real_sun: DataFrame | None = None) -> DataFrame:
    """(t, pt_id, sensor_id, illum): the sum of a simulation type's terms.

    ``planes``: sky and direct have (pt_id, sensor_id, patch, value); sun and views (pt_id, sensor_id, patch, value), where the patch
    says which suns they stand for; difference is made of sky and direct. A type that is not listed is one fixed plane of
    that name with coefficient 1. A missing plane is an error. All terms are one product (``summed_products``).

    ``sun`` says on which patch the sampled sun that stands for each time lies; ``real_sun`` (the same columns, ``sun`` if not
    given) on which patch the sun itself does: 1compdv takes the patch to be replaced from the real sun, 3comp from the sampled one."""
    terms = SIMTYPES.get(simtype)
    if terms is None:
        if simtype not in planes:
            raise ValueError(f"no plane {simtype!r}")
        fixed = planes[simtype].groupBy("pt_id", "sensor_id").agg((F.sum("value") * scale).alias("illum"))
        return sky.select("t").distinct().crossJoin(fixed)
    if "difference" in {p for p, _ in terms} and "difference" not in planes:
        if not {"sky", "direct"} <= planes.keys():
            raise ValueError("the difference needs the planes sky and direct")
        planes = planes | {"difference": direct_difference(planes["sky"], planes["direct"], ["pt_id", "sensor_id"])}
    if missing := [p for p, _ in terms if p not in planes]:
        raise ValueError(f"missing planes: {missing}")
    coefs = {
        "sky": sky.select("t", "patch", "coef"),
        "sky+sun": with_sun_patch(sky, sun),
        "sun patch": with_sun_patch(sky, sun, False),
        "real sun patch": with_sun_patch(sky, sun if real_sun is None else real_sun, False),
        "sun": sun.select("t", "patch", F.col("sun_rad").alias("coef")),
    }
    found = summed_products([(coefs[kind], planes[plane]) for plane, kind in terms], ["pt_id", "sensor_id"])
    return found.select("t", "pt_id", "sensor_id", (F.col("value") * scale).alias("illum"))


def sensor_sum(planes: list[tuple[str, DataFrame, float]], sky: DataFrame, sun: DataFrame, scale: float = SCALE) -> DataFrame:
    """(t, pt_id, sensor_id, illum) from planes (kind, contributions, factor) with kind sky, skysun, patch, sun or fixed."""
    kinds = {"sky": sky.select("t", "patch", "coef"), "skysun": with_sun_patch(sky, sun), "patch": with_sun_patch(sky, sun, False), "sun": sun.select("t", "patch", F.col("sun_rad").alias("coef"))}
    keys = ["pt_id", "sensor_id"]
    if unknown := [kind for kind, _, _ in planes if kind != "fixed" and kind not in kinds]:
        raise ValueError(f"unknown plane kind {unknown[0]!r}")
    scaled = lambda contrib, factor: contrib.withColumn("value", F.col("value") * factor * scale)
    terms = [(kinds[kind], scaled(contrib, factor)) for kind, contrib, factor in planes if kind != "fixed"]
    fixed = [sky.select("t").distinct().crossJoin(scaled(contrib, factor).groupBy(*keys).agg(F.sum("value").alias("value"))) for kind, contrib, factor in planes if kind == "fixed"]
    parts = ([summed_products(terms, keys)] if terms else []) + fixed
    if len(parts) == 1:
        return parts[0].select("t", *keys, F.col("value").alias("illum"))
    return reduce(DataFrame.unionByName, parts).groupBy("t", *keys).agg(F.sum("value").alias("illum"))


def at_points(evaluated: DataFrame, points: DataFrame, plane: DataFrame, values: list[str]) -> DataFrame:
    """Values per plane point brought to query points: nearest once per point, then a join; point_err is the distance."""
    near = nearest(points, plane, "q_id", "pt_id", XYZ, 10.0)
    return evaluated.join(near, "pt_id").select("t", "q_id", "pt_id", *values, F.col("dist").alias("point_err"))


def zonal_points(times: DataFrame, chosen: DataFrame, fixed: DataFrame) -> DataFrame:
    """(t, pt_id, x, y, z, error_deg): times with an active sun take the points chosen for it, the others the fixed points.

    ``times`` has t and sun_rad; ``chosen`` has t, the points and the error of their sun."""
    active = times.where("sun_rad > 0").select("t").join(chosen, "t").select("t", "pt_id", "x", "y", "z", "error_deg")
    idle = times.where("not coalesce(sun_rad > 0, false)").select("t").crossJoin(fixed).select("t", "pt_id", "x", "y", "z", F.lit(0.0).alias("error_deg"))
    return active.unionByName(idle)


def union_of_rays(left: DataFrame, right: DataFrame, merge: float = 1e-6, summed: bool = False) -> DataFrame:
    """(pt_id, ray_id, side, dx, dy, dz, lum_l, lum_r[, lum]): the rays of two sources at one point.

    Rays of ``right`` that lie within ``merge`` of one of ``left`` are that ray; every other ray takes the value of the nearest
    ray of the other source at its point."""
    coords = ("dx", "dy", "dz")
    l2r = knn(left, right.withColumnRenamed("ray_id", "other"), "ray_id", "other", coords, 1, 2.0, ("pt_id",))
    r2l = knn(right, left.withColumnRenamed("ray_id", "other"), "ray_id", "other", coords, 1, 2.0, ("pt_id",))
    values = lambda df: df.select("pt_id", F.col("ray_id").alias("other"), F.col("lum").alias("_lum"))
    a = left.join(l2r, ["pt_id", "ray_id"], "left").join(values(right), ["pt_id", "other"], "left").select("pt_id", "ray_id", F.lit("l").alias("side"), *coords, F.col("lum").alias("lum_l"), F.coalesce("_lum", F.lit(0.0)).alias("lum_r"))
    b = right.join(r2l, ["pt_id", "ray_id"], "left").where(F.col("dist").isNull() | (F.col("dist") > merge)).join(values(left), ["pt_id", "other"], "left").select("pt_id", "ray_id", F.lit("r").alias("side"), *coords, F.coalesce("_lum", F.lit(0.0)).alias("lum_l"), F.col("lum").alias("lum_r"))
    both = a.unionByName(b)
    return both.withColumn("lum", F.col("lum_l") + F.col("lum_r")) if summed else both


def provenance(grid: DataFrame, planes: list[str]) -> DataFrame:
    """(t, q_id, metric, value): the plane point and its distance as further metrics."""
    wide = grid.select("t", "q_id", *(F.col(f"{p}_err").cast("double") for p in planes), *(F.col(f"{p}_pt").cast("double") for p in planes))
    return wide.unpivot(["t", "q_id"], [c for p in planes for c in (f"{p}_err", f"{p}_pt")], "metric", "value")


def summed_sources(evaluated: DataFrame, key: str = "src") -> DataFrame:
    """Additive metrics of several sources of one point as one value."""
    return evaluated.groupBy(*(c for c in evaluated.columns if c not in (key, "value"))).agg(F.sum("value").alias("value"))


def sensors(points: DataFrame, offsets: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """(pt_id, sensor_id, x, y, z, dx, dy, dz): offsets x directions at every point; both lists are short and given by the caller.

    ``offsets`` may hold complete sensors (o_id, ox, oy, oz, dx, dy, dz); ``directions`` is then left out."""
    if directions is None:
        local = offsets.withColumn("sensor_id", F.col("o_id").cast("int"))
        return points.crossJoin(local).select("pt_id", "sensor_id", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), (F.col("z") + F.col("oz")).alias("z"), "dx", "dy", "dz")
    local = offsets.crossJoin(directions).withColumn("sensor_id", F.col("o_id") * 1000 + F.col("d_id"))
    return points.crossJoin(local).select("pt_id", "sensor_id", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), (F.col("z") + F.col("oz")).alias("z"), "dx", "dy", "dz")
