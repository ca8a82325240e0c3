"""Interpolation between rays and over time."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import uniform
from . import zones
from .nearest import DXYZ, kept, knn_lists


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; a column would be put into the functions of array elements, and computed for each of them."""
    return F.transform(F.array(value), body)[0]


def _mean(values: Column) -> Column:
    """The mean of the values of an array that are not null."""
    return _let(F.filter(values, lambda x: x.isNotNull()), lambda known: F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))


def _of(name: str) -> Column:
    return F.transform("near", lambda x: x[name])


def _with(name: str, value: Callable[[Column], Column]) -> Column:
    return F.transform("near", lambda x: x.withField(name, value(x)))


def knn_weights(lists: DataFrame, with_lum: bool = False) -> DataFrame:
    """Adds w to each neighbour in near (``nearest.knn_lists``): exp(-d^2 / (2 mean d^2)), times the same on luminance deviation if asked (1 where the
    variance is 0)."""
    weight = lambda x, d2: F.coalesce(F.exp(-F.try_divide(x["dist"] * x["dist"], 2 * d2)), F.lit(1.0))
    square = _mean(F.transform("near", lambda x: x["dist"] * x["dist"]))
    if not with_lum:
        return lists.withColumn("near", _let(square, lambda d2: _with("w", lambda x: weight(x, d2))))
    gap = lambda x, lum: (x["lum"] - lum) * (x["lum"] - lum)
    both = lambda x, d2, lum, var: weight(x, d2) * F.when(var > 0, F.exp(-gap(x, lum) / (2 * var))).otherwise(1.0)
    spread = lambda lum: _mean(F.transform("near", lambda x: gap(x, lum)))
    of = lambda d2: _let(_mean(_of("lum")), lambda lum: _let(spread(lum), lambda var: _with("w", lambda x: both(x, d2, lum, var))))
    return lists.withColumn("near", _let(square, of))


def with_theta(lists: DataFrame) -> DataFrame:
    """Adds theta to each neighbour: its angle around the query direction, in the plane across it. Both have dx, dy, dz."""
    flat = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    axis = F.struct(F.coalesce(F.try_divide(-F.col("dy"), flat), F.lit(1.0)).alias("x"), F.coalesce(F.try_divide(F.col("dx"), flat), F.lit(0.0)).alias("y"))
    dz = F.col("dz")
    right = lambda x, r: x["dx"] * r["x"] + x["dy"] * r["y"]
    up = lambda x, r: -x["dx"] * dz * r["y"] + x["dy"] * dz * r["x"] + x["dz"] * (F.col("dx") * r["y"] - F.col("dy") * r["x"])
    return lists.withColumn("near", _let(axis, lambda r: _with("theta", lambda x: F.atan2(up(x, r), right(x, r)))))


def angle_weights(lists: DataFrame) -> DataFrame:
    """Adds wa to each neighbour: circular spacing by angle: a[i+1]/3 + a[i+2]/6 - a[i-1]/3 - a[i-2]/6, wrapped at 2 pi; near is then sorted by
    theta (``with_theta``)."""
    ordered = F.array_sort(F.transform("near", lambda x: F.struct(x["theta"].alias("theta"), x["ray_id"].alias("ray_id"), x.alias("n"))))

    def at(a, i, step: int):
        j = i + step
        return F.get(a, F.pmod(j, F.size(a)).cast("int"))["theta"] + 2 * math.pi * F.floor(j / F.size(a))

    spaced = lambda a: F.transform(a, lambda x, i: x["n"].withField("wa", at(a, i, 1) / 3 + at(a, i, 2) / 6 - at(a, i, -1) / 3 - at(a, i, -2) / 6))
    return lists.withColumn("near", _let(ordered, spaced))


def knn_interpolate(queries: DataFrame, rays: DataFrame, k: int = 10, with_lum: bool = False, with_content: bool = False, with_angle: bool = False, seed: int | None = None, distinct: bool = True) -> DataFrame:
    """(q_id, lum): weighted mean of the k nearest rays, weights by distance, luminance (``with_lum``) and angle (``with_angle``).

    ``with_content``, neighbours of other content (``content_matches``) weigh .001. With a ``seed`` one neighbour is drawn by
    weight instead of the mean. A query's neighbours stay in its row, so nothing is grouped again."""
    carry = ("lum", *(DXYZ if with_angle else ()), *(CONTENT if with_content else ()))
    lists = knn_lists(queries.select("q_id", *DXYZ, *(CONTENT if with_content else ())), rays, "q_id", "ray_id", DXYZ, k, carry, 2.0, distinct=distinct)
    weighted = knn_weights(lists, with_lum)
    if with_angle:
        weighted = angle_weights(with_theta(weighted)).withColumn("near", _with("w", lambda x: x["w"] * x["wa"]))
    if with_content:
        weighted = content_matches(weighted).withColumn("near", _with("w", lambda x: x["w"] * F.when(x["match"], 1.0).otherwise(0.001)))
    if seed is not None:
        drawn = dithered(weighted.withColumn("_all", F.col("near")), seed, keep=("_all",))
        return drawn.select("q_id", F.filter("_all", lambda x: x["ray_id"] == F.col("ray_id"))[0]["lum"].alias("lum"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    mean = F.try_divide(total(F.transform("near", lambda x: x["w"] * x["lum"])), total(_of("w")))
    return weighted.select("q_id", F.when(F.exists(_of("lum"), lambda x: x.isNotNull()), mean).alias("lum"))


def dithered(lists: DataFrame, seed: int = 42, q_id: str = "q_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One neighbour per query, drawn by its weight w: the first by rank whose running share reaches a random number of the query."""
    kind = lists.schema["near"].dataType.elementType["ray_id"].dataType
    ranked = F.array_sort(F.transform("near", lambda x: F.struct(x["rank"].alias("rank"), x["w"].alias("w"), x["ray_id"].alias("ray_id"))))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast(kind).alias("hit"))
    step = lambda goal: lambda a, x: F.struct((a["run"] + x["w"]).alias("run"), F.coalesce(a["hit"], F.when(a["run"] + x["w"] >= goal, x["ray_id"])).alias("hit"))
    goal = lambda a: uniform(seed, q_id) * F.aggregate(a, F.lit(0.0), lambda n, x: n + x["w"])
    drawn = _let(ranked, lambda a: _let(goal(a), lambda g: F.aggregate(a, start, step(g), lambda n: n["hit"])))
    return lists.select(q_id, drawn.alias("ray_id"), *keep).where("ray_id is not null")


#: What tells the content of a direction: material, normal and distance.
CONTENT = ("material", "nx", "ny", "nz", "depth")


def content_matches(lists: DataFrame, normal_deg: float = 5.0, distance: float = 0.5) -> DataFrame:
    """Adds match to each neighbour: of the same material, normal within ``normal_deg`` per axis and distance within ``distance``;
    the nearest where none matches. Queries and neighbours have the columns CONTENT."""
    edge = math.sin(math.radians(normal_deg))

    def same(x: Column) -> Column:
        near = [F.abs(F.col(c) - x[c]) <= (distance if c == "depth" else edge) for c in CONTENT[1:]]
        return F.coalesce(reduce(lambda a, b: a & b, near, F.col("material") == x["material"]), F.lit(False))

    nearest_one = lambda m: F.transform(m, lambda x: x.withField("match", x["rank"] == 1))
    return lists.withColumn("near", _let(_with("match", same), lambda m: F.when(F.exists(m, lambda x: x["match"]), m).otherwise(nearest_one(m))))


#: Corners of a hull that every task may hold.
HULL = 100_000


def _enclosed(queries: DataFrame, points: DataFrame) -> DataFrame | None:
    """Queries with inside: within the convex hull of all points, or on it; None where the hull has too many corners to be sent to every task."""
    ring = zones.border(points.select(F.lit(0).alias("zone"), "x", "y"), 0.0).select(F.explode("ring").alias("p")).select("p.x", "p.y").limit(HULL + 1).toArrow()
    if ring.num_rows > HULL:
        return None
    corners = np.array([ring.column(c).to_numpy() for c in "xy"]).T
    held = queries.sparkSession.sparkContext.broadcast(corners)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        edge = np.roll(at, -1, axis=0) - at
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in "xy")
            within = np.full(len(x), len(at) > 2)
            for (px, py), (ex, ey) in zip(at, edge, strict=True):
                within &= ex * (y - py) - ey * (x - px) >= -1e-9
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], [*batch.schema.names, "inside"])

    return queries.mapInArrow(inside, T.StructType([*queries.schema.fields, T.StructField("inside", T.BooleanType())]))


def _weights(p: np.ndarray) -> np.ndarray | None:
    """Barycentric weights of the origin in the triangle ``p`` (3 x 2); None for a flat one."""
    (ax, ay), (bx, by), (cx, cy) = p
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    if abs(det) <= 1e-12:
        return None
    wa, wb = ((cy - by) * cx + (bx - cx) * cy) / det, ((ay - cy) * cx + (cx - ax) * cy) / det
    return np.array((wa, wb, 1 - wa - wb))


def delaunay_at_origin(p: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[float, float] | None:
    """(value at the origin, reach) by the Delaunay triangle of ``p`` (sorted by distance) that encloses it; None where none does.

    Points are lifted to x^2 + y^2: the Delaunay triangle is the enclosing one whose plane is lowest at the origin. From any enclosing
    triangle the point that lies furthest below its plane takes the place of a corner until none does. Points on the last circle are
    all of its triangles' corners: of these the first enclosing one by ids counts. ``reach`` is the largest distance of the circle from the origin."""
    z = (p * p).sum(axis=1)
    if z[0] < 1e-24:
        return float(values[0]), 0.0
    angle = np.arctan2(p[:, 1], p[:, 0])
    off = (angle - angle[0] + 2 * math.pi) % (2 * math.pi) - math.pi  # from the direction opposite to the nearest point
    left, right = np.flatnonzero((off >= 0) & (off < math.pi - 1e-12)), np.flatnonzero((off < 0) & (off > -math.pi + 1e-12))
    if not len(left) or not len(right):
        return None
    b, c = left[off[left].argmin()], right[off[right].argmax()]
    if off[b] - off[c] > math.pi + 1e-12 or _weights(p[[0, b, c]]) is None:
        return None
    three = [0, int(b), int(c)]
    for _ in range(10 * len(p) + 100):
        plane = np.linalg.solve(np.column_stack((p[three], np.ones(3))), z[three])
        gap = z - p @ plane[:2] - plane[2]
        low = int(gap.argmin())
        if gap[low] >= -1e-9 or low in three:
            break
        tries = [[low if k == n else three[k] for k in range(3)] for n in range(3)]
        rated = [(w.min(), t) for t in tries if (w := _weights(p[t])) is not None]
        three = max(rated)[1]
    reach = math.hypot(*plane[:2]) / 2 + math.sqrt(max(plane[2] + plane[0] ** 2 / 4 + plane[1] ** 2 / 4, 0.0))
    around = np.flatnonzero(gap <= 1e-9)
    for t in itertools.combinations(around[np.argsort(ids[around])].tolist(), 3):
        w = _weights(p[list(t)])
        if w is not None and w.min() >= -1e-12:
            return float(w @ values[list(t)]), reach
    return float(_weights(p[three]) @ values[three]), reach


def _planes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Values of queries with their k nearest points, and whether they stand whatever further points there are."""
    for batch in batches:
        values, sure = [], []
        for near in batch.column("near").to_pylist():
            p = np.array([(n["x"], n["y"]) for n in near])
            found = delaunay_at_origin(p, np.array([n["pt_id"] for n in near]), np.array([n["value"] for n in near], float))
            values.append(near[0]["value"] if found is None else found[0])
            sure.append(len(near) < k or (found is not None and found[1] < math.hypot(*p[-1]) - 1e-9))
        own = [batch.column(c) for c in ("q_id", "x", "y")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(values, pa.float64()), pa.array(sure, pa.bool_())], ["q_id", "x", "y", "value", "sure"])


def local_plane(queries: DataFrame, points: DataFrame, k: int = 10) -> DataFrame:
    """(q_id, value): linear interpolation over the Delaunay triangulation of all points in x, y; outside their convex hull, the nearest value.

    No triangulation is built. A query finds the Delaunay triangle around it among its k nearest points; it stands if its circle lies
    within the distance of the last of them, so that no further point can be in it, else k doubles for that query, up to all points. Points on
    one circle: the first enclosing triangle by ids. Points of one place count as the one with the smallest id, so they do not fill the k. Fewer than three points, or points on one line: the nearest value."""
    first = F.min(F.struct("pt_id", F.col("value").cast("double").alias("value"))).alias("_p")  # points of one place: the smallest id
    at = [F.col(c).cast("double").alias(n) for c in "xy" for n in (c, f"p{c}")]
    places = kept(points.where(F.col("pt_id").isNotNull()).groupBy("x", "y").agg(first).select("_p.pt_id", "_p.value", *at), "places")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # triangles are work per row: few bytes, many tasks
    asked = kept(queries.select("q_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct().repartition(tasks, "q_id"), "asked")
    inside = _enclosed(asked, places)
    kind = queries.schema["q_id"].dataType.simpleString()
    near_of = lambda q, n: knn_lists(q, places, "q_id", "pt_id", ("x", "y"), n, ("px", "py", "value"), 10.0, distinct=False)
    going, done = asked, []
    if inside is not None:
        inside = kept(inside, "inside")
        going = inside.where("inside").drop("inside")
        done.append(near_of(inside.where("not inside").drop("inside"), 1).select("q_id", F.col("near")[0]["value"].alias("value")))
    while True:
        around = F.transform("near", lambda n: F.struct(n["rank"].alias("rank"), n["pt_id"].alias("pt_id"), (n["px"] - F.col("x")).alias("x"), (n["py"] - F.col("y")).alias("y"), n["value"].alias("value")))
        listed = near_of(going, k).select("q_id", "x", "y", around.alias("near"))
        found = kept(listed.mapInArrow(lambda b, k=k: _planes(b, k), f"q_id {kind}, x double, y double, value double, sure boolean"), "planes")
        done.append(found.where("sure").select("q_id", "value"))
        going = found.where("not sure").select("q_id", "x", "y")
        if not going.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        k *= 2


def time_linear(series: DataFrame, asked: DataFrame, values: list[str], key: str = "station") -> DataFrame:
    """(key, t, values..): linear interpolation at the asked times; beyond the ends the end value. One window over both time sets."""
    both = series.select(key, "t", *values, F.lit(0).alias("_q")).unionByName(asked.select(key, "t", *(F.lit(None).cast("double").alias(v) for v in values), F.lit(1).alias("_q")))
    back = Window.partitionBy(key).orderBy("t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("t", F.col("_q").desc()).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_q") == 0, F.col("t"))
    out = both.withColumn("_t0", F.last(known, ignorenulls=True).over(back)).withColumn("_t1", F.first(known, ignorenulls=True).over(ahead))
    for v in values:
        out = out.withColumn(f"_a_{v}", F.last(v, ignorenulls=True).over(back)).withColumn(f"_b_{v}", F.first(v, ignorenulls=True).over(ahead))
    share = F.coalesce(F.try_divide(F.col("t") - F.col("_t0"), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    return out.where("_q = 1").select(key, "t", *((F.coalesce(F.col(f"_a_{v}"), F.col(f"_b_{v}")) + share * (F.coalesce(F.col(f"_b_{v}"), F.col(f"_a_{v}")) - F.coalesce(F.col(f"_a_{v}"), F.col(f"_b_{v}")))).alias(v) for v in values))


def time_cubic(series: DataFrame, asked: DataFrame, values: list[str], key: str = "station") -> DataFrame:
    """The same with a natural cubic spline per station: a year of hours is one small group."""
    kind = series.schema[key].dataType.simpleString()

    def spline(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = right[[key, "t"]].copy()
        left = left.drop_duplicates("t").sort_values("t")
        x, n = left["t"].to_numpy(float), len(left)
        for v in values:
            y = left[v].to_numpy(float)
            if n < 3:
                out[v] = np.interp(out["t"], x, y) if n else np.nan
                continue
            h, slope = np.diff(x), np.diff(y) / np.diff(x)
            lower, diag, upper, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
            for i in range(1, n - 2):
                w = lower[i] / diag[i - 1]
                diag[i] -= w * upper[i - 1]
                rhs[i] -= w * rhs[i - 1]
            m = np.zeros(n)
            for i in range(n - 3, -1, -1):
                m[i + 1] = (rhs[i] - (upper[i] * m[i + 2] if i < n - 3 else 0)) / diag[i]
            t = np.clip(out["t"].to_numpy(float), x[0], x[-1])
            i = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
            a, b = x[i + 1] - t, t - x[i]
            out[v] = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * a + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
        return out

    return series.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(spline, f"{key} {kind}, t double, " + ", ".join(f"{v} double" for v in values))
