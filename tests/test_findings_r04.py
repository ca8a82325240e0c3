"""Findings of round 4: what used to hold only for right sides of up to 20,000 rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayfield import plans
from dayfield.operators import integrate, nearest

MANY = 20_500


def _directions(spark, n, key, seed, names=nearest.DXYZ):
    """Even directions, written first so that they are the same in every read."""
    phi, z = F.rand(seed) * 2 * math.pi, F.rand(seed + 1) * 2 - 1
    rows = spark.range(0, n, 1, 2).select(F.col("id").alias(key), phi.alias("phi"), z.alias("z"))
    flat = F.sqrt(1 - F.col("z") * F.col("z"))
    return nearest.kept(rows.select(key, (flat * F.cos("phi")).alias(names[0]), (flat * F.sin("phi")).alias(names[1]), F.col("z").alias(names[2])), "directions")


def _squares(left, right, left_id, right_id, names=nearest.DXYZ):
    """Ids of both sides in order, and all squared distances."""
    sides = [df.orderBy(key).toArrow() for df, key in ((left, left_id), (right, right_id))]
    q, p = (np.array([t.column(c).to_numpy() for c in names]) for t in sides)
    return [t.column(k).to_numpy() for t, k in zip(sides, (left_id, right_id), strict=True)], sum((q[c][:, None] - p[c][None]) ** 2 for c in range(3))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    return _directions(spark, 120, "q_id", 3), _directions(spark, MANY, "ray_id", 5)


def test_many_candidate_suns_need_no_join(spark):
    """over 20,000 suns were looked up by cells, with rows of queries and suns shuffled and joined back."""
    suns, asked = _directions(spark, MANY, "sun_id", 3, nearest.SUN), _directions(spark, 120, "q_id", 7, nearest.SUN)
    found = nearest.candidate_suns(asked, suns, 0.6, 3)
    assert "Exchange" not in _plan(found)
    (queries, ids), d2 = _squares(asked, suns, "q_id", "sun_id", nearest.SUN)
    radius, want, few = 2 * math.sin(math.radians(0.6) / 2), set(), 0
    for q, row in zip(queries, d2, strict=True):
        near = np.flatnonzero(row <= radius * radius)
        few += len(near) < 3
        want |= {(q, s) for s in ids[near if len(near) >= 3 else np.argsort(row, kind="stable")[:3]]}
    got = [(r["q_id"], r["sun_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < few < 120


def test_many_candidate_suns_are_searched_in_several_tasks(spark):
    """a small file of queries was one task."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _directions(spark, nearest.SERVED + 1, "q_id", 7, nearest.SUN).coalesce(1)
    lists = nearest.candidate_lists(asked, _directions(spark, 50, "sun_id", 3, nearest.SUN), 0.6, 3)
    assert lists.rdd.getNumPartitions() == tasks and lists.count() == nearest.SERVED + 1


@pytest.mark.parametrize("some", [True, False])
def test_many_sources_need_no_pairs(spark, sides, some):
    """Rays met over 20,000 sources by cells, 27 copies a ray, and were joined back."""
    found = nearest.within_some(*sides, "q_id", "ray_id", 0.012, some=some)
    assert "Exchange" not in _plan(found)
    (queries, _), d2 = _squares(*sides, "q_id", "ray_id")
    want = (d2 <= 0.012 * 0.012).any(axis=1) == some
    assert sorted(r["q_id"] for r in found.collect()) == queries[want].tolist() and 10 < want.sum() < 110


@pytest.mark.parametrize("k", [1, 10])
def test_many_neighbours_need_no_cells(spark, sides, k):
    """Over 20,000 rays were copied into cells of all levels, and met by 27 copies a query."""
    left, right = sides
    (queries, ids), d2 = _squares(left, right, "q_id", "ray_id")
    want = {(q, i + 1): (ids[j], math.sqrt(row[j])) for q, row in zip(queries, d2, strict=True) for i, j in enumerate(np.argsort(row, kind="stable")[:k])}
    found = nearest.knn(left, right, "q_id", "ray_id", nearest.DXYZ, k, 2.0, distinct=False)
    lists = nearest.knn_lists(left, right, "q_id", "ray_id", nearest.DXYZ, k, ("dz",), 2.0, distinct=False)
    assert "Exchange" not in _plan(found) and "Exchange" not in _plan(lists)
    assert {(r["q_id"], r["rank"]): (r["ray_id"], r["dist"]) for r in found.collect()} == want
    assert {(r["q_id"], n["rank"]): (n["ray_id"], n["dist"]) for r in lists.collect() for n in r["near"]} == want


def test_many_rays_in_a_radius_need_no_cells(spark, sides):
    """the same for a radius."""
    found = nearest.within(*sides, "q_id", "ray_id", 0.1)
    assert "Exchange" not in _plan(found)
    (queries, ids), d2 = _squares(*sides, "q_id", "ray_id")
    i, j = np.nonzero(d2 <= 0.1 * 0.1)
    assert sorted((r["q_id"], r["ray_id"]) for r in found.collect()) == sorted(zip(queries[i].tolist(), ids[j].tolist(), strict=True)) and len(i) > 5000


def test_many_queries_among_more_rays_need_no_cells(spark):
    """over 20,000 queries among many rays made a copy of each ray for every level of cells."""
    left, right = _directions(spark, MANY, "q_id", 3), _directions(spark, nearest.PLACES + 1, "ray_id", 5)
    found = nearest.nearest(left, right, "q_id", "ray_id", nearest.DXYZ, 2.0)
    assert "_cell" not in _plan(found)
    some = left.where("q_id < 40")
    (queries, ids), d2 = _squares(some, right, "q_id", "ray_id")
    got = {r["q_id"]: (r["ray_id"], r["dist"]) for r in found.collect()}
    assert len(got) == MANY and {q: got[q] for q in queries} == {q: (ids[row.argmin()], math.sqrt(row.min())) for q, row in zip(queries, d2, strict=True)}


def test_rows_without_a_place_come_last():
    """The tree leaves out what has no finite place, and a far query meets what it needs."""
    rng = np.random.default_rng(1)
    at, asked = rng.random((3, 3000)), rng.random((3, 200))
    at[:, ::7], asked[:, 0] = np.nan, 50.0
    for k in (1, 4):
        found = list(nearest._searched(asked, at, k))
        rows, best, dist = (np.concatenate([f[i] for f in found]) for i in range(3))
        d2 = np.where(np.isnan(at[0])[None], np.inf, ((asked[:, :, None] - np.nan_to_num(at)[:, None]) ** 2).sum(axis=0))
        order = np.lexsort((dist, rows))
        assert (best[order].reshape(200, k) == np.argsort(d2, axis=1, kind="stable")[:, :k]).all()


def test_candidate_points_meet_by_class(spark, sf_dir):
    """a row per sun and point was made in a few tasks, and joined with the candidates."""
    found = plans.QUERIES["jn07_candidate_points"](spark, sf_dir)
    assert _plan(found).count("Join") == 1 and found.count() > 300


@pytest.mark.parametrize("flat", [True, False])
def test_suns_of_the_same_points_are_searched_once(spark, flat):
    """each candidate sun's points were searched, also where a nearer sun has the same points."""
    suns, asked = _directions(spark, 60, "sun_id", 3, nearest.SUN), _directions(spark, 12, "q_id", 7, nearest.SUN)
    height = F.lit(1.2) if flat else F.rand(13) * 0.2
    points = nearest.kept(spark.range(40).select(F.col("id").alias("pt_id"), (F.rand(11) * 2).alias("x"), (F.rand(12) * 2).alias("y"), height.alias("z")), "points")
    of = nearest.kept(suns.select("sun_id").join(points, F.expr("(pt_id + sun_id) % 3 = 0")), "of")
    found = nearest.points_by_sun(asked, suns, of, 0.5, 40.0, 3)
    rows, at = {}, {}
    for r in of.collect():
        at.setdefault(r["sun_id"], []).append((r["pt_id"], r["x"], r["y"], r["z"]))
    for r in nearest.candidate_suns(asked, suns, 40.0, 3).collect():
        rows.setdefault(r["q_id"], []).extend((p, r["sun_id"], x, y, z, z + r["chord"] / 0.5) for p, x, y, z in at[r["sun_id"]])
    want = set()
    for q, lifted in rows.items():
        for x, y, z in {r[2:5] for r in lifted}:
            want.add((q, *min(((x - r[2]) * (x - r[2]) + (y - r[3]) * (y - r[3]) + (z - r[5]) * (z - r[5]), r[0], r[1]) for r in lifted)[1:]))
    assert {(r["q_id"], r["pt_id"], r["sun_id"]) for r in found.collect()} == want and len(want) > 100


def test_only_the_nearest_sun_of_the_same_points_is_expanded():
    """of three suns with the same points the nearest is left, and all where a position lies above its lifted points."""
    names = ["_kind", "pt_id", "sun_id", *nearest.XYZ]
    rows = [(1, p, s, float(p), 0.0, z) for s in (1, 2, 3, 4) for p, z in ((1, 1.2), (2, 1.2))[: 1 if s == 4 else 2]]
    chord = np.array([0.3, 0.1, 0.1, 0.5])
    points = nearest._Points(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))))
    assert points.better(np.zeros(4, int), np.arange(4), chord, 0.5).tolist() == [False, True, True, True]
    high = [(k, p, s, x, y, 2.0 if p == 2 else z) for k, p, s, x, y, z in rows]
    points = nearest._Points(pa.table(dict(zip(names, map(list, zip(*high, strict=True)), strict=True))))
    assert points.better(np.zeros(4, int), np.arange(4), chord, 0.5).all()


def test_shared_patches_make_no_row_per_pair(spark, sf_dir):
    """every time and contribution of a patch was a row, and shuffled to be joined with its product."""
    assert "Join" not in _plan(plans.QUERIES["ag10_distinct_then_join"](spark, sf_dir))


def test_counted_products_count_nulls(spark):
    """pairs with a null value are pairs; where all are null, so is the sum."""
    sky = spark.createDataFrame([(1, 0, 2.0), (1, 0, None), (1, 1, 3.0), (2, 1, None), (3, None, 1.0)], "t int, patch int, coef double")
    contrib = spark.createDataFrame([(7, 0, 5.0), (7, 1, 1.0), (8, 1, None), (None, 0, 1.0)], "k int, patch int, value double")
    found = integrate.coefficient_product(sky, contrib, ["k"], count="n")
    joined = sky.join(contrib, "patch").groupBy("t", "k").agg(F.sum(F.col("coef") * F.col("value")).alias("value"), F.count("*").alias("n"))
    rows = lambda df: sorted(((r["t"], r["k"], r["value"], r["n"]) for r in df.collect()), key=str)
    assert rows(found) == rows(joined) and len(rows(found)) == 5


@pytest.mark.parametrize("fixed", [True, False])
def test_points_by_class_are_not_shuffled(spark, fixed):
    """every sun's points were rows, and shuffled to the blocks of queries."""
    suns = _directions(spark, 60, "sun_id", 3, nearest.SUN).withColumn("m", F.col("sun_id") % 3)
    asked = _directions(spark, 30, "q_id", 7, nearest.SUN)
    points = nearest.kept(spark.range(40).select(F.col("id").alias("pt_id"), (F.rand(11) * 2).alias("x"), (F.rand(12) * 2).alias("y"), F.lit(1.2).alias("z")), "points")
    points = points.withColumn("m", F.pmod(-F.col("pt_id"), F.lit(3)))
    of = suns.select("sun_id", "m").join(points, "m").drop("m")
    more = points.select((-F.col("pt_id") - 1).alias("pt_id"), (F.col("x") + 0.05).alias("x"), "y", "z")
    rows = lambda df: sorted(map(tuple, df.collect()))
    held = nearest.points_by_sun(asked, suns, points, 0.5, 40.0, 3, more if fixed else None, by="m")
    assert "Join" not in _plan(held) and _plan(held).count("Exchange") == 1
    assert rows(held) == rows(nearest.points_by_sun(asked, suns, of, 0.5, 40.0, 3, more if fixed else None)) and held.count() > 300
    if fixed:
        near = nearest.candidate_lists(asked, suns, 40.0, 3)
        found = nearest.fixed_to_suns(near, points, more, suns=suns, by="m")
        assert "Join" not in _plan(found) and rows(found) == rows(nearest.fixed_to_suns(near, of, more)) and found.count() == 30 * 40
