"""Steps whose memory, time or shuffle was projected beyond its limit in round 3."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayfield.operators import cube, evaluation, integrate, nearest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_scan_many_without_cells(spark):
    """ties go to the smaller id, and the right side is not copied per level."""
    draw = random.Random(3)
    right = [(i, draw.randrange(30) / 10, draw.randrange(30) / 10, 0.0) for i in range(400)]
    left = [(i, draw.random() * 3, draw.random() * 3, 0.0) for i in range(20)] + [(20, 1.0, 1.0, 0.0)]
    many = spark.createDataFrame(right, "ray_id long, x double, y double, z double").repartition(3)
    few = spark.createDataFrame(left, "q_id long, x double, y double, z double")
    for k in (1, 3):
        found = nearest.knn(few, many, "q_id", "ray_id", nearest.XYZ, k, 2.0, small=100)
        want = {(q, r, n) for q, *a in left for n, (_, r) in enumerate(sorted((sum((u - v) * (u - v) for u, v in zip(a, b, strict=True)), r) for r, *b in right)[:k], 1)}
        assert {(x["q_id"], x["ray_id"], x["rank"]) for x in found.collect()} == want
        assert "Generate" not in _plan(found)


def test_rebase_moves_a_cell_once(spark):
    """the errors come out with the values; the moved cube is not grouped."""
    result = spark.createDataFrame([(1, 7, "a", "m", 2.0), (1, 7, "a", "n", 3.0), (2, 7, "a", "m", 4.0)], "sky int, point long, view string, metric string, value double")
    points = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (8, 9.0, 9.0, 0.0)], "pt_id long, x double, y double, z double")
    found = cube.rebase(result, points, spark.createDataFrame([(1, 3.0, 4.0, 0.0), (2, 9.0, 9.0, 0.0)], "q_id long, x double, y double, z double"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a", "m", 2.0), (1, 1, "a", "n", 3.0), (1, 1, "a", "rebase_err", 5.0), (2, 1, "a", "m", 4.0), (2, 1, "a", "rebase_err", 5.0)]
    assert "Union" not in _plan(found)


def test_pull_is_one_grouping(spark):
    """No pivot, and padding comes after the pull with the same cells as before it."""
    result = spark.createDataFrame([(1, 7, "a", "F", 2.0), (1, 7, "a", "O", None), (2, 7, "b", "O", 4.0)], "sky int, point long, view string, metric string, value double")
    found = cube.pull(result, "metric", ["F", "O"])
    assert sorted(map(tuple, found.collect())) == [(1, 7, "a", 2.0, None), (2, 7, "b", None, 4.0)]
    assert "pivotfirst" not in _plan(found)
    times = spark.createDataFrame([(1,), (3,)], "sky int")
    padded = cube.printed(result, "metric", ["F", "O"], times=times)
    old = cube.pull(cube.pad(result, times), "metric", ["F", "O"])
    assert sorted((r[0], r[2], r[3] == "", r[4] == "") for r in padded.collect()) == sorted((r[0], r[2], r[3] is None, r[4] is None) for r in old.collect())


def test_terms_are_one_product(spark):
    """terms are summed inside the product, not grouped after."""
    sky = spark.createDataFrame([(1, 0, 2.0), (2, 1, 3.0)], "t int, patch int, coef double")
    sun = spark.createDataFrame([(1, 0, 5.0, 0.5), (2, 0, 7.0, 0.5)], "t int, patch int, sun_rad double, patch_rad double")
    rows = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 10.0)], "pt_id long, sensor_id int, patch int, value double")
    found = integrate.simulate("2comp", sky, sun, {"sky": rows, "sun": rows}, 1.0)
    assert {r["t"]: r["illum"] for r in found.collect()} == {1: 7.0, 2: 37.0}
    summed = integrate.sensor_sum([("sky", rows, 1.0), ("sun", rows, -1.0), ("fixed", rows, 1.0)], sky, sun, 1.0)
    assert {r["t"]: r["illum"] for r in summed.collect()} == {1: 2.0 - 5.0 + 11.0, 2: 30.0 - 7.0 + 11.0}
    assert _plan(found).split("FlatMapCoGroupsInArrow")[0].count("Aggregate") == 0


def test_sources_are_summed_in_their_block(spark):
    """the sum over sources equals that of the rows apart."""
    draw = random.Random(9)
    rows = [(p, "v", s, p * 100 + s * 10 + i, i % 3, draw.random(), draw.random(), draw.random()) for p in range(9) for s in range(3) for i in range(5)]
    seen = spark.createDataFrame(rows, "pt_id long, view string, src int, ray_id long, patch int, lum double, omega double, cos double")
    sky = spark.createDataFrame([(t, p, draw.random()) for t in range(4) for p in range(t)], "t int, patch int, coef double")
    apart = integrate.summed_sources(evaluation.evaluate(sky, seen, ["illum"], keys=("src",)))
    found = evaluation.evaluate(sky, seen, ["illum"], keys=("src",), summed=True)
    sides = [{(r["sky"], r["point"], r["view"], r["metric"]): round(r["value"], 6) for r in x.collect()} for x in (apart, found)]
    assert sides[0] == sides[1] and len(sides[0]) == found.count() == 27


def _tied_pairs(spark):
    draw = np.random.default_rng(4)
    s = draw.normal(size=(60, 3))
    s /= np.linalg.norm(s, axis=1)[:, None]
    p = np.array([(i * 37 % 101 / 10, i * 53 % 97 / 10, 1.2) for i in range(300)] + [(i * 37 % 101 / 10, i * 53 % 97 / 10, 1.2) for i in range(20)])
    q = np.hstack((draw.permutation(np.vstack([s] * 5)) + draw.normal(size=(300, 3)) * 1e-3, draw.permutation(p)[:300] + np.array([0.05, 0.05, 0.0])))
    frame = lambda rows, *names: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ", ".join([f"{names[0]} long", *(f"{n} double" for n in names[1:])]))
    frames = frame(q, "q_id", "sx", "sy", "sz", "x", "y", "z"), frame(s, "sun_id", "sx", "sy", "sz"), frame(p, "pt_id", "x", "y", "z")
    gaps = [q[:, None, None, c] - s[None, :, None, c] for c in range(3)] + [q[:, None, None, 3 + c] * 0.1 - p[None, None, :, c] * 0.1 for c in range(3)]
    return frames, sum(g * g for g in gaps)


def test_sampled_pairs_are_met_in_one_scan(spark):
    """no row per query and sun, and ties as the sum of the six squares has them."""
    (asked, suns, points), d2 = _tied_pairs(spark)
    keep = (np.arange(60)[:, None] + np.arange(320)[None]) % 3 == 0
    members = spark.createDataFrame(np.argwhere(keep).tolist(), "sun_id long, pt_id long").join(points, "pt_id")
    want = {i: divmod(int(np.where(keep, d2[i], np.inf).argmin()), 320) for i in range(300)}
    found = nearest.nearest_pair(asked, suns, members, 0.1)
    assert {r["q_id"]: (r["sun_id"], r["pt_id"]) for r in found.collect()} == want
    assert "MapInArrow" in _plan(found) and "Join" not in _plan(found)


def test_pairs_of_classes_are_those_of_members(spark):
    """suns and points of one class, by a scan and by rings; rows without a place are no pair's."""
    (asked, suns, points), d2 = _tied_pairs(spark)
    suns, points = suns.withColumn("m", F.col("sun_id") % 3), points.withColumn("m", F.pmod(-F.col("pt_id"), F.lit(3)))
    want = np.where((np.arange(60)[:, None] + np.arange(320)[None]) % 3 == 0, d2, np.inf).reshape(300, -1).min(axis=1)
    for small in (0, 1000):
        got = {r["q_id"]: r["dist"] for r in nearest.nearest_pair(asked, suns, points, 0.1, by="m", small=small).collect()}
        assert np.allclose([got[i] for i in range(300)], np.sqrt(want))
    nowhere = points.where("m = 0").withColumn("x", F.lit(float("nan")))
    got = nearest.nearest_pair(asked, suns, points.where("m = 1").unionByName(nowhere), 0.1, by="m")
    assert {r["sun_id"] % 3 for r in got.collect()} == {1}
    assert nearest.nearest_pair(asked, suns.limit(0), points, 0.1, by="m").count() == 0


def test_a_sun_with_every_point_needs_no_join(spark):
    """the form of every sun with every point is the same scan."""
    (asked, suns, points), d2 = _tied_pairs(spark)
    found = nearest.nearest_pair(asked, suns, points, 0.1)
    assert {r["q_id"]: (r["sun_id"], r["pt_id"]) for r in found.collect()} == {i: divmod(int(d2[i].argmin()), 320) for i in range(300)}
    assert "Join" not in _plan(found)


def _glare_rays(draw, twice):
    """Rays of 4 points and 2 views, some of them dark, level or out of the task zone, and (``twice``) some with two rows."""
    rows = []
    for p in range(4):
        for v in range(2):
            for i in range(37 if p else 3):
                row = (p, v, i, draw.randrange(3), draw.choice([0.0, 5.0, draw.random() * 10, 10 ** (draw.random() * 9)]), 0.1 + draw.random(), draw.random() if p != 2 else 0.1, 1 + draw.random())
                rows += [row, (*row[:3], (row[3] + 1) % 3, *row[4:])] if twice and i % 5 == 0 else [row]
    return rows


def _glare_of(rows, coef, times, threshold):
    """Parts by brute force: a ray's light is the sum of its rows."""
    out = {}
    for t in range(times):
        for p, v in {r[:2] for r in rows}:
            mine = [r for r in rows if r[:2] == (p, v)]
            rays = {i: [r for r in mine if r[2] == i] for i in {r[2] for r in mine}}
            light = {i: 179 * sum(r[4] * coef.get((t, r[3]), 0.0) for r in rs) for i, rs in rays.items()}
            one = {i: rs[0] for i, rs in rays.items()}
            task = [i for i, r in one.items() if r[6] >= np.cos(np.radians(60))]
            area = sum(one[i][5] for i in task)
            limit = threshold * sum(light[i] * one[i][5] for i in task) / area if area else np.inf
            over = [i for i in rays if light[i] > limit]
            if any((t, r[3]) in coef for r in mine):
                out[t, p, v] = [sum(light[i] * r[5] * r[6] for i, r in one.items()), sum(light[i] * one[i][5] * one[i][6] for i in over), sum(one[i][5] for i in over), sum(light[i] ** 2 * one[i][5] / one[i][7] ** 2 for i in over),
                                sum(light[i] * r[5] for i, r in one.items() if i not in over), sum(r[5] for i, r in one.items() if i not in over), max(light.values())]
    return out


@pytest.mark.parametrize(("twice", "sign", "held"), [(False, 1, 65_536), (True, 1, 65_536), (True, 1, 8), (True, -1, 65_536)])
def test_sources_are_found_in_the_order_of_luminance(spark, monkeypatch, twice, sign, held):
    """rays of one patch, of two, of groups over many blocks, and under a coefficient below 0 give the sums of brute force."""
    monkeypatch.setattr(evaluation, "HELD", held)
    draw = random.Random(7)
    rows = _glare_rays(draw, twice)
    coef = {(t, p): draw.random() if t else sign * 0.5 for t in range(5) for p in range(3) if (t + p) % 4}
    sky = spark.createDataFrame([(*k, c) for k, c in coef.items()], "t int, patch int, coef double")
    seen = spark.createDataFrame(rows, "pt_id long, view int, ray_id long, patch int, lum double, omega double, cos double, pos double")
    parts = ["illum", "srcillum", "srcarea", "pwsl2", "back_flux", "back_area", "maxlum"]
    found = evaluation._summed_by_ray(sky, seen, ["pt_id", "view"], parts, 1.5, 120.0)
    want = _glare_of(rows, coef, 5, 1.5)
    got = {(r["t"], r["pt_id"], r["view"]): [r[p] for p in parts] for r in found.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert np.allclose(got[k][:-1], values[:-1], rtol=1e-9), (k, got[k], values)
        assert np.isclose(got[k][-1], max(values[-1], 0.0))
    if held > 100:  # the zone is summed where its rays are
        assert "Union" not in _plan(found) and "Join" not in _plan(found)


def test_light_from_sources_only_leaves_no_background(spark):
    """where every ray is a source, illum and srcillum are the same number, so no background luminance is left by rounding."""
    draw = random.Random(3)
    rows = [(p, 0, i, i % 7, draw.random() * 1e5, draw.random(), draw.random(), 1.0) for p in range(20) for i in range(60)]
    seen = spark.createDataFrame(rows, "pt_id long, view int, ray_id long, patch int, lum double, omega double, cos double, pos double")
    sky = spark.createDataFrame([(t, p, draw.random() + 1) for t in range(5) for p in range(7)], "t int, patch int, coef double")
    found = evaluation._summed_by_ray(sky, seen, ["pt_id", "view"], ["illum", "srcillum", "pwsl2"], 0.0, 120.0)
    assert all(r["illum"] == r["srcillum"] > 0 for r in found.collect())
