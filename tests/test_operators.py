"""Invariants: energy, round trips, identities of the cube, brute force of the nearest joins."""

from __future__ import annotations

import itertools
import math
import random
import shutil

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayfield.functions import directions, draws
from dayfield.functions import directions as d
from dayfield.functions import sky
from dayfield.operators import cube, evaluation, grid, integrate, interpolate, metrics, nearest, rays, suns, zones


def test_uv_round_trip(spark):
    n = 40
    cells = spark.range(2 * n * n).select(((F.floor(F.col("id") / n) + 0.5) / n).alias("u"), ((F.col("id") % n + 0.5) / n).alias("v"))
    v = d.from_uv(F.col("u"), F.col("v"))
    back = cells.select("u", "v", v.x.alias("dx"), v.y.alias("dy"), v.z.alias("dz"))
    u2, v2 = d.to_uv(d.xyz())
    row = back.select(F.max(F.abs(u2 - F.col("u"))), F.max(F.abs(v2 - F.col("v"))), F.max(F.abs(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2 - 1))).first()
    assert max(row) < 1e-9


def test_patch_centre_is_in_its_patch(spark):
    side = 6
    at = spark.range(side * side + 1).select(F.col("id").cast("int").alias("p"))
    v = d.patch_centre(F.col("p"), side)
    rows = at.select("p", v.x.alias("dx"), v.y.alias("dy"), v.z.alias("dz")).withColumn("q", d.sky_patch(d.xyz(), side)).collect()
    assert all(r["p"] == r["q"] for r in rows)


def hemisphere(spark, n):
    return rays.hemisphere_cells(spark, n).withColumnRenamed("cell", "ray_id").withColumn("pt_id", F.lit(0))


def test_checkerboard_light_point(spark):
    """A checkerboard of luminance 1 and 0 over the hemisphere: illuminance pi / 2 * 179, gcr 2; half strength elsewhere."""
    n = 40
    cells = hemisphere(spark, n).withColumn("i", F.floor(F.col("ray_id") / n)).withColumn("j", F.col("ray_id") % n)
    board = cells.withColumns({"lum": ((F.col("i") + F.col("j")) % 2).cast("double"), "omega": F.lit(2 * math.pi / n**2), "cos": F.col("dz"), "vx": F.lit(0.0), "vy": F.lit(0.0), "vz": F.lit(1.0)})
    row = metrics.evaluate(board, ("pt_id",), ["illum", "avglum", "gcr", "view_area"]).first()
    assert row["illum"] == pytest.approx(math.pi / 2 * 179, rel=0.01)
    assert row["avglum"] == pytest.approx(179 / 2) and row["gcr"] == pytest.approx(2.0) and row["view_area"] == pytest.approx(2 * math.pi)
    dark = metrics.evaluate(board.withColumn("lum", F.lit(0.0)), ("pt_id",)).first()
    assert dark["illum"] == 0 and dark["gcr"] == 1 and dark["ugr"] == 0
    with pytest.raises(ValueError):
        metrics.evaluate(board, ("pt_id",), ["no such metric"])


def test_registered_metric(spark):
    metrics.register("twice", lambda: F.col("illum") * 2)
    n = 10
    board = hemisphere(spark, n).withColumns({"lum": F.lit(1.0), "omega": F.lit(2 * math.pi / n**2), "cos": F.col("dz"), "vx": F.lit(0.0), "vy": F.lit(0.0), "vz": F.lit(1.0)})
    row = metrics.evaluate(board, ("pt_id",), ["twice", "illum"]).first()
    assert row["twice"] == pytest.approx(2 * row["illum"])
    del metrics.REGISTRY["twice"]


def test_solid_angles_add_up(spark):
    draw = random.Random(4)
    rows = []
    for i in range(300):
        z, phi = draw.random(), draw.random() * 2 * math.pi
        rows.append((i % 2 if i > 40 else 1, i, math.sqrt(1 - z * z) * math.cos(phi), math.sqrt(1 - z * z) * math.sin(phi), z))
    df = spark.createDataFrame(rows, "pt_id int, ray_id long, dx double, dy double, dz double")
    got = rays.solid_angles(df, 24).groupBy("pt_id").agg(F.sum("omega").alias("s")).collect()
    assert len(got) == 2 and all(r["s"] == pytest.approx(2 * math.pi) for r in got)
    few = rays.solid_angles(df.where("ray_id < 10"), 24).collect()
    assert all(r["omega"] == pytest.approx(2 * math.pi / 10) for r in few)


def test_compression_keeps_energy(spark):
    lit = hemisphere(spark, 30).withColumns({"lum": F.rand(1) * 100, "omega": F.rand(2)}).withColumn("ray_id", F.col("ray_id").cast("long"))
    lit = lit.cache()
    small = grid.compressed(lit, ["pt_id"], d.sky_patch(d.xyz(), 6))
    a, b = (x.agg(F.sum(F.col("lum") * F.col("omega")), F.sum("omega"), F.count("*")).first() for x in (lit, small))
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1]) and b[2] < a[2]


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("shape", ["cube", "sphere", "cluster"])
def test_nearest_matches_brute_force(spark, k, shape):
    draw = np.random.default_rng(7)
    p, q = draw.normal(size=(300, 3)), draw.normal(size=(80, 3))
    if shape == "sphere":
        p, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (p, q))
    if shape == "cluster":
        p = np.concatenate((p * 1e-3, p[:5] * 50))
    p[10] = p[11]
    table = lambda x, name: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"{name} long, x double, y double, z double")
    got = {}
    for r in nearest.knn(table(q, "q_id"), table(p, "pt_id"), "q_id", "pt_id", nearest.XYZ, k, 5.0).collect():
        got[r["q_id"], r["rank"]] = r["pt_id"]
    for i in range(len(q)):
        d2 = (q[i, 0] - p[:, 0]) * (q[i, 0] - p[:, 0]) + (q[i, 1] - p[:, 1]) * (q[i, 1] - p[:, 1]) + (q[i, 2] - p[:, 2]) * (q[i, 2] - p[:, 2])
        assert [got[i, n + 1] for n in range(k)] == np.lexsort((np.arange(len(p)), d2))[:k].tolist()
    by_cells = {(r["q_id"], r["rank"]): r["pt_id"] for r in nearest.knn(table(q, "q_id"), table(p, "pt_id"), "q_id", "pt_id", nearest.XYZ, k, 5.0, small=0).collect()}
    assert by_cells == got
    assert nearest.knn(table(q, "q_id"), table(p, "pt_id").limit(0), "q_id", "pt_id").count() == 0


def test_zone_holds_its_cells_and_border(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 3.0), (3.0, 3.0), (3.0, 6.0), (0.0, 6.0)]
    zs = spark.createDataFrame([("l", 0, ring, 1.2, 0.0)], "zone string, ring_id int, ring array<struct<x:double,y:double>>, z double, rotation double")
    cells = zones.plan_grid(zs, 0.5)
    assert cells.count() == 27 * 4 and cells.where("x > 3 and y > 3").count() == 0
    points = spark.createDataFrame([("a", float(i % 5), float(i // 5)) for i in range(25)], "zone string, x double, y double")
    hull = zones.border(points, 0.5).first()["ring"]
    assert {(p["x"], p["y"]) for p in hull} == {(-0.5, -0.5), (4.5, -0.5), (4.5, 4.5), (-0.5, 4.5)}


def test_identity_grid_detail(spark):
    eye = spark.createDataFrame([(0, i, j, float(i == j)) for i in range(8) for j in range(8)], "run int, i int, j int, value double")
    got = {(r["i"], r["j"]): r["detail"] for r in grid.detail(eye, ["run"]).collect()}
    assert got[3, 3] == 3.0 and got[0, 7] == 0.0 and got[3, 4] == 1.0
    for mode in ("nearest", "constant", "mirror", "wrap"):
        assert grid.detail(eye, ["run"], "haar", mode).count() == 64


@pytest.mark.parametrize("limit", [0.5, 2.0])
def test_draw_counts(spark, limit):
    values = spark.createDataFrame([(0, i // 50, i % 50, abs(random.Random(i).gauss(0, 1))) for i in range(2000)], "run int, i int, j int, detail double")
    over = values.where(F.col("detail") > limit).count()
    assert grid.draw(values, ["run"], limit).count() == over
    drawn = grid.draw_weighted(values, ["run"], limit)
    assert drawn.count() == over and drawn.distinct().count() == over


def test_sky_is_consistent(spark):
    rows = [(f"{i}", None, None, alt, az, float(direct), float(diffuse)) for i, (alt, az, direct, diffuse) in enumerate([(25.772, -97.5, 305, 169), (61.2, -5.8, 636, 268), (5.48, 68.1, 0, 11), (37.5, 58.9, 772, 106)])]
    df = spark.createDataFrame(rows, "t string, month int, day int, alt double, az double, dir_norm double, dif_horiz double")
    v = d.from_alt_az(F.col("alt"), F.col("az"))
    states = sky.perez(df.withColumns({"sx": v.x, "sy": v.y, "sz": v.z, "dew_pt": F.lit(None).cast("double")})).cache()
    assert states.count() == 4 and states.where("diff_norm > 0 and ground_br > 0 and solar_rad >= 0").count() == 4
    # what the patches give on a horizontal plane is the diffuse light that went in
    side = 12
    matrix = sky.sky_matrix(states, side, 3, blend=False).where(F.col("patch") < side * side)
    at = d.patch_centre(F.col("patch"), side)
    sums = matrix.groupBy("t").agg((F.sum(F.col("coef") * at.z) * 2 * math.pi / side**2 * 179).alias("lux")).join(states.select("t", "dif_lum"), "t").collect()
    assert all(r["lux"] == pytest.approx(r["dif_lum"], rel=0.06) for r in sums)
    assert sky.unit_sky(spark, 4).count() == 17


def test_sun_position_at_known_times(spark):
    """Equinox and solstice noons: altitude is 90 - latitude plus declination, within .05 degrees."""
    rows = [(3, 20, 12.0, 0.0, 0.0), (6, 20, 12.0, 51.4779, 0.0), (12, 21, 12.0, 51.4779, 0.0)]
    df = spark.createDataFrame(rows, "month int, day int, hour double, lat double, lon double").withColumn("meridian", F.lit(0.0))
    got = sky.sun_position(sky.to_utc(sky.timestamps(df))).collect()
    alt = {r["month"]: r["sun_alt"] for r in got}
    assert alt[6] == pytest.approx(90 - 51.4779 + 23.437, abs=0.06) and alt[12] == pytest.approx(90 - 51.4779 - 23.437, abs=0.08) and alt[3] > 87.5


def test_timestamp_carries_the_hour(spark):
    row = sky.timestamps(spark.createDataFrame([(1, 31, 23.9999)], "month int, day int, hour double")).first()
    assert str(row["ts"]) == "2020-02-01 00:00:00"


def test_sun_patch_minus_sky_is_the_share(spark):
    s = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25)], "t int, patch int, coef double")
    sun = spark.createDataFrame([(0, 2, 9.0, 0.125), (1, 3, 9.0, 0.5)], "t int, patch int, sun_rad double, patch_rad double")
    got = {(r["t"], r["patch"]): r["coef"] for r in integrate.with_sun_patch(s, sun).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 0.375, (1, 3): 0.5}


def test_two_components_without_sun_is_sky_only(spark):
    s = spark.createDataFrame([(0, p, 0.1 * p) for p in range(4)], "t int, patch int, coef double")
    sun = spark.createDataFrame([(0, 1, 0.0, 0.0)], "t int, patch int, sun_rad double, patch_rad double")
    c = spark.createDataFrame([(1, 1, p, 1.0 + p) for p in range(4)], "pt_id int, sensor_id int, patch int, value double")
    run = lambda name: integrate.simulate(name, s, sun, {"sky": c, "sun": c, "direct": c}).first()["illum"]
    assert run("2comp") == run("skyonly") == run("1comp") == pytest.approx(run("3comp"))
    with pytest.raises(ValueError):
        integrate.simulate("2comp", s, sun, {"sky": c})
    with pytest.raises(ValueError):
        integrate.simulate("lamp", s, sun, {"sky": c})


def result(spark, rows):
    return spark.createDataFrame(rows, "sky int, point long, view string, metric string, value double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=8, unique=True), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2)), min_size=1, max_size=8, unique=True))
def test_merge_keeps_the_first(spark, a, b):
    left, right = (result(spark, [(s, p, "v", "m", float(k)) for s, p in rows]) for k, rows in ((1, a), (2, b)))
    got = {(r["sky"], r["point"]): r["value"] for r in cube.merge(left, right, along="sky").collect()}
    skies = {s for s, _ in a}
    assert got == {x: 1.0 for x in a} | {x: 2.0 for x in b if x[0] not in skies}


def test_cube_checks(spark):
    r = result(spark, [(0, 0, "v", "m", 1.0), (1, 0, "v", "m", 3.0)])
    assert cube.pad(r, spark.range(3).select(F.col("id").cast("int").alias("sky")), -1.0).where("value = -1").count() == 1
    assert cube.percentiles(r, "m", [0.25]).first()["value"] == 1.5
    assert cube.axis_filter(r, sky=[]).count() == 2
    for wrong in (lambda: cube.axis("zone"), lambda: cube.axis(7), lambda: cube.merge(r, along="sky"), lambda: cube.pull_zonal(r, "sky", [0])):
        with pytest.raises(ValueError):
            wrong()


def test_cubic_goes_through_the_nodes(spark):
    series = spark.createDataFrame([("s", float(t), math.sin(t / 3)) for t in range(12)], "station string, t double, v double")
    asked = spark.createDataFrame([("s", float(t) / 2) for t in range(23)], "station string, t double")
    got = {r["t"]: r["v"] for r in interpolate.time_cubic(series, asked, ["v"]).collect()}
    assert all(got[float(t)] == pytest.approx(math.sin(t / 3), abs=1e-9) for t in range(12))
    assert got[5.5] == pytest.approx(math.sin(5.5 / 3), abs=1e-3)


def test_suns_lie_inside_the_solar_boundary(spark):
    one = spark.createDataFrame([(0, 46.25, -6.13, -15.0)], "station int, lat double, lon double, meridian double")
    times = spark.range(12 * 8).select((F.col("id") % 12 + 1).cast("int").alias("month"), F.lit(10).alias("day"), (F.floor(F.col("id") / 12) + 9.5).alias("hour"))
    suns = sky.sun_position(sky.to_utc(sky.timestamps(one.crossJoin(times)))).where("sz > 0.05")
    ring = sky.solar_boundary(one).select("ring")
    inside = suns.crossJoin(ring).withColumn("inside", zones.in_ring(F.col("sx"), F.col("sy"), F.col("ring")))
    assert inside.where("not inside").count() == 0 and inside.count() > 50
    north = spark.createDataFrame([(0, 80.0, 0.0, 0.0)], "station int, lat double, lon double, meridian double")
    assert sky.solar_boundary(north).first()["ring"][-1]["y"] == -1000.0


def test_forms_with_errors_and_warnings(spark):
    rows = spark.createDataFrame([(s, p, v, m, float(s + p)) for s in range(3) for p in range(2) for v in "ab" for m in ("x", "y")], "sky int, point int, view string, metric string, value double")
    with pytest.warns(UserWarning, match="no metric"):
        assert cube.metric_filter(rows, ["x", "z"]).select("metric").distinct().count() == 1
    assert {r[0] for r in cube.metric_filter(rows, [-1]).select("metric").distinct().collect()} == {"y"}
    with pytest.raises(ValueError):
        cube.sky_filter(rows, spark.createDataFrame([], "t int"))
    with pytest.raises(ValueError):
        cube.axis_index(rows, "view", ["a", "q"])
    with pytest.raises(ValueError):
        cube.pull_order("sky", 0)
    assert cube.pull_order("view") == ["view", "sky", "point", "metric"]
    assert cube.pull_axes(rows, "metric", "view", preserve=2).columns == ["sky", "point", "x_a", "x_b", "y_a", "y_b"]
    assert cube.pull_axes(rows).columns == ["point", "view", "metric", "0", "1", "2"]
    with pytest.raises(ValueError):
        cube.merge_checked(rows, rows.where("point = 0"), along="sky")
    assert cube.merge_checked(rows, rows, along="sky").count() == rows.count()
    with pytest.raises(ValueError):
        directions.transform(rows, ["sky", "point"], "uv", ["u", "v"])
    with pytest.raises(ValueError):
        suns.candidates(rows, ["sky"])
    with pytest.raises(ValueError):
        suns.candidates(rows, ["sky"] * 5)
    with pytest.raises(ValueError):
        evaluation.evaluate(rows, rows, ["unknown"])
    with pytest.raises(ValueError):
        integrate.coefficients(rows, rows, "moon")


def test_block_product_matches_a_join(spark, monkeypatch):
    draw = np.random.default_rng(3)
    sky = spark.createDataFrame([(int(t), int(p), float(draw.random()), int(c)) for t in range(40) for p in draw.choice(30, 8) for c in (0, 1)], "t int, patch int, coef double, c int")
    contrib = spark.createDataFrame([(int(k), None if k == 7 else "s", int(p), float(draw.random()), int(c)) for k in range(60) for p in draw.choice(30, 5) for c in (0, 1)], "k long, s string, patch int, value double, c int")
    monkeypatch.setattr(integrate, "BLOCK", 13)
    for channel in (None, "c"):
        on = ["patch"] + ([channel] if channel else [])
        want = {tuple(r)[:-1]: r["v"] for r in sky.join(contrib.drop("c") if not channel else contrib, on).groupBy("t", "k", "s", *on[1:]).agg(F.sum(F.col("coef") * F.col("value")).alias("v")).collect()}
        got = {tuple(r)[:-1]: r["value"] for r in integrate.coefficient_product(sky, contrib, ["k", "s"], channel=channel).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert integrate.coefficient_product(sky.limit(0), contrib, ["k", "s"]).count() == 0


def test_hull_of_many_equal_columns(spark):
    draw = np.random.default_rng(5)
    xy = draw.normal(size=(2000, 2))
    points = spark.createDataFrame([("a", float(x), float(y)) for x, y in xy], "zone string, x double, y double")
    ring = [(p["x"], p["y"]) for p in zones.border(points, 0.1).first()["ring"]]
    around = np.array(ring)
    nxt = np.roll(around, -1, axis=0)
    for sx in (-0.1, 0.1):
        for sy in (-0.1, 0.1):
            p = xy + (sx, sy)
            cross = (nxt[:, 0] - around[:, 0])[:, None] * (p[:, 1][None] - around[:, 1][:, None]) - (nxt[:, 1] - around[:, 1])[:, None] * (p[:, 0][None] - around[:, 0][:, None])
            assert (cross >= -1e-9).all()


def test_uniform_draws_repeat_and_spread(spark):
    u = [r[0] for r in spark.range(2000).select(draws.uniform(1, "id")).collect()]
    again = [r[0] for r in spark.range(2000).repartition(7).select("id", draws.uniform(1, "id").alias("u")).orderBy("id").select("u").collect()]
    assert u == again and 0.45 < np.mean(u) < 0.55 and 0 <= min(u) and max(u) < 1


def unit(draw, n):
    x = draw.normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("small", [0, 20_000])
def test_nearest_pair_of_all_and_of_sampled_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(nearest.knn, "__defaults__", (*nearest.knn.__defaults__[:-1], small))
    draw = np.random.default_rng(9)
    s, p, q = unit(draw, 15), draw.uniform(0, 10, (40, 3)), np.hstack((unit(draw, 25), draw.uniform(0, 10, (25, 3))))
    frame = lambda rows, *names: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ", ".join([f"{names[0]} long", *(f"{n} double" for n in names[1:])]))
    suns_, points, asked = frame(s, "sun_id", "sx", "sy", "sz"), frame(p, "pt_id", "x", "y", "z"), frame(q, "q_id", "sx", "sy", "sz", "x", "y", "z")
    d2 = ((q[:, None, None, :3] - s[None, :, None]) ** 2).sum(-1) + ((q[:, None, None, 3:] - p[None, None]) ** 2).sum(-1) * 0.01
    got = {r["q_id"]: (r["sun_id"], r["pt_id"]) for r in nearest.nearest_pair(asked, suns_, points, 0.1).collect()}
    assert got == {i: divmod(int(d2[i].argmin()), 40) for i in range(25)}
    keep = np.add.outer(np.arange(15), np.arange(40)) % 6 == 0
    members = spark.createDataFrame([(i, j) for i, j in np.argwhere(keep).tolist()], "sun_id long, pt_id long").join(points, "pt_id")
    masked = np.where(keep[None], d2, np.inf)
    got = {r["q_id"]: (r["sun_id"], r["pt_id"]) for r in nearest.nearest_pair(asked, suns_, members, 0.1, first=2).collect()}
    assert got == {i: divmod(int(masked[i].argmin()), 40) for i in range(25)}
    assert nearest.nearest_pair(asked.limit(0), suns_, members, 0.1).count() == 0


@pytest.mark.parametrize("searched", [1, 50_000])
def test_penalised_points_are_those_of_all_pairs(spark, monkeypatch, searched):
    monkeypatch.setattr(nearest, "SEARCHED", searched)
    monkeypatch.setattr(nearest, "PAIRS", 300)
    draw = np.random.default_rng(4)
    rows = [(int(q), int(p), int(s), float(draw.choice([0.0, 0.02, 0.1, 0.3])), *map(float, draw.integers(0, 6, 2) / 4), float(draw.integers(0, 3)) / 8) for q in range(7) for s in range(3) for p in draw.choice(30, 12, replace=False)]
    df = spark.createDataFrame(rows, "q_id long, pt_id long, sun_id long, chord double, x double, y double, z double")
    scale, want = 0.5, set()
    for q in range(7):
        mine = [r for r in rows if r[0] == q]
        for a in mine:
            best = min(mine, key=lambda b: ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 + (a[6] - (b[6] + b[3] / scale)) ** 2, b[1], b[2]))
            want.add(best[:3])
    found = df.repartition("q_id").sortWithinPartitions("q_id").mapInArrow(lambda b: nearest._used_points(b, scale), df.schema)
    assert {(r["q_id"], r["pt_id"], r["sun_id"]) for r in found.collect()} == want


@pytest.mark.parametrize("parts", [2, 100_000])
def test_nearest_within_groups(spark, monkeypatch, parts):
    monkeypatch.setattr(nearest, "ASKED", parts)
    draw = np.random.default_rng(3)
    left, right = draw.uniform(0, 1, (40, 3)), draw.integers(0, 4, (60, 3)) / 4
    one = spark.createDataFrame([(i % 3 if i % 7 else None, i, *map(float, r)) for i, r in enumerate(left)], "g long, l long, x double, y double, z double")
    two = spark.createDataFrame([(i % 4, i, *map(float, r)) for i, r in enumerate(right)], "g long, r long, x double, y double, z double")
    got = {(r["g"], r["l"], r["rank"]): r["r"] for r in nearest.knn(one, two, "l", "r", k=3, by=("g",)).collect()}
    want = {}
    for i, v in enumerate(left):
        if i % 7:
            near = sorted((((v - right[j]) ** 2).sum(), j) for j in range(60) if j % 4 == i % 3)
            want |= {(i % 3, i, k): j for k, (_, j) in enumerate(near[:3], 1)}
    assert got == want


@pytest.mark.parametrize("size", [16, 8192])
@pytest.mark.parametrize("threshold", [4.0, 5000.0])
def test_glare_per_sky_matches_a_row_per_ray_and_sky(spark, monkeypatch, size, threshold):
    monkeypatch.setattr(evaluation, "RAYS", size)
    monkeypatch.setattr(evaluation, "TIMES", 2)
    draw = np.random.default_rng(6)
    v = unit(draw, 150)
    rows = [(int(i % 3), int(i), int(draw.integers(0, 5)), *map(float, v[i]), float(draw.uniform(0.01, 0.05)), float(draw.exponential(20.0))) for i in range(150)]
    rows += [(r[0], r[1], (r[2] + 2) % 5, *r[3:7], 3.0) for r in rows[::4]]  # a second patch for some rays
    rays_ = spark.createDataFrame(rows, "pt_id long, ray_id long, patch int, dx double, dy double, dz double, omega double, lum double")
    views = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 180.0), (1, 0.0, 1.0, 0.0, 180.0)], "view int, vx double, vy double, vz double, angle_deg double")
    sky_ = spark.createDataFrame([(t, p, float(draw.uniform(0, 2))) for t in range(5) for p in range(5) if (t, p) != (2, 3)], "t int, patch int, coef double")
    seen = evaluation.with_position(metrics.in_view(rays_, views))
    wanted = ["dgp", "ugp", "ugr", "pwsl2", "illum", "maxlum", "backlum_true", "tasklum", "gcr", "density"]
    found = evaluation.evaluate(sky_, seen, wanted, threshold=threshold, shared_rays=True)
    lit = seen.join(sky_, "patch").groupBy("t", "pt_id", "view", "ray_id", "dx", "dy", "dz", "vx", "vy", "vz", "omega", "cos").agg(F.sum(F.col("lum") * F.col("coef")).alias("lum"))
    whole = seen.select("pt_id", "view", "ray_id", "dx", "dy", "dz", "vx", "vy", "vz", "omega", "cos").distinct().crossJoin(sky_.select("t").distinct())
    lit = whole.join(lit.select("t", "pt_id", "view", "ray_id", "lum"), ["t", "pt_id", "view", "ray_id"], "left").fillna(0.0, ["lum"])
    want = metrics.evaluate(lit, ("t", "pt_id", "view"), wanted, threshold)
    want = {(r["t"], r["pt_id"], r["view"], n): r[n] for r in want.collect() for n in wanted}
    got = {(r["sky"], r["point"], r["view"], r["metric"]): r["value"] for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want if want[k] is not None)
    assert evaluation.evaluate(sky_, seen.limit(0), ["dgp"]).count() == evaluation.evaluate(sky_.limit(0), seen, ["illum"]).count() == 0


def test_plain_metrics_by_patch_match_those_by_ray(spark):
    draw = np.random.default_rng(8)
    rows = [(int(i % 4) or None, int(i), int(i % 5), *map(float, w), 0.02, float(draw.exponential(5.0))) for i, w in enumerate(unit(draw, 80))]
    rays_ = spark.createDataFrame(rows, "pt_id long, ray_id long, patch int, dx double, dy double, dz double, omega double, lum double")
    views = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 180.0)], "view int, vx double, vy double, vz double, angle_deg double")
    sky_ = spark.createDataFrame([(t, p, float(draw.uniform(0, 2))) for t in range(3) for p in range(5)], "t int, patch int, coef double")
    seen = evaluation.with_position(metrics.in_view(rays_, views))
    read = lambda df: {(r["sky"], r["point"], r["metric"]): r["value"] for r in df.collect()}
    wanted = ["illum", "avglum", "avgraylum", "gcr", "density", "view_area"]
    one, two = read(evaluation.evaluate(sky_, seen, wanted)), read(evaluation.evaluate(sky_, seen, [*wanted, "dgp"]))
    assert one.keys() == {k for k in two if k[2] != "dgp"}
    assert all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)


@pytest.mark.parametrize("layout", ["even", "clustered", "lattice", "line"])
def test_local_plane_is_the_delaunay_one(spark, layout):
    draw = np.random.default_rng(5)
    at = {"even": draw.uniform(0, 1, (24, 2)), "clustered": np.vstack((draw.normal(0, 0.01, (22, 2)) + 0.1, [(1, 1), (1, 0), (0, 1)])), "lattice": np.array([(i / 4, j / 4) for i in range(5) for j in range(5)]), "line": np.array([(i / 9, i / 9) for i in range(10)])}[layout]
    values = draw.uniform(0, 9, len(at))
    asked = np.vstack((draw.uniform(-0.2, 1.2, (60, 2)), at[:3], (at[:1] + at[1:2]) / 2))
    points = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(at, values, strict=True))], "pt_id long, x double, y double, value double")
    queries = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(asked)], "q_id long, x double, y double")
    got = {r["q_id"]: r["value"] for r in interpolate.local_plane(queries, points, k=4).collect()}
    circles = []
    for t in map(list, itertools.combinations(range(len(at)), 3)):
        m = np.column_stack((at[t], np.ones(3)))
        if abs(np.linalg.det(m)) > 1e-12:
            plane = np.linalg.solve(m, (at[t] ** 2).sum(axis=1))
            if ((at**2).sum(axis=1) - at @ plane[:2] - plane[2]).min() >= -1e-10:
                circles.append((t, m))
    for i, q in enumerate(asked):
        want = {float(w @ values[t]) for t, m in circles if (w := np.linalg.solve(m.T, [*q, 1])).min() >= -1e-11}
        near = values[np.isclose(((at - q) ** 2).sum(axis=1), ((at - q) ** 2).sum(axis=1).min(), atol=1e-14)]
        assert min(abs(got[i] - v) for v in (want or near)) < 1e-6


@pytest.mark.parametrize("ranked", [1, 100_000])
def test_first_rows_of_large_runs(spark, monkeypatch, ranked):
    monkeypatch.setattr(grid, "BUCKETS", 4)
    rnd = random.Random(1)
    rows = [(g, float(rnd.choice([0.0, 0.1, rnd.random(), rnd.random() ** 9])), i % 13, i // 13, n) for g, n, many in ((0, 70, 300), (1, 1, 40), (2, 500, 60), (3, 7, 7), (None, 3, 9)) for i in range(many)]
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "g int, w double, i int, j int, n int")
    got = {(r["g"], r["i"], r["j"]) for r in grid.first_n(df, ["g"], ["w", "i", "j"], "n", ranked).collect()}
    want = {(r[0], r[2], r[3]) for g in range(4) for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:4])[: {0: 70, 1: 1, 2: 500, 3: 7}[g]]}
    assert got == want
    alone = df.where("g = 0").drop("g")
    assert grid.first_n(alone, [], ["w", "i", "j"], "n", ranked).count() == 70


def test_refinement_goes_on_from_a_complete_level(spark, tmp_path):
    rows = [(k, i, j, float((i * 7 + j * 3 + k) % 11 + (20 if (i, j) == (5, 5) else 0))) for k in range(2) for i in range(8) for j in range(8)]
    pixels = spark.createDataFrame(rows, "k int, i int, j int, value double")
    read = lambda df: sorted(map(tuple, df.select("k", "level", "i", "j", "value").collect()))
    whole = read(rays.refine(pixels, ["k"], 3, 8, folder=str(tmp_path / "a")))
    assert {r[1] for r in whole} == {0, 1, 2} and sum(r[1] == 0 for r in whole) == 8
    rays.refine(pixels, ["k"], 3, 8, folder=str(tmp_path / "b")).count()
    shutil.rmtree(tmp_path / "b" / "level-2")
    shutil.rmtree(tmp_path / "b" / "level-1" / "complete")
    marked = (tmp_path / "b" / "level-0" / "samples" / "_SUCCESS").stat().st_mtime_ns
    assert read(rays.refine(pixels, ["k"], 3, 8, folder=str(tmp_path / "b"))) == whole
    assert (tmp_path / "b" / "level-0" / "samples" / "_SUCCESS").stat().st_mtime_ns == marked
    assert rays.refine(pixels.limit(0), ["k"], 3, 8).count() == 0
    angles = rays.refined_rays(rays.refine(pixels, ["k"], 3, 8), "k", 3, 8, cells=16, few=1).groupBy("pt_id").agg(F.sum("omega").alias("o"), F.count("*").alias("n"), F.min("dz").alias("dz")).collect()
    assert sorted((r["pt_id"], r["n"]) for r in angles) == [(k, sum(r[0] == k for r in whole)) for k in range(2)]
    assert all(r["o"] == pytest.approx(2 * math.pi) and r["dz"] > 0 for r in angles)


def test_blur_changes_glare(spark):
    pixels = rays.pixel_rays(spark.createDataFrame([(0, i, j, 500.0 if (i, j) == (7, 7) else 3.0) for i in range(16) for j in range(16)], "img int, i int, j int, lum double"), 16)
    plain, blurred = (metrics.evaluate(rays.peak_corrected(pixels, ["img"], 0.02, blur=b), ("img",), ["dgp", "illum"], 900.0).first() for b in (False, True))
    assert blurred["dgp"] < plain["dgp"] - 1e-4 and blurred["illum"] == pytest.approx(plain["illum"])


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(cube, "MOST_LABELS", 3)
    result = spark.createDataFrame([(1, 1, "v", f"m{k}", 1.0) for k in range(4)], "sky int, point int, view string, metric string, value double")
    with pytest.raises(ValueError):
        cube.metric_filter(result, ["m0"])
    with pytest.raises(ValueError):
        cube.pull_axes(result, "metric")
