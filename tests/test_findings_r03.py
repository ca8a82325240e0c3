"""Cases of the third review: each failed before its finding was settled."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dayfield import plans
from dayfield.functions import directions as d
from dayfield.operators import cube, integrate, interpolate, nearest


def copied(spark, sf_dir, target, times, **keys):
    """A copy of the tables with rows repeated ``times`` times, keys shifted; tables without keys are left out."""
    for table, columns in keys.items():
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        shift = {c: (F.col(c) + F.col("_i") * n).cast(rows.schema[c].dataType) for c, n in columns.items()}
        rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumns(shift).drop("_i").write.parquet(f"{target}/{table}.parquet")
    return str(target)


def test_draw_without_a_cell_over_the_limit_is_empty(spark, sf_dir, tmp_path):
    """means over many lines are even, so no detail reaches the limit."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_extendedprice", F.lit(7.0))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert plans.QUERIES["gr07_draw_detail"](spark, str(tmp_path)).count() == 0


def test_angles_heed_the_sign_of_zeros(spark):
    """at the nadir x and y are zeros of either sign."""
    rows = [(y, x) for y in (0.0, -0.0, 1.0, -1.0) for x in (0.0, -0.0, 1.0, -1.0)]
    got = spark.createDataFrame(rows, "y double, x double").select("y", "x", d.atan2(F.col("y"), F.col("x")).alias("a")).collect()
    assert len(got) == 16
    for r in got:
        want = math.atan2(r["y"], r["x"])
        assert abs(r["a"] - want) < 1e-12 and math.copysign(1, r["a"]) == math.copysign(1, want)
    assert spark.sql("select cast(0 as double) y, cast(null as double) x").select(d.atan2(F.col("y"), F.col("x"))).first()[0] is None


def test_point_of_the_plane_takes_itself(spark):
    """two points share a place."""
    points = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 5.0, 0.0, 1.0)], "pt_id long, x double, y double, z double")
    times = spark.createDataFrame([(7,)], "t int")
    found = integrate.time_by_point(times, points.withColumnRenamed("pt_id", "q_id"), {"sky": points}, own=True)
    assert sorted((r["q_id"], r["sky_pt"], r["sky_err"]) for r in found.collect()) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    other = spark.createDataFrame([(2, 5.0, 0.0, 1.0), (9, 0.0, 0.0, 1.0)], "pt_id long, x double, y double, z double")
    found = integrate.time_by_point(times, points.withColumnRenamed("pt_id", "q_id"), {"sky": other}, own=True)
    assert sorted((r["q_id"], r["sky_pt"]) for r in found.collect()) == [(1, 9), (2, 9), (3, 2)]


def test_scale_of_points_that_share_their_places(spark):
    """a gap of zero gives an infinite scale, not a null."""
    suns = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0), (2, 0.0, 1.0, 0.0, 0)], "sun_id long, sx double, sy double, sz double, level int")
    points = spark.createDataFrame([(i, float(i // 2), 0.0, 1.0, 0) for i in range(6)], "pt_id long, x double, y double, z double, level int")
    row = nearest.scale_factor(suns, points).first()
    assert row["point_gap"] == 0 and row["scale"] == math.inf


def test_products_once_per_key_are_computed_on_written_rows(spark, sf_dir):
    """both sides of the join back must read the same sums, so no aggregation may stand below the products' join."""
    plan = plans.QUERIES["ag10_distinct_then_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_discount" not in plan and "o_totalprice" not in plan


def test_pairs_tie_in_the_rounded_sum(spark):
    """two points whose own squares differ in the last digit are level once the sun's part is added; the smaller pair wins."""
    suns = spark.createDataFrame([(5, 0.0, 0.6, 0.8)], "sun_id long, sx double, sy double, sz double")
    points = [(2, 0.1 + 0.2, 0.0, 0.0), (9, 0.3, 0.0, 0.0)] + [(i, 5.0, float(i), 0.0) for i in range(20, 90)]
    points += [(i, 0.3, 0.0, 0.0) for i in range(100, 120)]
    asked = spark.createDataFrame([(1, 0.6, 0.8, 0.0, 0.0, 0.0, 0.0)], "q_id long, sx double, sy double, sz double, x double, y double, z double")
    p = spark.createDataFrame(points, "pt_id long, x double, y double, z double")
    row = nearest.nearest_pair(asked, suns, p, 1.0).first()
    assert (0.1 + 0.2) ** 2 > 0.3**2 and (row["sun_id"], row["pt_id"]) == (5, 2)


def test_sun_index_counts_before_it_joins(spark, sf_dir):
    """suns and points are counted per class first, so no row per sun and point is made."""
    plan = plans.QUERIES["io06_sun_point_index"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def _directions(spark, n, name, seed):
    return spark.range(n).select(F.col("id").alias(name), *((F.rand(seed + i) * 2 - 1).alias(c) for i, c in enumerate(nearest.DXYZ)))


def test_radius_join_with_a_small_side_shuffles_nothing(spark):
    """27 copies of every left row were made for the join of cells."""
    left, right = nearest.kept(_directions(spark, 400, "q_id", 1), "l"), nearest.kept(_directions(spark, 300, "ray_id", 7), "r")
    found = nearest.within(left, right, "q_id", "ray_id", 0.3)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = lambda df: sorted((r["q_id"], r["ray_id"], r["dist"]) for r in df.collect())
    assert pairs(found) == pairs(nearest.within(left, right, "q_id", "ray_id", 0.3, small=0)) and found.count() > 100


def test_weights_of_neighbours_shuffle_nothing(spark):
    """Neighbours were dealt out again by query for every weight."""
    left, right = nearest.kept(_directions(spark, 400, "q_id", 1), "l"), nearest.kept(_directions(spark, 300, "ray_id", 7).withColumn("lum", F.col("ray_id") * 1.5), "r")
    lists = nearest.knn_lists(left, right, "q_id", "ray_id", nearest.DXYZ, 5, ("lum",), 2.0, distinct=False)
    drawn = interpolate.dithered(interpolate.knn_weights(lists, True))
    mean = interpolate.knn_interpolate(left, right, 5, True, with_angle=True, distinct=False)
    for df in (lists, drawn, mean):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and df.count() == 400
    rows = lambda df: sorted((r["q_id"], n["ray_id"], n["rank"], n["dist"], n["lum"]) for r in df.collect() for n in r["near"])
    assert rows(lists) == rows(nearest.knn_lists(left, right, "q_id", "ray_id", nearest.DXYZ, 5, ("lum",), 2.0, small=0))


def _sun_case(spark):
    suns = nearest.kept(_directions(spark, 60, "sun_id", 3).toDF("sun_id", *nearest.SUN), "s")
    asked = nearest.kept(_directions(spark, 150, "q_id", 5).toDF("q_id", *nearest.SUN), "a")
    points = spark.range(40).select(F.col("id").alias("pt_id"), (F.rand(11) * 9).alias("x"), (F.rand(12) * 9).alias("y"), F.lit(1.2).alias("z"))
    of = nearest.kept(suns.select("sun_id").join(points, F.expr("(pt_id + sun_id) % 3 = 0")), "p")
    return asked, suns, of, points.select((-F.col("pt_id")).alias("pt_id"), (F.col("x") + 0.05).alias("x"), "y", "z")


def test_candidate_suns_need_no_join(spark):
    """candidates were counted per query, and joined back twice through the driver's broadcasts."""
    asked, suns, *_ = _sun_case(spark)
    found = nearest.candidate_suns(asked, suns, 20.0, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    pairs = lambda df: sorted((r["q_id"], r["sun_id"], r["chord"]) for r in df.collect())
    assert pairs(found) == pairs(nearest.candidate_suns(asked, suns, 20.0, 3, small=0)) and found.count() >= 450


def _exchanged(df):
    """Rows that each shuffle of the plan has written, largest first."""
    df.write.format("noop").mode("overwrite").save()
    out, stack = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return sorted(out, reverse=True)


def test_points_of_suns_are_not_copied_per_query(spark, monkeypatch):
    """A row per query and sampled (or fixed) point was shuffled."""
    asked, suns, of, fixed = _sun_case(spark)
    near = nearest.candidate_lists(asked, suns, 20.0, 3)
    pairs = near.select("q_id", F.explode("near").alias("n")).select("q_id", "n.*")
    sampled = pairs.join(of, "sun_id")
    every = sampled.select("q_id", "sun_id", "pt_id", "chord", *(F.col(c).alias(f"_{c}") for c in "xyz")).crossJoin(fixed.select(F.col("pt_id").alias("f"), *"xyz"))
    want = every.groupBy("q_id", "f").agg(F.min(F.struct(nearest.squared("", "_", nearest.XYZ).alias("d2"), "pt_id", "sun_id", "chord")).alias("b"))
    want = sorted((r["q_id"], r["f"], r["b"]["sun_id"], r["b"]["chord"]) for r in want.collect())
    found = nearest.fixed_to_suns(near, of, fixed, 3.0)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 150 * 40
    assert max(_exchanged(found)) < 150 + of.count() * 8 + 40 * 8
    with_fixed = {(r["q_id"], r["pt_id"]): r["sun_id"] for r in nearest.points_by_sun(asked, suns, of, 0.5, 20.0, 3, fixed).collect()}
    given = {(q, f): s for q, f, s, _ in want}
    assert with_fixed and all(s == given[k] for k, s in with_fixed.items() if k[1] < 0)
    monkeypatch.setattr(nearest, "SERVED", 7)  # blocks in parts
    assert sorted(tuple(r) for r in nearest.fixed_to_suns(near, of, fixed, 3.0).collect()) == want


def test_rows_near_some_source_need_no_pairs(spark):
    """Pairs were listed and joined back to the rows."""
    left, right = nearest.kept(_directions(spark, 400, "ray_id", 1), "l"), nearest.kept(_directions(spark, 60, "sv_id", 7), "r")
    for some in (True, False):
        found = nearest.within_some(left, right, "ray_id", "sv_id", 0.3, some=some)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        assert rows(found) == rows(nearest.within_some(left, right, "ray_id", "sv_id", 0.3, some=some, small=0)) and 20 < found.count() < 380


def test_rebase_sky_by_sky_makes_pairs_last(spark, monkeypatch):
    """a row per sky and new point was made, shuffled twice and joined back."""
    zonal = nearest.kept(spark.range(600).select((F.col("id") % 5).cast("int").alias("sky"), F.col("id").alias("point"), *((F.floor(F.rand(i) * 6)).cast("double").alias(c) for i, c in enumerate("xyz")), F.lit(2.0).alias("area"), (F.col("id") * 1.5).alias("value")), "zonal")
    new = nearest.kept(spark.range(300).select(F.col("id").alias("q_id"), *((F.rand(40 + i) * 6).alias(c) for i, c in enumerate("xyz"))), "new")
    best = new.join(zonal.select("sky", "point", "value", *(F.col(c).alias(f"_{c}") for c in "xyz"))).groupBy("sky", "q_id").agg(F.min(F.struct(nearest.squared("", "_", nearest.XYZ).alias("d2"), "point", "value")).alias("b"))
    want = sorted((r["sky"], r["q_id"], r["b"]["value"]) for r in best.collect())
    for grouped, asking in ((200_000, 500_000), (100, 70)):
        monkeypatch.setattr(nearest, "GROUPED", grouped)
        monkeypatch.setattr(nearest, "ASKING", asking)
        found = cube.rebase_zonal(zonal, new, 100.0)
        assert sorted((r["sky"], r["point"], r["value"]) for r in found.collect()) == want and len(want) == 1500
    monkeypatch.undo()
    assert "CartesianProduct" not in (plan := cube.rebase_zonal(zonal, new, 100.0)._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1  # the number of points only


def test_points_of_one_place_do_not_fill_the_neighbours(spark, monkeypatch):
    """with many points on each place, k doubled until it reached other places."""
    spots = spark.range(49).select((F.col("id") % 7).cast("double").alias("x"), F.floor(F.col("id") / 7).cast("double").alias("y"), F.col("id").alias("at"))
    points = nearest.kept(spots.join(spark.range(30).withColumnRenamed("id", "n")).select((F.col("n") * 100 + F.col("at")).alias("pt_id"), "x", "y", (F.col("at") + F.col("n")).cast("double").alias("value")), "points")
    asked = nearest.kept(spark.range(80).select(F.col("id").alias("q_id"), (F.rand(1) * 7 - 0.5).alias("x"), (F.rand(2) * 7 - 0.5).alias("y")), "asked")
    listed, lists = [], nearest.knn_lists
    monkeypatch.setattr(interpolate, "knn_lists", lambda *a, **n: listed.append(a[5]) or lists(*a, **n))
    got = {r["q_id"]: r["value"] for r in interpolate.local_plane(asked, points).collect()}
    once = {r["q_id"]: r["value"] for r in interpolate.local_plane(asked, points.where("pt_id < 100")).collect()}
    assert got == once and len(got) == 80 and max(listed) <= 40
