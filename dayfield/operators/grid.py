"""Measured grids and the planning of the next, finer round of samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import directions as d
from ..functions.draws import uniform, weighted_key
from .nearest import kept, knn

#: Kernels of the detail filters: per direction the weights of (-1, 0, 1) along it.
HAAR, WAVELET = (-1.0, 1.0), (-0.5, 1.0, -0.5)


def detail(grid: DataFrame, keys: list[str], kernel: str = "wav", mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """Adds detail: the sum of absolute responses along rows, columns and both diagonals of (keys, i, j, value).

    wav: -1/2, 1, -1/2 around the cell; haar: the difference to the cell before. Outside the grid ``reflect`` and ``nearest`` repeat
    the edge cell, ``mirror`` takes the cell on the other side, ``wrap`` the far edge, ``constant`` the value ``cval``."""
    if mode not in ("reflect", "nearest", "constant", "mirror", "wrap"):
        raise ValueError(f"unknown edge mode {mode!r}")
    size = grid.groupBy(*keys).agg(F.max("i").alias("_hi_i"), F.max("j").alias("_hi_j"), F.min("i").alias("_lo_i"), F.min("j").alias("_lo_j"))
    own = grid.join(size, keys)
    steps = [(1, 0), (0, 1), (1, 1), (1, -1)]
    taps = [(k, s, s * di, s * dj) for k, (di, dj) in enumerate(steps) for s in ((-1, 1) if kernel == "wav" else (-1,))]
    asked = own.withColumn("_tap", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for k, s, di, dj in taps))))

    def folded(axis: str) -> Column:
        at, lo, hi = F.col(axis) + F.col(f"_tap.d{axis}"), F.col(f"_lo_{axis}"), F.col(f"_hi_{axis}")
        if mode == "constant":
            return at
        if mode in ("reflect", "nearest"):
            return F.least(F.greatest(at, lo), hi)
        if mode == "mirror":
            return F.when(at < lo, F.least(2 * lo - at, hi)).when(at > hi, F.greatest(2 * hi - at, lo)).otherwise(at)
        return F.pmod(at - lo, hi - lo + 1) + lo

    asked = asked.withColumn("_i", folded("i")).withColumn("_j", folded("j"))
    to = grid.select(*keys, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("_v"))
    near = asked.join(to, [*keys, "_i", "_j"], "left").withColumn("_v", F.coalesce("_v", F.lit(cval) if mode == "constant" else F.col("value")))
    weight = 0.5 if kernel == "wav" else 1.0
    along = near.groupBy(*keys, "i", "j", "value", F.col("_tap.k").alias("_k")).agg(F.abs(F.first("value") - weight * F.sum("_v")).alias("_r"))
    return along.groupBy(*keys, "i", "j", "value").agg(F.sum("_r").alias("detail"))


def normalised(grid: DataFrame, keys: list[str], inside: str | None = None, edge: float = 0.0) -> DataFrame:
    """Adds norm: (value - min) / (max - min) over each key (no keys: over all rows, by one aggregation); unchanged where all values agree.

    ``inside`` names a boolean column: cells outside the zone do not count and take the constant ``edge``."""
    of = F.when(F.col(inside), F.col("value")) if inside else F.col("value")
    span = grid.groupBy(*keys).agg(F.min(of).alias("_lo"), F.max(of).alias("_hi"))
    both = grid.join(span, keys) if keys else grid.crossJoin(span)
    norm = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("value"))
    return both.withColumn("norm", F.when(F.col(inside), norm).otherwise(F.lit(edge)) if inside else norm).drop("_lo", "_hi")


REDUCERS = {"max": F.max, "sum": F.sum, "avg": F.avg}


def reduce_features(grid: DataFrame, keys: list[str], how: str = "max", value: str = "value") -> DataFrame:
    """One value per (keys, i, j) over the features: max, sum or avg."""
    return grid.groupBy(*keys, "i", "j").agg(REDUCERS[how](value).alias(value))


def threshold(level: int, levels: int, t0: float = 0.25, t1: float = 0.1, accuracy: float = 1.0) -> float:
    """Threshold ladder from t0 to t1, times the accuracy; with two levels the second is the mean of both."""
    if levels == 2:
        return accuracy * (t0 if level == 0 else (t0 + t1) / 2)
    return accuracy * ((t1 - t0) / max(1, levels - 1) * level + t0)


#: Buckets of a histogram of keys, and rows of a run that one task may rank.
BUCKETS, RANKED = 1024, 100_000


def _on(df: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
    """``df`` with the columns of ``side`` (one row per key; one row where there are no keys)."""
    return df.join(side, keys) if keys else df.crossJoin(F.broadcast(side))


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: str, ranked: int = RANKED) -> DataFrame:
    """The first rows of each run by the numeric columns ``order``, as many as its column ``n`` says; ``n`` is dropped.

    A run of up to ``ranked`` rows is ranked in one window. A larger one is selected by histograms: the span of its first order column
    that is not constant is cut into BUCKETS, counts say in which bucket the n-th row lies, all rows before it are taken and only that
    bucket goes on, until it is small. So no run of any size is one task, unless its rows are equal in every order column."""
    if not keys:
        return first_n(rows.withColumn("_run", F.lit(0)), ["_run"], order, n, ranked).drop("_run")
    largest = lambda df: df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    going, taken, most = rows, [], largest(rows)
    while most > ranked:
        span = going.groupBy(*keys).agg(*(f(c).cast("double").alias(f"_{x}{k}") for k, c in enumerate(order) for x, f in (("lo", F.min), ("hi", F.max))))
        place = lambda k: F.least(F.floor((F.col(order[k]) - F.col(f"_lo{k}")) / (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * BUCKETS), F.lit(BUCKETS - 1))
        at = F.coalesce(*(F.when(F.col(f"_hi{k}") > F.col(f"_lo{k}"), F.coalesce(place(k), F.lit(-1))) for k in range(len(order))), F.lit(0)).cast("int")
        dealt = going.join(span, keys).withColumn("_at", at).select(*going.columns, "_at")
        counts = dealt.groupBy(*keys, "_at").agg(F.count("*").alias("_c"), F.max(n).alias("_n"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = kept(counts.withColumn("_before", before).where((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_c") >= F.col("_n"))).select(*keys, F.col("_at").alias("_edge"), "_before"), "edges")
        fewer = counts.groupBy(*keys).agg(F.sum("_c").alias("_c"), F.max("_n").alias("_n")).where("_c < _n").select(*keys)
        met = dealt.join(edge, keys)
        taken += [dealt.join(fewer, keys, "left_semi").drop("_at", n), met.where("_at < _edge").drop("_at", "_edge", "_before", n)]
        going = kept(met.where("_at = _edge").withColumn(n, F.col(n) - F.col("_before")).select(*going.columns), "going")
        if (now := largest(going)) >= most:
            break
        most = now
    ranks = going.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= F.col(n)).drop("_r", n)
    return reduce(DataFrame.unionByName, [ranks, *taken])


def draw(cells: DataFrame, keys: list[str], limit: float, value: str = "detail", least: int = 1) -> DataFrame:
    """Cells over the limit; where fewer than ``least`` are, the first cells by (i, j) make up the number.

    Counted per run by a grouping; only runs that lack cells select further ones (``first_n``)."""
    over = F.coalesce(F.col(value) > limit, F.lit(False))
    picked = cells.where(over)
    if least <= 0:
        return picked
    lacking = cells.groupBy(*keys).agg((F.lit(least) - F.sum(over.cast("long"))).alias("_n")).where("_n > 0")
    return picked.unionByName(first_n(_on(cells.where(~over), keys, lacking), keys, ["i", "j"], "_n"))


def draw_weighted(cells: DataFrame, keys: list[str], limit: float, value: str = "detail", lb: float = 0.5, ub: float = 2.0, least: int = 1, seed: int = 42, ranked: int = RANKED) -> DataFrame:
    """As many cells as exceed the limit, drawn without replacement: candidates over lb * limit, weight clipped at ub * limit.

    Where no cell is a candidate, ``least`` cells are drawn evenly. The draw follows from the seed and the cell, not from the partitioning.
    The number comes from a grouping, the cells with the smallest keys from ``first_n``."""
    candidate = F.col(value) > lb * limit
    n = F.greatest(F.sum(F.when(F.col(value) > limit, 1).otherwise(0)), F.lit(least)).cast("long")
    found = _on(cells, keys, cells.groupBy(*keys).agg(n.alias("_n"), F.max(candidate).alias("_any"))).where(candidate | ~F.col("_any"))
    weight = F.when(F.col("_any"), F.least(F.col(value), F.lit(ub * limit))).otherwise(1.0)
    found = found.withColumn("_key", weighted_key(uniform(seed, *keys, "i", "j"), weight)).drop("_any")
    return first_n(found, keys, ["_key", "i", "j"], "_n", ranked).drop("_key")


def draw_suns(cells: DataFrame, limit: float, sun: str = "feature") -> DataFrame:
    """Cells per sun whose value bends along the ordered suns of their plan cell by more than the limit; suns without one drop out."""
    over = Window.partitionBy("i", "j").orderBy(sun)
    near = lambda f: F.coalesce(f("value").over(over), F.col("value"))
    found = cells.withColumn("detail", F.abs(F.col("value") - 0.5 * (near(F.lag) + near(F.lead))))
    return draw(found, [sun], limit, least=0)


def lift(coarse: DataFrame, keys: list[str], factor: int = 2) -> DataFrame:
    """Every coarse cell as factor * factor fine cells of the same value."""
    k = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    return coarse.withColumn("_a", k).withColumn("_b", k).select(*keys, (F.col("i") * factor + F.col("_a")).alias("i"), (F.col("j") * factor + F.col("_b")).alias("j"), "value")


def plan_next(grid: DataFrame, keys: list[str], level: int, levels: int, measured: DataFrame | None = None, how: str = "max", **options) -> DataFrame:
    """Requests of the next round: all cells where a grid is even (variance under 1e-9) at level 0, else cells with detail.

    Cells of ``measured`` (keys, i, j) are left out."""
    found = reduce_features(detail(grid, [*keys, "feature"], **options), keys, how, "detail")
    found = _on(found, keys, found.groupBy(*keys).agg((F.var_pop("detail") < 1e-9).alias("_even")))
    found = found.join(measured, [*keys, "i", "j"], "left_anti") if measured is not None else found
    limit = threshold(level, levels)
    picked = draw(found.where(~F.col("_even")), keys, limit)
    whole = found.where("_even") if level == 0 else found.where("_even and i = 0 and j = 0")
    return picked.unionByName(whole).drop("_even")


def updated(grid: DataFrame, measured: DataFrame, keys: list[str], positive_only: bool = False) -> DataFrame:
    """Measured values written into the grid; only positive ones if asked."""
    new = measured.select(*keys, "i", "j", F.col("value").alias("_new"))
    ok = F.col("_new").isNotNull() & ((F.col("_new") > 0) if positive_only else F.lit(True))
    return grid.join(new, [*keys, "i", "j"], "left").withColumn("value", F.when(ok, F.col("_new")).otherwise(F.col("value"))).drop("_new")


def scheme(spark, resolution: int, levels: int, aspect: int = 1) -> DataFrame:
    """(level, rows, columns): aspect * res * 2^i by res * 2^i."""
    return spark.range(levels).select(F.col("id").cast("int").alias("level"), (aspect * resolution * F.pow(F.lit(2), F.col("id"))).cast("int").alias("rows"), (resolution * F.pow(F.lit(2), F.col("id"))).cast("int").alias("columns"))


def statistics(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """(level, n, rate): samples and their share of the cells per level, and a total with a null level."""
    per = samples.groupBy("level").agg(F.count("*").alias("n")).join(cells.select("level", (F.col("rows") * F.col("columns")).alias("cells")), "level")
    total = per.agg(F.lit(None).cast("int").alias("level"), F.sum("n").alias("n"), F.sum("cells").alias("cells"))
    return per.unionByName(total).select("level", "n", (F.col("n") / F.col("cells")).alias("rate"))


def batch_index(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Adds idx: running number within a run, ordered by level and cell.

    Numbered within each (level, i) of a run, from where the rows before it end: sums over the counts of the (level, i) give that."""
    lines = samples.groupBy(*keys, "level", "i").agg(F.count("*").alias("_n"))
    base = lines.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("level", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "level", "i").orderBy("j"))
    return samples.withColumn("_k", within).join(base, [*keys, "level", "i"]).withColumn("idx", (F.col("_base") + F.col("_k") - 1).cast("int")).drop("_base", "_k")


def unanswered(requests: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Requests that have no answer yet: what a resumed run still has to do."""
    return requests.join(answers.select(*on).distinct(), on, "left_anti")


def repeated(guide: DataFrame, source: str) -> DataFrame:
    """The samples of a guide run as requests for another source."""
    return guide.select("pt_id", "ray_id", "dx", "dy", "dz", F.lit(source).alias("source")).distinct()


def mean_positive(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.where("value > 0").groupBy(*keys).agg(F.avg("value").alias("scale"))


def source_raster(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, i, j, dx, dy, dz, omega, lum): the full n * n square map of each key; cells without a sample take the nearest one."""
    spark = cells.sparkSession
    grid = spark.range(n * n).select(F.col("id").alias("cell"), F.floor(F.col("id") / n).cast("double").alias("i"), (F.col("id") % n).cast("double").alias("j"))
    asked = cells.select(*keys).distinct().crossJoin(F.broadcast(grid))
    samples = cells.select(*keys, (F.col("i") * n + F.col("j")).cast("long").alias("_sample"), F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"), "lum")
    near = knn(asked, samples, "cell", "_sample", ("i", "j"), 1, float(n), tuple(keys))
    filled = near.join(samples.select(*keys, "_sample", "lum"), [*keys, "_sample"])
    u, v = d.bin_uv(F.col("cell"), n)
    at = d.from_uv(u, v)
    return filled.select(*keys, F.floor(F.col("cell") / n).cast("int").alias("i"), (F.col("cell") % n).cast("int").alias("j"), at.x.alias("dx"), at.y.alias("dy"), at.z.alias("dz"), F.lit(2 * math.pi / (n * n)).alias("omega"), "lum")


def bilinear(queries: DataFrame, pixels: DataFrame, q_id: str = "q_id", keys: list[str] | None = None) -> DataFrame:
    """([keys,] q_id, value): weighted sum of the four pixels around (i, j) in pixel units; outside, the median of the border.

    With ``keys`` there is one raster per key and a query looks into its own."""
    keys = keys or []
    size = pixels.groupBy(*keys).agg(F.max("i").alias("_hi"), F.max("j").alias("_hj"))
    edge = _on(pixels, keys, size).where("i = 0 or j = 0 or i = _hi or j = _hj").groupBy(*keys).agg(F.median("value").alias("_edge"))
    at = queries.withColumn("_i", F.floor("i").cast("int")).withColumn("_j", F.floor("j").cast("int"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    each = at.withColumn("_c", corner)
    fi, fj = F.col("i") - F.col("_i"), F.col("j") - F.col("_j")
    w = F.when(F.col("_c.a") == 1, fi).otherwise(1 - fi) * F.when(F.col("_c.b") == 1, fj).otherwise(1 - fj)
    each = each.select(*keys, q_id, (F.col("_i") + F.col("_c.a")).alias("_pi"), (F.col("_j") + F.col("_c.b")).alias("_pj"), w.alias("_w"))
    found = each.join(pixels.select(*keys, F.col("i").alias("_pi"), F.col("j").alias("_pj"), "value"), [*keys, "_pi", "_pj"], "left")
    sums = found.groupBy(*keys, q_id).agg(F.sum(F.col("_w") * F.col("value")).alias("_v"), F.sum(F.when(F.col("value").isNull() & (F.col("_w") > 0), 1).otherwise(0)).alias("_miss"))
    return _on(sums, keys, edge).select(*keys, q_id, F.when(F.col("_miss") > 0, F.col("_edge")).otherwise(F.col("_v")).alias("value"))


def ray_parents(tree: DataFrame) -> DataFrame:
    """(tree_id, seq, px, py, pz, material): for each sky hit the first later row one level up, if its direction differs (dot < .99).

    ``tree`` is (tree_id, seq, level, dx, dy, dz, material[, nx, ny, nz]); normals of the parents come along."""
    normal = [c for c in ("nx", "ny", "nz") if c in tree.columns]
    hits = tree.where("material = 'sky'").select("tree_id", F.col("seq").alias("_s"), (F.col("level") - 1).alias("level"), *(F.col(f"d{c}").alias(f"_{c}") for c in "xyz"))
    later = hits.join(tree, ["tree_id", "level"]).where("seq > _s").groupBy("tree_id", "_s", "_x", "_y", "_z").agg(F.min_by(F.struct("dx", "dy", "dz", "material", *normal), "seq").alias("p"))
    differs = F.col("_x") * F.col("p.dx") + F.col("_y") * F.col("p.dy") + F.col("_z") * F.col("p.dz") < 0.99
    return later.where(differs).select("tree_id", F.col("_s").alias("seq"), F.col("p.dx").alias("px"), F.col("p.dy").alias("py"), F.col("p.dz").alias("pz"), "p.material", *(f"p.{c}" for c in normal))


def distinct_normals(parents: DataFrame, digits: int = 6) -> DataFrame:
    """(nx, ny, nz): the different surface normals of ray parents, to ``digits`` decimals."""
    return parents.select(*(F.round(c, digits).alias(c) for c in ("nx", "ny", "nz"))).distinct()


def compressed(rays: DataFrame, keys: list[str], patch: Column, lum_step: float = 0.2) -> DataFrame:
    """Lossy compression: rays of one direction cell and one luminance step (a log scale) become one ray.

    Directions are omega-weighted and renormalised, omega is summed, luminance is omega-weighted, so the energy (sum of omega * lum)
    stays."""
    step = F.floor(F.log(F.greatest("lum", F.lit(1e-9))) / math.log1p(lum_step)).cast("int")
    w = F.col("omega")
    sums = rays.groupBy(*keys, patch.alias("_cell"), step.alias("_step")).agg(*(F.sum(w * F.col(f"d{c}")).alias(c) for c in "xyz"), F.sum(w).alias("omega"), (F.sum(w * F.col("lum")) / F.sum(w)).alias("lum"), F.min("ray_id").alias("ray_id"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return sums.select(*keys, "ray_id", *(F.try_divide(F.col(c), size).alias(f"d{c}") for c in "xyz"), "omega", "lum")


def source_views(rays: DataFrame, keys: list[str], least: float = 1e-8, none: float = 1e-7) -> DataFrame:
    """(keys, dx, dy, dz, lum, share, omega, radius) of the rays that see a source; no row where nothing exceeds ``none``."""
    over = rays.withColumn("_seen", F.col("lum") > least)
    mean = lambda c: F.avg(F.when(F.col("_seen"), F.col(c)))
    sums = over.groupBy(*keys).agg(mean("dx").alias("x"), mean("dy").alias("y"), mean("dz").alias("z"), mean("lum").alias("lum"), F.avg(F.col("_seen").cast("double")).alias("share"), F.sum("omega").alias("all"), F.max("lum").alias("top")).where(F.col("top") > none)
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    omega = F.col("all") * F.col("share")
    return sums.select(*keys, *(F.try_divide(F.col(c), size).alias(f"d{c}") for c in "xyz"), "lum", "share", omega.alias("omega"), F.sqrt(omega / math.pi).alias("radius"))
