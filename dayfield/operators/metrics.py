"""Metrics over rays in a view: named aggregates, built as columns over one grouped plan."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import directions as d
from ..functions import glare

KEYS = ("sky", "point", "view")
SCALE = glare.SCALE


def in_view(rays: DataFrame, views: DataFrame) -> DataFrame:
    """rays x views: rays within half the opening angle, with cos. ``views`` (view, vx, vy, vz, angle_deg) is a short list given by the
    caller; it is counted before it is broadcast."""
    if views.limit(1001).count() > 1000:
        raise ValueError("more than 1000 views")
    pairs = rays.crossJoin(F.broadcast(views)).withColumn("cos", d.dot(d.xyz("d"), d.xyz("v")))
    return pairs.where(F.col("cos") >= F.cos(F.radians(F.col("angle_deg") / 2)) - 1e-12)


def with_threshold(rays: DataFrame, keys: tuple[str, ...], threshold: float = 2000.0, task_deg: float = 30.0) -> DataFrame:
    """Adds is_src, task (in the task zone), pos. A threshold over 100 is cd/m2, else a factor of the task zone's mean luminance."""
    task = F.col("cos") >= math.cos(math.radians(task_deg / 2))
    out = rays.withColumn("task", task)
    over = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(F.when(task, F.col("lum") * F.col("omega"))).over(over), F.sum(F.when(task, F.col("omega"))).over(over)) * SCALE
    limit = F.lit(threshold) if threshold > 100 else F.lit(threshold) * mean
    return out.withColumn("is_src", F.coalesce(F.col("lum") * SCALE > limit, F.lit(False))).withColumn("pos", glare.position_index(d.xyz("d"), d.xyz("v")))


def _sum(value: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0.0))


def base_aggregates() -> dict[str, Column]:
    """Additive parts that every metric is made of."""
    lum, omega, cos, src, task = (F.col(c) for c in ("lum", "omega", "cos", "is_src", "task"))
    return {
        "illum": _sum(lum * omega * cos) * SCALE,
        "flux": _sum(lum * omega) * SCALE,
        "flux2": _sum(lum * lum * omega) * SCALE * SCALE,
        "view_area": _sum(omega),
        "n_rays": F.count("*").cast("double"),
        "sum_lum": _sum(lum) * SCALE,
        "srcillum": _sum(lum * omega * cos, src) * SCALE,
        "srcarea": _sum(omega, src),
        "maxlum": F.max(lum) * SCALE,
        "pwsl2": _sum(lum * lum * omega * SCALE * SCALE / (F.col("pos") * F.col("pos")), src),
        "task_flux": _sum(lum * omega, task) * SCALE,
        "task_area": _sum(omega, task),
        "back_flux": _sum(lum * omega, ~src) * SCALE,
        "back_area": _sum(omega, ~src),
    }


def derived() -> dict[str, Column]:
    """Metrics as expressions over the additive parts; names are the ones to ask for."""
    c = F.col
    back = (c("illum") - c("srcillum")) / math.pi
    t1, log_gc, t2, dgp = glare.dgp(c("illum"), c("pwsl2"))
    return {
        "illum": c("illum"),
        "avglum": F.try_divide(c("flux"), c("view_area")),
        "avgraylum": F.try_divide(c("sum_lum"), c("n_rays")),
        "gcr": F.coalesce(F.try_divide(F.try_divide(c("flux2"), c("view_area")), F.pow(F.try_divide(c("flux"), c("view_area")), F.lit(2))), F.lit(1.0)),
        "view_area": c("view_area"),
        "density": F.try_divide(c("n_rays"), c("view_area")),
        "tasklum": F.try_divide(c("task_flux"), c("task_area")),
        "backlum": back,
        "backlum_true": F.try_divide(c("back_flux"), c("back_area")),
        "srcillum": c("srcillum"),
        "srcarea": c("srcarea"),
        "maxlum": c("maxlum"),
        "pwsl2": c("pwsl2"),
        "dgp_t1": t1,
        "log_gc": log_gc,
        "dgp_t2": t2,
        "dgp": dgp,
        "ugr": glare.ugr(c("pwsl2"), back),
        "ugp": glare.ugp(c("pwsl2"), back),
    }


#: Further metrics by name.
REGISTRY: dict[str, Callable[[], Column]] = {}


def register(name: str, build: Callable[[], Column]) -> None:
    """A further metric: a column over the additive parts of ``base_aggregates``."""
    REGISTRY[name] = build


def evaluate(rays: DataFrame, keys: tuple[str, ...] = KEYS, wanted: list[str] | None = None, threshold: float = 2000.0) -> DataFrame:
    """One row per key with the wanted metrics in their order (default: all). Unknown names are an error.

    ``rays`` has dx, dy, dz, omega, lum, cos and the view vx, vy, vz."""
    known = derived() | {n: b() for n, b in REGISTRY.items()}
    names = list(known) if wanted is None else wanted
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown metrics: {missing}")
    parts = with_threshold(rays, keys, threshold).groupBy(*keys).agg(*(x.alias(n) for n, x in base_aggregates().items()))
    return parts.select(*keys, *(known[n].alias(n) for n in names))


def unpivoted(wide: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), names, "metric", "value")


def rebuilt(summed: DataFrame) -> DataFrame:
    """dgp and ugp from additive parts that were summed over sources (illum, backlum, pwsl2)."""
    _, _, _, dgp = glare.dgp(F.col("illum"), F.col("pwsl2"))
    return summed.withColumn("dgp", dgp).withColumn("ugp", glare.ugp(F.col("pwsl2"), F.col("backlum")))


def log_gcr(rays: DataFrame, keys: tuple[str, ...], floor: float = 1e-4, scale: float = 8.0) -> DataFrame:
    """ln(gcr) / scale of luminance floored at ``floor``."""
    lum = F.greatest(F.col("lum"), F.lit(floor))
    sums = rays.groupBy(*keys).agg(F.sum(lum * lum * F.col("omega")).alias("s2"), F.sum(lum * F.col("omega")).alias("s1"), F.sum("omega").alias("s0"))
    return sums.select(*keys, (F.log(F.col("s2") * F.col("s0") / (F.col("s1") * F.col("s1"))) / scale).alias("loggcr"))


def peak_direction(rays: DataFrame, keys: tuple[str, ...], threshold: float = 0.0) -> DataFrame:
    """xpeak, ypeak: weighted direction of rays over max(.9 * maximum, threshold); 1 - acos(component) / pi, 1 where undefined."""
    top = F.max("lum").over(Window.partitionBy(*keys))
    bright = rays.withColumn("_top", top).where(F.col("lum") > F.greatest(0.9 * F.col("_top"), F.lit(threshold)))
    w = F.col("lum") * F.col("omega")
    sums = bright.groupBy(*keys).agg(*(F.sum(F.col(f"d{c}") * w).alias(c) for c in "xyz"))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    part = lambda c: F.coalesce(1 - F.acos(d.clip(F.try_divide(F.col(c), size), -1.0, 1.0)) / math.pi, F.lit(1.0))
    return sums.select(*keys, part("x").alias("xpeak"), part("y").alias("ypeak"))


def field(rays: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Average field vector (unit part and magnitude) and the brightest ray."""
    w = F.col("lum") * F.col("omega")
    best = F.max_by(F.struct("dx", "dy", "dz", "lum"), F.struct("lum", -F.col("ray_id"))).alias("b")
    sums = rays.groupBy(*keys).agg(*((F.sum(F.col(f"d{c}") * w) * SCALE / F.sum("omega")).alias(c) for c in "xyz"), best)
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    return sums.select(*keys, *(F.try_divide(F.col(c), size).alias(f"avg_{c}") for c in "xyz"), size.alias("avg_mag"), *((F.col(f"b.d{c}") * F.col("b.lum")).alias(f"peak_{c}") for c in "xyz"))


def equator(spark, n: int, closed: bool = False) -> DataFrame:
    """(k, phi, ex, ey): n angles around the equator; ``closed`` repeats the first at 2 pi."""
    step = 2 * math.pi / (n - 1 if closed else n)
    k = spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") * step).alias("phi"))
    return k.withColumn("ex", F.cos("phi")).withColumn("ey", F.sin("phi"))


def equator_of(rows: DataFrame, n: str, closed: bool = False) -> DataFrame:
    """``rows`` times their own number ``n`` of equator angles: k, phi, ex, ey; ``closed`` ends with the first angle again (k = n)."""
    k = F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - (0 if closed else 1)))
    return rows.withColumn("k", k).withColumn("phi", F.col("k") * 2 * math.pi / F.col(n)).withColumn("ex", F.cos("phi")).withColumn("ey", F.sin("phi"))


def around(rays: DataFrame, angles: DataFrame, keys: tuple[str, ...], sigma_deg: float = 10.0, low_below: float = 1000.0) -> DataFrame:
    """Per equator angle: eq_lum (gaussian mean weighted by sin theta * omega, wrapped), eq_illum, eq_gcr, eq_loggc, eq_dgp.

    ``angles`` comes from ``equator``: its few rows are broadcast."""
    pairs = rays.crossJoin(F.broadcast(angles))
    cos = F.greatest(F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey"), F.lit(0.0))
    gap = F.abs(F.atan2(F.sin(F.atan2("dy", "dx") - F.col("phi")), F.cos(F.atan2("dy", "dx") - F.col("phi"))))
    kernel = F.exp(-gap * gap / (2 * math.radians(sigma_deg) ** 2)) * F.sqrt(F.greatest(1 - F.col("dz") * F.col("dz"), F.lit(0.0))) * F.col("omega")
    sums = pairs.groupBy(*keys, "k").agg(
        F.try_divide(F.sum(kernel * F.col("lum")), F.sum(kernel)).alias("eq_lum"), F.sum(F.col("lum") * F.col("omega") * cos).alias("e"),
        F.sum(F.col("lum") * F.col("lum") * F.col("omega") * cos).alias("e2"), F.sum(F.col("omega") * cos).alias("a"),
    )
    ev = F.col("e") * SCALE
    _, log_gc, _, dgp = glare.dgp(ev, F.col("e2") * SCALE * SCALE, low_below)
    return sums.select(*keys, "k", "eq_lum", ev.alias("eq_illum"), F.try_divide(F.col("e2") * F.col("a"), F.col("e") * F.col("e")).alias("eq_gcr"), log_gc.alias("eq_loggc"), dgp.alias("eq_dgp"))


def azimuth_density(rays: DataFrame, angles: DataFrame, keys: tuple[str, ...], sigma: float = 0.3) -> DataFrame:
    """eq_density: gaussian density of azimuth over three wraps, bandwidth sigma / 3 deviations of the tripled data, times 3."""
    az = rays.select(*keys, F.explode(F.array(*(F.lit(k * 2 * math.pi) for k in (-1, 0, 1)))).alias("w"), F.atan2("dy", "dx").alias("a")).select(*keys, (F.col("a") + F.col("w")).alias("a"))
    width = az.groupBy(*keys).agg((F.stddev_samp("a") * sigma / 3).alias("h"))
    pairs = az.join(width, list(keys)).crossJoin(F.broadcast(angles))
    z = F.try_divide(F.col("phi") - F.col("a"), F.col("h"))
    return pairs.groupBy(*keys, "k").agg((F.avg(F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2 * math.pi))) * 3).alias("eq_density"))


def occluded(rays: DataFrame, sources: DataFrame, large: float = 0.00027) -> DataFrame:
    """Rays with those hidden behind a large source left out, plus the sources as rays.

    By angle to the source, the nearest rays go whose running solid angle stays within the source's own, but for the last of
    them. Both have (pt_id, ray_id, dx, dy, dz, omega, lum); one large source a point (the one with the smallest id) hides rays."""
    big = sources.where(F.col("omega") > large).groupBy("pt_id").agg(F.min_by(F.struct("dx", "dy", "dz", "omega"), "ray_id").alias("s"))
    seen = rays.join(big, "pt_id", "left").withColumn("_cos", F.col("dx") * F.col("s.dx") + F.col("dy") * F.col("s.dy") + F.col("dz") * F.col("s.dz"))
    order = Window.partitionBy("pt_id").orderBy(F.col("_cos").desc(), "ray_id")
    run = seen.withColumn("_run", F.sum("omega").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(order))
    inside = run.withColumn("_n", F.sum(F.when(F.col("_run") <= F.col("s.omega"), 1).otherwise(0)).over(Window.partitionBy("pt_id")))
    kept = inside.where(F.col("s").isNull() | (F.col("_row") > F.greatest(F.col("_n") - 1, F.lit(0))))
    columns = ["pt_id", "ray_id", "dx", "dy", "dz", "omega", "lum"]
    return kept.select(*columns).unionByName(sources.select(*columns))
