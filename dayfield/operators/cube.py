"""The result cube as a long table (sky, point, view, metric, value): filter, pivot, merge, pad, rebase, summarise, compare."""

from __future__ import annotations

import itertools
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nearest import XYZ, kept, nearest, nearest_in_each

AXES = ("sky", "point", "view", "metric")


def axis(name: str | int) -> str:
    """The axis of a name or number; an unknown one is an error."""
    if isinstance(name, int):
        if not -len(AXES) <= name < len(AXES):
            raise ValueError(f"no axis {name}")
        return AXES[name]
    if name not in AXES:
        raise ValueError(f"no axis {name!r}")
    return name


def axis_filter(result: DataFrame, **wanted) -> DataFrame:
    """Rows whose axis values are listed; a range is (first, last) in a tuple, an empty list means no filter."""
    for name, values in wanted.items():
        column = F.col(axis(name))
        if isinstance(values, tuple):
            result = result.where(column.between(*values))
        elif isinstance(values, list):
            result = result.where(column.isin(values)) if values else result
        else:
            result = result.where(column == values)
    return result


#: Labels of one axis that may become columns or names in a plan.
MOST_LABELS = 10_000


def _labels(rows: DataFrame, axis: str) -> list:
    """The distinct labels of an axis in order; more than MOST_LABELS are an error, never a part of them."""
    found = [r[0] for r in rows.select(axis).distinct().orderBy(axis).limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"{axis} has more than {MOST_LABELS} labels: name the ones to take")
    return found


def metric_filter(result: DataFrame, wanted: list[str | int]) -> DataFrame:
    """Rows of metrics by name or by place in their order; unknown names warn and are left out."""
    known = _labels(result, "metric")
    names = [known[w] if isinstance(w, int) and -len(known) <= w < len(known) else w for w in wanted]
    for name in names:
        if name not in known:
            warnings.warn(f"no metric {name!r}", stacklevel=2)
    return result.where(F.col("metric").isin([n for n in names if n in known]))


def sky_filter(result: DataFrame, times: DataFrame) -> DataFrame:
    """Rows of the skies in ``times`` (a column t of a filtered sky table); an empty result is an error."""
    if not times.limit(1).count():
        raise ValueError("the sky filter leaves no time")
    return filter_by(result, "sky", times.select("t"))


def filter_by(result: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """Rows whose axis value is in the one-column table ``labels``."""
    only = labels.select(F.col(labels.columns[0]).alias(axis(name))).distinct()
    return result.join(only, axis(name), "left_semi")


def pull(result: DataFrame, column: str, values: list, **filters) -> DataFrame:
    """One column per value of the ``column`` axis, one row per combination of the other axes.

    One grouping: a pivot would group by all axes first, with tables of groups in the memory of the same task."""
    rows = [a for a in AXES if a != axis(column)]
    cells = [F.first(F.when(F.col(column) == F.lit(v), F.col("value")), ignorenulls=True).alias(str(v)) for v in values]
    return axis_filter(result, **filters).groupBy(*rows).agg(*cells)


def pull_order(*axes: str | int) -> list[str]:
    """All axes: those given, then the others in their own order."""
    named = [axis(a) for a in axes]
    if len(set(named)) < len(named):
        raise ValueError(f"an axis is named twice: {named}")
    return named + [a for a in AXES if a not in named]


def pull_axes(result: DataFrame, *axes: str | int, labels: dict[str, list] | None = None, preserve: int = 1, **filters) -> DataFrame:
    """The cube with the first ``preserve`` axes (of ``pull_order``) as columns and the others as label columns of the rows.

    Columns are named by their labels, joined by "_" where several axes are kept. ``labels`` gives the values of the kept axes; an
    axis that is left out takes the distinct ones (they become columns: more than MOST_LABELS are an error)."""
    order = pull_order(*axes)
    kept, rows = order[:preserve], order[preserve:]
    found = axis_filter(result, **filters)
    known = {a: (labels or {}).get(a) or _labels(found, a) for a in kept}
    names = ["_".join(map(str, combo)) for combo in itertools.product(*known.values())]
    key = F.concat_ws("_", *(F.col(a).cast("string") for a in kept))
    return found.withColumn("_column", key).groupBy(*rows).pivot("_column", names).agg(F.first("value"))


def pull_zonal(result: DataFrame, column: str, values: list, **filters) -> DataFrame:
    """``pull`` of a ragged cube: points belong to a sky, so sky cannot be the column and point can neither be it nor be filtered."""
    if column in ("sky", "point") or "point" in filters:
        raise ValueError("a ragged cube has no column or filter over its points, and no sky column")
    return pull(result, column, values, **filters)


def merge(*results: DataFrame, along: str) -> DataFrame:
    """Union along one axis; for a label of that axis that several cubes have, the first cube's values stay."""
    if len(results) < 2:
        raise ValueError("a merge needs two results at least")
    name = axis(along)
    ordered = reduce(DataFrame.unionByName, [r.select(*AXES, "value", F.lit(i).alias("_from")) for i, r in enumerate(results)])
    first = ordered.groupBy(name).agg(F.min("_from").alias("_first"))
    return ordered.join(first, name).where("_from = _first").select(*AXES, "value")


def axis_mismatches(left: DataFrame, right: DataFrame, along: str, tolerance: float = 1e-5) -> DataFrame:
    """(axis, label, side): labels of the other axes that only one cube has. A merge is sound where this is empty.

    Numbers agree if they differ by ``tolerance`` or less, relative to the larger and at least absolutely: labels are dealt into cells of that
    width and meet in the same or the next cell. Other labels must be equal."""
    parts = []
    for name in AXES:
        if name != axis(along):
            number = isinstance(left.schema[name].dataType, T.NumericType)
            sides = []
            for r in (left, right):
                label = r.select(F.col(name).cast("string").alias("label"), *([F.col(name).cast("double").alias("v")] if number else [])).distinct()
                sides.append(label.withColumn("cell", F.floor(F.asinh(F.col("v")) / (2 * tolerance))) if number else label.withColumn("cell", F.col("label")))
            for (one, two), side in zip((sides, sides[::-1]), ("left", "right"), strict=True):
                if number:
                    near = two.select(F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("_c"), F.col("v").alias("_v"))
                    close = F.abs(F.col("v") - F.col("_v")) <= tolerance * F.greatest(F.abs("v"), F.abs("_v"), F.lit(1.0))
                    alone = one.join(near, (F.col("cell") == F.col("_c")) & close, "left_anti")
                else:
                    alone = one.join(two.select(F.col("cell").alias("_c")), F.col("cell") == F.col("_c"), "left_anti")
                parts.append(alone.select(F.lit(name).alias("axis"), "label", F.lit(side).alias("side")))
    return reduce(DataFrame.unionByName, parts)


def merge_checked(*results: DataFrame, along: str) -> DataFrame:
    """``merge`` of cubes whose other axes agree; else an error that names the first mismatches."""
    for other in results[1:]:
        if bad := axis_mismatches(results[0], other, along).limit(5).collect():
            raise ValueError(f"axes differ: {[tuple(r) for r in bad]}")
    return merge(*results, along=along)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Chunks of one evaluation over skies as one cube; a sky that two chunks hold is an error of the caller and stays twice."""
    return reduce(DataFrame.unionByName, [p.select(*AXES, "value") for p in parts])


def percentiles(result: DataFrame, metric, levels: list[float]) -> DataFrame:
    """(point, view, level, value): exact percentiles over skies of one metric, linear between ranks."""
    found = result.where(F.col("metric") == metric).groupBy("point", "view").agg(F.percentile("value", F.array(*map(F.lit, levels))).alias("p"))
    return found.select("point", "view", F.posexplode("p").alias("i", "value")).select("point", "view", F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1).alias("level"), "value")


def pad(result: DataFrame, times: DataFrame, fill: float = 0.0) -> DataFrame:
    """Every time of ``times`` (a column sky) for every (point, view, metric); missing values take ``fill``."""
    others = result.select("point", "view", "metric").distinct()
    return times.select("sky").distinct().crossJoin(others).join(result, list(AXES), "left").select(*AXES, F.coalesce("value", F.lit(fill)).alias("value"))


def rebase(result: DataFrame, old_points: DataFrame, new_points: DataFrame) -> DataFrame:
    """The cube at new points: each takes its nearest old point's values, with the distance as metric ``rebase_err``.

    Distances are found once per point and then joined to the facts. A cell's metrics are one row in the join and come apart, with its distance, in the last
    step: no row of the moved cube is shuffled. A q_id has one position."""
    near = nearest(new_points, old_points.withColumnRenamed("pt_id", "point"), "q_id", "point", XYZ, 10.0)
    kind = result.schema["metric"].dataType
    cells = result.groupBy("sky", "point", "view").agg(F.collect_list(F.struct("metric", F.col("value").cast("double").alias("value"))).alias("_cells"))
    error = F.array(F.struct(F.lit("rebase_err").cast(kind).alias("metric"), F.col("dist").alias("value")))
    moved = cells.join(near, "point").select("sky", F.col("q_id").alias("point"), "view", F.explode(F.concat("_cells", error)).alias("_c"))
    return moved.select("sky", "point", "view", "_c.metric", "_c.value")


def rebase_zonal(zonal: DataFrame, new_points: DataFrame, total: float) -> DataFrame:
    """A ragged cube at new points, sky by sky. ``zonal`` is (sky, point, x, y, z, area, value); every sky has its own points.

    Positions are dropped, area becomes origarea and the new area is ``total`` over the number of new points."""
    count = new_points.agg(F.count("*").alias("_n"))
    zonal = kept(zonal.select("sky", "point", *XYZ, "area", "value"), "zonal")  # counted, then dealt
    moved = nearest_in_each(new_points, zonal, "q_id", "point", "sky", XYZ, ("area", "value")).crossJoin(F.broadcast(count))
    return moved.select("sky", F.col("q_id").alias("point"), "value", F.col("area").alias("origarea"), (F.lit(total) / F.col("_n")).alias("area"), F.col("dist").alias("rebase_err"))


def info(result: DataFrame, few: int = 20) -> DataFrame:
    """(axis, n, label): all labels of a short axis, the first and last five of a long one.

    Labels are counted, and the ends come from two sorted heads; no window runs over all labels."""
    parts = []
    for name in AXES:
        labels = result.select(F.col(name).alias("_k")).distinct()
        n = labels.agg(F.count("*").alias("n"))
        limit = 100 if name == "metric" else few
        ends = labels.orderBy("_k").limit(5).union(labels.orderBy(F.col("_k").desc()).limit(5))
        shown = ends.union(labels.orderBy("_k").limit(limit).crossJoin(n).where(F.col("n") <= limit).select("_k")).distinct()
        parts.append(shown.crossJoin(n).select(F.lit(name).alias("axis"), "n", F.col("_k").cast("string").alias("label")))
    return reduce(DataFrame.unionByName, parts)


def deviation(candidate: DataFrame, reference: DataFrame, relative: str, bounds: DataFrame | None = None) -> DataFrame:
    """(view, metric, mae, msd): mean absolute and signed deviation per option and metric; ``relative`` is divided by its reference.

    ``bounds`` keeps the rows of listed (sky, point) only."""
    both = candidate.join(reference.withColumnRenamed("value", "ref"), list(AXES))
    both = both.join(bounds, ["sky", "point"], "left_semi") if bounds is not None else both
    gap = F.when(F.col("metric") == relative, F.try_divide(F.col("value") - F.col("ref"), F.col("ref"))).otherwise(F.col("value") - F.col("ref"))
    return both.groupBy("view", "metric").agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("msd"))


def deviation_total(report: DataFrame) -> DataFrame:
    return report.groupBy("metric").agg(F.avg("mae").alias("mae"), F.avg("msd").alias("msd"))


def formatted(kind: str, column: Column) -> Column:
    """A label for file names: four digits of a whole number, two decimals of every member of a tuple, text as it is."""
    if kind == "tuple":
        return F.array_join(F.transform(column, lambda x: F.format_string("%05.02f", x.cast("double"))), "_")
    return F.format_string("%04d", column.cast("long")) if kind == "number" else column.cast("string")


def labels(result: DataFrame) -> DataFrame:
    """Adds file_label (four digits of sky and point) and row_label."""
    return result.withColumn("file_label", F.concat_ws("_", formatted("number", F.col("sky")), formatted("number", F.col("point")))).withColumn("row_label", F.concat_ws("\t", "sky", "point", "view"))


def axis_index(result: DataFrame, name: str | int, wanted: list) -> DataFrame:
    """(label, index): places of labels in the ordered axis, from 0; a label that the axis does not have is an error.

    The index is a count of smaller labels, taken for the wanted labels only."""
    a = axis(name)
    known = result.select(F.col(a).alias("label")).distinct()
    asked = known.where(F.col("label").isin(wanted))
    if asked.count() < len(set(wanted)):
        raise ValueError(f"labels that axis {a!r} does not have among {wanted}")
    before = [F.count_if(F.col("label") < F.lit(w)).cast("int") for w in wanted]
    counts = known.agg(F.array(*(F.struct(F.lit(w).alias("label"), b.alias("index")) for w, b in zip(wanted, before, strict=True))).alias("a"))
    return counts.select(F.explode("a").alias("s")).select("s.label", "s.index")


def heat_map(values: DataFrame, steps_per_day: int) -> DataFrame:
    """(day, row, value) from (t, value), t from 0: one column per day, hours from the last to the first."""
    t = F.col("t")
    return values.select(F.floor(t / steps_per_day).cast("int").alias("day"), (steps_per_day - 1 - t % steps_per_day).cast("int").alias("row"), "value")


def _padded(result: DataFrame, column: str, values: list, times: DataFrame, fill: float) -> DataFrame:
    """``pull`` of ``pad``; where sky is not the column, cells are pulled first, so that what is padded has one row per time, point and view and nothing is
    grouped after. A label of ``column`` is filled where its row has it at some time, as in ``pad``."""
    if column == "sky":
        return pull(pad(result, times, fill), column, values)
    rows = [a for a in AXES if a not in ("sky", column)]
    names = [str(v) for v in values]
    has = result.groupBy(*rows).agg(*(F.max(F.coalesce(F.col(column) == F.lit(v), F.lit(False))).alias(f"_has_{i}") for i, v in enumerate(values)))
    wide = pull(result, column, values)
    every = times.select("sky").distinct().crossJoin(has).join(wide, ["sky", *rows], "left")
    return every.select("sky", *rows, *(F.coalesce(F.col(f"`{n}`"), F.when(F.col(f"_has_{i}"), F.lit(fill))).alias(n) for i, n in enumerate(names)))


def printed(result: DataFrame, column: str, values: list, row_labels: bool = True, times: DataFrame | None = None, fill: float = 0.0, **filters) -> DataFrame:
    """``pull`` as text with five significant digits: the rows of the TSV export.

    With ``times`` (a column sky) every time of the year has its rows, ``fill`` where the cube has none. ``row_labels`` keeps the
    labels of the rows as leading columns; without them rows still come in the order of their labels when written."""
    chosen = axis_filter(result, **filters)
    wide = pull(chosen, column, values) if times is None else _padded(chosen, column, values, times, fill)
    rows = [a for a in AXES if a != column] if row_labels else []
    return wide.select(*rows, *(F.when(F.col(f"`{v}`").isNull(), "").otherwise(F.format_string("%.4e", F.col(f"`{v}`").cast("double"))).alias(str(v)) for v in values))


def write_tsv(wide: DataFrame, path: str, header: bool = True, by: str | None = None) -> None:
    """One TSV table, or one folder per value of ``by``, each with one file (``by`` has few values)."""
    parted = wide.repartition(by) if by else wide
    writer = parted.write.mode("overwrite").option("sep", "\t").option("header", header)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_serial(result: DataFrame, column: str, values: list, last: str, path: str, header: bool = True, **options) -> None:
    """A TSV table per value of the axis ``last``: folders ``file_label=<formatted value>``; ragged cubes repeat the labels of their rows."""
    kind = "number" if isinstance(result.schema[axis(last)].dataType, T.IntegralType) else "text"
    wide = printed(result, column, values, **options).withColumn("file_label", formatted(kind, F.col(last))).drop(last)
    write_tsv(wide, path, header, "file_label")


def write_result(result: DataFrame, path: str, by: str = "metric") -> None:
    """Partitioned by metric (dense cubes) or by another axis, so that a later filter on it prunes files."""
    result.write.mode("overwrite").partitionBy(axis(by)).parquet(path)


def read_result(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*AXES, "value")
