"""Operator 4: entropy balancing. Tilted document rates that meet a token target per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, prefix_sums, written


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size) -> the same with ``weight``, ``full`` and ``target``.

    ``sources`` has one row per source. Targets share ``share`` of all sizes by weight; a source whose part would exceed
    ``most`` times its size stops there and the rest is shared again among the others, until none is above. Weights repeat over
    the sources in code point order, null last.

    The sources that stop are those with the least size per weight: in that order, what a unit of weight gets if all sources
    before stop is a prefix sum, and a source stops where that exceeds its own bound. One window over the sources, one row each."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    repeat = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    bound = (F.col("source_size") * most).cast("decimal(30,3)")
    state = sources.withColumn("weight", repeat).withColumn("_bound", bound).withColumn("_each", F.col("source_size") * most / F.col("weight"))
    before = Window.orderBy("_each", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    left = F.sum(F.col("source_size")).over(everywhere) * share - F.coalesce(F.sum("_bound").over(before), F.lit(0)).cast("double")
    unit = left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    state = state.withColumn("_unit", unit).withColumn("full", F.col("_unit") > F.col("_each"))
    level = F.max(F.when(~F.col("full"), F.col("_unit"))).over(everywhere)
    target = F.when(F.col("full"), F.col("source_size") * most).otherwise(level * F.col("weight")).cast("double")
    return written(state.withColumn("target", target).drop("_bound", "_each", "_unit"), "targets")


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    """exp(lambda * size / mean), not above ``most``."""
    return F.least(F.exp(F.least(F.greatest(lam * size / mean, F.lit(-60.0)), F.lit(5.0))), F.lit(most))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def balance(sizes: DataFrame, sources: DataFrame, most: float = 2.0, rounds: int = 60, tolerance: float = 1e-4) -> DataFrame:
    """``sources`` with ``lam``: the multipliers of the dual.

    The dual of "least relative entropy to rate 1, with the tokens of each source equal to its target" is convex, and its
    Hessian has one entry per source. A source's distinct sizes and their counts are one array in its row (of n words in all, sqrt(2 n) sizes
    at most), so all Newton steps of a source are one expression and all sources step in one job; sums go by size, so reruns agree. A step that
    leaves the bracket of earlier signs is replaced by the middle of the bracket. Sources at their cap or without words need no multiplier
    (rate ``most`` and 1). Multipliers that have not settled after ``rounds`` steps are an error."""
    span = 400.0
    mean, target = F.col("mean"), F.col("target")

    def summed(lam: Column) -> Column:
        add = lambda z, x, rate: F.struct(
            (z["tokens"] + rate * x["size"] * x["n"]).alias("tokens"),
            (z["slope"] + F.when(rate < most, rate * x["size"] * (x["size"] / mean) * x["n"]).otherwise(0.0)).alias("slope"),
        )
        start = F.struct(F.lit(0.0).alias("tokens"), F.lit(0.0).alias("slope"))
        return F.aggregate("_held", start, lambda z, x: _let(_rate(lam, x["size"], mean, most), lambda rate: add(z, x, rate)))

    def moved(s: Column, z: Column) -> Column:
        gap = z["tokens"] - target
        lo, hi = F.when(gap < 0, s["lam"]).otherwise(s["lo"]), F.when(gap > 0, s["lam"]).otherwise(s["hi"])
        step = s["lam"] - gap / F.greatest(z["slope"], F.lit(1e-9))
        near = (F.abs(gap) <= tolerance * F.greatest(target, F.lit(1.0))) | (hi - lo < 1e-9)
        lam = F.when(near, s["lam"]).otherwise(F.round(F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2), 12))
        return F.struct(lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), near.alias("done"))

    held = sizes.groupBy(F.col("source").alias("_source")).agg(F.array_sort(F.collect_list(F.struct(F.col("size").cast("double").alias("size"), F.col("n").cast("double").alias("n")))).alias("_held"))
    state = sources.withColumn("mean", F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")).otherwise(1.0))
    state = state.join(held, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-span).alias("lo"), F.lit(span).alias("hi"), (F.col("full") | (F.col("source_size") == 0)).alias("done"))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(s["done"], s).otherwise(_let(summed(s["lam"]), lambda z: moved(s, z))))
    state = written(state.withColumn("_s", steps).drop("_held").select("*", "_s.lam", "_s.done").drop("_s"), "balance")
    if state.where("not done").limit(1).count():
        raise RuntimeError(f"the multipliers did not settle in {rounds} steps")
    return state


def _hash(seed: int, doc: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc, text)


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _whole(size: Column, h: Column, most: float, seed: int) -> tuple[Column, Column]:
    """(rate, words of the whole copies) of a row, given the columns of its source."""
    rate = F.when(F.col("full"), F.lit(most)).when(F.col("source_size") == 0, F.lit(1.0)).otherwise(_rate(F.col("lam"), size, F.col("mean"), most))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    return rate, (copies * size).cast("long")


def _room(size: Column, whole: Column, lack: Column, most: float) -> Column:
    """How many words a row can still take, or give back."""
    return F.when(lack >= 0, F.floor(F.lit(most) * size).cast("long") - whole).otherwise(whole)


def _plan(docs: DataFrame, weights, share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, state): one row of numbers per document with its place in the hash order, and one row per source."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text).alias("size"), _hash(seed, F.col(id_col), text).alias("_h"))
    rows = written(rows, "sizes")
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    state = balance(sizes, targets(sources, weights, share, most), most).select(F.col("source").alias("_source"), "n_docs", "source_size", "target", "full", "lam", "mean")
    rate, whole = _whole(F.col("size"), F.col("_h"), most, seed)
    rated = rows.join(state, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate).withColumn("whole", whole)
    lacks = written(rated.groupBy("source").agg((F.round(F.max("target")).cast("long") - F.sum("whole")).alias("lack")).withColumnRenamed("source", "_of"), "lacks")
    state = written(state.join(lacks, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of"), "state")
    rated = rated.join(lacks, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    rated = rated.withColumn("room", _room(F.col("size"), F.col("whole"), F.col("lack"), most))
    held = bucket_count(state.agg(F.max("n_docs")).first()[0] or 0)
    high = F.shiftright("_h", 64 - max(1, (held - 1).bit_length())).cast("int")
    return prefix_sums(rated, ["source"], ["_h", "doc_id", "size"], F.col("room"), "before", bucket=high), state


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each row the mix takes: doc_id, source, size, source_size, target, rate, taken.

    Rates are exponentially tilted by ``balance`` and rounded to whole copies by a hash of the row; what a source then lacks or
    has too much is added or taken in hash order, so one document per source at most has a part copy (taken is not a multiple of
    its size), and the taken words of a source equal its target to the word. No document is taken more than ``most`` times.
    Null texts and texts without words have size 0 and are taken 0; null sources are one source, the last. Repeated rows each
    count. Other columns are not read. An empty table gives no rows. Equal input gives equal output, whatever the partitioning."""
    placed, _ = _plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    change = F.greatest(F.least(F.abs("lack") - F.col("before"), F.col("room")), F.lit(0))
    taken = (F.col("whole") + F.when(F.col("lack") >= 0, change).otherwise(-change)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", taken.alias("taken"), "_h")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, broadcast_sources: int = 100_000) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as ``mix`` takes them; the part copy of a source is cut between words.

    A row's copies follow from its source, its hash and the one place in the hash order of its source where the correction ends,
    so one row per source (counted: broadcast up to ``broadcast_sources``, else joined) meets the texts and no text is shuffled. Rows
    that are equal at that place share the part evenly, rounded down. Documents without words are not taken; null texts and
    sources are as ``mix`` says; an empty table gives no rows. Columns of ``docs`` come back unchanged but for a cut text and, if
    there, its n_chars."""
    placed, state = _plan(docs, weights, share, most, seed, "doc_id", "text", "source")
    few = F.broadcast if state.count() <= broadcast_sources else (lambda df: df)
    ends = written(placed.where((F.col("room") > 0) & (F.col("before") < F.abs("lack"))).groupBy(F.col("source").alias("_s")).agg(F.max("_h").alias("_end")), "ends")
    last = placed.select("source", "_h", "before", "lack").join(few(ends), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_end")))
    parts = last.groupBy("_s", "_end").agg(F.floor((F.max(F.abs("lack")) - F.min("before")) / F.count("*")).cast("long").alias("_part"))
    held = written(state.join(parts, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "ends")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source"), _size(F.col("text")).alias("size"), _hash(seed, F.col("doc_id"), F.col("text")).alias("_h"))
    rows = rows.join(few(held), F.col("source").eqNullSafe(F.col("_source"))).withColumn("whole", _whole(F.col("size"), F.col("_h"), most, seed)[1])
    rows = rows.withColumn("room", _room(F.col("size"), F.col("whole"), F.col("lack"), most))
    change = F.when(F.col("_h") < F.col("_end"), F.col("room")).when(F.col("_h") == F.col("_end"), F.least("room", "_part")).otherwise(0)
    rows = rows.withColumn("taken", F.col("whole") + F.when(F.col("lack") >= 0, change).otherwise(-change)).where("size > 0 and taken > 0")
    rows = rows.withColumn("copies", F.ceil(F.col("taken") / F.col("size")).cast("int")).withColumn("rest", (F.col("taken") % F.col("size")).cast("int"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    text, part = F.col("row.text"), (F.col("copy") == F.col("copies")) & (F.col("rest") > 0)
    cut = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("rest")), " ")
    out = rows.withColumn("row", F.col("row").withField("text", F.when(part, cut).otherwise(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("row", F.col("row").withField("n_chars", F.when(part, F.length("row.text").cast(kind)).otherwise(F.col("row.n_chars"))))
    return out.select("row.*")
