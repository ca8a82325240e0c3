"""Operator 12: what each filter of a chain removes in every order of the filters, from counts of failure masks."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unique_join, written

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters by letter; the bit of a letter in a mask is its place here.
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a whole text (not null) fails. Words are told apart by case."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < 200, 100 * different < 50 * n, 100 * capitals > 2 * F.length(text).cast("long"), F.rlike(text, F.lit("[#$%&*|]")))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    E fails where a smaller doc_id has the same text, anywhere in the table: each text is known by its SHA-256, each (text, part, labels) becomes
    one row with its smallest doc_id, and these rows meet the text's smallest one. A text that a third of all rows share is thus
    summed before it is shuffled. A null text is the empty one; a null part is the part ''. Rows that repeat a doc_id and text are each
    counted and not duplicates of themselves; a row without doc_id neither fails E nor makes another row fail it. A document with several labels has a label
    if one of them says so. Other columns are not read; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.select("id", "part", F.sha2("text", 256).alias("print"), text_failures(F.col("text")).alias("mask"))
    each = seen.groupBy("id", "part", "print", "mask").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = each.join(said, F.col("id") == F.col("_id"), "left")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    kinds = ("part", "print", "mask", "good", "toxic")
    groups = each.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")}).groupBy(*kinds)
    groups = written(groups.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first.alias("first")), "groups")
    least = groups.groupBy("print").agg(F.min("first.id").alias("least"), F.count("*").alias("rows"))
    met = unique_join(groups, least, "print", "rows")
    originals = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    two = F.explode(F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + (1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - originals).alias("n"))))
    dealt = met.select("part", "good", "toxic", two.alias("x")).select("part", "x.mask", "x.n", *(F.when(F.col(k), F.col("x.n")).otherwise(0).alias(k) for k in ("good", "toxic")))
    return dealt.groupBy("part", "mask").agg(*(F.sum(k).alias(k) for k in COUNTS))


def _rank(prefix: tuple[int, ...], letters: int) -> int:
    """Lexicographic rank of the first order that begins with ``prefix``: its Lehmer digits in the factorial base."""
    left, rank = list(range(letters)), 0
    for i, letter in enumerate(prefix):
        rank += left.index(letter) * math.factorial(letters - 1 - i)
        left.remove(letter)
    return rank


def removal_intervals(letters: int = len(LETTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, from, to): the orders, as intervals of ranks, in which documents of a mask go at a step.

    They go where the first letter of the order that is in the mask stands: orders that share the letters up to there are
    consecutive, so every such beginning is one interval."""
    out = []
    for step in range(1, letters + 1):
        for prefix in itertools.permutations(range(letters), step):
            after = [x for x in range(letters) if x not in prefix]
            begin = _rank(prefix, letters)
            for others in itertools.chain.from_iterable(itertools.combinations(after, k) for k in range(len(after) + 1)):
                out.append((sum(1 << x for x in (prefix[-1], *others)), step, begin, begin + math.factorial(letters - step)))
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from ``failure_counts``; columns as the query returns them.

    Each mask adds its counts at the beginning of every interval of its orders and takes them away at the end; a running sum over the
    120 ranks of a (part, step) gives what goes there. Parts stay apart: a window holds 120 rows, and no row of a document is
    seen again."""
    spark = counts.sparkSession
    size, orders = len(LETTERS), list(itertools.permutations(range(len(LETTERS))))
    held = spark.createDataFrame(removal_intervals(), "mask int, step int, begin int, end int")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    changes = counts.join(F.broadcast(held), "mask").select("part", "step", *COUNTS, ends.alias("e"))
    changes = changes.where(F.col("e.rank") < len(orders)).groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*(F.sum(F.col(k) * F.col("e.sign")).alias(k) for k in COUNTS))
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    fails = F.array(*(of(F.col("mask").bitwiseAND(1 << i) != 0) for i in range(size)))
    alone = F.array(*(of(F.col("mask") == 1 << i) for i in range(size)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"), fails.alias("fails"), alone.alias("alone"))
    places = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit("".join(LETTERS[x] for x in o)).alias("filter_order")) for r, o in enumerate(orders)))
    grid = parts.select("*", F.explode(places).alias("p")).select("part", "all", "fails", "alone", "p.*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    grid = grid.withColumn("letter", F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    full = grid.join(changes, ["part", "step", "rank"], "left")
    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gone = full.select("part", "step", "rank", "letter", "filter_order", "all", F.get("fails", F.col("letter")).alias("failing"), F.get("alone", F.col("letter")).alias("unique_fails"), *(F.coalesce(F.sum(k).over(over_ranks), F.lit(0)).alias(k) for k in COUNTS))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return gone.select(
        "part", "filter_order", "step",
        (F.col("all") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"), (F.col("failing") - F.col("n")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )
