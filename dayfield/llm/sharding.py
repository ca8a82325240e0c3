"""Operator 2: a reproducible shuffle by a Feistel permutation over global row numbers."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, prefix_sums, written

#: A prime below 2^31: products of two residues stay inside a signed 64-bit integer.
PRIME = 2147483647


def _round_keys(seed: int, rounds: int) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME), draw.randrange(1, PRIME)) for _ in range(rounds)]


def permute(number: Column, n: int, seed: int = 42, rounds: int = 6) -> Column:
    """``number`` in 0..n-1 under a permutation of that range.

    The domain is a rectangle of a x b >= n cells (a = ceil(sqrt n)), so at most a cells lie outside; a balanced pair of
    residues is mixed by additive Feistel rounds, and a result outside 0..n-1 is permuted again (cycle walking) until it
    falls inside, which takes at most a steps."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    keys = F.array(*(F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit(z).cast("long").alias("z")) for i, (x, y, z) in enumerate(_round_keys(seed, rounds))))

    def mixed(value: Column, key: Column) -> Column:
        first = (value % PRIME * key["x"] + key["y"]) % PRIME
        second = first * first % PRIME
        return (second * key["z"] + F.shiftright(second, 16)) % PRIME

    def one_round(state: Column, key: Column) -> Column:
        left = F.when(key["even"], (state["l"] + mixed(state["r"], key)) % a).otherwise(state["l"])
        right = F.when(key["even"], state["r"]).otherwise((state["r"] + mixed(state["l"], key)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def once(value: Column) -> Column:
        start = F.struct((value % a).cast("long").alias("l"), F.floor(value / a).cast("long").alias("r"))
        return F.aggregate(keys, start, one_round, lambda s: s["r"] * a + s["l"])

    steps = F.sequence(F.lit(1), F.lit(a))
    return F.aggregate(F.array(once(number.cast("long"))), F.lit(0).cast("long"), lambda _, x: F.when(x < n, x).otherwise(F.aggregate(steps, x, lambda s, __: F.when(s < n, s).otherwise(once(s)))))


def global_numbers(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` 0..n-1 and n. The number depends on the values of ``keys`` alone, not on files or tasks.

    Rows that agree in all ``keys`` are counted first and unfolded again in runs of 100,000, so a third of all rows may be
    the same row."""
    counted = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "numbered")
    n = counted.agg(F.sum("_n")).first()[0] or 0
    first = prefix_sums(counted, [], keys, F.col("_n"), "_first", bucket_count(n))
    run = 100_000
    runs = first.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / run).cast("long"))))
    copies = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * run, F.least(F.col("_run") * run + run, F.col("_n")) - 1)))
    return copies.withColumn("row_number", F.col("_first") + F.col("_copy")).drop("_n", "_first", "_run", "_copy"), int(n)


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` gets a shard and a slot: doc_id, size, text_crc32, row_number, position, shard, slot.

    ``position`` is the row's place in the shuffled order; shard = position mod n_shards and slot = position div n_shards, so
    row counts differ by one at most and slots have no gaps. Null texts have size 16 and the checksum of the empty text.
    Null ids, repeated ids and repeated rows all get places of their own; equal rows are interchangeable. Other columns of
    ``docs`` are not read. An empty table gives no rows."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"),
    )
    numbered, n = global_numbers(rows, ["_text_hash", "doc_id", "size", "text_crc32"])
    placed = numbered.drop("_text_hash").withColumn("position", permute(F.col("row_number"), n, seed))
    return placed.withColumn("shard", (F.col("position") % n_shards).cast("int")).withColumn("slot", F.floor(F.col("position") / n_shards).cast("long"))
