"""Helpers that several operators share: written intermediate tables, prefix sums, components, ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: space and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-dayfield-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(rows: int, each: int = 20_000) -> int:
    """Buckets for ``prefix_sums`` over a group of so many rows."""
    return max(64, -(-rows // each))


def unique_join(rows: DataFrame, values: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """``rows`` joined to ``values`` (one row per key, ``weight`` = how many rows have it) on one column of non-null keys.

    Keys that hold over a thousandth of all rows are a thousand at most: these are broadcast, so that a key with a third of all
    rows is not one task; the others meet in an ordinary join."""
    total = values.agg(F.sum(weight)).first()[0] or 0
    edge = max(1000, total // 1000)
    often, seldom = values.where(F.col(weight) > edge).drop(weight), values.where(F.col(weight) <= edge).drop(weight)
    hot = rows.join(F.broadcast(often), key)
    return hot.unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by a hash bucket of ``order`` (or by ``bucket``, an int) and then by ``order``. Sums are taken per (group, bucket) first, so a group
    that holds a third of all rows is still spread over ``buckets`` window partitions; only one row per bucket is summed
    across buckets. Rows that agree in every ``order`` column are interchangeable. Null groups are groups."""
    keyed = df.withColumn("_value", value.cast("long")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket)
    keys = [*group, "_bucket"]
    totals = keyed.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = inner.join(bases, on=same, how="inner")
    return joined.withColumn(out, F.col("_base") + F.col("_within")).drop("_value", "_within", "_base", "_bucket", *(f"_of_{k}" for k in keys))


def _salted_min(pairs: DataFrame, salts: int) -> DataFrame:
    """(u, v, m): each pair with the smallest of u and its partners. A hub's pairs are spread over ``salts`` keys."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    return keyed.join(least, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, rounds: int = 200, salts: int = 8) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that an edge (a, b) names.

    Alternating large-star and small-star steps; each round is written to the shared folder and the loop ends when the
    edge set no longer changes. Nothing but one count and one checksum reaches the driver. The rounds grow with the logarithm of
    the longest chain; more than ``rounds`` is an error, never an unfinished result."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _salted_min(both, salts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _salted_min(large, salts)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m")).where("a <> b").distinct()
        now = written(small, "edges")
        row = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            break
        mark = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
