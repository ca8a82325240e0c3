"""Operator 7: URL lists over time. Dated entries become validity intervals; an as-of join finds those active at the fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme and authority; a backslash ends the authority as a slash does.
AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)"
SEGMENT = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*[/\\]([^/?#\\]+)"


def host_of(url: Column) -> Column:
    """The host in lower case: without user and password (all up to the last @), port and trailing dots; [..] for IPv6."""
    place = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[]*)", 1), r"\.+$", ""))


def keys_of(url: Column) -> Column:
    """array<(key, rank)>: host plus first path segment (rank 1000), then the host and its parent domains by number of labels.

    Parents have two labels or more; addresses (IPv4, IPv6) have none."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segment = F.regexp_extract(url, SEGMENT, 1)
    n = F.size(labels)
    last = F.when(F.rlike(host, F.lit(r"^\[|(^|\.)[0-9]+$")), F.lit(1)).otherwise(F.greatest(n - 1, F.lit(1)))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")))
    path = F.when(segment != "", F.array(F.struct(F.concat(host, F.lit("/"), segment).alias("key"), F.lit(1000).alias("rank")))).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))
    return F.when(host != "", F.concat(path, domains))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, action, key, since, until) of entries (list, action, key, op, at, seq): op ``add`` holds until the next entry of the same
    list and key; ``remove`` ends it. Entries of one moment count in order of ``seq``; the last one holds. until is null while open."""
    after = Window.partitionBy("list", "key").orderBy("at", "seq", "op", "action")
    spans = entries.where("key is not null and at is not null").withColumn("until", F.lead("at").over(after))
    return spans.where("op = 'add' and (until is null or until > at)").select("list", "action", "key", F.col("at").alias("since"), "until")


def active_at(asked: DataFrame, spans: DataFrame, each: int = 20_000) -> DataFrame:
    """``asked`` (key, _time, ..) with the ``list`` and ``action`` of every interval that holds at ``_time``.

    As-of join: intervals of one (key, list) do not overlap, so rows and intervals are ordered by time together and each row
    sees the last interval that began at or before it; no row meets the other intervals of its key. A key with more than ``each`` rows is
    dealt by hash into parts of about that many, counted per key; each part has all intervals of the key."""
    only = [c for c in asked.columns]
    parts = asked.groupBy("key").agg(F.ceil(F.count("*") / each).cast("int").alias("_parts")).where("_parts > 1")
    asked = asked.join(parts, "key", "left").withColumn("_salt", F.pmod(F.xxhash64(*only), F.coalesce("_parts", F.lit(1))).cast("int")).select(*only, "_salt")
    dealt = spans.join(parts, "key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    lists = dealt.select("key", "_salt", "list").distinct()
    rows = asked.join(lists, ["key", "_salt"]).select("key", "_salt", "list", F.col("_time").alias("_at"), F.struct(*asked.columns).alias("_row"), F.lit(None).cast(dealt.select(F.struct("action", "until")).schema[0].dataType).alias("_span"))
    starts = dealt.select("key", "_salt", "list", F.col("since").alias("_at"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct("action", "until").alias("_span"))
    so_far = Window.partitionBy("key", "_salt", "list").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(starts).withColumn("_span", F.last("_span", ignorenulls=True).over(so_far)).where("_row is not null and _span is not null")
    return met.where("_span.until is null or _at < _span.until").select("_row.*", "list", "_span.action")


def apply_lists(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", each: int = 20_000) -> DataFrame:
    """``captures`` with n_active, list, key and verdict (allow, block or keep).

    An entry counts if since <= fetch time < until and its key is the URL's host, a parent domain or host plus first segment. The
    most specific key wins; at one key, allow before block, then the list that is first by name. No active entry, a null or
    malformed URL and a null time give ``keep``. Repeated captures are decided once and each returned; existing columns of the
    four names are replaced, others pass through, whatever their names. Keys that more than ``each`` captures share are dealt into
    parts. Empty tables give no rows, or ``keep`` for every capture."""
    distinct = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_time")).where("_url is not null and _time is not null").distinct()
    asked = distinct.withColumn("_k", F.explode(keys_of(F.col("_url")))).select("_url", "_time", F.col("_k.key").alias("key"), F.col("_k.rank").alias("_rank"))
    met = active_at(asked, intervals(entries), each)
    first = F.min(F.struct((-F.col("_rank")).alias("r"), F.col("action").alias("action"), F.col("list").alias("list"), F.col("key").alias("key")))
    decided = met.groupBy("_url", "_time").agg(F.count("*").alias("_n"), first.alias("_first"))
    kept = [c for c in captures.columns if c not in ("n_active", "list", "key", "verdict")]
    rows = captures.select(F.struct(*kept).alias("_row"), F.col(url_col).alias("_u"), F.col(time_col).alias("_t"))
    rows = rows.join(decided, (F.col("_u") == F.col("_url")) & (F.col("_t") == F.col("_time")), "left")
    return rows.select("_row.*", F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"), F.col("_first.list").alias("list"), F.col("_first.key").alias("key"), F.coalesce("_first.action", F.lit("keep")).alias("verdict"))
