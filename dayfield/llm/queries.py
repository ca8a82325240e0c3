"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, covertree, filter_audit, langid, mixing, packing, quality, secret_scan, sharding, simhash, spelling, url_filter
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate")


def op5_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid_vectors(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of two lists over the hosts, sites and first path segments that the pages name.

    Each key and list has 0 to 3 entries, add and remove in turn, on days that the MD5 of both decides."""
    keys = pages.select(F.explode(url_filter.keys_of(F.col("url"))).alias("k")).select("k.key").distinct()
    lists = F.explode(F.array(F.struct(F.lit("blocked").alias("list"), F.lit("block").alias("action")), F.struct(F.lit("trusted").alias("list"), F.lit("allow").alias("action"))))
    drawn = keys.withColumn("l", lists).select("key", "l.list", "l.action").withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", "list", "key").cast("binary")), 1, 7), 16, 10).cast("long"))
    each = drawn.where("h % 4 > 0").withColumn("seq", F.explode(F.sequence(F.lit(1), (F.col("h") % 4).cast("int"))))
    day = F.floor(F.col("h") / F.pow(F.lit(7.0), F.col("seq"))) % 60
    return each.select("list", "action", "key", F.when(F.col("seq") % 2 == 1, "add").otherwise("remove").alias("op"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("at"), "seq")


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 90).cast("int")))
    return url_filter.apply_lists(captures, _list_entries(pages)).select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "n_active", "list", "key", "verdict")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op9_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), columns=["doc_id", "source"])
    return judged.select("doc_id", "source", "host_quality", "path_quality", "evidence", "p_quality", "keep")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_feistel_shards, op3_language_id, op4_entropy_mix, op5_bin_slack_packing, op6_multiprobe_search, op7_temporal_url_filter, op8_simhash_dedup, op9_cover_tree_dedup, op10_site_quality, op11_spelling_variants, op12_filter_audit, op13_byte_bpe)
}

_OP7_SQL = r"""
WITH places AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', '') AS place,
    regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*[/\\]([^/?#\\]+)', 1) AS segment, DATE '2024-01-01' + CAST(page_id * 7919 % 90 AS INT) AS fetched FROM pages),
hosts AS (SELECT page_id, url, segment, fetched, lower(regexp_replace(regexp_extract(place, '^(\[[^\]]*\]|[^:\[]*)', 1), '\.+$', '')) AS host FROM places),
parts AS (SELECT *, string_split(host, '.') AS labels, regexp_matches(host, '^\[|(^|\.)[0-9]+$') AS address FROM hosts WHERE host <> ''),
asked AS (SELECT page_id, host || '/' || segment AS key, 1000 AS rank FROM parts WHERE segment <> ''
  UNION ALL SELECT page_id, array_to_string(labels[i:], '.'), len(labels) - i + 1 FROM parts, range(1, 100) r(i) WHERE i <= CASE WHEN address THEN 1 ELSE greatest(len(labels) - 1, 1) END),
keys AS (SELECT DISTINCT key FROM asked),
drawn AS (SELECT key, list, action, CAST('0x' || substr(md5(list || '|' || key), 1, 7) AS BIGINT) AS h
  FROM keys, (VALUES ('blocked', 'block'), ('trusted', 'allow')) l(list, action)),
entries AS (SELECT key, list, action, s AS seq, CASE WHEN s % 2 = 1 THEN 'add' ELSE 'remove' END AS op,
    DATE '2024-01-01' + CAST(CAST(floor(h / pow(7.0, s)) AS BIGINT) % 60 AS INT) AS since FROM drawn, range(1, 4) r(s) WHERE s <= h % 4),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since, seq) AS until FROM entries),
met AS (SELECT a.page_id, a.rank, s.action, s.list, s.key FROM asked a JOIN hosts h USING (page_id) JOIN spans s ON a.key = s.key
  WHERE s.op = 'add' AND s.since <= h.fetched AND (s.until IS NULL OR h.fetched < s.until)),
best AS (SELECT page_id, count(*) OVER (PARTITION BY page_id) AS n, action, list, key,
    row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, action, list, key) AS r FROM met)
SELECT h.page_id, h.url, CAST(h.fetched AS VARCHAR) AS fetched, coalesce(b.n, 0) AS n_active, b.list, b.key, coalesce(b.action, 'keep') AS verdict
FROM hosts h LEFT JOIN best b ON h.page_id = b.page_id AND b.r = 1
"""

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _found_sql(pattern: str) -> str:
    """(rid, s, e, v) of all matches of a pattern: lengths of the parts between and of the matches before add up to the offsets."""
    before = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT rid, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(v) AS e, v FROM (SELECT rid, m[i] AS v, {before} AS s FROM (
  SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, {_text(pattern)}) AS m, regexp_split_to_array(t, {_text(pattern)}) AS p FROM docs)))"""


def _class_sql(name: str, pattern: str, alphabet: str, window: int, bits: float) -> str:
    """CTEs that end in {name}: stretches of windows whose sum of c log c stays under the bound."""
    terms = "[" + ", ".join(map(str, secret_scan._terms(window))) + "]"
    bound = math.floor(secret_scan.SCALE * window * (math.log2(window) - bits))
    slug = secret_scan.SLUG_PART.strip("^$")
    allowed = " OR ".join(f"regexp_matches(v, {_text(p)})" for p in (*secret_scan.ALLOW, f"^{slug}(?:{secret_scan.BETWEEN}{slug})+$"))
    words = " OR ".join(f"regexp_matches(v, {_text(p)})" for p in secret_scan.ALLOW_WORDS)
    folded = "lower(v)" if len(alphabet) == 16 else "v"
    return f"""{name}_runs AS (SELECT * FROM ({_found_sql(pattern)}) WHERE NOT ({allowed})),
{name}_windows AS (SELECT rid, s, v, i, string_split(substr({folded}, i, {window}), '') AS w FROM {name}_runs, range(1, (SELECT coalesce(max(length(v)), 0) + 1 FROM {name}_runs)) r(i) WHERE i <= length(v) - {window - 1}),
{name}_hot AS (SELECT rid, s, i, v FROM {name}_windows WHERE list_sum(list_transform(list_distinct(w), lambda c: CAST({terms} AS BIGINT[])[len(list_filter(w, lambda z: z = c)) + 1])) <= {bound}),
{name} AS (SELECT rid, s, e FROM (SELECT rid, s + min(i) - 1 AS s, s + max(i) - 1 + {window} AS e, substr(any_value(v), min(i), max(i) - min(i) + {window}) AS v FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid, s ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid, s ORDER BY i) + {window} THEN 0 ELSE 1 END AS fresh FROM {name}_hot)) GROUP BY rid, s, g) WHERE NOT ({words}))"""


def _op1_sql() -> str:
    (assign, a_pattern, _, a_least), (access, _, _, _), (hexes, _, _, _) = secret_scan.BASE
    group = f"regexp_extract(v, {_text(a_pattern)}, 2)"
    parts = [f"SELECT rid, s, e, 0 AS k, '{assign}' AS kind FROM ({_found_sql(a_pattern)}) WHERE length({group}) >= {a_least}"]
    parts += [f"SELECT rid, s, e, {i}, '{kind}' FROM ({_found_sql(secret_scan.SEARCH[kind])})" for i, kind in ((1, access), (2, hexes))]
    clear = "NOT EXISTS (SELECT 1 FROM {other} o WHERE o.rid = x.rid AND o.s <= x.s AND x.e <= o.e)"
    (one, *_), (two, *_) = secret_scan.CLASSES
    listed = "coalesce(string_agg({which}, ',' ORDER BY s, k), '')"
    said = "kind || ':' || s || ':' || e"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(parts)}),
{_class_sql(*secret_scan.CLASSES[0])}, {_class_sql(*secret_scan.CLASSES[1])},
spans AS (SELECT * FROM base UNION ALL SELECT rid, s, e, 3, 'entropy' FROM {one} x WHERE {clear.format(other="base")}
  UNION ALL SELECT rid, s, e, 3, 'entropy' FROM {two} x WHERE {clear.format(other="base")} AND {clear.format(other=one)})
SELECT doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
  sha256({listed.format(which=f"CASE WHEN k < 3 THEN {said} END")}) AS base_sha256, {listed.format(which=said)} AS spans
FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


_OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
seen AS (SELECT t.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, min(t.doc_id) OVER (PARTITION BY t) AS least FROM texts t LEFT JOIN said l ON t.doc_id = l.doc_id),
failed AS (SELECT part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM seen),
classes AS (SELECT part, f, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
steps AS (SELECT part, filter_order, s AS step, o[s] AS letter, n, good, toxic, f[o[s]] AS fails, NOT list_bool_or([false] || list_transform(o[1:s - 1], lambda k: f[k])) AS here,
    list_sum(list_transform(f, lambda x: x::INT)) = 1 AS single FROM classes, orders, range(1, 6) r(s)),
summed AS (SELECT part, filter_order, step, letter, sum(CASE WHEN here AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND NOT here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
"""

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": _OP12_SQL, "op1_secret_scan": _op1_sql(), "op7_temporal_url_filter": _OP7_SQL}
