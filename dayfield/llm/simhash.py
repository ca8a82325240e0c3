"""Operator 8: SimHash near-duplicates. One-wildcard segment variants find every pair within the bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, unique_join, written

BITS, MOST, SEGMENTS, SHINGLE, SEED = 64, 4, 3, 4, 42
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Everything but the six white-space characters of the word contract is kept by str.split after this.
_WHITE = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words give 0."""
    words = [w for w in (text or "").translate(_WHITE).split(" ") if w]
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(" ".join(words).translate(_LOWER).encode("utf-8", "surrogatepass"), seed)]
    else:
        data = " ".join(words).translate(_LOWER).encode("utf-8", "surrogatepass")
        ends = np.flatnonzero(np.frombuffer(data + b" ", np.uint8) == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        view, digest = memoryview(data), xxhash.xxh64_intdigest
        hashes = [digest(view[i:j], seed) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and empty texts get 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def segment_bounds(segments: int = SEGMENTS, bits: int = BITS) -> list[tuple[int, int]]:
    edges = [round(bits * i / segments) for i in range(segments + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _variants(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """64 rows per fingerprint: a key for each wildcard position, of its segment with that bit cleared."""
    full = (1 << BITS) - 1
    masks = np.array([((1 << hi) - (1 << lo)) & ~(1 << p) & full for lo, hi in segment_bounds(segments) for p in range(lo, hi)], np.uint64)
    lows = np.array([lo for lo, hi in segment_bounds(segments) for _ in range(lo, hi)], np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            value = (part[:, None] & masks[None]) >> lows[None]
            key = (np.arange(len(masks), dtype=np.uint64)[None] << np.uint64(32)) | value
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["key", "fp"])


def _forest(points: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (x, first) that join each linked set of ``points`` to its first member; every pair within ``most`` is covered.

    A breadth-first walk: a point that has been reached is not compared again, so a dense set costs one comparison a point."""
    out, open_points = [], points
    while len(open_points) > 1:
        first, open_points = open_points[0], open_points[1:]
        frontier = np.array([first], np.uint64)
        while len(frontier) and len(open_points):
            near = np.zeros(len(open_points), bool)
            for at in range(0, len(frontier), 256):
                left = np.flatnonzero(~near)
                near[left] = (np.bitwise_count(open_points[left][None] ^ frontier[at : at + 256, None]) <= most).any(axis=0)
            frontier, open_points = open_points[near], open_points[~near]
            out += [(x, first) for x in frontier]
    return out


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: verified links inside each run of one key. A run that goes on in the next batch is held back."""
    held_key, held = np.empty(0, np.int64), np.empty(0, np.uint64)

    def close(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        a, b = [], []
        sizes = ends - starts
        for i in starts[sizes == 2]:
            if int(fp[i] ^ fp[i + 1]).bit_count() <= most:
                a.append(fp[i + 1])
                b.append(fp[i])
        for i, j in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            for x, y in _forest(fp[i:j], most):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    pending: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        pending.append((key, fp))
        if key[0] == key[-1] and pending[0][0][0] == key[0]:
            continue
        held_key, held = (np.concatenate(x) for x in zip(*pending, strict=True))
        last = np.searchsorted(held_key, held_key[-1])
        if last:
            yield close(held_key[:last], held[:last])
        pending = [(held_key[last:], held[last:])]
    if pending:
        held_key, held = (np.concatenate(x) for x in zip(*pending, strict=True))
        yield close(held_key, held)


def links(prints: DataFrame, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect the same sets as all pairs within ``most`` bits.

    With ``most`` < 2 * ``segments`` two such fingerprints differ by one bit at most in some segment, so they share a
    one-wildcard variant of it. Variants are dealt and sorted by key; within one key each linked set comes out as a star, so the
    output is linear in the rows even where a key is common."""
    if most >= 2 * segments:
        raise ValueError("most must be below twice the number of segments")
    distinct = prints.select("fp").distinct()
    keyed = distinct.mapInArrow(lambda b: _variants(b, segments), "key long, fp long")
    ordered = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(lambda b: _links(b, most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most: int = MOST, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Equal fingerprints are one class; classes link at ``most`` or fewer differing bits; component_id is the smallest doc_id
    that links reach. Null and empty texts have fingerprint 0 and link like any other. Rows with a null id get a component, but
    never name one (a component of null ids only has a null component_id). Repeated rows come out as often as they went in.
    Other columns are not read; an empty table gives no rows. Only 16 bytes a row are shuffled, never texts."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    labels = components(links(classes, most, segments))
    named = classes.join(labels, F.col("fp") == F.col("id"), "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    smallest = written(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    to = written(unique_join(named, smallest, "component").select("fp", "component_id", F.col("rows").alias("n")), "named")
    return unique_join(prints, to, "fp").select("doc_id", "fp", "component_id")


def hex_print(column: str = "fp"):
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def deduplicated(docs: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """One document of each component: the row of its smallest doc_id; repeated rows of that id are one document.

    Rows with a null id cannot be named: they stay, one row for each different text. The ids that go are counted: up
    to ``broadcast_rows`` of them are broadcast, so that no text is shuffled; beyond, texts are joined by id."""
    return one_of_each(docs, near_duplicates(docs, **options), broadcast_rows)


def one_of_each(docs: DataFrame, found: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, component_id) keeps, as ``deduplicated`` says."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    flags = written(found.groupBy("doc_id").agg(F.count_if(stays).alias("n")).withColumnRenamed("doc_id", "id"), "kept")
    keep, gone = flags.where("n > 0 or id is null"), flags.where("n = 0 and id is not null")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc"))
    if gone.count() <= broadcast_rows:
        kept = rows.join(F.broadcast(gone), F.col("doc").eqNullSafe(F.col("id")), "left_anti")
    else:
        kept = rows.join(keep, F.col("doc").eqNullSafe(F.col("id")), "left_semi")
    if keep.where("n > 1 or id is null").limit(1).count():
        key = F.struct(*(F.xxhash64(F.col("row").getField(c)) for c in docs.columns))
        best = kept.groupBy(F.col("doc").alias("id")).agg(F.min(key).alias("best"))
        named = kept.where("doc is not null").join(best, (F.col("doc") == F.col("id")) & (key == F.col("best")), "left_semi")
        kept = named.unionByName(kept.where("doc is null")).withColumn("text", F.col("row.text")).dropDuplicates(["doc", "text"])
    return kept.select("row.*")
