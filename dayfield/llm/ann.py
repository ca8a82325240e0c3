"""Operator 6: approximate nearest neighbours by multiprobe p-stable hashing and exact reranking."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): vectors that are not null, empty or zero and whose components are all finite."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = rows.schema[vec_col].dataType.elementType
    to = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.cast(to).alias("vec")).where(F.col("vec_id").isNotNull() & vec.isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each dimension in an array<float or double> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(dim)[None]]))
    return out


@dataclass(frozen=True)
class Index:
    """Tables of ``k`` projections each, cut into cells of ``width`` (in units of the spread of the vectors); ``probes`` per table."""

    tables: int = 12
    k: int = 6
    width: float = 1.4
    probes: int = 80
    seed: int = 42
    spread: float = 1.0

    def _project(self, table: int, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng([self.seed, table, x.shape[1]])
        direction, shift = draw.normal(size=(x.shape[1], self.k)), draw.uniform(0, 1, self.k)
        return x.astype(np.float64) @ direction / (self.width * self.spread) + shift

    def _key(self, table: int, dim: int, cells: np.ndarray) -> np.ndarray:
        key = np.full(len(cells), (table + 1) * 1_000_003 + dim, np.uint64)
        for column in cells.T:
            key = (key ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x tables: the bucket of each vector in each table."""
        return np.stack([self._key(t, x.shape[1], np.floor(self._project(t, x))) for t in range(self.tables)], axis=1)

    def probe_keys(self, x: np.ndarray) -> np.ndarray:
        """rows x (tables * probes): the buckets around each vector whose hits are most likely.

        A step of -1, 0 or 1 in a projection costs the squared distance to that border; the sets of steps with the least sums
        come first (the own bucket costs 0)."""
        steps = np.array(list(itertools.product((-1, 0, 1), repeat=self.k)), np.int64)
        out = []
        for t in range(self.tables):
            at = self._project(t, x)
            cell = np.floor(at)
            low = at - cell
            cost = np.zeros((len(x), len(steps)))
            for i in range(self.k):
                cost += np.where(steps[:, i] == 0, 0.0, np.where(steps[:, i] < 0, low[:, i : i + 1], 1 - low[:, i : i + 1])) ** 2
            best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            cells = cell[:, None, :] + steps[best]
            out.append(self._key(t, x.shape[1], cells.reshape(-1, self.k)).reshape(len(x), -1))
        return np.concatenate(out, axis=1)


def _keyed(batches: Iterator[pa.RecordBatch], index: Index, probes: bool) -> Iterator[pa.RecordBatch]:
    """A row (key, vec_id, vec) per bucket of each vector."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256 if probes else 2048):
            part = batch.slice(start, 256 if probes else 2048)
            for rows, x in matrix(part.column("vec")):
                keys = index.probe_keys(x) if probes else index.keys(x)
                owner = np.repeat(rows, keys.shape[1])
                for at in range(0, len(owner), 8192):
                    mine = pa.array(owner[at : at + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[at : at + 8192]), part.column("vec_id").take(mine), part.column("vec").take(mine)], ["key", "vec_id", "vec"])


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row: Euclidean distance in double precision, from the differences."""
    return np.sqrt(((q.astype(np.float64) - x.astype(np.float64)) ** 2).sum(axis=-1))


def _nearest(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of the k nearest of each query in one block; ties by id stay exact."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    rough = qq[:, None] + xx[None] - 2 * q @ x.T
    rough[qid[:, None] == xid[None]] = np.inf
    if len(xid) > k:
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
        near = rough <= (edge + 1e-9 * (qq + xx.max()))[:, None]
    else:
        near = np.ones_like(rough, bool)
    near &= np.isfinite(rough)
    i, j = np.nonzero(near)
    return qid[i], xid[j], distances(q[i], x[j])


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged blocks: each candidate of a query once, the k nearest kept."""
    q, x, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((d, x, q))
    q, x, d = q[order], x[order], d[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
    q, x, d = q[first], x[first], d[first]
    order = np.lexsort((x, d, q))
    q, x, d = q[order], x[order], d[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < k], x[rank < k], d[rank < k]


def _rerank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key with queries first: exact distances inside each key; the task's k nearest of each query come out."""
    probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held: list[tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    key_now, size = None, 0
    for batch in batches:
        keys, kinds, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kind", "vec_id"))
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1, [len(keys)])) if len(keys) else np.array([0])
        blocks = matrix(batch.column("vec"))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[i] != key_now:
                key_now, probes = keys[i], {}
            for rows, x in blocks:
                a, b = np.searchsorted(rows, i), np.searchsorted(rows, j)
                if a == b:
                    continue
                dim, mine, vecs = x.shape[1], ids[rows[a:b]], x[a:b]
                if kinds[i] == 0:
                    old = probes.get(dim)
                    probes[dim] = (mine, vecs) if old is None else (np.concatenate((old[0], mine)), np.concatenate((old[1], vecs)))
                elif dim in probes:
                    for at, to in itertools.product(range(0, len(probes[dim][0]), 512), range(0, len(mine), 4096)):
                        found.append(_nearest(probes[dim][0][at : at + 512], probes[dim][1][at : at + 512], mine[to : to + 4096], vecs[to : to + 4096], k))
                        size += len(found[-1][0])
        if size > 500_000:
            found = [_best(found, k)]
            size = len(found[0][0])
    if found:
        q, x, d = _best(found, k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(d)], ["query_id", "vec_id", "score"])


def _ranked(rows: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    both = probes.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)))
    dealt = both.repartition("key").sortWithinPartitions("key", "kind").select("key", "kind", "vec_id", "vec")
    return dealt.mapInArrow(lambda b: _rerank(b, k), "query_id long, vec_id long, score double")


def _split_hot(rows: DataFrame, probes: DataFrame, edge: int = 8192) -> tuple[DataFrame, DataFrame]:
    """The same rows and probes under keys that no more than about ``edge`` rows and ``edge`` probes share.

    Rows and probes of a key that many have are dealt into parts by a hash of their ids; every part of the rows meets every part of
    the probes once, so no pair is lost."""
    count = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / edge).cast("int").alias(name))
    hot = count(rows, "r").join(count(probes, "q"), "key").where("r > 1 or q > 1")
    hot = written(hot, "hot")
    one = F.lit(1)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        at = df.join(hot, "key", "left").withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.coalesce(own, one))).withColumn("_to", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        parts = (F.col("_own"), F.col("_to")) if own == "r" else (F.col("_to"), F.col("_own"))
        return at.select(F.when(F.col("r").isNull(), F.col("key")).otherwise(F.xxhash64("key", *(p.cast("long") for p in parts))).alias("key"), "vec_id", "vec")

    return dealt(rows, "r", "q"), dealt(probes, "q", "r")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, sample: int = 2000) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (exact Euclidean distance, ties to smaller ids).

    ``vectors`` and ``queries`` are (vec_id, vec) of ``valid_vectors``. All rows are indexed and all are searched; the spread of
    the vectors, which scales the cell width, comes from ``sample`` rows at most. A query never finds its own id; rows that
    repeat an id count once, at their nearest. Vectors of different length never meet. Queries for which the probed buckets
    give fewer than k candidates are searched again against every row, in blocks."""
    index = index or Index()
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).agg(F.transform(F.array(F.avg(F.aggregate("vec", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))), lambda x: F.sqrt(x))[0].alias("s")).first()
    index = Index(index.tables, index.k, index.width, index.probes, index.seed, float(some["s"] or 1.0))
    kind = vectors.schema["vec"].dataType.simpleString()
    schema = f"key long, vec_id long, vec {kind}"
    rows = vectors.mapInArrow(lambda b: _keyed(b, index, False), schema)
    probes = queries.mapInArrow(lambda b: _keyed(b, index, True), schema)
    found = written(_top(_ranked(*_split_hot(rows, probes), k), k), "found")
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(counts, "vec_id", "left_anti")
    if short.limit(1).count():
        blocks = 64
        by_block = vectors.withColumn("key", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long"))
        to_all = short.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        again = _top(_ranked(by_block.select("key", "vec_id", "vec"), to_all.select("key", "vec_id", "vec"), k), k)
        found = found.join(counts, found["query_id"] == counts["vec_id"], "left_semi").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
