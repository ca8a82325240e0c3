"""Near copies by Jaccard similarity of five-word shingles: SimHash links and MinHash bands find candidates, whole texts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, unique_join, written
from .simhash import _LOWER, _WHITE, fingerprint, one_of_each
from .simhash import links as fingerprint_links

#: A pair at Jaccard 0.8 shares no band with probability (1 - 0.8^4)^24, 3 in a million.
SHINGLE, BANDS, ROWS, SEED = 5, 24, 4, 42
#: Least Jaccard as a fraction, and the share of equal minima from which a pair's texts are read (0.8 less almost five deviations).
LEAST, ESTIMATE = (4, 5), 0.6
_DRAWN = np.random.default_rng(SEED)
_PLACE = _DRAWN.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; a shorter text is one shingle, one without words has none.

    Words and case are those of the SimHash contract. ``known`` keeps word hashes from text to text."""
    words = [w for w in (text or "").translate(_WHITE).translate(_LOWER).split(" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    known = {} if known is None else known
    if len(known) > 100_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED)
    hashes = np.array([known[w] for w in words], np.uint64)
    n, size = max(len(words) - SHINGLE + 1, 1), min(len(words), SHINGLE)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def signature(values: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hash functions, its upper 32 bits."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        least = np.minimum(least, (values[at : at + 1024][None] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def _set_id(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), SEED)).view(np.int64)) if len(values) else 0


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        ids, sigs, sizes, prints = [], [], [], []
        for text in (x.as_py() for x in batch.column(1)):
            values = shingles(text, known)
            ids.append(_set_id(values))
            sigs.append(signature(values).tobytes() if len(values) else None)
            sizes.append(len(values))
            prints.append(fingerprint(text))
        columns = [pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "set_id", "sig", "size", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [shingles(text.as_py(), known) for text in batch.column(0).slice(at, 512)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["set_id", "whole"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per band: its key, the set and the band."""
    band = np.arange(BANDS, dtype=np.uint64)[None]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            ids = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            sigs = np.frombuffer(b"".join(batch.column(1).slice(at, 4096).to_pylist()), "<u4").astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = band + np.zeros((len(sigs), 1), np.uint64)
            for k in range(ROWS):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, k])
            columns = [key.ravel().view(np.int64), np.repeat(ids, BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "set_id", "band"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a key with the first set of the key (a star). Rows are sorted by key; the centre is carried from batch to batch."""
    key_before, centre_before = None, None
    for batch in batches:
        key, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if not len(key):
            continue
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        first = ids[starts].copy()
        if key_before == key[0]:
            first[0] = centre_before
        centre = np.repeat(first, np.diff(np.append(starts, len(key))))
        apart = ids != centre
        edges = np.unique(np.stack((np.maximum(ids, centre)[apart], np.minimum(ids, centre)[apart])), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])
        key_before, centre_before = key[-1], centre[-1]


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b), a > b: pairs of sets that SimHash links: each with the first set of its fingerprint, and the first sets of fingerprints that
    ``simhash.links`` joins. Linear in the sets, as those links are."""
    held = classes.where("sig is not null").select("set_id", "fp")
    first = written(held.groupBy("fp").agg(F.min("set_id").alias("first")), "first")
    one, two = (first.select(F.col("fp").alias(f"_{c}"), F.col("first").alias(f"_f{c}")) for c in "ab")
    linked = fingerprint_links(first).join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("_fa", "_fb")
    pairs = linked.union(held.join(first, "fp").where("set_id <> first").select("set_id", "first"))
    return pairs.select(F.greatest("_fa", "_fb").alias("a"), F.least("_fa", "_fb").alias("b"))


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of one value of ``names`` at a time, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and any(held[-1].column(n)[0] != part.column(n)[0] for n in names):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


BLOCKS = ("key", "rows", "probes")


def _candidates(run: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(probe, rows) of one block whose signatures are close. A pair is looked at in the first band that it shares, and in one direction."""
    ids, component, probe, apart = (run.column(c).to_numpy() for c in ("set_id", "component", "probe", "apart"))
    band = run.column("band")[0].as_py()
    sigs = np.frombuffer(b"".join(run.column("sig").to_pylist()), "<u4").reshape(len(ids), -1)
    mine = np.flatnonzero(~probe)
    for k in np.flatnonzero(probe):
        near = mine[(component[mine] != component[k]) & (~apart[mine] | (ids[mine] > ids[k]))]
        same = sigs[near] == sigs[k]
        close = np.count_nonzero(same, axis=1) >= ESTIMATE * BANDS * ROWS
        near, same = near[close], same[close]
        near = near[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(near):
            yield int(k), near


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block that have a candidate in it: rows, not pairs, so their number is bounded by what came in."""
    names = [*BLOCKS, "band", "set_id", "component", "probe", "apart"]
    for run in _runs(batches, BLOCKS):
        met = np.zeros(run.num_rows, bool)
        for k, near in _candidates(run):
            met[k] = met[near] = True
        yield from run.select(names).filter(pa.array(met)).combine_chunks().to_batches()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, decided on the whole sets inside a block: as many as it takes to connect what the block connects."""
    for run in _runs(batches, BLOCKS):
        ids, component = run.column("set_id").to_numpy(), run.column("component").to_numpy()
        wholes = [np.frombuffer(x.as_buffer(), np.uint64) for x in run.column("whole")]
        above: dict[int, int] = {}

        def top(c: int, above: dict[int, int] = above) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = above.get(up, up)
                c = up
            return c

        found: list[tuple[int, int]] = []
        for k, near in _candidates(run):
            for i in near.tolist():
                one, two = top(int(component[k])), top(int(component[i]))
                if one != two and similar(wholes[k], wholes[i]):
                    above[one] = two
                    found.append((int(ids[k]), int(ids[i])))
        a, b = (np.array([p[n] for p in found], np.int64) for n in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _left_apart(docs: DataFrame, classes: DataFrame, edges: DataFrame, broadcast_rows: int, block: int = 1024, most_bytes: int = 1 << 23) -> DataFrame:
    """Links between sets that share a band and that ``edges`` leave in different components.

    Sets outside the commonest component of a key (probes) are compared with every set of it. Rows and probes are both dealt into blocks, of about
    ``block`` rows and ``most_bytes`` of whole sets, and a task holds one block of each. Signatures alone say first which rows have a candidate in their
    block; only these fetch their whole sets, and links come out, never candidate pairs."""
    at = components(edges).select(F.col("id").alias("_id"), "component")
    rows = classes.where("sig is not null").select("set_id", "sig").mapInArrow(_banded, "key long, set_id long, band int")
    rows = rows.join(at, F.col("set_id") == F.col("_id"), "left").select("key", "set_id", "band", F.coalesce("component", "set_id").alias("component"))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    runs = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("main"))
    runs = written(runs.where("parts > 1 and n > 2").select(F.col("key").alias("_key"), "main"), "runs")
    sized = classes.select(F.col("set_id").alias("_set"), "sig", (8 * F.col("size")).alias("bytes"))
    found = rows.join(runs, F.col("key") == F.col("_key")).select("key", "band", "set_id", "component", (F.col("component") != F.col("main")).alias("apart"))
    found = written(found.join(sized, F.col("set_id") == F.col("_set")).drop("_set"), "apart")
    share = lambda which: F.ceil(F.greatest(F.sum(F.when(which, 1).otherwise(0)) / block, F.sum(F.when(which, F.col("bytes")).otherwise(0)) / most_bytes)).cast("int")
    blocks = found.groupBy(F.col("key").alias("_key")).agg(share(F.lit(True)).alias("_rows"), share(F.col("apart")).alias("_probes"))
    found = found.join(blocks, F.col("key") == F.col("_key")).drop("_key", "bytes")
    dealt = lambda n: F.pmod(F.xxhash64("set_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = found.withColumn("rows", dealt(F.col("_rows"))).withColumn("probes", every("_probes")).withColumn("probe", F.lit(False))
    asks = found.where("apart").withColumn("probes", dealt(F.col("_probes"))).withColumn("rows", every("_rows")).withColumn("probe", F.lit(True))
    names = [*BLOCKS, "band", "set_id", "component", "probe", "apart"]
    both = own.select(*names, "sig").unionByName(asks.select(*names, "sig"))
    schema = "key long, rows int, probes int, band int, set_id long, component long, probe boolean, apart boolean"
    involved = written(both.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS).mapInArrow(_involved, schema), "involved")
    sets = _whole(docs, classes, involved.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")), broadcast_rows)
    held = sized.select("_set", "sig").join(sets.select(F.col("set_id").alias("_own"), "whole"), F.col("_set") == F.col("_own"))
    full = involved.join(held, F.col("set_id") == F.col("_set")).select(*names, "sig", "whole")
    return full.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS).mapInArrow(_across, "a long, b long").distinct()


def _pairs(batches: Iterator[pa.RecordBatch], right) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passed = [right(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))


def _likely(x, y) -> bool:
    return np.count_nonzero(np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")) >= ESTIMATE * BANDS * ROWS


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes have the least Jaccard similarity or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0]


def _alike(x, y) -> bool:
    return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))


def _met(pairs: DataFrame, rows: DataFrame, value: str, right) -> DataFrame:
    """The pairs for whose two values ``right`` holds."""
    one, two = (rows.select(F.col("set_id").alias(f"_{c}"), F.col(value).alias(f"_v{c}")) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    return both.select("a", "b", "_va", "_vb").mapInArrow(lambda x: _pairs(x, right), "a long, b long")


def _whole(docs: DataFrame, classes: DataFrame, pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """(set_id, whole): the shingle sets that the pairs name, from one text each. Null ids cannot be looked up: all are read."""
    named = pairs.select(F.col("a").alias("_set")).union(pairs.select("b")).distinct()
    wanted = written(classes.join(named, F.col("set_id") == F.col("_set"), "left_semi").where("least is not null").select(F.col("least").alias("_id")).distinct(), "wanted")
    asked = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = docs.select("doc_id", "text")
    found = texts.join(asked, F.col("doc_id") == F.col("_id"), "left_semi").select("text").union(texts.where("doc_id is null").select("text"))
    return written(found.mapInArrow(_sets, "set_id long, whole binary").dropDuplicates(["set_id"]), "sets")


def near_copies(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, component_id) for every row: documents that pairs of Jaccard 0.8 or more connect; the smallest doc_id names them.

    Equal shingle sets are one class. Classes that SimHash links, and those that share a MinHash band with the first of it, are candidates; links
    that the texts confirm make components, and then every pair of a band that is still apart is compared. Texts without words are one class. Repeated rows are one
    document with several rows; rows with a null id stand in the component of their text; an empty table gives no rows."""
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, set_id long, sig binary, size long, fp long"), "prints")
    classes = written(prints.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.any_value("sig").alias("sig"), F.any_value("size").alias("size"), F.min("fp").alias("fp"), F.count("*").alias("n")), "classes")
    banded = classes.where("sig is not null").select("set_id", "sig").mapInArrow(_banded, "key long, set_id long, band int").select("key", "set_id")
    ordered = banded.repartitionByRange("key", "set_id").sortWithinPartitions("key", "set_id")
    candidates = by_fingerprint(classes).union(ordered.mapInArrow(_links, "a long, b long")).distinct()
    stars = written(_met(candidates, classes, "sig", _likely), "stars")
    sure = written(_met(stars, _whole(docs, classes, stars, broadcast_rows), "whole", _alike), "sure")
    labels = components(sure.union(written(_left_apart(docs, classes, sure, broadcast_rows), "left")))
    named = classes.select("set_id", "least", F.col("n").alias("rows")).join(labels, F.col("set_id") == F.col("id"), "left")
    named = written(named.select("set_id", "least", "rows", F.coalesce("component", "set_id").alias("component")), "named")
    smallest = written(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    to = written(unique_join(named, smallest, "component").select("set_id", "component_id", F.col("rows").alias("n")), "named")
    return unique_join(prints.select("doc_id", "set_id"), to, "set_id").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each component of near copies, as ``simhash.deduplicated`` does it for fingerprints."""
    return one_of_each(docs, near_copies(docs, broadcast_rows), broadcast_rows)
