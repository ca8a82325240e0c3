"""Operator 5: best-fit packing by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, prefix_sums, written

CAPACITY, END_ID = 1024, 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: White space as the pattern of the vocabulary knows it (the Unicode property), and the length from which a run is cut out.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN, ADDED = 50_000, {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """(encoder, encoder of single runs): the byte-level vocabulary as ranks gives the ids of ``byte_bpe_50k.json`` several times
    faster (tests compare them). The second takes a text as one word of the pattern."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    make = lambda name, pattern, added: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return make("byte_bpe_50k", public_tokenizers.PATTERN, ADDED), make("byte_bpe_50k_run", r"[\s\S]+", {})


def _plain(text: str, path: str) -> list[int]:
    """Ids of a text without added tokens. The pattern looks ahead after white space and recurses over the run, so very long runs
    are encoded by themselves: such a run is one word but for its last character, which belongs to what follows."""
    words, run = _encoder(path)
    if len(text) < LONG_RUN:
        return words.encode_ordinary(text)
    ids, at = [], 0
    for found in _WHITE.finditer(text):
        if found.end() - found.start() >= LONG_RUN:
            end = found.end() - (found.end() < len(text))
            ids += words.encode_ordinary(text[at : found.start()]) + run.encode_ordinary(text[found.start() : end])
            at = end
    return ids + words.encode_ordinary(text[at:])


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of the whole text, whatever its length, then the end id. The vocabulary's added token keeps its own id."""
    ids: list[int] = []
    for i, part in enumerate((text or "").split(*ADDED)):
        ids += [*ADDED.values()] * bool(i) + _plain(part, path)
    ids.append(END_ID)
    return np.array(ids, "<u4")


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(text, path)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), ids[i:j].astype(np.int32) if keep_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if keep_ids else arrays[:5], names if keep_ids else names[:5])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only documents over ``capacity`` are cut, the first piece is the rest.

    ``vocabulary`` is a file that every executor has. Null texts are empty: one piece with the end id. Texts of any length are encoded
    whole; repeated rows give their pieces each; other columns are not read; an empty table gives no rows."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(lambda b: _pieces(b, path, capacity, keep_ids), schema)


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), until every length is used up.

    Each bin holds the largest length that is left; a bitset of reachable sums, grown by one item at a time from long to short,
    finds the fullest combination of the others. A combination is taken as often as its counts allow, so the work follows the
    number of distinct lengths (below ``capacity``), not the number of documents."""
    left, out = dict(counts), []
    while lengths := sorted((x for x, n in left.items() if n > 0), reverse=True):
        first = lengths[0]
        room = capacity - first
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for length in lengths:
            for _ in range(min(left[length] - (length == first), room // length) if length <= room else 0):
                grown = reach | (reach << length) & mask
                if grown == reach:
                    break
                steps.append((length, reach))
                reach = grown
            if reach >> room & 1:
                break
        total, chosen = reach.bit_length() - 1, [first]
        for length, before in reversed(steps):
            if not before >> total & 1:
                chosen.append(length)
                total -= length
        chosen.sort(reverse=True)
        times = min(left[x] // chosen.count(x) for x in set(chosen))
        for x in chosen:
            left[x] -= times
        out.append((chosen, times))
    return out


def _plan(counts: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, sequence of that rank, offset): ranks from there on go to the following sequences."""
    used: dict[int, int] = dict.fromkeys(counts, 0)
    places: dict[int, list[tuple[int, int, int]]] = {x: [] for x in counts}
    sequence = 0
    for lengths, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for x in lengths:
            places[x].append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in places.items()}


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column length of 1..capacity) with sequence_id and offset; no sequence is over ``capacity``.

    The driver sees one count per length (``capacity`` numbers at most) and plans bins over them; items are ranked within their
    length by two-level sums and look their place up. Columns doc_id and piece, if there, fix the order of equal lengths; equal
    rows are interchangeable. Columns sequence_id and offset of ``items`` are replaced. An empty table gives no rows."""
    items = items.drop("sequence_id", "offset")
    counts = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    held = items.sparkSession.sparkContext.broadcast(_plan(counts, capacity))
    order = [c for c in ("doc_id", "piece") if c in items.columns] or items.columns
    ranked = prefix_sums(items, ["length"], order, F.lit(1), "_rank", bucket_count(max(counts.values(), default=0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.concatenate(([0], np.flatnonzero(np.diff(length[order])) + 1, [len(order)])) if len(order) else np.array([0])
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                mine = order[i:j]
                first, base, at = plan[int(length[mine[0]])]
                slot = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = base[slot] + rank[mine] - first[slot], at[slot]
            kept = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(c for c in batch.schema.names if c != "_rank"), "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return ranked.select(*items.columns, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Token pieces of all documents with their places. Repeated rows are documents of their own; other columns are not read."""
    return pack(written(pieces(docs, capacity, vocabulary, keep_ids), "pieces"), capacity)
