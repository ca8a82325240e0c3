"""Operator 11: spelling variants, words of a corpus that one edit apart from a commoner word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unique_join, written

#: Words that are counted: code points and occurrences at least.
SHORTEST, SELDOMEST = 5, 3
#: Maximal runs that are long enough; losing a code point makes none longer.
RUN = f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a group that are scanned together; larger groups are dealt by longer shared parts first.
GROUP = 128
#: Parts that are tried first (a power of two); a word stands in two groups for each.
PARTS = 4


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int = 97) -> DataFrame:
    """(word, n): words of whole texts by number of occurrences, as the contract takes them.

    A run whose checksum with its document's id is divisible by ``drop_one_in`` loses one code point (0: none do). Null and empty texts have
    no words; a null id counts as an empty one; repeated rows count each. Other columns are not read. Counting combines inside
    each task first, so a word that is everywhere is a row per task in the shuffle."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))
    lowered = F.when(F.rlike("run", F.lit("[À-ÿ]")), F.translate("run", CAPITALS, CAPITALS.lower())).otherwise(F.lower("run"))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", lowered.alias("run"))
    if drop_one_in:
        sum_of = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        runs = runs.withColumn("h", sum_of).select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("run"))
    return runs.where(F.length("run") >= SHORTEST).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= SELDOMEST)


def _key(m: Column, parts: Column, part: Column) -> Column:
    """Key of words that may differ inside one part only: the number of parts, the length of the shorter word, which part, and a hash of
    what stands before and behind it. Different texts under one hash only cost time."""
    begin, end = (F.floor(p * m / parts).cast("int") for p in (part, part + 1))
    before, behind = F.substring(F.col("word"), F.lit(1), begin), F.substring(F.col("word"), F.length("word") - (m - end) + 1, m - end)
    return F.xxhash64(parts, m, part, before, behind)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _key(F.col("m"), F.col("parts"), F.col("part")))


def _groups(vocabulary: DataFrame, limit: int, rounds: int = 40) -> DataFrame:
    """(key, word, n, m, parts, part): words in groups of those that may be one edit apart.

    The shorter word of a pair has m code points; cut into equal parts, one edit lies in one of them and the rest is shared. ``PARTS`` are tried
    first; a group of over ``limit`` words is cut into parts of half the length, until parts are single code points: so no
    common stem makes a large group, and no pair is lost."""
    each = vocabulary.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("m") >= SHORTEST)
    open_rows = _dealt(each.select("word", "n", "m", F.lit(PARTS).alias("parts"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part")))
    done: list[DataFrame] = []
    for _ in range(rounds):
        open_rows = written(open_rows, "groups")
        sizes = written(open_rows.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.max(F.col("parts") < F.col("m")).alias("divisible")).where("n > 1"), "sizes")
        large = (F.col("n") > limit) & F.col("divisible")
        known = sizes.select(F.col("_key").alias("key"), F.col("n").alias("rows"), large.alias("large"))
        met = unique_join(open_rows, known, "key", "rows")
        done.append(met.where(~F.col("large")).drop("large"))
        if not sizes.where(large).limit(1).count():
            return _all(done)
        halves = F.explode(F.array(2 * F.col("part"), 2 * F.col("part") + 1))
        open_rows = _dealt(met.where("large").select("word", "n", "m", (2 * F.col("parts")).alias("parts"), halves.alias("part")))
        open_rows = open_rows.where(F.floor(F.col("part") * F.col("m") / F.col("parts")) < F.floor((F.col("part") + 1) * F.col("m") / F.col("parts")))
    raise RuntimeError(f"groups did not become small in {rounds} rounds")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def near_in_list(listed: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, shared) for i < j: words of a sorted list of different words that are exactly one edit apart, and their common prefix.

    For each word the rest of the list is scanned. Row d of the edit matrix (the band of three cells around its diagonal, capped at 2)
    belongs to the first d code points of the scanned word; the rows of what it shares with the word before are used again. Where
    no cell of a row is 1 or less, all words that share those d code points are skipped."""
    shared = [0, *(_common(a, b) for a, b in pairwise(listed))]
    lower = [len(listed)] * len(listed)  # next place whose shared prefix is shorter
    waiting: list[int] = []
    for i, n in enumerate(shared):
        while waiting and shared[waiting[-1]] > n:
            lower[waiting.pop()] = i
        waiting.append(i)
    own = [(2, 0, 1), *[(1, 0, 1)] * (max(map(len, listed), default=0) + 4)]  # a word against itself: 1 beside the diagonal
    for i, word in enumerate(listed[:-1]):
        size = len(word)
        padded, rows = [None, *word, None, None, None, None], own[: size + 5]
        depth = alike = size
        j = i + 1
        while j < len(listed):
            other, again = listed[j], shared[j]
            depth, alike = min(depth, again), min(alike, again)
            low, mid, high = rows[depth]
            alive = True
            for d in range(depth + 1, len(other) + 1):
                c = other[d - 1]
                low, mid, high = low + (padded[d - 1] != c), mid + (padded[d] != c), high + (padded[d + 1] != c)
                _, up, further = rows[d - 1]
                low = low if low <= up else up + 1
                mid = min(mid, further + 1, low + 1)
                high = high if high <= mid else mid + 1
                if low > 1 and mid > 1 and high > 1:
                    alive, depth = False, d - 1
                    break
                rows[d] = (low, mid, high)
            j += 1
            if alive:
                depth = len(other)
                gap = size - depth
                if -1 <= gap <= 1 and rows[depth][gap + 1] == 1:
                    yield i, j - 1, alike
            else:
                while j < len(listed) and shared[j] > depth:  # all of these share the code points of the dead row
                    j = lower[j]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each group, from rows sorted by key and word; a pair counts in the part where its words first differ."""
    held: list[list] = [[], [], []]
    key = None

    def found() -> Iterator[pa.RecordBatch]:
        listed, n, (m, parts, part) = held[0], held[1], held[2]
        begin, end = part * m // parts, (part + 1) * m // parts
        out: list[tuple] = []
        for i, j, alike in near_in_list(listed):
            a, b = listed[i], listed[j]
            if min(len(a), len(b)) == m and (begin <= alike < end or (alike == m == end)):
                out += ((a, n[i], b, n[j]), (b, n[j], a, n[i]))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "parts", "part")]
        for k, word, n, *place in zip(*columns, strict=True):
            if k != key:
                if key is not None and len(held[0]) > 1:
                    yield from found()
                key, held = k, [[], [], place]
            held[0].append(word)
            held[1].append(n)
    if key is not None and len(held[0]) > 1:
        yield from found()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["word", "n", "other", "other_n"])


def near_words(vocabulary: DataFrame, limit: int = GROUP) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words one edit apart. ``vocabulary`` has one row per word."""
    rows = _groups(vocabulary, limit).select("key", "word", "n", "m", "parts", "part")
    return rows.repartition("key").sortWithinPartitions("key", "word").mapInArrow(_near, "word string, n long, other string, other_n long")


def variants(vocabulary: DataFrame, limit: int = GROUP, rounds: int = 70) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocabulary`` (word, n).

    A word's form is its commonest near word, the first in code-point order of equals, where that is at least twice as common. Roots are found by
    following forms of forms: each round doubles the steps, and as counts double at every step, a chain is short."""
    vocabulary = written(vocabulary, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = near_words(vocabulary, limit).groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(near, F.col("word") == F.col("_word"), "left")
    has = -F.col("best.n") >= 2 * F.col("n")
    table = written(joined.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n")), "variants")
    chains = table.where("form is not null").select("word", F.col("form").alias("at"))
    for _ in range(rounds):
        chains = written(chains, "chains")
        following = chains.select(F.col("word").alias("at"), F.col("at").alias("next"))
        weights = chains.groupBy("at").agg(F.count("*").alias("rows"))
        going = written(following.join(weights, "at"), "going")
        if not going.limit(1).count():
            break
        moved = unique_join(chains, going, "at", "rows").select("word", F.col("next").alias("at"))
        chains = moved.unionByName(chains.join(going.select("at"), "at", "left_anti").select("word", "at"))
    else:
        raise RuntimeError(f"roots did not settle in {rounds} rounds")
    ends = chains.select(F.col("word").alias("_word"), F.col("at").alias("root"))
    return table.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs``. An empty table, or one without words that are long and frequent enough, gives no rows."""
    return variants(words(docs, id_col, text_col))
