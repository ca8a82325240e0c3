"""Operator 3: language by string kernels (blended n-gram presence), Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Orders of the blended spectrum, size of the hashed n-gram space, and how many characters are coded at a time.
ORDERS, SPACE_BITS, CHUNK = (1, 2, 3), 17, 1 << 18
#: Cells of one presence matrix.
CELLS = 1 << 24


def _codes(points: np.ndarray, owner: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code) of every n-gram that lies inside one text."""
    owners, codes = [], []
    grown = np.zeros(len(points), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        size = len(points) - n + 1
        grown = (grown[:size] * np.uint32(0x01000193)) ^ (points[n - 1 :] + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        if n in orders:
            inside = owner[:size] == owner[n - 1 :]
            mixed = grown ^ (grown >> np.uint32(15))
            codes.append(((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SPACE_BITS))[inside])
            owners.append(owner[:size][inside])
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners).astype(np.int64), np.concatenate(codes).astype(np.int64)


def presence(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bounds, codes) for runs of texts: codes[bounds[i]:bounds[i+1]] are the sorted distinct n-grams of a text.

    Texts are lower-cased and read whole; a very long one is coded in overlapping pieces into one presence table."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        start = at
        while at < len(texts) and (not group or size + len(texts[at] or "") <= CHUNK):
            group.append((texts[at] or "").lower())
            size += len(group[-1])
            at += 1
        if len(group) == 1 and size > CHUNK:
            seen = np.zeros(1 << SPACE_BITS, bool)
            for i in range(0, size, CHUNK):
                piece = np.frombuffer(group[0][i : i + CHUNK + max(orders) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
                seen[_codes(piece, np.zeros(len(piece), np.int32), orders)[1]] = True
            found = np.flatnonzero(seen)
            yield start, np.array([0, len(found)]), found
            continue
        points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(group), dtype=np.int32), [len(x) for x in group])
        owners, codes = _codes(points, owner, orders)
        key = (owners << SPACE_BITS) | codes
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        bounds = np.searchsorted(key, np.arange(len(group) + 1, dtype=np.int64) << SPACE_BITS)
        yield start, bounds, key & ((1 << SPACE_BITS) - 1)


@dataclass
class Model:
    """Kernel values against the landmarks are ``P(x) @ landmarks / sqrt(k(x, x))``; ``weights`` is landmarks @ alpha."""

    langs: list[str]
    weights: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: kernel ridge outputs of the one-versus-rest problems, 0 where a text has no n-gram.

        A block of texts is a matrix of n-gram presence over the n-grams that occur in it; its product with the weights gives all
        outputs of the block."""
        out = np.zeros((len(texts), max(1, len(self.langs))))
        if not self.langs:
            return out
        for first, bounds, codes in presence(texts, self.orders):
            count = np.diff(bounds)
            used = np.zeros(1 << SPACE_BITS, bool)
            used[codes] = True
            column, weights = np.cumsum(used) - 1, self.weights[used]
            block = max(1, CELLS // max(1, len(weights)))
            for at in range(0, len(count), block):
                n = count[at : at + block]
                x = np.zeros((len(n), len(weights)), np.float32)
                x[np.repeat(np.arange(len(n)), n), column[codes[bounds[at] : bounds[at + len(n)]]]] = 1
                out[first + at : first + at + len(n)] = (x @ weights) / np.sqrt(np.maximum(n, 1))[:, None]
        return out


def fit(features: list[np.ndarray], langs: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """Nystroem kernel ridge regression on presence features (sorted distinct codes of each text).

    Landmarks are dealt to the languages in turn: ``landmarks`` of them, and two of each language at least."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1, 1)))
    y = np.array([names.index(x) for x in langs])
    by_class = [np.flatnonzero(y == c) for c in range(len(names))]
    order = [members[i] for i in range(max(map(len, by_class))) for members in by_class if i < len(members)]
    chosen = [i for i in order if len(features[i])][: max(landmarks, 2 * len(names))]
    if not chosen:
        return Model(names, np.zeros((1 << SPACE_BITS, len(names)), np.float32))
    table = np.zeros((1 << SPACE_BITS, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        table[features[i], j] = 1 / np.sqrt(len(features[i]))
    kernel = np.stack([table[f].sum(axis=0) / np.sqrt(max(1, len(f))) for f in features]).astype(np.float64)
    among = kernel[chosen]
    goal = np.where(y[:, None] == np.arange(len(names))[None], 1.0, 0.0)
    weight = np.array([len(y) / (len(names) * len(by_class[c])) for c in y])
    left = (kernel * weight[:, None]).T @ kernel + ridge * len(y) * (among + among.T) / 2 + 1e-6 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, (kernel * weight[:, None]).T @ goal)
    return Model(names, (table @ alpha).astype(np.float32))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        out = [codes[bounds[i] : bounds[i + 1]].astype(np.int32) for _, bounds, codes in presence(texts) for i in range(len(bounds) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.list_(pa.int32()))], ["lang", "codes"])


def train(labelled: DataFrame, per_lang: int = 250, landmarks: int = 160, id_col: str = "doc_id") -> Model:
    """A model from at most ``per_lang`` rows of each language (the bound of the sample), chosen by a hash of their ids.

    ``labelled`` has id, text and lang. Rows without a language or a letter are not used. A count per language (the model has a
    column for each) sets a hash threshold first, so that only about twice the sample leaves the scan and is ranked."""
    usable = labelled.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select(F.col(id_col).alias("doc_id"), "text", "lang")
    usable = usable.withColumn("_h", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    edges = {lang: int(float(2 * per_lang + 20) * (1 << 30) / n) for lang, n in sizes.items()}
    edge = F.try_element_at(F.create_map(*(F.lit(x) for pair in edges.items() for x in pair)), "lang") if edges else F.lit(0)
    near = usable.where(F.col("_h") <= edge)
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_r") <= per_lang)
    rows = ranked.select("text", "lang", "_h").mapInArrow(_feature_batches, "lang string, codes array<int>").toArrow()
    found = sorted(zip(rows.column("lang").to_pylist(), (np.asarray(x.values) for x in rows.column("codes")), strict=True), key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    mixed = [found[i] for i in np.random.default_rng(7).permutation(len(found))]
    return fit([x[1].astype(np.int64) for x in mixed], [x[0] for x in mixed], landmarks)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the class with the largest output, and that output within 0 and 1.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned. Ties go to the
    language that is first by name. Only id and text are read; repeated rows are judged each; texts of any length are read whole; an empty
    table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in rows:
            texts = batch.column(1).to_pylist()
            scores = model.scores(texts)
            best = scores.argmax(axis=1)
            known = [bool(t) and bool(model.langs) and any(map(str.isalpha, t)) for t in texts]
            names = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)]
            value = np.where(known, np.clip(scores[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
