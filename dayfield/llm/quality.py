"""Operator 10: hierarchical empirical Bayes quality. Document evidence with host and path posteriors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table, unique_join, written

SYMBOLS = "#$%&*@^~<>{}[]=|\\_+"


def read(text: str | None) -> tuple[list[float], Counter]:
    """(shape, words) of the whole text: repetition, capitals, symbols, marks, word lengths, and how often each word occurs. Null
    and blank texts have a shape of their own and no words."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    if not n:
        return [1.0] + [0.0] * 12, counts
    letters = sum(map(str.isalpha, text))
    lower = text.lower()
    capitals = sum(a != b for a, b in zip(text, lower, strict=False)) if len(lower) == size else sum(map(str.isupper, text))
    symbols = sum(map(text.count, SYMBOLS))
    shape = [
        0.0,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        capitals / max(1, letters),
        symbols / size,
        symbols / n,
        text.count("!") / n,
        sum(map(text.count, "!?#$%&*")) / size,
        text.count("|") / n,
        letters / size,
        min(20.0, (size - n + 1) / n) / 20,
        np.log1p(n) / 10,
    ]
    return shape, counts


def features(text: str | None) -> list[float]:
    return read(text)[0]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    words: dict[str, float] = field(default_factory=dict)
    word_weight: float = 0.0

    def of_shape(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def evidence(self, texts) -> np.ndarray:
        """Log likelihood ratio of good to bad for each text, within -12 and 12: of its shape and of its words."""
        if not len(texts):
            return np.zeros(0)
        shapes, tokens = np.empty((len(texts), len(self.mean))), np.empty(len(texts))
        for i, text in enumerate(texts):
            shapes[i], counts = read(text)
            tokens[i] = token_evidence(counts, self.words)
        return np.clip(self.of_shape(shapes) + self.word_weight * tokens, -12, 12)


def token_evidence(counts: Iterable[str], words: dict[str, float]) -> float:
    """Sum of the log likelihood ratios of the distinct words that are known, over the root of their number and ten more, so that
    long texts do not outgrow their shape."""
    known = [words[w] for w in counts if w in words]
    return sum(known) / float(np.sqrt(len(known) + 10))


def word_ratios(holds: dict[bool, Counter], n: dict[bool, int], least: int = 3) -> dict[str, float]:
    """Log ratio of the share of good and of bad documents that hold a word, smoothed by one document of each; words of ``least`` documents or more."""
    good, bad = holds[True], holds[False]
    return {w: float(np.log((good[w] + 1) / (n[True] + 2) * (n[False] + 2) / (bad[w] + 1))) for w in {*good, *bad} if good[w] + bad[w] >= least}


def fit_texts(texts: list[str | None], good: np.ndarray) -> Model:
    """Shape evidence by ridge logistic regression, then word evidence on top of it.

    The weight of the words is fitted on halves that did not name their ratios (the other half did), with the shape evidence as
    a fixed offset, so that words add what the shape leaves open. Without both classes the evidence of every text is 0. Texts are
    read twice, so that no more than counts of words is held."""
    shapes = np.empty((len(texts), len(features(None))))
    holds = {(h, g): Counter() for h in (0, 1) for g in (True, False)}
    n = Counter()
    for i, text in enumerate(texts):
        shapes[i], counts = read(text)
        holds[i % 2, bool(good[i])].update(counts.keys())
        n[i % 2, bool(good[i])] += 1
    shape = fit(shapes, good)
    if len(np.unique(good)) < 2:
        return shape
    ratios = [word_ratios({g: holds[h, g] for g in (True, False)}, {g: n[h, g] for g in (True, False)}) for h in (0, 1)]
    every = word_ratios({g: holds[0, g] + holds[1, g] for g in (True, False)}, {g: n[0, g] + n[1, g] for g in (True, False)})
    tokens = np.array([token_evidence(read(text)[1], ratios[1 - i % 2]) for i, text in enumerate(texts)])
    offset = np.clip(shape.of_shape(shapes), -12, 12)
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(good)
    b, penalty = 0.0, 1e-2 * len(good)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(offset + b * tokens, -30, 30)))
        step = ((weight * (good - p)) @ tokens - penalty * b) / ((weight * p * (1 - p)) @ tokens**2 + penalty)
        b += step
        if abs(step) < 1e-9:
            break
    return Model(shape.mean, shape.scale, shape.weights, every, max(0.0, b))


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> Model:
    """Ridge logistic regression by Newton steps; both classes weigh the same, so the intercept holds no prior.

    With one class only, or none, the evidence of every text is 0."""
    width = x.shape[1] if x.ndim == 2 and len(x) else len(features(None))
    if len(np.unique(good)) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(x)
    w, penalty = np.zeros(width + 1), np.diag([ridge * len(x)] * width + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (good - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    """From at most ``sample`` labelled documents by hash of their ids (the bound of the sample; it is the broadcast side too).

    One text of each sampled id reaches the driver, where the model is fitted. Labels of one id are averaged; ids and labels that are null, and ids without a document, are not used."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good")).orderBy("doc_id").toPandas()
    return fit_texts(rows["text"].tolist(), rows["good"].to_numpy(bool))


def _evidence(docs: DataFrame, model: Model) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.evidence(text))

    return score("text")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-x))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-count of a Beta prior by moments: how little the groups vary around ``centre`` beyond their own sampling noise."""
    p = F.col("good") / F.col("n")
    row = groups.agg(F.sum(F.col("n") * (p - centre) * (p - centre)).alias("spread"), F.sum(centre * (1 - centre)).alias("noise"), F.sum("n").alias("n"), F.avg(centre * (1 - centre)).alias("v")).first()
    if not row["n"]:
        return 1.0
    between = max((row["spread"] - row["noise"]) / row["n"], 1e-6)
    return float(min(max(row["v"] / between - 1, 1.0), 1e4))


def global_rate(scored: DataFrame) -> float:
    """The share of good documents that agrees with the evidence: a fixed point of the mean posterior over counts of rounded
    evidence (241 values at most, as evidence lies within -12 and 12)."""
    steps = scored.groupBy(F.round("evidence", 1).alias("e")).agg(F.count("*").alias("n")).toPandas().sort_values("e")
    e, n, rate = steps["e"].to_numpy(float), steps["n"].to_numpy(float), 0.8
    for _ in range(100 if len(n) else 0):
        new = float(np.clip((n / (1 + np.exp(-e - np.log(rate / (1 - rate))))).sum() / n.sum(), 0.01, 0.99))
        rate, moved = round(new, 9), abs(new - rate)
        if moved < 1e-7:
            break
    return rate


@dataclass(frozen=True)
class Sites:
    """``rows``: host, path, path_good, path_n, host_good, host_n; the global rate and the pseudo-counts of hosts and paths."""

    rows: DataFrame
    rate: float
    host_pull: float
    path_pull: float

    def own(self, evidence: Column) -> Column:
        """Expected quality of one document under the global rate."""
        return F.round(_sigmoid(evidence + float(np.log(self.rate / (1 - self.rate)))), 9)

    def host_quality(self, out: Column, n: int = 1) -> Column:
        """Posterior of a host without ``n`` documents of the expected quality ``out``."""
        return (F.greatest(F.col("host_good") - out, F.lit(0.0)) + self.host_pull * self.rate) / (F.col("host_n") - n + self.host_pull)

    def path_quality(self, out: Column, n: int = 1) -> Column:
        return (F.greatest(F.col("path_good") - out, F.lit(0.0)) + self.path_pull * self.host_quality(out, n)) / (F.col("path_n") - n + self.path_pull)


def sites(scored: DataFrame) -> Sites:
    """Counts and expected good documents of hosts and paths from (host, path, evidence).

    Every document counts as its expected quality under the global rate. A host's rate is shrunk to the global rate and a path's
    to its host's, each with a pseudo-count estimated from all groups, so sparse sites lean on the level above. Sums are
    taken before rows are shuffled, so a hot host is one row per task."""
    rate = global_rate(scored)
    good = F.round(_sigmoid(F.col("evidence") + float(np.log(rate / (1 - rate)))), 9).cast("decimal(20,9)")
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum(good).cast("double").alias("path_good")), "paths")
    hosts = written(paths.groupBy(F.col("host").alias("_host")).agg(F.sum("path_n").alias("host_n"), F.sum(F.col("path_good").cast("decimal(30,9)")).cast("double").alias("host_good")), "hosts")
    host_pull = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), F.lit(rate))
    joined = written(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "sites")
    held = Sites(joined, rate, host_pull, 1.0)
    centred = joined.select(F.col("path_n").alias("n"), F.col("path_good").alias("good"), held.host_quality(F.lit(0.0), 0).alias("centre"))
    return Sites(joined, rate, host_pull, _strength(centred, F.col("centre")))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = 6000, least: float = 0.5, columns: list[str] | None = None, broadcast_sites: int = 100_000) -> DataFrame:
    """``docs`` (or its ``columns``) with host_quality, path_quality, evidence, p_quality and keep (p_quality >= ``least``).

    log odds = evidence of the whole text + log odds of its path's posterior, both posteriors taken without the document itself,
    so that no text counts twice. ``host`` and ``path`` default to the source and its language. Null hosts and paths are sites
    of their own. Null, empty and very long texts are judged like any other; repeated rows stay. Without labels of both classes
    the evidence is 0 and every document is kept; an empty table gives no rows. Columns of ``docs`` of the five new names are
    replaced; others pass through. Texts are read by Python once: rows and evidence are written. Up to ``broadcast_sites``
    sites (counted) are sent to every task and no text is shuffled; beyond, sites that hold over a thousandth of all rows still are, and
    only the rows of the others are shuffled by their site."""
    model = train(docs, labels, sample)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    new = ("host_quality", "path_quality", "evidence", "p_quality", "keep")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in new]
    scored = written(docs.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"), F.round(_evidence(docs, model), 9).alias("evidence")), "scored")
    found = sites(scored.select("host", "path", "evidence"))
    site = F.to_json(F.struct("host", "path")).alias("site")  # one key without nulls
    at = found.rows.select(site, "host_n", "host_good", "path_n", "path_good", F.col("path_n").alias("n"))
    keyed = scored.select("row", "evidence", site)
    met = keyed.join(F.broadcast(at.drop("n")), "site") if at.limit(broadcast_sites + 1).count() <= broadcast_sites else unique_join(keyed, at, "site")
    out = met.withColumn("_own", found.own(F.col("evidence")))
    out = out.select("row.*", found.host_quality(F.col("_own")).alias("host_quality"), found.path_quality(F.col("_own")).alias("path_quality"), "evidence")
    out = out.withColumn("p_quality", _sigmoid(F.col("evidence") + _logit(F.col("path_quality"))))
    return out.withColumn("keep", F.col("p_quality") >= least)


def kept_documents(docs: DataFrame, sf_dir: str, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns they came with. Nulls, repeats and empty tables are as ``judge`` says."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang"), table(docs.sparkSession, sf_dir, "labels"), columns=["row"], **options)
    return judged.where("keep").select("row.*")
