"""Near copies of the pipeline's stage against all pairs of shingle sets."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from dayfield.llm import near_copies

WHITE = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def brute_sets(text: str | None) -> frozenset:
    words = [w for w in (text or "").translate(WHITE).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(texts: dict[int, str | None]) -> set[int]:
    """The smallest id of each component of pairs with Jaccard 0.8 or more, from counts of shared shingles."""
    sets = {i: brute_sets(t) for i, t in texts.items()}
    holders, shared, parent = defaultdict(list), Counter(), {i: i for i in texts}
    for i, s in sorted(sets.items()):
        for x in s:
            holders[x].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for ids in holders.values():
        shared.update((i, j) for k, j in enumerate(ids) for i in ids[:k])
    empty = sorted(i for i, s in sets.items() if not s)
    for i, j in [p for p, n in shared.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + [(empty[0], j) for j in empty[1:]]:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return {find(i) for i in texts}


def test_stage_matches_all_pairs_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(texts)


def test_stage_matches_all_pairs_beside_a_common_passage(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage, body = draw.choices(words, k=60), draw.choices(words, k=120)
    texts: dict[int, str | None] = {0: None, 1: " \t", 2: "one two", 3: "ONE two", 4: "one two three"}
    for i in range(10, 250):
        texts[i] = " ".join(passage + draw.choices(words, k=60))
    for i in range(250, 330, 2):
        mine = draw.choices(words, k=60)
        near = mine[:]
        near[draw.randrange(60)] = "changed"
        texts[i], texts[i + 1] = " ".join(passage + mine), " ".join(near + passage)
    for i in range(400, 600):
        near = body[:]
        for _ in range(draw.randrange(1, 4)):
            near[draw.randrange(120)] = draw.choice(words)
        texts[i] = " ".join(near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == brute_kept(texts)


def test_stage_edge_cases(spark):
    rows = [(7, "other words here now"), (7, "other words here now"), (None, "lone text of a null id"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] or -1 for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [-1, -1, 2, 7]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_simhash_links_near_copies_without_bands(spark, monkeypatch):
    """Without any MinHash link the stage still joins what SimHash finds."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for i in range(0, 20, 2):
        mine = draw.choices(words, k=1500)
        texts[i], texts[i + 1] = " ".join(mine), " ".join([*mine, "tail"])
    monkeypatch.setattr(near_copies, "_links", lambda batches: (b.select(["key", "set_id"]).rename_columns(["a", "b"]).slice(0, 0) for b in batches))
    monkeypatch.setattr(near_copies, "_left_apart", lambda docs, classes, edges, most: edges.limit(0))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == set(range(0, 20, 2)) == brute_kept(texts)
