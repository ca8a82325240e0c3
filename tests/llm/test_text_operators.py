"""Language, packing, SimHash and quality against brute force and held-out rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dayfield.llm import langid, packing, quality, simhash

WORDS = ["alpha", "Beta", "gamma", "delta", "Ünïcode", "eps", "zeta", "eta", "theta", "iota", "😀"]


def brute_print(text: str | None) -> int:
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    draw = random.Random(1)
    texts = [None, "", " \t\n ", "one", "One two", "a b c d", "a b c d e", "x y z\x0bq w e"] + [" ".join(draw.choices(WORDS, k=draw.randrange(1, 400))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_components_link_every_pair_within_four_bits(spark):
    draw = random.Random(2)
    prints = [draw.getrandbits(64) for _ in range(150)]
    for p in prints[:60]:
        q = p
        for _ in range(draw.randrange(1, 6)):
            q ^= sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5)))
            prints.append(q)
    dense = draw.getrandbits(64)
    prints += [dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints = list(dict.fromkeys(prints))
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                parent[find(p)] = find(q)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    from dayfield.llm.common import components

    labels = {r["id"]: r["component"] for r in components(simhash.links(df)).collect()}
    mine: dict = {}
    for p in prints:
        mine.setdefault(labels.get(signed(p), signed(p)), set()).add(p)
    wanted: dict = {}
    for p in prints:
        wanted.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates_and_edge_cases(spark):
    texts = [(5, "a b c d e f g"), (3, "A B c d e f g"), (9, None), (2, ""), (7, "other words here now"), (7, "other words here now"), (None, "lone text of a null id"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).count() == len(texts)
    by_id = {k[0]: v for k, v in got.items() if k[0] is not None}
    assert by_id == {5: 3, 3: 3, 9: 2, 2: 2, 7: 7}
    assert sorted(v for k, v in got.items() if k[0] is None and k[1] == 0) == [2]
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, -1, 2, 3, 7]
    assert sorted((r["doc_id"] or -1) for r in simhash.deduplicated(docs, broadcast_rows=0).collect()) == [-1, -1, 2, 3, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()), per_lang=60)
    found = langid.predict(docs, model).join(docs.where(langid.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_scores_match_an_explicit_kernel_ridge():
    """Kernel values from Python sets, landmarks and ridge solved directly, against the folded weights and block products."""
    draw = random.Random(11)
    pools = {"aa": "abcdeé ", "bb": "abxyzž ", "cc": "кошмапт "}
    rows = [("".join(draw.choices(pools[lang], k=draw.randrange(5, 60))), lang) for lang in draw.choices(list(pools), k=90)]
    texts, langs = [t for t, _ in rows], [x for _, x in rows]
    sets = [set(codes[bounds[i] : bounds[i + 1]].tolist()) for _, bounds, codes in langid.presence(texts) for i in range(len(bounds) - 1)]
    model = langid.fit([np.array(sorted(s)) for s in sets[:60]], langs[:60], landmarks=12, ridge=1e-3)
    names = sorted(set(langs[:60]))
    members = {n: [i for i in range(60) if langs[i] == n] for n in names}
    chosen = [members[n][k] for k in range(60) for n in names if k < len(members[n])][:12]
    kernel = lambda a, b: len(sets[a] & sets[b]) / np.sqrt(len(sets[a]) * len(sets[b]))
    k_nm, k_mm = np.array([[kernel(i, j) for j in chosen] for i in range(60)]), np.array([[kernel(i, j) for j in chosen] for i in chosen])
    w = np.diag([60 / (len(names) * len(members[x])) for x in langs[:60]])
    y = np.array([[float(x == n) for n in names] for x in langs[:60]])
    alpha = np.linalg.solve(k_nm.T @ w @ k_nm + 1e-3 * 60 * k_mm + 1e-6 * np.eye(12), k_nm.T @ w @ y)
    wanted = np.array([[kernel(i, j) for j in chosen] for i in range(60, 90)]) @ alpha
    assert model.langs == names and np.abs(model.scores(texts[60:]) - wanted).max() < 1e-3


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "12 34", "en"), (3, "the and of " * 40, "en"), (4, "der die und " * 40, "de"), (5, "der und " * 200000, None), (None, "the of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as score")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[4][0] == "de" and got[5][0] == "de"
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_kernel_presence_matches_sets():
    text = "Grüße, grüße! " * 3
    (first, bounds, codes), = langid.presence([text, "", "ab"])
    assert first == 0 and list(np.diff(bounds))[1] == 0
    grams = {text.lower()[i : i + n] for n in langid.ORDERS for i in range(len(text) - n + 1)}
    assert bounds[1] - bounds[0] <= len(grams) and bounds[1] - bounds[0] >= len(grams) - 2  # hashed, few collisions


def fullest(lengths: list[int], room: int) -> int:
    """The largest subset sum of ``lengths`` that is at most ``room``, by all subsets."""
    return max(s for m in range(1 << len(lengths)) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= room)


def test_minimum_bin_slack_fills_bins():
    draw = random.Random(9)
    for capacity in (12, 37, 1024):
        for _ in range(25):
            counts: dict[int, int] = {}
            for _ in range(draw.randrange(1, 13)):
                x = draw.randrange(1, capacity + 1)
                counts[x] = counts.get(x, 0) + 1
            left = dict(counts)
            for lengths, times in packing.minimum_bin_slack(counts, capacity):
                for _ in range(times):
                    items = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
                    assert lengths[0] == items[0] and sum(lengths) == items[0] + fullest(items[1:], capacity - items[0])
                    for x in lengths:
                        left[x] -= 1
            assert not any(left.values())


@pytest.mark.parametrize("text", [" " * 1_000_000, "word" + " " * 900_000 + "next\n" + "\t\n" * 60_000, "\u3000" * 300_000 + "a", "abc" * 400_000, "1234567890" * 100_000, "漢字仮名" * 100_000, "<|endoftext|>" + " " * 120_000 + "<|endoftext|>x"])
def test_very_long_runs_have_the_ids_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encode(text, packing.default_vocabulary()).tolist() == [*reference.encode(text, add_special_tokens=False).ids, 2]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    texts = [None, "", "short", "<|endoftext|> is <|endoftext|><|endoftext|> a token", " " * 200_000 + "end"] + [" ".join(draw.choices(WORDS, k=draw.randrange(1, 1500))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "3 as length", "4 as sequence_id", "5 as offset")
    got = packing.packed(docs, keep_ids=True).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
    for i, text in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in pieces for x in r["ids"]] == [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        assert all(r["length"] == 1024 for r in pieces[1:]) and [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 1024) + 2
    assert packing.packed(docs.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    """Fitted on one half of the labels, judged on the other; no sample is shared."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judge(docs, labels.where("doc_id % 2 = 0"), columns=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(got) > 1000
    assert np.mean([bool(r["quality"]) == r["keep"] for r in got]) > 0.99
    assert np.mean([r["keep"] for r in got if r["quality"] == 1]) > 0.998


def test_quality_words_add_to_shape():
    draw = random.Random(4)
    common = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(common, k=80) + draw.choices(["spamword", "buynow", "cheap"] if i % 2 else ["theorem", "proof", "lemma"], k=8)) for i in range(400)]
    good = np.arange(400) % 2 == 0
    model = quality.fit_texts(texts[:200], good[:200])
    assert model.word_weight > 0 and ((model.evidence(texts[200:]) > 0) == good[200:]).mean() > 0.95


def test_posteriors_match_brute_force(spark):
    """Every document's posteriors, summed over its host and path without itself, row by row in plain Python."""
    draw = random.Random(8)
    rows = [(i, draw.choice(["h1", "h1", "h2", None]), draw.choice(["p", "q", None]), f"{'good words here ' * draw.randrange(1, 9)}{'!!! $$$ BUY ' * draw.randrange(0, 6)}") for i in range(120)]
    docs = spark.createDataFrame([*rows, (120, "lone", "p", "one single page")], "doc_id long, source string, lang string, text string").selectExpr("*", "1 as host", "2 as _own", "3 as row")
    labels = spark.createDataFrame([(r[0], int("BUY" not in r[3])) for r in rows if r[0] % 2], "doc_id long, quality int")
    got = [r.asDict() for r in quality.judge(docs, labels).collect()]
    scored = spark.createDataFrame([(r["source"], r["lang"], r["evidence"]) for r in got], "host string, path string, evidence double")
    held = quality.sites(scored)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    own = [sigmoid(r["evidence"] + np.log(held.rate / (1 - held.rate))) for r in got]
    for i, r in enumerate(got):
        host = [own[k] for k, o in enumerate(got) if k != i and o["source"] == r["source"]]
        path = [own[k] for k, o in enumerate(got) if k != i and (o["source"], o["lang"]) == (r["source"], r["lang"])]
        h = (sum(host) + held.host_pull * held.rate) / (len(host) + held.host_pull)
        p = (sum(path) + held.path_pull * h) / (len(path) + held.path_pull)
        assert abs(r["host_quality"] - h) < 1e-6 and abs(r["path_quality"] - p) < 1e-6
        assert abs(r["p_quality"] - sigmoid(r["evidence"] + np.log(p / (1 - p)))) < 1e-6 and r["keep"] == (r["p_quality"] >= 0.5)
    lone = next(r for r in got if r["doc_id"] == 120)
    assert abs(lone["path_quality"] - held.rate) < 1e-6 and lone["host"] == 1 and lone["_own"] == 2


def test_quality_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "good words in a row here", "s", "en"), (3, "good words in a row here", "s", "en"), (None, "x " * 100000, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as evidence")
    labels = spark.createDataFrame([(3, 1), (None, 0), (77, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(r["keep"] and r["evidence"] == 0 for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_empirical_bayes_shrinks_sparse_sites(spark):
    rows = [("big", "a", 4.0)] * 300 + [("big", "b", 4.0)] * 20 + [("bad", "a", -4.0)] * 300 + [("tiny", "a", -4.0)]
    held = quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = {(r["host"], r["path"]): r["q"] for r in held.rows.select("host", "path", held.path_quality(F.lit(0.0), 0).alias("q")).collect()}
    assert got["bad", "a"] < got["tiny", "a"] < got["big", "a"]


@pytest.mark.parametrize("text", [None, "", "   ", "word", "A" * 100000, "ẞ İ ŉ"])
def test_features_are_finite(text):
    assert np.isfinite(quality.features(text)).all()
