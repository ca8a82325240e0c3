"""Spelling variants, filter audit and byte-level BPE against brute force, with the edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dayfield.llm import bpe, filter_audit, queries, spelling

# --- spelling ---------------------------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(docs, drop_one_in=97):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_one_in and h % drop_one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def expected_variants(n):
    near = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdefg", "aé×\U0001f600"])
def test_sorted_list_scan_finds_all_pairs(alphabet):
    rnd = random.Random(len(alphabet))
    for _ in range(60):
        listed = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 50))})
        found = {(listed[i], listed[j]): shared for i, j, shared in spelling.near_in_list(listed)}
        assert found.keys() == {(a, b) for a, b in itertools.combinations(listed, 2) if one_edit(a, b)}
        for (a, b), shared in found.items():
            assert a[:shared] == b[:shared] and a[shared : shared + 1] != b[shared : shared + 1]


@pytest.mark.parametrize("limit", [2, 8, 128])
def test_near_words_with_groups_of_any_size(spark, limit):
    rnd = random.Random(7)
    n = {"".join(rnd.choice("abc") for _ in range(rnd.randint(5, 8))): rnd.randint(3, 40) for _ in range(500)}
    n |= {"stem" * 40 + "".join(rnd.choice("xyz") for _ in range(3)): rnd.randint(3, 90) for _ in range(40)}
    found = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), limit)
    assert found_variants(found) == expected_variants(n)


def test_spelling_of_texts_with_odd_rows(spark):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abcdéÉ") for _ in range(rnd.randint(3, 7))) for _ in range(60)]
    docs = [(i if i % 9 else None, " ".join(rnd.choice(pool).title() if rnd.random() < 0.3 else rnd.choice(pool) for _ in range(60))) for i in range(80)]
    docs += [(1000, None), (1001, ""), (1002, "12 34 ..."), (5, docs[5][1]), (5, docs[5][1]), (1003, "Zebra×Āzebra-zebra " * 2000), (1004, "q" * 200_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert found_variants(spelling.spelling_groups(df)) == expected_variants(counted(docs))
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_spelling_query_on_documents(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n = counted(docs)
    found = queries.op11_spelling_variants(spark, sf_dir)
    assert found.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = found_variants(found)
    assert {w: r[2] for w, r in rows.items()} == n
    by_hole = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in by_hole.values():
        for a in group:
            near[a] |= group - {a}
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in n and short != w:
                near[w].add(short)
                near[short].add(w)
    assert all(len(near[w]) == r[3] for w, r in rows.items())
    assert any(r[0] for r in rows.values())


# --- filter audit -----------------------------------------------------------------------------------------------------------


def expected_audit(docs, labels):
    texts = [(i, "" if s is None else s, t or "") for i, t, s in docs]
    least = {}
    for i, _, t in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    fails = []
    for i, s, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        fails.append((s, {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {s for s, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                failing = sum(letter in x[1] for x in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {letter} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for order, step in itertools.product(map("".join, itertools.permutations("ABCDE")), range(1, 6)):
            out[part, order, step].append(shapley[order[step - 1]])
    return out


def found_audit(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[k] for k in names] for r in df.collect()}


def test_intervals_cover_every_order_once_per_mask():
    rank = {o: r for r, o in enumerate(itertools.permutations(range(5)))}
    held = defaultdict(list)
    for mask, step, begin, end in filter_audit.removal_intervals():
        held[mask] += [(r, step) for r in range(begin, end)]
    for mask in range(1, 32):
        assert sorted(held[mask]) == sorted((r, next(s for s, x in enumerate(o, 1) if mask >> x & 1)) for o, r in rank.items())


def test_audit_matches_brute_force(spark):
    rnd = random.Random(11)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [None, "", "SHOUT", "a|b", long, "same " * 300, long.upper(), long + " #", "é ÉÉ", "x" * 300_000, "a b\tc\nd " * 60_000]
    docs = [(i, rnd.choice(pool) if rnd.random() < 0.7 else long + f" {i}", rnd.choice(["s1", "s2", None, ""])) for i in range(120)]
    docs += [docs[3], docs[3], (None, long, "s1"), (None, "SHOUT", "s3"), (-5, long, "s2")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 100)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "m", 7) for d in docs], "doc_id long, text string, source string, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = found_audit(filter_audit.audit(filter_audit.failure_counts(df, marks)))
    assert found == expected_audit(docs, labels)
    assert filter_audit.audit(filter_audit.failure_counts(df.limit(0), marks)).count() == 0
    assert found_audit(filter_audit.audit(filter_audit.failure_counts(df, marks.limit(0)))) == expected_audit(docs, [])


# --- byte-level BPE ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.default_vocabulary(), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


HARD = ["", "a", "it's we'll I'VE", "  two  spaces \n\n\t end  ", "กำน 日本語 \U0001f468‍\U0001f469‍\U0001f467", "x̧́", "\x00\x1c\x1f\x85 ", "<|endoftext|>", "\U00031350Ᲊ՘ \U00010940", "1²२Ⅷ", "﻿�￿"]


def test_ids_are_those_of_the_library(library, ranks):
    coder = bpe.encoder(bpe.default_vocabulary())
    rnd = random.Random(5)
    kinds = ["ab", "abcdefghijklmnopqrstuvwxyz", "äöüßé", "日本語漢字", "0123456789", "  \n\t", "!?.,;-='", "\U0001f600\U0001f1e6", "АБаб"]
    texts = HARD + ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    listed = list(ranks)
    texts += [b"".join(rnd.choices(listed, k=3)).decode("utf-8", "ignore") for _ in range(3000)]
    for text in texts:
        assert coder.encode(text) == packed(library.encode_ordinary(text)), text


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 60_000, "=-" * 50_000, "日本" * 30_000, "aA" * 50_000, " " * 30_000, "9" * 50_000])
def test_long_words(library, text):
    assert bpe.encoder(bpe.default_vocabulary()).encode(text) == packed(library.encode_ordinary(text))


def test_long_random_word_leaves_in_parts(library):
    rnd = random.Random(2)
    word = "".join(rnd.choice("abcde") for _ in range(60_000))
    machine = bpe.encoder(bpe.default_vocabulary()).machine
    parts = list(machine.feed(word.encode()))
    assert len(parts) > 10 and max(map(len, parts)) <= bpe.BLOCK
    assert [t for p in parts for t in p] == library.encode_ordinary(word)


def test_the_last_byte_of_a_word_makes_no_state(library, ranks):
    """Words are kept whole, so what only ends a word would fill the table of states, which is then emptied and made again."""
    machine = bpe.Transducer(ranks)
    words = [f" thenininqz{c}" for c in "abcdefgh"]
    assert [machine.tokens(w.encode()) for w in words[:1]] == [library.encode_ordinary(words[0])]
    known = len(machine._states)
    assert [machine.tokens(w.encode()) for w in words] == [library.encode_ordinary(w) for w in words] and len(machine._states) == known


def test_small_tables_give_the_same_ids(monkeypatch, library):
    for name in ("MOST_STATES", "MOST_PIECES", "MOST_PAIRS"):
        monkeypatch.setattr(bpe, name, 5)
    coder = bpe.Encoder(bpe.default_vocabulary())
    for text in [*HARD, "the quick brown fox jumps over thirteen lazy dogs " * 3]:
        assert coder.encode(text) == packed(library.encode_ordinary(text))


def test_state_machine_decodes_any_bytes():
    rnd = random.Random(9)
    for _ in range(3000):
        data = bytes(rnd.choice([0x41, 0x7F, 0x80, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xA0, 0xED, 0x9F, 0xEF, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF]) for _ in range(rnd.randint(0, 12)))
        back = bpe.Decoder({b: bytes([b]) for b in range(256)})
        assert "".join(back.stream(np.frombuffer(data, np.uint8).astype("<u4"))) == data.decode("utf-8", "replace"), data


def test_round_trip_with_odd_rows(spark, library):
    texts = [None, *HARD, "word " * 60_000, "é" * 300_000, "same", "same"]
    df = spark.createDataFrame([(i if i % 5 else None, t, b"x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids binary, row string")
    found = bpe.round_trip(df).collect()
    want = sorted((packed(library.encode_ordinary(t or "")), t or "") for t in texts if t is None or len(t) < 200_000)
    assert sorted((bytes(r["ids"]), r["text"]) for r in found if len(r["text"]) < 200_000) == want
    assert sorted(r["text"] for r in found) == sorted(t or "" for t in texts)
    apart = bpe.decode(bpe.encode(df)).collect()
    assert sorted(r["text"] for r in apart) == sorted(t or "" for t in texts)
    assert bpe.round_trip(df.limit(0)).count() == bpe.decode(bpe.encode(df.limit(0))).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] == ""


def test_bpe_query_on_documents(spark, sf_dir, library):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op13_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
