"""Search, cover tree and URL lists against brute force, and the pipeline end to end."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from dayfield.llm import ann, covertree, url_filter


def vectors(seed: int, n: int = 400, dim: int = 16) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    x = centres[draw.integers(0, 12, n)] + draw.normal(size=(n, dim)) * draw.choice([0.02, 0.3, 1.0], size=(n, 1))
    x[n // 8 : n // 6] = x[n // 8]
    return x.astype(np.float32)


BAD = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 15 + [None]]


def frame(spark, x: np.ndarray):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(10_000 + i, v) for i, v in enumerate(BAD)] + [(20_000, [1.0, 2.0]), (20_001, [1.0, 2.1]), (None, [1.0] * 16), (3, [float(v) for v in x[3]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "0 as rank")


def test_search_recall_scores_and_edge_cases(spark):
    x = vectors(1)
    valid = ann.valid_vectors(frame(spark, x))
    got = ann.search(valid, valid.where("vec_id % 20 = 0"), 10).collect()
    by_query: dict = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == {*range(0, 400, 20), 20_000}
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        rows = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11)) and q not in [r["vec_id"] for r in rows]
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in rows)
        assert rows == sorted(rows, key=lambda r: (r["score"], r["vec_id"]))
        hits += len({r["vec_id"] for r in rows} & set(best.tolist()))
    assert hits / 200 >= 0.9
    assert [(r["vec_id"], round(r["score"], 6)) for r in by_query[20_000]] == [(20_001, 0.1)]
    assert ann.search(valid.limit(0), valid.limit(0), 10).count() == 0


def test_few_probes_fall_back_to_all_rows(spark):
    x = vectors(2, 60)
    valid = ann.valid_vectors(frame(spark, x)).where("vec_id < 60")
    got = ann.search(valid, valid.where("vec_id % 20 = 0"), 10, ann.Index(tables=1, k=6, width=0.05, probes=1)).collect()
    assert len(got) == 30
    for q in (0, 20, 40):
        d = ann.distances(np.repeat(x[q][None], 60, axis=0), x)
        d[q] = np.inf
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.lexsort((np.arange(60), d))[:10].tolist()


def test_hot_keys_are_split_without_losing_pairs(spark):
    rows = spark.range(300).selectExpr("id % 3 * (id % 2) as key", "id as vec_id", "array(1f) as vec")
    probes = spark.range(90).selectExpr("id % 4 as key", "1000 + id as vec_id", "array(1f) as vec")
    pair = lambda a, b: {(r[0], r[1]) for r in a.join(b.withColumnRenamed("vec_id", "q"), "key").select("vec_id", "q").collect()}
    r, p = ann._split_hot(rows, probes, 20)
    assert pair(r, p) == pair(rows, probes)
    assert r.groupBy("key").count().agg(F.max("count")).first()[0] < 60


def test_probes_start_with_the_own_bucket():
    index = ann.Index(tables=3, k=4, probes=20)
    x = vectors(3, 20)
    keys, probes = index.keys(x), index.probe_keys(x)
    assert (probes.reshape(20, 3, 20)[:, :, 0] == keys).all()


def brute_components(x: np.ndarray, threshold: float):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[linked[i]].min() if linked[i].any() else i) for i in range(len(x))])
        if (new == label).all():
            return linked.sum(axis=1), label
        label = new


def test_cover_tree_matches_brute_force(spark):
    for seed, node_rows, block in ((4, 4096, 8192), (5, 37, 23)):
        x = vectors(seed)
        covertree.CHILDREN = 64 if node_rows > 100 else 3  # lists of children in many pieces
        got = {r["vec_id"]: r for r in covertree.near_duplicates(frame(spark, x), 0.9, node_rows=node_rows, block=block).collect()}
        covertree.CHILDREN = 64
        count, label = brute_components(x, 0.9)
        assert [got[i]["n_links"] for i in range(400)] == count.tolist()
        assert [got[i]["component_id"] for i in range(400)] == label.tolist()
        assert all(got[i]["kept"] == (label[i] == i) for i in range(400))
        assert all(got[10_000 + i]["n_links"] == 0 and got[10_000 + i]["component_id"] == 10_000 + i and got[10_000 + i]["kept"] for i in range(len(BAD)))
        assert got[20_001]["component_id"] == 20_000 and got[20_000]["n_links"] == 1
        assert got[None]["n_links"] == 0 and not got[None]["kept"] and len(got) == 400 + len(BAD) + 3
    assert covertree.near_duplicates(frame(spark, x).limit(0)).count() == 0


def test_tree_levels_and_traversal(spark):
    draw = np.random.default_rng(6)
    x = (draw.normal(size=(40, 32))[draw.integers(0, 40, 1500)] + 0.1 * draw.normal(size=(1500, 32))).astype(np.float32)
    reach = math.sqrt(0.2)
    classes = ann.valid_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).selectExpr("vec_id as class", "vec", "1L as w")
    rows, nodes = covertree.build(classes, reach, node_rows=100)
    leaf = {r["class"]: r["node"] for r in rows.select("class", "node").collect()}
    assert sorted(leaf) == list(range(1500))
    unit, by_name = covertree._unit(x), {r["node"]: r for r in nodes.collect()}
    for i, name in leaf.items():
        while name:
            r = by_name[name]
            assert r["centre"] is None or np.linalg.norm(unit[i] - np.array(r["centre"])) <= r["cover"] + 1e-9 <= r["radius"] + 2e-9
            assert not r["parent"] or by_name[r["parent"]]["radius"] in (r["radius"], 2 * r["radius"])
            name = r["parent"]
    found, figures = covertree.traverse(nodes, reach)
    alive = {(r["i"], r["j"]) for r in found.collect()}
    alive |= {(j, i) for i, j in alive}
    assert all((leaf[i], leaf[j]) in alive for i, j in np.argwhere(unit @ unit.T >= 0.9).tolist())
    assert figures and sum(kept for _, kept in figures) < 0.2 * sum(tested for tested, _ in figures)


def test_lists_over_time(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = [
        ("l1", "block", "example.com", "add", day(5), 1), ("l1", "block", "example.com", "remove", day(10), 2),
        ("l2", "allow", "good.example.com", "add", day(1), 1), ("l3", "block", "good.example.com/bad", "add", day(7), 1),
        ("l1", "block", "same.org", "add", day(3), 1), ("l1", "block", "same.org", "remove", day(3), 2), ("l1", "block", None, "add", day(1), 1), ("l1", "block", "x.net", "add", None, 1),
    ]
    captures = [
        (1, "http://EXAMPLE.com/a", day(4)), (2, "http://example.com/a", day(5)), (3, "https://www.example.com:8080/a?b", day(9)), (4, "http://example.com/a", day(10)),
        (5, "http://good.example.com/x", day(6)), (6, "http://good.example.com/bad/x", day(8)), (7, "http://same.org/", day(4)), (8, None, day(6)), (9, "not a url", day(6)),
        (10, "http://example.com/a", None), (11, "http://notexample.com/", day(6)), (2, "http://example.com/a", day(5)), (12, "http://x.net/", day(6)),
    ]
    e = spark.createDataFrame(entries, "list string, action string, key string, op string, at date, seq int")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date").selectExpr("*", "1 as n_active", "'z' as action")
    got = url_filter.apply_lists(c, e)
    rows = {r["page_id"]: (r["verdict"], r["list"], r["n_active"]) for r in got.collect()}
    assert got.count() == len(captures)
    assert rows == {1: ("keep", None, 0), 2: ("block", "l1", 1), 3: ("block", "l1", 1), 4: ("keep", None, 0), 5: ("allow", "l2", 2), 6: ("block", "l3", 3), 7: ("keep", None, 0), 8: ("keep", None, 0), 9: ("keep", None, 0), 10: ("keep", None, 0), 11: ("keep", None, 0), 12: ("keep", None, 0)}
    assert url_filter.apply_lists(c.limit(0), e).count() == 0 and url_filter.apply_lists(c, e.limit(0)).where("verdict <> 'keep'").count() == 0


def test_hosts_behind_user_names_ports_and_brackets(spark):
    cases = {
        "http://user:pw@bad.com/x": ["bad.com/x", "bad.com"], "http://a@b@Bad.com.:8080": ["bad.com"], "http://[2001:DB8::1]:80/z": ["[2001:db8::1]/z", "[2001:db8::1]"],
        "http://a.bad.com\\@good.com": ["a.bad.com/@good.com", "a.bad.com", "bad.com"], "http://1.2.3.4/a/b": ["1.2.3.4/a", "1.2.3.4"], "https://x.y.z?q=/no": ["x.y.z", "y.z"], "http://": None, "mailto:x@y.z": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url_filter.keys_of(F.col("url")).alias("k")).collect()
    assert {r["url"]: r["k"] and [k["key"] for k in r["k"]] for r in rows} == cases


def test_pipeline_stages_and_columns(spark):
    import corpus_pipeline
    from dayfield.llm.common import written

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scan", "entropy_mix", "bin_slack_packing"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, sf_dir), name)
        assert sorted(at.columns) == sorted(docs.columns)
        seen[name] = [r["doc_id"] for r in at.select("doc_id").collect()]
    good = {i for i, q in labels.items() if q == 1}
    bad = {i for i, q in labels.items() if q == 0}
    assert good & {r["doc_id"] for r in docs.select("doc_id").collect()} <= set(seen["quality_classifier"])
    assert len(bad & set(seen["quality_classifier"])) <= 0.05 * len(bad)
    assert len(set(seen["simhash_near_dedup"])) == len(seen["simhash_near_dedup"]) and set(seen["secret_scan"]) == set(seen["simhash_near_dedup"])
    out = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(seen["entropy_mix"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Null and empty texts, a very long one, repeated rows, null ids and sources, and clashing column names in every stage."""
    import corpus_pipeline
    from dayfield.llm.common import written

    plain = "a plain document with enough ordinary words to be read by every stage of this pipeline, number "
    rows = [(i, plain + " ".join(f"w{i}n{k}" for k in range(30)), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(3, rows[3][1], "en", "s0", 1)] * 3 + [(30, None, None, None, None), (31, "", "en", "s1", 0), (None, plain + "without an id", "en", None, 2), (32, "long words here " * 60_000 + " " * 200_000 + "token=abcdefgh1234", "en", "s2", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as _h", "'k' as row", "2 as base", "3 as _id", "4 as taken", "5 as keep", "6 as component")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, "/root/testdata/sf0.001"), name)
        assert at.columns == docs.columns
        assert at.selectExpr("max(_h)", "max(row)", "max(base)", "max(_id)", "max(taken)", "max(component)").first() == (1, "k", 2, 3, 4, 6) or not at.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").selectExpr("sum(length)").first()[0] > 100_000
