from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strata.operators import entities as E
from strata.operators import evaluation as V
from strata.operators import media as M
from strata.operators import retrieval as R


def test_bm25_takes_terms_as_a_set_and_exact_over_fuzzy(spark):
    docs = spark.createDataFrame([(1, "leopard radar radar"), (2, "leoprad tank"), (3, "other thing here")], "doc int, text string")
    post = R.postings(docs)
    once, twice = (R.query_terms(spark.createDataFrame([(1, q)], "query int, text string")) for q in ("radar", "radar radar"))
    assert R.bm25(post, once).collect() == R.bm25(post, twice).collect()
    terms = R.query_terms(spark.createDataFrame([(1, "leopard")], "query int, text string"))
    hits = {r.doc: r for r in R.bm25(post, terms, R.spellings(terms, post), post).collect()}
    assert set(hits) == {1, 2} and not hits[1].typo and hits[2].typo and hits[2].terms == ["leoprad"]
    n, df, length, average = 3, 1, 3, 8 / 3
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * 1 / (1 + 1.2 * (0.25 + 0.75 * length / average))
    assert hits[1].score == pytest.approx(want)


def test_fusion_arithmetic(spark):
    semantic = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "query int, doc int, score double")
    lexical = spark.createDataFrame([(1, 2, 5.0), (1, 9, 9.0)], "query int, doc int, score double")
    found = {r.doc: r for r in R.fuse(semantic, lexical).collect()}
    assert found[2].score == pytest.approx(1 / 62 + 2 / 61, abs=1e-12) and 9 not in found and found[1].lexical_rank is None
    outer = {r.doc: r.score for r in R.fuse(semantic, lexical, w_l=1.0, outer=True).collect()}
    assert outer[9] == pytest.approx(1 / 61) and outer[2] == pytest.approx(2 / 62)
    named = R.with_name_override(R.fuse(semantic, lexical), F.col("doc") == 3).where("name_match").first()
    assert named.score == pytest.approx(2.7)


def test_pages_of_ties(spark):
    rows = spark.range(205).select(F.col("id"), F.lit(1.0).alias("score"))
    seen = [r.id for n in range(1, 5) for r in R.page(rows, n, 60, F.col("score").desc(), F.col("id")).orderBy("position").collect()]
    assert seen == list(range(205))
    last = R.page(rows, 4, 60, F.col("score").desc(), F.col("id")).first()
    assert last.total == 205 and not last.has_more and R.page(rows, 9, 60, F.col("id")).count() == 0
    with pytest.raises(ValueError):
        R.page(rows, 0, 10, F.col("id"))


def test_claims_and_one_claim_for_a_field(spark):
    facts = [("a", 0, "Range", "5 km", None, None), ("a", 1, "Range", "20 km", None, None), ("b", 0, "Range", "about 7 km", None, None), ("c", 0, "Range", "unknown", None, None),
             ("d", 0, "Range", "7 km | see note", None, None), ("e", 0, "Range", "7 km", None, "estimated"), ("f", 0, "Range", "7 km", None, "max")]
    rows = spark.createDataFrame(facts, "entity string, position int, name string, raw string, unit string, qualifier string")
    rules = spark.createDataFrame([("Range", "range")], "name string, field string")
    found = E.claims(rows, rules, {"range": "m"})
    assert {(r.entity, r.position): r.status for r in found.collect()} == {("a", 0): "known", ("a", 1): "known", ("b", 0): "approximate", ("c", 0): "unknown", ("d", 0): "unparsed", ("e", 0): "approximate", ("f", 0): "unparsed"}
    entities = rows.select("entity").distinct()
    ask = lambda *p: sorted(r.entity for r in E.where(entities, found, list(p), {"range": "m"}).collect())
    assert ask("range > 4 km") == ["a"] and ask("range > 6 km", "range < 10 km") == [] and ask("range != 5 km") == ["a"] and ask("range != 99 km") == ["a"]


def test_merge_reconcile_and_latest(spark):
    rows = spark.createDataFrame([("k", "t", "x", ["b"], ["1"]), ("k", "t", "x", ["a", "b"], ["2"]), ("m", "t", "x", [], []), ("m", "u", "x", [], [])], "key string, title string, kind string, aliases array<string>, categories array<string>")
    found = {r.key: r for r in E.merge_entities(rows).collect()}
    assert found["k"].aliases == ["a", "b"] and not found["k"].conflict and found["m"].conflict
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 1), (4, "z", 1)], "id int, s string, n int")
    assert {r.id: (r.state, r.fields) for r in E.reconcile(a, b, "id", ["s", "n"]).collect()} == {1: ("matched", []), 2: ("changed", ["s"]), 3: ("missing", []), 4: ("added", [])}
    assert [(r.id, r.s) for r in E.latest(a.unionByName(a.withColumn("s", F.lit("later")).where("id = 1")), "id", F.col("s")).orderBy("id").collect()][0] == (1, "x")


def test_cyclic_categories_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    paths = E.tree_paths(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted("/".join(r.path) for r in paths.collect()) == ["a", "a/b", "a/b/c"]


def test_near_duplicates_find_every_pair(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = base + [h ^ sum(1 << b for b in rng.sample(range(64), k)) for h in base for k in (1, 3, 5, 6)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    found = {(r.left, r.right) for r in M.near_duplicates(rows).collect()}
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if 0 < bin(hashes[i] ^ hashes[j]).count("1") <= 5}
    assert found == want


def test_families_and_budgets(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11)], "left long, right long")
    assert {r.node: r.family for r in M.families(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10}
    assert M.within_budget([("a", 5), ("b", 9), ("c", 4)], 10) == ["a", "c"]
    assert list(M.parts(iter([("a", 5), ("b", 6), ("c", 4), ("d", 1)]), 10)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_farthest_first(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (1, 4, [-1.0, 0.0]), (2, 7, [1.0, 0.0])], "e int, i int, v array<double>")
    assert sorted((r.e, r.turn, r.i) for r in M.farthest_first(rows, "e", "i", "v", 3).collect()) == [(1, 1, 1), (1, 2, 4), (1, 3, 3), (2, 1, 7)]


def test_metrics_and_gates(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, 30), (4, None)], "query int, rank int")
    m = V.metrics(ranks).first()
    assert (m.top1, m.recall5) == (0.25, 0.5) and m.mrr20 == pytest.approx((1 + 0.25) / 4)
    assert {r.gate: r.passed for r in V.gates(V.metrics(ranks), {"top1_min": 0.2, "top1_max": 0.2}).collect()} == {"top1_min": True, "top1_max": False}
    w = V.intervals(spark.createDataFrame([(0, 10)], "hits int, total int"), "hits", "total").first()
    assert w.low == pytest.approx(0, abs=1e-9) and w.high == pytest.approx(0.27753, abs=1e-4)


def test_fit_thresholds(spark):
    rows = [(True, i, 10) for i in range(50, 100)] + [(False, i, 10) for i in range(0, 52)]
    found = V.fit_thresholds(spark.createDataFrame(rows, "good boolean, a int, b int"), ["a", "b"], 0.05, 64)
    assert 45 <= found["a"] <= 52 and found["b"] == 10
