from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.functions import lexical as L
from strata.operators import hybrid as H
from strata.operators import retrieval as R


@pytest.mark.parametrize(
    ("query", "name", "anywhere", "subject", "loose"),
    [
        ("F-16C range", "F-16C", True, True, True),
        ("range of the F-16C", "F-16C", True, False, True),
        ("the big tank", "Tank", True, False, True),
        ("tank", "Tank", True, True, True),
        ('a "Tank" of old', "Tank", True, True, True),
        ("thanks", "Tank", False, False, False),
        ("superleopards", "leopard", False, False, True),
        ("", "Tank", False, False, False),
    ],
)
def test_names_by_policy(spark, query, name, anywhere, subject, loose):
    assert (L.span_match(query, [name]), L.subject_match(query, [name]), L.loose_match(query, [name])) == (anywhere, subject, loose)
    asked = spark.createDataFrame([(1, query)], "query long, text string")
    names = spark.createDataFrame([(7, name), (7, None), (8, "")], "entity long, text string")
    for policy, wanted in ((0, loose), (1, anywhere), (2, subject), (3, subject)):
        assert [r.entity for r in H.named(asked, names, policy).collect()] == [7] * wanted


def _docs(spark):
    kind = "entity long, ordinal int, text string, evidence string"
    names = spark.createDataFrame([(1, 0, "Leopard", None), (1, 1, "Kampfpanzer", None), (2, 0, "Tiger", None), (3, 0, None, None)], kind)
    bodies = spark.createDataFrame([(1, 0, "prefix zebra\nradar on a mast", "e1"), (2, 0, "prefix\nradar on a mast", "e2"), (2, 1, "  ", "e3")], kind)
    captions = spark.createDataFrame([(2, 0, "radar on a mast", "e4")], kind)
    return H.lexical_documents(names, bodies, captions), names


def test_documents_and_the_best_of_each_entity(spark):
    docs, _ = _docs(spark)
    assert sorted((r.doc.place, r.entity, r.doc.ordinal, r.text) for r in docs.collect()) == [
        (0, 1, 0, "Leopard"), (0, 1, 1, "Kampfpanzer"), (0, 2, 0, "Tiger"), (1, 1, 0, "radar on a mast"), (1, 2, 0, "radar on a mast"), (2, 2, 0, "radar on a mast"),
    ]
    asked = spark.createDataFrame([(1, "radar"), (2, "zebra"), (3, "leoprad")], "query long, text string")
    best = {(r["query"], r.entity): r for r in H.best_documents(R.postings(docs), asked).collect()}
    # a prefix is no text; of equal documents the body comes before the caption; misspelt names count
    assert set(best) == {(1, 1), (1, 2), (3, 1)} and best[1, 2].hit.place == 1 and best[3, 1].typo


def test_one_ranking(spark):
    pool = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (2, 1, 0.5)], "query long, entity long, cosine double")
    hits = spark.createDataFrame([(1, 2, 5.0), (1, 9, 7.0)], "query long, entity long, bm25 double").withColumn("hit", F.lit("x"))
    none = spark.createDataFrame([], "query long, entity long")
    bonus = spark.createDataFrame([(1, 3, 0.5, "Mass: 3 kg")], "query long, entity long, bonus double, fact string")
    rows = H.pooled(pool, hits)
    old = {r.entity: r for r in H.leaders(H.search(rows, none, bonus, 2), 5).where("query = 1").collect()}
    assert [old[i].rank for i in (2, 1, 3)] == [1, 2, 3] and old[2].chosen == "lexical" and old[1].chosen == "semantic"
    assert old[2].score == pytest.approx(2 / 61 + 1 / 62, abs=1e-9)
    new = {r.entity: r for r in H.leaders(H.search(rows, none, bonus, 3), 5).where("query = 1").collect()}
    assert new[3].rank == 1 and new[3].score == pytest.approx(1 / 63 + 0.5, abs=1e-9) and new[3].chosen == "specification"
    # the bonus alone supports nothing: neither a name nor a term leads
    assert new[3].match_status == "no_supported_match" and old[2].match_status == "candidates"
    named = spark.createDataFrame([(2, 1)], "query long, entity long")
    lead = H.leaders(H.search(rows, named, None, 3), 1).where("query = 2").first()
    assert lead.score == pytest.approx(2.5) and lead.match_status == "candidates"


def test_marks_and_dashes():
    assert L.tokens("Ünïcödé — naïve") == ["unicode", "naive"] and L.tokens("F‐16 − 3") == ["f16", "3"]
