from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strata.functions import vectors
from strata.operators import observations as O


def test_half_vectors(spark):
    rows = spark.createDataFrame([(1, [0.6, 0.8]), (2, [2.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "i int, v array<double>")
    found = {r.i: r.w for r in rows.select("i", vectors.unpack_half(vectors.pack_half(F.col("v"))).alias("w")).collect()}
    assert abs(np.linalg.norm(found[1]) - 1) < 1e-6 and abs(found[1][0] - 0.6) < 1e-3 and found[2] is None and found[3] is None and found[4] is None


def test_encoder(spark):
    rows = spark.createDataFrame([(1, "red radar"), (2, "radar red"), (3, "tank"), (4, None)], "i int, t string")
    found = {r.i: r.v for r in rows.select("i", vectors.encoded(F.col("t"), vectors.hashing_encoder(32), 2).alias("v")).collect()}
    assert found[1] == found[2] != found[3] and found[4] is None and abs(np.linalg.norm(found[3]) - 1) < 1e-6
    pooled = vectors.mean_pooled(np.ones((1, 3, 4)), np.array([[1, 1, 0]]))
    assert np.allclose(pooled, 0.5)


def test_images():
    flat = np.full((10, 20, 4), 255, np.uint8)
    assert np.allclose(vectors.resized(flat, 8, 6, (0.5,) * 3, (0.5,) * 3), 1.0) and vectors.resized(flat, 8, 6, (0.5,) * 3, (0.5,) * 3).shape == (3, 6, 6)
    assert vectors.difference_hash(np.tile(np.arange(9), (8, 1))) == 0 and vectors.difference_hash(np.tile(np.arange(9)[::-1], (8, 1))) == (1 << 64) - 1


def test_strict_json(spark):
    rows = ['{"a":1,"b":{"c":2}}', '{"a":1}', '{"a":1,"b":2,"c":3}', '{"a":null,"b":1}', '{"a":1,"a":2,"b":1}', '{"a":1,"b":{"c":1,"c":2}}', "[]", "x", None]
    found = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", vectors.strict_json(F.col("t"), ("a", "b")).alias("ok")).orderBy("i")
    assert [r.ok for r in found.collect()] == [True] + [False] * 8
    assert vectors.framed({"b": [1, "x"], "a": None}) == vectors.framed({"a": None, "b": [1.0, "x"]}) != vectors.framed({"a": None, "b": [1, "y"]})


def test_register_and_captions(spark):
    rows = [
        ("m", "pending", "e", "v", "c", True, None), ("m", "saved", "e", "v", "c", True, None), ("n", "failed", "e", "v", None, True, None), ("n", "excluded", "f", "v", " ", False, "icon"),
        ("o", "excluded", "e", "v", "c", True, "icon"), ("o", "excluded", "e", "w", "c", True, None), ("p", "pending", "e", "v", "c", True, "small"), ("p", "pending", "e", "w", "c", False, "icon"),
        ("q", "pending", None, None, None, False, None), ("r", "pending", "e", "v", "c", False, None),
    ]
    rows = spark.createDataFrame(rows, "id string, state string, entity string, evidence string, caption string, associated boolean, exclusion string")
    found = {r.id: r for r in O.registered(rows).collect()}
    assert {k: r.state for k, r in found.items()} == {"m": "saved", "n": "failed", "o": "pending", "p": "excluded", "q": "unassociated", "r": "pending"}
    assert len(found["m"].references) == 1 and len(found["n"].references) == 2 and found["q"].references == [] and found["p"].error == "icon; small"
    refs = spark.createDataFrame([("e", "v", "A  b", "z"), ("e", "v", "A b", "y"), ("e", "v", " ", "x")], "entity string, evidence string, caption string, media string")
    assert [tuple(r) for r in O.captions(refs).collect()] == [("e", "v", "A b", "y")]


def test_eligible_references(spark):
    kind = "references array<struct<evidence:string,caption:string>>, occurrences array<struct<evidence:string,caption:string,layout:boolean>>"
    rows = spark.createDataFrame([([("v", "c"), ("v", "d"), ("w", None)], [("v", "c", False), ("w", None, True)])], kind)
    assert [tuple(r) for r in rows.select(O.eligible(F.col("references"), F.col("occurrences"))).first()[0]] == [("v", "c")]


def test_outcomes_and_regions(spark):
    media = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "media string, selected boolean")
    seen, bad = (spark.createDataFrame([x], "media string, kind string") for x in (("a", "ocr"), ("b", "ocr")))
    found = {(r.media, r.kind): r.state for r in O.outcomes(media, seen, bad, ("ocr", "text")).collect()}
    assert found == {("a", "ocr"): "observed", ("a", "text"): "empty", ("b", "ocr"): "failed", ("b", "text"): "empty", ("c", "ocr"): "selection", ("c", "text"): "selection"}
    rows = spark.createDataFrame([([(" x ", 0.9, [[5.0, 20.0]]), ("y", 0.1, [[0.0, 0.0]])],)], "r array<struct<text:string,confidence:double,polygon:array<array<double>>>>")
    got = rows.select(O.read_regions(F.col("r"), F.lit(10.0), F.lit(10.0), 0.5).alias("r")).select("r", O.region_text(F.col("r")).alias("t")).first()
    assert got.r[0].polygon == [[0.5, 1.0]] and got.t == "x"


def test_relations(spark):
    quote = lambda e, q: (e, f"v{e}", q)
    rows = [("b", "a", "equivalent", [quote("a", "one"), quote("b", "two")]), ("a", "b", "equivalent", [quote("a", "one"), quote("b", "two")]), ("a", "b", "variant_of", [quote("a", "one")]), ("a", "b", "component_of", [quote("a", "one"), quote("b", "absent")])]
    reviewed = spark.createDataFrame(rows, "source string, target string, type string, quotes array<struct<entity:string,evidence:string,quote:string>>")
    pages = spark.createDataFrame([("va", "page one"), ("vb", "page two")], "evidence string, markdown string")
    good, bad = O.relations(reviewed, pages)
    assert [tuple(r) for r in good.collect()] == [("a", "b", "equivalent")] and sorted(r.type for r in bad.collect()) == ["component_of", "variant_of"]
