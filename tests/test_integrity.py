from __future__ import annotations

import base64

from pyspark.sql import functions as F

from strata.functions.urls import identity
from strata.operators import integrity as I

FACT = "struct<name:string,raw:string,evidence:string>"
PAGE = "struct<id:string,url:string,retrieved_at:string>"


def test_safe_names(spark):
    keys = {"a": True, "A.b_c-9": True, "9": True, "a" * 128: True, "a" * 129: False, "": False, ".a": False, "-a": False, "a/b": False, "a\n": False, "é": False, None: False}
    rows = spark.createDataFrame([(k, ok) for k, ok in keys.items()], "k string, ok boolean")
    assert rows.where(I.safe_key(F.col("k")) != F.col("ok")).count() == 0
    sources = {"web": True, "a_b-1": True, "-": True, "Web": False, "a.b": False, "": False, "a\n": False, None: False}
    rows = spark.createDataFrame([(k, ok) for k, ok in sources.items()], "k string, ok boolean")
    assert rows.where(I.safe_source(F.col("k")) != F.col("ok")).count() == 0


def test_member_names_follow_the_media_type(spark):
    kinds = [("text/html", "html"), ("\tTEXT/HTML ; charset=x", "html"), ("application/xhtml+xml", "html"), ("application/json", "json"), ("", "json"), (None, "json")]
    rows = spark.createDataFrame([("s", "https://a.b/", k, x) for k, x in kinds], "source string, url string, kind string, suffix string")
    want = F.concat(F.lit("responses/s/"), identity(F.col("url")), F.lit("."), "suffix")
    assert rows.where(I.member_name(F.col("source"), F.col("url"), F.col("kind")).eqNullSafe(want)).count() == len(kinds)


def test_page_bodies_are_text_or_base64_on_one_line(spark):
    raw = [b"", "é<p>".encode(), b"\xff" + b"a" * 500, b"\xed\xa0\x80", None]
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(raw)], "i int, b binary")
    found = {r.i: (r.p.html, r.p.html_base64) for r in rows.select("i", I.page_body(F.col("b")).alias("p")).collect()}
    code = lambda x: base64.b64encode(x).decode()
    assert found == {0: ("", None), 1: ("é<p>", None), 2: (None, code(raw[2])), 3: (None, code(raw[3])), 4: (None, None)}


def test_locators(spark):
    facts, pages = [("range", "10 km", "u1")], [("e1", "u1", "2020-01-01")]
    records = spark.createDataFrame([("x", facts, pages), ("y", None, None)], f"entity string, facts array<{FACT}>, evidence array<{PAGE}>")
    shot = (I.CAPTURED, "2020-01-01", "u1")
    rows = [
        ("x", "fact", 0, "e1", facts[0], "same"), ("x", "fact", 0, "e1", ("range", "11 km", "u1"), "differs"), ("x", "fact", 1, "e1", facts[0], "out_of_range"),
        ("x", "fact", -1, "e1", facts[0], "out_of_range"), ("x", "captured_at", 0, "e1", shot, "same"), ("x", "captured_at", 0, "e2", shot, "unrelated"),
        ("x", "captured_at", 0, "e1", facts[0], "differs"), ("x", "other", 0, "e1", facts[0], "differs"), ("x", "fact", 0, "e1", None, "differs"),
        ("y", "fact", 0, "e1", facts[0], "out_of_range"), ("z", "captured_at", 0, "e1", shot, "out_of_range"),
    ]
    claims = spark.createDataFrame(rows, f"entity string, kind string, index int, evidence string, raw {FACT}, want string")
    found = I.located(claims, records)
    assert found.count() == len(rows) and found.where("state <> want").count() == 0
    only = spark.createDataFrame([("x",), ("x",)], "entity string")
    assert {r.entity for r in I.located(claims, records, only).collect()} == {"x"}
    assert I.located(claims, records, only).count() == 9
    assert I.located(claims.limit(0), records).count() == 0


def test_response_faults(spark):
    entities = spark.createDataFrame([(1, "a"), (2, "b")], "entity long, source string")
    pages = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q")], "entity long, evidence string")
    asked = spark.createDataFrame([("m", None), ("n", "a")], "query string, source string")
    rows = [("m", 1, "a", "p"), ("m", 1, "a", ""), ("m", 2, "a", "q"), ("m", 3, "a", ""), ("n", 1, "a", "q"), ("n", 2, "b", None)]
    results = spark.createDataFrame(rows, "query string, entity long, source string, evidence string")
    found = sorted(tuple(r) for r in I.response_faults(results, asked, entities, pages).collect())
    assert found == [("m", 1, "duplicate"), ("m", 2, "source"), ("m", 3, "unknown"), ("n", 1, "evidence"), ("n", 2, "evidence"), ("n", 2, "leak")]
    assert I.response_faults(results.limit(0), asked, entities, pages).count() == 0
