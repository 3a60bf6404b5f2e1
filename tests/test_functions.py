from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.functions import lexical, urls, values


def column(spark, rows, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")


def results(rows, expression):
    return [r.y for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("F-16C", ["f16c"]), ("100-200", ["100", "200"]), ("Größe", ["große"]), ("3.5 a.b 1.", ["3.5", "a", "b", "1"]), ("AN/SPY-1", ["an", "spy1"]),
        ("x—5", ["x5"]), ("5−x", ["5x"]), ("a--1", ["a", "1"]), ("a - 1", ["a", "1"]), ("snake_case", ["snake", "case"]), ("", []), (None, []),
    ],
)
def test_tokens(text, want):
    assert lexical.tokens(text) == want


@pytest.mark.parametrize(
    ("query", "name", "want"),
    [
        ("leopard", "Leopard", True), ("the leopard", "Leopard", False), ("Leopard 2 tank", "Leopard 2", True), ("a Leopard 2 tank", "Leopard 2", True),
        ("about the Leopard 2", "Leopard 2", False), ('about "Leopard"', "Leopard", True), ('all about "Leopard"', "Leopard", False), ("", "Leopard", False),
        ("“Leopard” tank", "Leopard", True), ("F-16 engine", "F-16", True), ("F-16C engine", "F-16", False), ("radar", "", False),
    ],
)
def test_subject_match(query, name, want):
    assert lexical.subject_match(query, [name]) is want


def test_subjects_among_several_names():
    assert lexical.subject_match("f-16 or leopard", ["leopard", "F 16"]) and lexical.subject_match("x «Leopard»", ["other", "leopard"])
    assert not lexical.subject_match("leopard tank", ["leopard", ""]) and not lexical.subject_match('"" tank', [""]) and lexical.subject_match('the “a" «Leopard»', ["leopard"]) is False
    assert lexical.subject_match('"no" "leopard"', ["leopard"])


def test_older_matches():
    assert lexical.span_match("the leopard 2 tank", ["Leopard 2"])
    assert not lexical.span_match("leopard 2a4", ["Leopard 2"])
    assert lexical.loose_match("see leopards", ["leopard"]) and not lexical.loose_match("cats", ["cat"])


def test_one_edit(spark):
    pairs = [("leopard", "leoprad", True), ("leopard", "leopards", True), ("abc", "acb", True), ("abc", "cba", False), ("a", "b", True), ("same", "same", True), ("ab", "", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert rows.where(lexical.one_edit(F.col("a"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize(
    ("raw", "unit", "want"),
    [
        ("12 km", "m", (12000.0, 12000.0, True, True)), ("up to 12 km", "m", (None, 12000.0, False, True)), ("more than 2 t", "kg", (2000.0, None, False, False)),
        ("at least 3 kW", "W", (3000.0, None, True, False)), ("1,200 m", "m", (1200.0, 1200.0, True, True)), ("3 - 5 km", "m", (3000.0, 5000.0, True, True)),
        ("5 to 7 MHz", "Hz", (5e6, 7e6, True, True)), ("10 MW", "W", (1e7, 1e7, True, True)), ("10 mw", "W", None), ("10 MHZ", "Hz", None), ("5 apples", "count", None),
        ("7", "count", (7.0, 7.0, True, True)), ("7.5", "count", None), ("5 - 3 m", "m", None), ("<5 - 6 m", "m", None), ("5 kg", "m", None), ("", "m", None), ("≤ 4 kg", "kg", (None, 4.0, False, True)),
    ],
)
def test_numbers(spark, raw, unit, want):
    found = results(column(spark, [raw]), values.number_of(F.col("x"), unit))[0]
    assert (None if found is None else tuple(found)[:4]) == want


@pytest.mark.parametrize(
    ("raw", "unit", "both", "want"),
    [
        ("10 kHz - 2 MHz", "Hz", True, (1e4, 2e6)), ("10 kHz - 2 MHz", "Hz", False, None), ("10 - 20 kHz", "Hz", True, (1e4, 2e4)), ("2 MHz - 10 kHz", "Hz", True, None),
        ("5 m - 2 MHz", "Hz", True, None), ("3 ㎞", "m", False, (3000.0, 3000.0)), ("５ km", "m", False, (5000.0, 5000.0)), ("1\u202f000 m", "m", False, None), ("12\u00a0km", "m", False, (12000.0, 12000.0)),
        ("1,20 m", "m", False, None), ("1,200,300 m", "m", False, (1200300.0, 1200300.0)), ("1.5e3 m", "m", False, (1500.0, 1500.0)), ("-5 m", "m", False, None), ("5 m 3", "m", False, None),
        ("3…5 km", "m", False, (3000.0, 5000.0)), ("3...5 km", "m", False, (3000.0, 5000.0)), ("up to", "m", False, None), ("up to5 m", "m", False, None), (".5 m", "m", False, (0.5, 0.5)), ("3 − 5 km", "m", False, (3000.0, 5000.0)),
    ],
)
def test_quantities(spark, raw, unit, both, want):
    found = results(column(spark, [raw]), values.number_of(F.col("x"), unit, both_units=both))[0]
    assert (None if found is None else (found["min"], found["max"])) == want


def test_unit_hint(spark):
    rows = column(spark, ["5", "5 km", "5 m"])
    assert [r and r["min"] for r in results(rows, values.number_of(F.col("x"), "m", F.lit("km")))] == [5000.0, 5000.0, None]


def test_dates(spark):
    rows = column(spark, ["1999", "1999-02", "2024-02-29", "2023-02-29", "March 5, 2001", "2001-03-05T10:11:12", "Foo 3, 2001", "2024-13", "x"])
    found = [r and (str(r["min"]), str(r["max"]), r["precision"]) for r in results(rows, values.dates_of(F.col("x")))]
    assert found == [
        ("1999-01-01", "1999-12-31", "year"), ("1999-02-01", "1999-02-28", "month"), ("2024-02-29", "2024-02-29", "day"), None,
        ("2001-03-05", "2001-03-05", "day"), ("2001-03-05", "2001-03-05", "day"), None, None, None,
    ]


def test_number_predicates(spark):
    cases = [((None, 5.0, False, True), "<=", 5, True), ((None, 5.0, False, True), "<", 5, False), ((None, 5.0, False, True), ">", 1, False), ((5.0, None, False, False), ">", 5, True),
             ((5.0, 5.0, True, True), "=", 5 + 1e-10, True), ((4.0, 5.0, True, True), "!=", 4.5, False), ((4.0, 5.0, True, True), "!=", 6, True), ((4.0, 5.0, True, False), "!=", 5, True), (None, "!=", 5, False)]
    for value, op, x, want in cases:
        row = spark.createDataFrame([(value and (*value, "m"),)], f"number {values.INTERVAL}")
        assert (row.where(values.number_condition(op, x)).count() == 1) is want, (value, op, x)


def test_predicate_errors():
    for bad in ("power ~ 5 kW", "weight = 5 kg", "power = 5 kg", "name < x", "power = "):
        with pytest.raises(ValueError):
            values.predicate(bad, {"power": "W", "name": "text"})


def test_specifications():
    found = values.specifications("Range: 12 km; power: 3 - 5 kW\nbad; x: y; Range: 12000 m; mass: 5 - 3 kg")
    assert [f[:4] for f in found] == [("range", "m", 12000.0, 12000.0), ("power", "W", 3000.0, 5000.0)]


def test_urls(spark):
    rows = column(spark, ["http://Ex.com:80/a//b?utm_source=x&k=1#t", "https://u@x.com/", "https://x.com/a/../b", "https://x.org", "ftp://x.org/", None])
    assert results(rows, urls.normal(F.col("x"))) == ["https://ex.com/a/b", None, None, "https://x.org/", None, None]
    assert results(rows, urls.without_tracking(F.col("x")))[0] == "http://Ex.com:80/a//b?k=1"
    assert results(rows, urls.origin(F.col("x")))[:4] == ["http://ex.com:80", None, "https://x.com:443", "https://x.org:443"]


def test_plain_text_and_vectors(spark):
    rows = column(spark, ["# A [b](http://x) <i>c</i> https://y.z  d|e"])
    assert results(rows, urls.plain_text(F.col("x"))) == ["A b c d e"]
    v = column(spark, [[0.6, 0.8], [1.0, 1.0], [float("nan"), 0.0]], "array<double>")
    assert results(v, urls.is_unit(F.col("x"))) == [True, False, False]
    square = column(spark, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]], "array<array<double>>")
    assert results(square, urls.polygon_area(F.col("x"))) == [4.0]
