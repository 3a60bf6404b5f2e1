"""Entities, claims, relations and the comparisons between snapshots of them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import values


def union_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The sorted distinct names of each target."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(name)).alias("names"))


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity a key; conflict where key's rows disagree on title or kind.

    Aliases and categories are united and sorted.  rows: key, title, kind, aliases, categories.
    """
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("key").agg(
        F.min("title").alias("title"), F.min("kind").alias("kind"), (F.min(F.struct("title", "kind")) != F.max(F.struct("title", "kind"))).alias("conflict"),
        flat("aliases").alias("aliases"), flat("categories").alias("categories"), F.count("*").alias("n"),
    )


def consistent(rows: DataFrame, by: str, *content: str) -> DataFrame:
    """Keys whose rows do not all have the same content."""
    return rows.groupBy(by).agg(F.count_distinct(F.struct(*content)).alias("versions")).where("versions > 1")


def claims(facts: DataFrame, rules: DataFrame, units: dict[str, str]) -> DataFrame:
    """Typed claims from facts (entity, position, name, raw, unit, qualifier) whose name a rule maps to a field.

    units: field to 'text', 'date' or a canonical unit.  A claim that cannot be
    parsed keeps its raw value with status unparsed.
    """
    rows = facts.join(F.broadcast(rules), "name")
    status, raw = values.status_of(F.col("raw"), F.col("qualifier"))
    rows = rows.withColumn("status", status).withColumn("plain", raw)
    kinds = F.try_element_at(F.from_json(F.lit(json.dumps(units)), "map<string,string>"), F.col("field"))
    rows = rows.withColumn("kind", kinds)
    known = F.col("status").isin("known", "approximate")
    odd = F.coalesce(F.lower("qualifier"), F.lit("")).isin("", "value", "range") | (F.col("status") == "approximate")
    # a quantity is parsed once, whatever units there are, and then asked for its field's
    found = values.interval_of(values.quantity(F.col("plain"), F.col("unit")), F.col("kind"), F.col("field").isin(*values.UNITS_AT_BOTH_ENDS))
    rows = rows.withColumn("number", F.when(known & odd & ~F.col("kind").isin("text", "date"), found))
    rows = rows.withColumn("date", F.when(known & (F.col("kind") == "date"), values.dates_of(F.col("plain"))))
    rows = rows.withColumn("text", F.when(known & (F.col("kind") == "text"), F.trim(F.regexp_replace("plain", r"\s+", " "))))
    parsed = F.col("number").isNotNull() | F.col("date").isNotNull() | F.col("text").isNotNull()
    rows = rows.withColumn("status", F.when(F.col("status") == "unknown", "unknown").when(parsed, F.col("status")).otherwise("unparsed"))
    claim = F.substr(F.sha2(F.concat_ws("\n", "entity", "field", F.col("position").cast("string"), "raw"), 256), F.lit(1), F.lit(24))
    return rows.withColumn("claim", claim).select("claim", "entity", "field", "position", "name", "raw", "status", "text", "number", "date")


def where(entities: DataFrame, found: DataFrame, expressions: list[str], kinds: dict[str, str]) -> DataFrame:
    """Entities that satisfy every expression: of each field one known claim has to satisfy all of its expressions."""
    if len(expressions) > 32:
        raise ValueError("at most 32 predicates")
    by_field: dict[str, list[Column]] = {}
    for e in expressions:
        field, condition = values.predicate(e, kinds)
        by_field.setdefault(field, []).append(condition)
    # one pass over the claims of these fields, and one row an entity: a field holds if one of its claims does
    met = [(F.col("field") == field) & reduce(lambda a, b: a & b, conditions) for field, conditions in by_field.items()]
    claimed = found.where((F.col("status") == "known") & F.col("field").isin(*by_field))
    good = claimed.groupBy("entity").agg(*[F.bool_or(F.coalesce(m, F.lit(False))).alias(f"f{i}") for i, m in enumerate(met)])
    good = good.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") for i in range(len(met))], F.lit(True))).select("entity")
    return entities.join(good, "entity", "left_semi") if met else entities


def compare(entities: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """Entity by field grid, a list of claims in each cell (empty where there are none)."""
    cells = found.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.struct("claim", "raw", "status"))).alias("claims"))
    grid = entities.crossJoin(F.broadcast(fields)).join(cells, ["entity", "field"], "left")
    return grid.withColumn("claims", F.coalesce("claims", F.array().cast(cells.schema["claims"].dataType)))


def relations_of(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges that leave or enter each node: a union of two equi-joins."""
    edges = edges if kind is None else edges.where(F.col("type") == kind)
    out = edges.join(nodes.select(F.col("node").alias("source")), "source").select(F.col("source").alias("node"), F.col("target").alias("other"), "type", F.lit("out").alias("direction"))
    into = edges.where("source <> target").join(nodes.select(F.col("node").alias("target")), "target").select(F.col("target").alias("node"), F.col("source").alias("other"), "type", F.lit("in").alias("direction"))
    return out.unionByName(into)


def reconcile(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """matched, changed (with the fields), missing or added for every key."""
    a = before.select(key, F.struct(*fields).alias("a"))
    b = after.select(key, F.struct(*fields).alias("b"))
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.size(changed) > 0, "changed").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), F.when(state == "changed", changed).otherwise(F.array().cast("array<string>")).alias("fields"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """What only one side has: side, and the columns."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def latest(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The last state of each key: an aggregate, not a window, so no key gathers its rows."""
    others = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(by, "r.*")


def first_occurrence(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first come."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def tree_paths(edges: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """(root, node, depth, path) of a category graph by repeated joins; a node already on the path is not entered again."""
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    whole = level
    steps = edges.select(F.col("parent").alias("node"), "child")
    for d in range(1, depth + 1):
        level = level.join(steps, "node").where(~F.array_contains("path", F.col("child"))).select("root", F.col("child").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("child")).alias("path")).checkpoint()
        if level.isEmpty():
            break
        whole = whole.unionByName(level)
    return whole


def fair_order(rows: DataFrame, source: str, *order: Column) -> DataFrame:
    """Round robin over sources: each one's first, then each one's second."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
