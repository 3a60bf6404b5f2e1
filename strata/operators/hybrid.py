"""Search for entities by names, texts, vectors and specifications in one ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import values
from strata.functions.lexical import key_of, spans_of, tokens_of
from strata.functions.urls import clamp
from strata.operators import retrieval as R

FIELDS = ("name", "body", "caption", "observation")


def lexical_documents(names: DataFrame, bodies: DataFrame, captions: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """(doc, entity, field, text, evidence) of frames with entity, ordinal, text, evidence.

    ``doc`` orders them: all names, then bodies (without their first line, the prefix), captions, observations;
    texts that are null or blank are no documents.
    """
    out = None
    for place, frame in enumerate(f for f in (names, bodies, captions, observations) if f is not None):
        text = F.regexp_replace("text", r"^[^\n]*\n", "") if FIELDS[place] == "body" else F.col("text")
        doc = F.struct(F.lit(place).alias("place"), F.col("entity").cast("long").alias("entity"), F.col("ordinal").cast("int").alias("ordinal"))
        rows = frame.select(doc.alias("doc"), F.col("entity").cast("long").alias("entity"), F.lit(FIELDS[place]).alias("field"), text.alias("text"), "evidence")
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.trim("text") != "")


def best_documents(post: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entity, bm25, hit, terms, typo): of each entity its best document, of equals the first."""
    terms, names = R.query_terms(queries), post.where("doc.place = 0")
    hits = R.bm25(post, terms, R.spellings(terms, names), names)
    best = F.min(F.struct((-F.round("score", 6)).alias("least"), F.col("doc").alias("hit"), "terms", "typo")).alias("b")
    return hits.groupBy("query", F.col("doc.entity").alias("entity")).agg(best).select("query", "entity", (-F.col("b.least")).alias("bm25"), "b.hit", "b.terms", "b.typo")


def named(queries: DataFrame, names: DataFrame, policy: int) -> DataFrame:
    """(query, entity) where a name is what the query asks for: the spans of a query meet the keys of names."""
    every, firm = spans_of(F.col("text"), policy)
    spans = queries.select("query", every.alias("every"), firm.alias("firm"))
    spans = spans.select("query", F.explode("every").alias("key"), F.lit(False).alias("only_firm")).unionByName(spans.select("query", F.explode("firm").alias("key"), F.lit(True).alias("only_firm")))
    words = names.select("entity", "text", tokens_of(F.col("text")).alias("words"))
    key = key_of(F.col("text") if policy == 0 else F.array_join("words", ""))
    keys = words.select("entity", key.alias("key"), F.size("words").alias("n")).where("key <> ''")
    is_firm = (F.col("n") > 1) | (F.col("key").rlike(r"\p{L}") & F.col("key").rlike(r"\p{Nd}"))
    return keys.join(R.small(spans), "key").where(~F.col("only_firm") | is_firm).select("query", "entity").distinct()


def specified(claims: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, entity, bonus, fact): each term of a query that a known claim of the same label, unit and bounds meets
    earns its share; ``fact`` is the first claim of the last such term.

    ``terms``: query, term, label, unit, low, high, n_terms; ``claims`` carry a label beside their columns.
    """
    v = F.col("number")
    same = (v["unit"] == F.col("spec_unit")) & v["min_inclusive"] & v["max_inclusive"] & (values.compare(v["min"], F.col("low")) == 0) & (values.compare(v["max"], F.col("high")) == 0)
    known = claims.where((F.col("status") == "known") & v.isNotNull()).select("entity", "position", "name", "raw", "number", "label")
    met = known.join(R.small(terms.withColumnRenamed("unit", "spec_unit")), "label").where(same)
    fact = F.max_by(F.concat_ws(": ", "name", "raw"), F.struct("term", -F.col("position")))
    return met.groupBy("query", "entity").agg((F.count_distinct("term") / F.first("n_terms")).alias("bonus"), fact.alias("fact"))


def pooled(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """The pool ``semantic`` (query, entity, cosine) with best documents and the sum of reciprocal ranks: alike for all policies."""
    rows = semantic.join(lexical, ["query", "entity"], "left").withColumnRenamed("entity", "doc")
    return R.fuse_scores(rows).withColumnRenamed("doc", "entity")


def search(rows: DataFrame, names: DataFrame, bonus: DataFrame | None = None, policy: int = 3) -> DataFrame:
    """Of a pool: entities that are named at 2 and their cosine, the others at their ranks and bonus.

    Policy 1 matches names anywhere in the query, 2 as its subject, 3 adds the bonus of specifications.
    ``chosen`` says what stands for an entity: a fact, its best document if that weighs as much as its vector, or that.
    """
    if policy >= 3 and bonus is not None:
        rows = rows.join(bonus, ["query", "entity"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    else:
        rows = rows.withColumn("bonus", F.lit(0.0)).withColumn("fact", F.lit(None).cast("string"))
    rows = rows.join(names.withColumn("name_match", F.lit(True)), ["query", "entity"], "left").withColumn("name_match", F.coalesce("name_match", F.lit(False)))
    share = lambda w, r: w / (R.RANK_CONSTANT + F.col(r))
    by_text = F.coalesce(share(R.LEXICAL_WEIGHT, "lexical_rank") >= share(R.SEMANTIC_WEIGHT, "semantic_rank"), F.lit(False))
    rows = rows.withColumn("chosen", F.when(F.col("fact").isNotNull(), "specification").when(by_text, "lexical").otherwise("semantic"))
    score = F.when(F.col("name_match"), 2 + clamp(F.col("cosine"))).otherwise(F.col("score") + F.col("bonus"))
    return rows.withColumn("score", F.round(score, 9))


def leaders(rows: DataFrame, k: int) -> DataFrame:
    """The first k entities of each query with their rank and the query's match_status, which its first one decides."""
    top = R.top(rows, k, "query", F.col("name_match").desc(), F.col("score").desc(), F.col("entity"))
    first = F.first(F.col("name_match") | F.col("lexical_rank").isNotNull()).over(Window.partitionBy("query").orderBy("rank"))
    return top.withColumn("match_status", F.when(first, "candidates").otherwise("no_supported_match"))
