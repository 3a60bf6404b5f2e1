"""Media registers, captions that count, generated observations and reviewed relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relation types, and those that have no direction.
RELATIONS = ("equivalent", "related_system", "variant_of", "family_member_of", "component_of")
SYMMETRIC = ("equivalent", "related_system")


def registered(candidates: DataFrame) -> DataFrame:
    """One record a medium: references united, and the state that its occurrences leave.

    candidates: id, state (saved, failed, pending, excluded, unassociated), entity, evidence, caption, and of each
    occurrence associated (whether it belongs to its entity) and exclusion (a reason, or null).  What is saved stays
    saved.  An occurrence that belongs and is not excluded makes a medium wait, unless it has failed; without one,
    a reason excludes it; without reason or reference it is unassociated.
    """
    has = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
    good = F.coalesce(F.bool_or(F.col("associated") & F.col("exclusion").isNull()), F.lit(False))
    reasons, references = F.count("exclusion"), F.count("entity")
    waiting = F.when(has("failed"), "failed").otherwise("pending")
    state = (
        F.when(has("saved"), "saved").when(good, waiting).when(reasons > 0, "excluded").when(references == 0, "unassociated")
        .when(has("failed") | has("pending"), waiting).when(has("excluded"), "excluded").otherwise("unassociated")
    )
    united = F.array_sort(F.collect_set(F.when(F.col("entity").isNotNull(), F.struct("entity", "evidence", "caption"))))
    return candidates.groupBy("id").agg(state.alias("state"), united.alias("references"), F.array_join(F.array_sort(F.collect_set("exclusion")), "; ").alias("error"))


def eligible(references: Column, occurrences: Column) -> Column:
    """The references that an occurrence on the page supports: same evidence and caption, none of it layout."""
    return F.filter(references, lambda r: F.exists(occurrences, lambda o: (o["evidence"] == r["evidence"]) & o["caption"].eqNullSafe(r["caption"])) & F.forall(occurrences, lambda o: (o["evidence"] != r["evidence"]) | ~o["layout"]))


def page_owners(entities: DataFrame, page: str) -> DataFrame:
    """(entity, evidence) pairs whose evidence was captured from the page; entities: entity, evidence array<struct<id,url>>."""
    return entities.select("entity", F.explode("evidence").alias("e")).where(F.col("e.url") == page).select("entity", F.col("e.id").alias("evidence")).distinct()


def captions(references: DataFrame) -> DataFrame:
    """Distinct captions of each entity and evidence, under the least medium that shows them."""
    text = F.trim(F.regexp_replace("caption", r"\s+", " "))
    return references.withColumn("text", text).where(F.col("text") != "").groupBy("entity", "evidence", "text").agg(F.min("media").alias("media"))


def outcomes(media: DataFrame, observations: DataFrame, failures: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """observed, failed or empty for every medium and kind; media that are not selected are 'selection'."""
    grid = media.crossJoin(F.broadcast(media.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")))
    seen = observations.select("media", "kind", F.lit(True).alias("seen")).distinct()
    bad = failures.select("media", "kind", F.lit(True).alias("bad")).distinct()
    state = F.when(~F.col("selected"), "selection").when(F.col("seen"), "observed").when(F.col("bad"), "failed").otherwise("empty")
    return grid.join(seen, ["media", "kind"], "left").join(bad, ["media", "kind"], "left").select("media", "kind", state.alias("state"))


def observation_id(*core: str) -> Column:
    """A digest of an observation's core fields, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(core))), 256)


def read_regions(regions: Column, width: Column, height: Column, least: float) -> Column:
    """Regions of at least a confidence, with polygons in shares of the picture."""
    inside = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    kept = F.filter(regions, lambda r: r["confidence"] >= least)
    return F.transform(kept, lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence"), F.transform(r["polygon"], lambda p: F.array(inside(p[0], width), inside(p[1], height))).alias("polygon")))


def region_text(regions: Column) -> Column:
    return F.array_join(F.transform(regions, lambda r: F.trim(r["text"])), "\n")


def relations(reviewed: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) reviewed relations.

    reviewed: source, target, type, quotes array<struct<entity,evidence,quote>>.
    Symmetric pairs are put in order and no edge counts twice.  Every quote
    must stand in the page of its evidence, and both ends need one.
    """
    swap = F.col("type").isin(*SYMMETRIC) & (F.col("source") > F.col("target"))
    rows = reviewed.select(F.when(swap, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(swap, F.col("source")).otherwise(F.col("target")).alias("target"), "type", "quotes").dropDuplicates(["source", "target", "type"])
    each = rows.select("source", "target", "type", F.explode_outer("quotes").alias("q"))
    found = each.join(pages.select(F.col("evidence").alias("e"), "markdown"), F.col("q.evidence") == F.col("e"), "left")
    ends = F.count_distinct(F.when((F.col("q.entity") == F.col("source")) | (F.col("q.entity") == F.col("target")), F.col("q.entity")))
    held = F.bool_and(F.coalesce(F.contains("markdown", "q.quote") & (F.length("q.quote") > 0), F.lit(False)))
    checked = found.groupBy("source", "target", "type").agg(ends.alias("ends"), held.alias("held"))
    good = (F.col("ends") == 2) & F.col("held") & F.col("type").isin(*RELATIONS) & (F.col("source") != F.col("target"))
    return checked.where(good).select("source", "target", "type"), checked.where(~good).select("source", "target", "type")
