"""Whether what is given out can be traced back: names of members, locators of claims, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.urls import identity

# Media types that are kept as pages, all others are records.
PAGE_TYPES = ("text/html", "application/xhtml+xml")
CAPTURED = "Captured at"


def safe_key(key: Column) -> Column:
    """1 to 128 ASCII letters, digits, dots, underscores and dashes, a letter or digit first."""
    return F.coalesce(key.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"), F.lit(False))


def safe_source(source: Column) -> Column:
    """Lower-case ASCII letters, digits, underscores and dashes, one at least."""
    return F.coalesce(source.rlike(r"\A[a-z0-9_-]+\z"), F.lit(False))


def member_name(source: Column, url: Column, content_type: Column) -> Column:
    """Where a response is kept: by its source, the identity of its URL and its media type without parameters."""
    mime = F.lower(F.regexp_replace(F.substring_index(content_type, ";", 1), r"\A\s+|\s+\z", ""))
    suffix = F.when(mime.isin(*PAGE_TYPES), "html").otherwise("json")
    return F.concat(F.lit("responses/"), source, F.lit("/"), identity(url), F.lit("."), suffix)


def page_body(html: Column) -> Column:
    """(html, html_base64) of a page's bytes: the text if they are UTF-8, else their base64; the other is null."""
    text = html.cast("string")
    valid = F.is_valid_utf8(text)
    lines = F.translate(F.base64(html), "\r\n", "")  # base64 puts line ends after 76 characters
    return F.struct(F.when(valid, text).alias("html"), F.when(~valid, lines).alias("html_base64"))


def located(claims: DataFrame, records: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """``claims`` (entity, kind, index, evidence, raw) with the ``state`` of what their locators point at.

    ``records`` has a row for each entity: ``facts``, structs of name, raw and evidence as a claim's ``raw`` is one,
    and ``evidence``, structs of id, url and retrieved_at.  A claim of kind "fact" names a fact by its place, one of
    kind "captured_at" a page.  The state is out_of_range (also without a record), unrelated (a page that is not the
    claim's evidence), same or differs.  With ``eligible`` (entity) only claims of those entities are looked up.
    """
    if eligible is not None:
        claims = claims.join(eligible.select("entity"), "entity", "left_semi")
    own = records.select("entity", F.col("facts").alias("_facts"), F.col("evidence").alias("_pages"))
    fact, page = F.get("_facts", F.col("index")), F.get("_pages", F.col("index"))
    capture = F.struct(F.lit(CAPTURED).alias("name"), page["retrieved_at"].alias("raw"), page["url"].alias("evidence"))
    captured = F.col("kind") == "captured_at"
    size = F.coalesce(F.when(captured, F.size("_pages")).otherwise(F.size("_facts")), F.lit(0))
    same = F.when(captured, capture.eqNullSafe(F.col("raw"))).otherwise((F.col("kind") == "fact") & fact.eqNullSafe(F.col("raw")))
    state = (
        F.when((F.col("index") < 0) | (F.col("index") >= size), "out_of_range")
        .when(captured & ~page["id"].eqNullSafe(F.col("evidence")), "unrelated")
        .when(same, "same").otherwise("differs")
    )
    return claims.join(own, "entity", "left").withColumn("state", state).drop("_facts", "_pages")


def response_faults(results: DataFrame, asked: DataFrame, entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(query, entity, fault) for what is wrong with ``results`` (query, entity, source, evidence).

    duplicate: a query has the entity more than once; unknown: not in ``entities`` (entity, source); source: another
    than the entity's; leak: the entity is not of the source that ``asked`` (query, source or null) names; evidence:
    null, or neither empty nor one of the entity's ``pages`` (entity, evidence).  Each fault once.
    """
    twice = results.groupBy("query", "entity").agg(F.count("*").alias("n")).where("n > 1").select("query", "entity", F.lit("duplicate").alias("fault"))
    known = entities.select("entity", F.col("source").alias("_own"), F.lit(True).alias("_known"))
    wanted = asked.where("source IS NOT NULL").select("query", F.col("source").alias("_asked"))
    theirs = pages.select("entity", "evidence").distinct().withColumn("_theirs", F.lit(True))
    rows = results.join(known, "entity", "left").join(wanted, "query", "left").join(theirs, ["entity", "evidence"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "unknown"),
        F.when(F.col("_known") & ~F.col("source").eqNullSafe(F.col("_own")), "source"),
        F.when(F.col("_known") & F.col("_asked").isNotNull() & ~F.col("_asked").eqNullSafe(F.col("_own")), "leak"),
        F.when(F.col("evidence").isNull() | ((F.col("evidence") != "") & F.col("_theirs").isNull()), "evidence"),
    ))
    return twice.unionByName(rows.select("query", "entity", F.explode(found).alias("fault")).distinct())
