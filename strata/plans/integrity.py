"""Queries that check names, locators and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import integrity as I
from strata.plans.tables import read


def safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the beginnings of texts can be keys, and languages and sources names of sources."""
    rows = read(spark, sf_dir, "documents").withColumn("key", F.split("text", " ")[0])
    return rows.select("doc_id", I.safe_key(F.col("key")).alias("key_ok"), I.safe_source(F.col("source")).alias("source_ok"), I.safe_source(F.upper("lang")).alias("lang_ok"))


SAFE_KEYS = r"""SELECT doc_id, coalesce(regexp_full_match(split_part(text, ' ', 1), '[A-Za-z0-9][A-Za-z0-9._-]{0,127}'), false) AS key_ok,
  coalesce(regexp_full_match(source, '[a-z0-9_-]+'), false) AS source_ok, coalesce(regexp_full_match(upper(lang), '[a-z0-9_-]+'), false) AS lang_ok FROM documents"""


def page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member names of pages under three media types, and their bodies, of which every seventh is not UTF-8."""
    rows = read(spark, sf_dir, "pages")
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' Application/XHTML+XML ' ELSE 'application/json' END")
    html = F.encode("html", "UTF-8")
    body = I.page_body(F.when(F.col("page_id") % 7 == 0, F.concat(html, F.unhex(F.lit("FF")))).otherwise(html))
    rows = rows.select("page_id", I.member_name(F.lit("web"), F.col("url"), kind).alias("member"), body.alias("body"))
    return rows.select("page_id", "member", F.char_length("body.html").cast("long").alias("n_chars"), F.md5("body.html_base64").alias("base64_md5"))


PAGE_MEMBERS = """SELECT page_id, 'responses/web/' || substr(sha256(url), 1, 24) || CASE WHEN page_id % 3 = 2 THEN '.json' ELSE '.html' END AS member,
  CASE WHEN page_id % 7 <> 0 THEN length(html) END AS n_chars, CASE WHEN page_id % 7 = 0 THEN md5(to_base64(encode(html) || '\\xFF'::BLOB)) END AS base64_md5 FROM pages"""


def located_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of urgent orders as claims about the sorted lines of the order; of every fifth order the place is one too far."""
    lines = read(spark, sf_dir, "lineitem").withColumn("entity", F.col("l_orderkey"))
    raw = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.col("l_partkey").cast("string").alias("raw"), F.col("l_returnflag").alias("evidence"))
    facts = F.array_sort(F.collect_list(raw)).alias("facts")
    records = lines.groupBy("entity").agg(facts).withColumn("evidence", F.expr("CAST(array() AS array<struct<id:string,url:string,retrieved_at:string>>)"))
    index = (F.col("l_linenumber") - F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(1)).cast("int")
    claims = lines.select("entity", F.lit("fact").alias("kind"), index.alias("index"), F.lit("").alias("evidence"), raw.alias("raw"))
    urgent = read(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("entity"))
    return I.located(claims, records, urgent).groupBy("entity", "state").agg(F.count("*").alias("n"))


LOCATED_FACTS = """WITH l AS (SELECT l_orderkey AS entity, l_linenumber, {'name': l_linenumber::VARCHAR, 'raw': l_partkey::VARCHAR, 'evidence': l_returnflag} AS r FROM lineitem),
f AS (SELECT entity, list_sort(list(r)) AS facts FROM l GROUP BY entity),
c AS (SELECT l.entity, r, facts, l_linenumber + CASE WHEN l.entity % 5 = 0 THEN 1 ELSE 0 END AS place FROM l JOIN f ON l.entity = f.entity WHERE l.entity IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT entity, CASE WHEN place > len(facts) THEN 'out_of_range' WHEN facts[place] = r THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM c GROUP BY ALL"""


def response_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of the month's query, customers as entities, with faults planted by divisibility."""
    orders = read(spark, sf_dir, "orders").withColumn("query", F.date_format("o_orderdate", "yyyy-MM"))
    name = lambda c: F.concat(F.lit("s"), (c % 7).cast("string"))
    entity = F.when(F.col("o_orderkey") % 13 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).cast("long")
    source = F.when(F.col("o_orderkey") % 11 == 0, "sx").otherwise(name(F.col("o_custkey")))
    evidence = (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)).cast("string")
    results = orders.select("query", entity.alias("entity"), source.alias("source"), evidence.alias("evidence"))
    asked = orders.select("query", F.when(F.col("query").endswith("-01"), "s1").alias("source")).distinct()
    entities = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("entity"), name(F.col("c_custkey")).alias("source"))
    pages = orders.select(F.col("o_custkey").cast("long").alias("entity"), F.col("o_orderkey").cast("string").alias("evidence"))
    return I.response_faults(results, asked, entities, pages)


RESPONSE_AUDIT = """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS query, (CASE WHEN o_orderkey % 13 = 0 THEN -o_custkey ELSE o_custkey END)::BIGINT AS entity,
  CASE WHEN o_orderkey % 11 = 0 THEN 'sx' ELSE 's' || (o_custkey % 7) END AS source, o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS evidence FROM orders),
e AS (SELECT c_custkey::BIGINT AS entity, 's' || (c_custkey % 7) AS own FROM customer), j AS (SELECT r.*, own FROM r LEFT JOIN e ON r.entity = e.entity)
SELECT query, entity, 'duplicate' AS fault FROM r GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT query, entity, 'unknown' FROM j WHERE own IS NULL
UNION ALL SELECT DISTINCT query, entity, 'source' FROM j WHERE own <> source
UNION ALL SELECT DISTINCT query, entity, 'leak' FROM j WHERE own <> 's1' AND query LIKE '%-01'
UNION ALL SELECT DISTINCT query, entity, 'evidence' FROM r WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = entity AND o_orderkey = evidence)"""

QUERIES = {
    "safe_keys": (safe_keys, SAFE_KEYS), "page_members": (page_members, PAGE_MEMBERS),
    "located_facts": (located_facts, LOCATED_FACTS), "response_audit": (response_audit, RESPONSE_AUDIT),
}
