"""Queries that follow results back to their evidence, and the sequential budgets of exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.lexical import tokens_of
from strata.operators import entities as E
from strata.operators import media as M
from strata.operators.chunks import windows
from strata.plans.search import sql_tokens
from strata.plans.tables import read


def observed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the best turn: a generated one has to beat every other strictly; of equals the first."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("score"), (F.col("role") == "assistant").alias("generated"))
    w = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), F.col("generated"), "turn")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("conv_id", "turn", "role", F.col("score").cast("long").alias("score"))


OBSERVED_TEXT = "SELECT conv_id, turn, role, length(text) AS score FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, (role = 'assistant'), turn) = 1"


def chunk_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of each document occur as they are in its single-spaced text."""
    docs = read(spark, sf_dir, "documents")
    plain = docs.select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")).alias("plain"))
    chunks = windows(docs, "doc_id", "text").select("doc_id", F.array_join("words", " ").alias("chunk"))
    return chunks.join(plain, "doc_id").groupBy("doc_id").agg(F.count_if(F.contains("plain", "chunk")).alias("held"), F.count("*").alias("n"))


CHUNK_CONTAINMENT = r"""SELECT doc_id, n AS held, n FROM (SELECT doc_id, (greatest(CEIL((len(w) - 192) / 144.0)::BIGINT, 0) + 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents) WHERE len(w) > 0)"""


def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests over canonical JSON: keys in order, without the volatile ones."""
    rows = read(spark, sf_dir, "customer")
    text = F.to_json(F.struct(F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")))
    return rows.select("c_custkey", F.sha2(text, 256).alias("digest"))


CANONICAL_DIGEST = """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS digest FROM customer"""


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of all turns in the order in which they first come."""
    rows = read(spark, sf_dir, "conversations").select(F.sha2("text", 256).alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    return E.first_occurrence(rows, "key", "place").select("key", "place")


ORDERED_DISTINCT = "SELECT sha256(text) AS key, min(conv_id * 1000 + turn) AS place FROM conversations GROUP BY 1"


def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one markdown text, turns in order behind rules."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n---\n\n")
    return rows.select("conv_id", F.size("t").cast("long").alias("turns"), F.sha2(text, 256).alias("sha256"))


CONVERSATION_EXPORT = "SELECT conv_id, count(*) AS turns, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text)) AS sha256 FROM conversations GROUP BY conv_id"


def raw_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest orders with their customers: joined after the limit."""
    page = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)
    return F.broadcast(page).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").where("o_orderkey IS NOT NULL").select("o_orderkey", "o_totalprice", "c_name")


RAW_AFTER_LIMIT = "SELECT o_orderkey, o_totalprice, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN customer ON o_custkey = c_custkey"


def unambiguous_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that their host and path alone tell apart from all others."""
    at = F.regexp_extract("url", r"^https?://([^?#]+)", 1)
    rows = read(spark, sf_dir, "pages").select("page_id", at.alias("at"))
    single = rows.groupBy("at").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).where("n = 1")
    return single.select("page_id", "at")


UNAMBIGUOUS = "SELECT min(page_id) AS page_id, regexp_extract(url, '^https?://([^?#]+)', 1) AS at FROM pages GROUP BY 2 HAVING count(*) = 1"


def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every turn."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens_of(F.col("text"))).cast("long").alias("n"))


LABEL_TOKENS = f"SELECT conv_id, turn, len({sql_tokens('text')}) AS n FROM conversations"


def export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in order, in parts of at most 200,000 characters: a rule that looks at all before, so one task streams it."""
    limit = 200_000
    rows = read(spark, sf_dir, "pages").select("page_id", F.char_length("html").alias("size")).orderBy("page_id").coalesce(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = M.parts(((i, int(s)) for b in batches for i, s in zip(b["page_id"], b["size"])), limit)
        held: list[tuple] = []
        for x in found:
            held.append(x)
            if len(held) == 10_000:
                yield pd.DataFrame(held, columns=["page_id", "part"])
                held = []
        yield pd.DataFrame(held, columns=["page_id", "part"]).astype({"page_id": "int64", "part": "int64"})

    return rows.mapInPandas(run, "page_id long, part long")


EXPORT_PARTS = """WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY page_id) AS k, page_id, length(html) AS size FROM pages),
t AS (SELECT k, page_id, size AS used, 0 AS part FROM p WHERE k = 1
  UNION ALL SELECT p.k, p.page_id, CASE WHEN used + size > 200000 THEN size ELSE used + size END, CASE WHEN used + size > 200000 THEN part + 1 ELSE part END FROM t JOIN p ON p.k = t.k + 1)
SELECT page_id, part FROM t"""

QUERIES = {
    "observed_text": (observed_text, OBSERVED_TEXT), "chunk_containment": (chunk_containment, CHUNK_CONTAINMENT), "canonical_digest": (canonical_digest, CANONICAL_DIGEST),
    "ordered_distinct": (ordered_distinct, ORDERED_DISTINCT), "conversation_export": (conversation_export, CONVERSATION_EXPORT), "raw_after_limit": (raw_after_limit, RAW_AFTER_LIMIT),
    "unambiguous_pages": (unambiguous_pages, UNAMBIGUOUS), "label_tokens": (label_tokens, LABEL_TOKENS), "export_parts": (export_parts, EXPORT_PARTS),
}
