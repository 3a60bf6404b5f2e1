"""Retrieval queries: documents answer the benchmark texts, parts carry names, embeddings are views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import lexical, urls
from strata.operators import retrieval as R
from strata.plans.tables import read

DEPTH = 10


def sql_tokens(text: str) -> str:
    """DuckDB list of the tokens of a text without dashes between letters and digits."""
    dotted = rf"regexp_replace(regexp_replace(strip_accents(lower({text})), '(\p{{Nd}})\.(\p{{Nd}})', '\1·\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1·\2', 'g')"
    return rf"list_transform(regexp_extract_all({dotted}, '[\p{{L}}\p{{Nd}}·]+'), lambda x: replace(x, '·', '.'))"


SQL_INDEX = f"""
d AS (SELECT doc_id AS doc, lang, {sql_tokens("text")} AS toks FROM documents),
tf AS (SELECT doc, token, count(*) AS tf FROM (SELECT doc, unnest(toks) AS token FROM d) GROUP BY ALL),
size AS (SELECT doc, len(toks) AS length FROM d WHERE len(toks) > 0),
n AS (SELECT count(*) AS n, avg(length) AS a FROM size),
df AS (SELECT token, count(*) AS df, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY token),
qt AS (SELECT item_id AS query, token, count(*) AS tf FROM (SELECT item_id, unnest({sql_tokens("text")}) AS token FROM benchmark) GROUP BY ALL),
lex AS (
  SELECT query, doc, round(sum(idf * 2.2 * tf.tf / (tf.tf + 1.2 * (0.25 + 0.75 * length / n.a))), 6) AS score
  FROM tf JOIN qt USING (token) JOIN df USING (token) JOIN size USING (doc), n GROUP BY ALL
),
sem AS (
  SELECT query, doc, round(sum(qt.tf * tf.tf) / (any_value(qn.l) * any_value(dn.l)), 6) AS score
  FROM tf JOIN qt USING (token) JOIN (SELECT query, sqrt(sum(tf * tf)) AS l FROM qt GROUP BY query) qn USING (query)
  JOIN (SELECT doc, sqrt(sum(tf * tf)) AS l FROM tf GROUP BY doc) dn USING (doc) GROUP BY ALL
)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the documents, query terms and query postings of the benchmark texts."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    # the index is a table of its own: all of its readers share one pass over the texts
    return R.postings(docs, "doc_id").checkpoint(), R.query_terms(items, "item_id"), R.postings(items, "item_id").withColumnRenamed("doc", "query")


def _lexical(post: DataFrame, terms: DataFrame) -> DataFrame:
    return R.bm25(post, terms).select("query", "doc", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    post, terms, _ = _index(spark, sf_dir)
    hits = R.top(_lexical(post, terms), DEPTH, "query", F.col("score").desc(), F.col("doc"))
    return hits.select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("doc").alias("doc_id"), "score")


BM25_TOPK = f"""WITH {SQL_INDEX}
SELECT query AS item_id, rank, doc AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM lex) WHERE rank <= {DEPTH}"""


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_stats(R.postings(read(spark, sf_dir, "documents"), "doc_id")).select("token", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


TERM_STATS = f"WITH {SQL_INDEX} SELECT token, df, round(idf, 6) AS idf FROM df"


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    post, _, queries = _index(spark, sf_dir)
    fused = R.fuse_scores(R.scores(post, queries)).withColumn("score", F.round("score", 9))
    out = R.top(fused, DEPTH, "query", F.col("score").desc(), F.col("doc"))
    return out.select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("doc").alias("doc_id"), F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"), "score")


def _fused_sql(pool: str) -> str:
    return f"""
s AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS semantic_rank FROM sem WHERE {pool}),
l AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS lexical_rank FROM lex WHERE {pool}),
f AS (SELECT query, doc, semantic_rank, lexical_rank, round(1.0 / (60 + semantic_rank) + coalesce(2.0 / (60 + lexical_rank), 0), 9) AS score FROM s LEFT JOIN l USING (query, doc))
SELECT query AS item_id, rank, doc AS doc_id, semantic_rank, lexical_rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= {DEPTH}"""


RRF_FUSION = f"WITH {SQL_INDEX}, {_fused_sql('true')}"


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only English documents are ranked; idf is that of all documents."""
    post, _, queries = _index(spark, sf_dir)
    pool = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    fused = R.fuse_scores(R.scores(post, queries).join(pool, "doc", "left_semi")).withColumn("score", F.round("score", 9))
    out = R.top(fused, DEPTH, "query", F.col("score").desc(), F.col("doc"))
    return out.select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("doc").alias("doc_id"), F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"), "score")


HYBRID_FILTERED = f"WITH {SQL_INDEX}, {_fused_sql('doc IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')}"


def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query is a candidate if its leader was found by terms too."""
    post, _, queries = _index(spark, sf_dir)
    lead = R.top(R.fuse_scores(R.scores(post, queries)).withColumn("score", F.round("score", 9)), 1, "query", F.col("score").desc(), F.col("doc"))
    found = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")).join(lead, "query", "left")
    return found.select(F.col("query").alias("item_id"), F.when(F.col("lexical_rank").isNotNull(), "candidates").otherwise("no_supported_match").alias("match_status"))


MATCH_STATUS = f"""WITH {SQL_INDEX},
s AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS sr FROM sem),
l AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS lr FROM lex),
f AS (SELECT query, doc, lr, row_number() OVER (PARTITION BY query ORDER BY round(1.0 / (60 + sr) + coalesce(2.0 / (60 + lr), 0), 9) DESC, doc) AS rank FROM s LEFT JOIN l USING (query, doc))
SELECT item_id, CASE WHEN lr IS NOT NULL THEN 'candidates' ELSE 'no_supported_match' END AS match_status FROM benchmark LEFT JOIN (SELECT * FROM f WHERE rank = 1) ON query = item_id"""

_NAME_QUERIES = ((1, "samll ring"), (2, "red wigdet"), (3, "smal rings"), (4, "widget"), (5, "ring small red"))
_NAMES_SQL = ", ".join(f"({i}, '{q}')" for i, q in _NAME_QUERIES)


def bm25_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against misspelt queries."""
    post = R.postings(read(spark, sf_dir, "part"), "p_partkey", "p_name")
    terms = R.query_terms(spark.createDataFrame(list(_NAME_QUERIES), "query long, text string"))
    hits = R.bm25(post, terms, R.spellings(terms, post), post).withColumn("score", F.round("score", 6))
    out = R.top(hits, DEPTH, "query", F.col("score").desc(), F.col("doc"))
    return out.select("query", F.col("rank").cast("long").alias("rank"), F.col("doc").alias("p_partkey"), "score", F.array_join("terms", " ").alias("terms"), "typo")


BM25_FUZZY = f"""WITH d AS (SELECT p_partkey AS doc, {sql_tokens("p_name")} AS toks FROM part),
tf AS (SELECT doc, token, count(*) AS tf FROM (SELECT doc, unnest(toks) AS token FROM d) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d WHERE len(toks) > 0),
df AS (SELECT token, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY token),
q AS (SELECT DISTINCT query, unnest({sql_tokens("text")}) AS term FROM (VALUES {_NAMES_SQL}) v(query, text)),
sp AS (SELECT term, term AS token, false AS fuzzy FROM (SELECT DISTINCT term FROM q) UNION ALL
  SELECT term, token, true FROM (SELECT DISTINCT term FROM q), df WHERE regexp_full_match(term, '\\p{{L}}{{5,}}') AND regexp_full_match(token, '\\p{{L}}{{5,}}') AND term <> token AND damerau_levenshtein(term, token) <= 1),
h AS (SELECT query, term, sp.token, doc, fuzzy, CASE WHEN fuzzy THEN 0.65 ELSE 1 END * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(toks) / n.a)) AS score
  FROM q JOIN sp USING (term) JOIN tf ON tf.token = sp.token JOIN df ON df.token = sp.token JOIN d USING (doc), n),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, term, doc ORDER BY fuzzy, score DESC, token DESC) = 1),
s AS (SELECT query, doc, round(sum(score), 6) AS score, array_to_string(list_sort(list_distinct(list(token))), ' ') AS terms, bool_or(fuzzy) AS typo FROM b GROUP BY ALL)
SELECT query, rank, doc AS p_partkey, score, terms, typo FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= {DEPTH}"""


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a query names as its subject, at its beginning or in quotes."""
    query = 'the "small ring" of many'
    rows = read(spark, sf_dir, "part")
    return rows.where(lexical.subject_match_of(query, F.array("p_name"))).select("p_partkey", "p_name", F.regexp_replace(lexical.key_of(F.col("p_name")), " ", "").alias("key"))


NAME_MATCH = "SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS key FROM part WHERE regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') = 'smallring'"


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and of each label its first one as query."""
    rows = read(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("self"))
    return rows.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), first.select(F.col("label").alias("query"), "q", "self")


_SQL_VIEWS = """
q AS (SELECT label AS query, arg_min(embedding, vec_id)::DOUBLE[] AS q, min(vec_id) AS self FROM embeddings GROUP BY label),
s AS (SELECT query, self, vec_id, label, round(list_inner_product(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q)"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _views(spark, sf_dir)
    hits = R.nearest(queries, rows).withColumn("cosine", F.round("cosine", 6))
    return R.top(hits, DEPTH, "query", F.col("cosine").desc(), F.col("id")).select("query", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "cosine")


VECTOR_TOPK = f"WITH {_SQL_VIEWS} SELECT query, rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= {DEPTH}"


def similar_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _views(spark, sf_dir)
    hits = R.nearest(queries, rows).where("id <> self").withColumn("cosine", F.round("cosine", 6))
    return R.top(hits, 5, "query", F.col("cosine").desc(), F.col("id")).select("query", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "cosine")


SIMILAR_EXCL_SELF = f"WITH {_SQL_VIEWS} SELECT query, rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM s WHERE vec_id <> self) WHERE rank <= 5"


def max_view_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are entities with many views; an entity scores by its best."""
    rows, queries = _views(spark, sf_dir)
    hits = R.nearest(queries, rows).withColumn("cosine", F.round("cosine", 6))
    return R.best_view(hits, "query", "label", order=(F.col("cosine").desc(), F.col("id"))).select("query", "label", F.col("id").alias("vec_id"), "cosine")


MAX_VIEW = f"WITH {_SQL_VIEWS} SELECT query, label, vec_id, cosine FROM s QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY cosine DESC, vec_id) = 1"


def image_text_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two full rankings of entities, fused with equal weights: best view, and mean of views."""
    rows, queries = _views(spark, sf_dir)
    hits = R.nearest(queries, rows).withColumn("cosine", F.round("cosine", 6))
    image = hits.groupBy("query", F.col("label").alias("doc")).agg(F.max("cosine").alias("score"))
    text = hits.where("id <> self").groupBy("query", F.col("label").alias("doc")).agg(F.round(F.avg("cosine"), 6).alias("score"))
    fused = R.fuse(image, text, w_s=1.0, w_l=1.0, outer=True)
    return fused.select("query", F.col("doc").alias("label"), F.col("semantic_rank").cast("long").alias("image_rank"), F.col("lexical_rank").cast("long").alias("text_rank"), F.round("score", 9).alias("score"))


IMAGE_TEXT = f"""WITH {_SQL_VIEWS},
i AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY m DESC, label) AS image_rank FROM (SELECT query, label, max(cosine) AS m FROM s GROUP BY ALL)),
t AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY m DESC, label) AS text_rank FROM (SELECT query, label, round(avg(cosine), 6) AS m FROM s WHERE vec_id <> self GROUP BY ALL))
SELECT query, label, image_rank, text_rank, round(coalesce(1.0 / (60 + image_rank), 0) + coalesce(1.0 / (60 + text_rank), 0), 9) AS score FROM i FULL JOIN t USING (query, label)"""


def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of 20 of all vectors by likeness to the first one."""
    rows = read(spark, sf_dir, "embeddings")
    q = rows.agg(F.min_by("embedding", "vec_id").alias("q"))
    hits = R.nearest(q, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).withColumn("cosine", F.round("cosine", 6))
    out = R.page(hits, 3, 20, F.col("cosine").desc(), F.col("id"))
    return out.select(F.col("position").cast("long").alias("position"), F.col("id").alias("vec_id"), "cosine", "total", "has_more")


PAGE_WINDOW = """WITH q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings),
s AS (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q),
r AS (SELECT row_number() OVER (ORDER BY cosine DESC, vec_id) AS position, vec_id, cosine, count(*) OVER () AS total FROM s)
SELECT *, total > 60 AS has_more FROM r WHERE position BETWEEN 41 AND 60"""


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors are finite and of length 1."""
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(urls.is_unit(v)).alias("good"), F.count("*").alias("n"))


UNIT_VECTORS = "SELECT label, count(*) FILTER (abs(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) <= 0.002) AS good, count(*) AS n FROM embeddings GROUP BY label"

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_TOPK), "bm25_fuzzy": (bm25_fuzzy, BM25_FUZZY), "term_stats": (term_stats, TERM_STATS), "rrf_fusion": (rrf_fusion, RRF_FUSION),
    "hybrid_filtered": (hybrid_filtered, HYBRID_FILTERED), "match_status": (match_status, MATCH_STATUS), "name_match": (name_match, NAME_MATCH),
    "vector_topk": (vector_topk, VECTOR_TOPK), "similar_excl_self": (similar_excl_self, SIMILAR_EXCL_SELF), "max_view_per_label": (max_view_per_label, MAX_VIEW),
    "image_text_fusion": (image_text_fusion, IMAGE_TEXT), "page_window": (page_window, PAGE_WINDOW), "unit_vectors": (unit_vectors, UNIT_VECTORS),
}
