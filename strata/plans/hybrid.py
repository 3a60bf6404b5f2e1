"""Hybrid search over parts: names, lines and captions as texts, vectors of the same number as their encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import lexical, values
from strata.operators import hybrid as H
from strata.operators import retrieval as R
from strata.plans.records import part_claims
from strata.plans.search import sql_tokens
from strata.plans.tables import read

DEPTH = 10
#: Number, text and query vector.
ASKED = (
    (1, "small ring", 3), (2, "the red widget of brand 7", 11), (3, "Length: 12 cm; power: 12 - 17 MW", 20),
    (4, "zzz qqq", 40), (5, "show me blue bolt economy", 60), (6, "smal wigdet", 80),
)


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED), "query long, text string, vec_id long")


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents of parts, and their names."""
    parts = read(spark, sf_dir, "part").withColumn("entity", F.col("p_partkey")).withColumn("ordinal", F.lit(0))
    evidence = F.concat(F.lit("p"), F.col("p_partkey")).alias("evidence")
    names = parts.select("entity", "ordinal", F.col("p_name").alias("text"), F.lit(None).cast("string").alias("evidence"))
    bodies = parts.select("entity", "ordinal", F.concat(F.lit("part\n"), F.concat_ws(" ", "p_brand", "p_type", F.lit("size"), "p_size")).alias("text"), evidence)
    captions = parts.where("p_size % 2 = 0").select("entity", "ordinal", F.concat_ws(" ", F.lit("photo of a"), "p_name", "p_type").alias("text"), evidence)
    return H.lexical_documents(names, bodies, captions), names


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten parts of each query by each policy, with what stands for them and the query's status."""
    asked, (docs, names) = _asked(spark), _texts(spark, sf_dir)
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    wanted = vectors.withColumnRenamed("v", "q").join(R.small(asked.select("query", "vec_id")), "vec_id").select("query", "q")
    pool = R.nearest(wanted, vectors.join(names.select(F.col("entity").alias("vec_id")), "vec_id", "left_semi")).select("query", F.col("vec_id").alias("entity"), F.round("cosine", 6).alias("cosine"))
    hits = H.best_documents(R.postings(docs).checkpoint(), asked)
    rows = H.pooled(pool, hits).checkpoint()
    specs = [(q, i, *t[:4], len(found)) for q, text, _ in ASKED for found in [values.specifications(text)] for i, t in enumerate(found)]
    terms = spark.createDataFrame(specs, "query long, term int, label string, unit string, low double, high double, n_terms int")
    claims = part_claims(spark, sf_dir).withColumn("label", lexical.label_of(F.col("name")))
    bonus = H.specified(claims, terms).checkpoint()
    out = None
    for policy in (1, 2, 3):
        found = H.leaders(H.search(rows, H.named(asked, names, policy), bonus, policy), DEPTH).withColumn("policy", F.lit(policy))
        out = found if out is None else out.unionByName(found)
    # texts are read for the rows that are shown
    shown = out.withColumn("hit", F.when(F.col("chosen") == "lexical", F.col("hit"))).join(docs.select(F.col("doc").alias("hit"), "text"), "hit", "left")
    longs = [F.col(c).cast("long").alias(c) for c in ("policy", "rank", "entity", "semantic_rank", "lexical_rank")]
    return shown.select("query", *longs, "score", F.round("bonus", 6).alias("bonus"), "name_match", "match_status", "chosen", F.coalesce("fact", "text").alias("snippet"))


_VALUES = ", ".join(f"({q}, '{t}', {v})" for q, t, v in ASKED)
_KEY = "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"

HYBRID_SEARCH = f"""WITH a AS (SELECT * FROM (VALUES {_VALUES}) v(query, text, vec_id)),
d AS (
  SELECT 0 AS place, p_partkey AS entity, p_name AS text, {sql_tokens("p_name")} AS toks FROM part
  UNION ALL SELECT 1, p_partkey, p_brand || ' ' || p_type || ' size ' || p_size, {sql_tokens("p_brand || ' ' || p_type || ' size ' || p_size")} FROM part
  UNION ALL SELECT 2, p_partkey, 'photo of a ' || p_name || ' ' || p_type, {sql_tokens("'photo of a ' || p_name || ' ' || p_type")} FROM part WHERE p_size % 2 = 0
),
tf AS (SELECT place, entity, token, count(*) AS tf, any_value(l) AS l FROM (SELECT place, entity, len(toks) AS l, unnest(toks) AS token FROM d) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d),
df AS (SELECT token, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY token),
qt AS (SELECT DISTINCT query, unnest({sql_tokens("text")}) AS term FROM a),
sp AS (SELECT DISTINCT term, term AS token, false AS fuzzy FROM qt UNION ALL
  SELECT term, token, true FROM (SELECT DISTINCT term FROM qt), (SELECT DISTINCT token FROM tf WHERE place = 0)
  WHERE regexp_full_match(term, '[a-z]{{5,}}') AND regexp_full_match(token, '[a-z]{{5,}}') AND term <> token AND damerau_levenshtein(term, token) <= 1),
h AS (SELECT query, term, sp.token, place, entity, fuzzy, CASE WHEN fuzzy THEN 0.65 ELSE 1 END * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * l / n.a)) AS score
  FROM qt JOIN sp USING (term) JOIN tf ON tf.token = sp.token AND (place = 0 OR NOT fuzzy) JOIN df ON df.token = sp.token, n),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, term, place, entity ORDER BY fuzzy, score DESC, token DESC) = 1),
best AS (SELECT * FROM (SELECT query, place, entity, round(sum(score), 6) AS bm25 FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query, entity ORDER BY bm25 DESC, place) = 1),
pool AS (SELECT query, e.vec_id AS entity, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine
  FROM a JOIN embeddings q USING (vec_id), embeddings e WHERE e.vec_id IN (SELECT p_partkey FROM part)),
r AS (SELECT query, entity, place, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, entity) AS semantic_rank,
  CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY query ORDER BY bm25 DESC NULLS LAST, entity) END AS lexical_rank FROM pool LEFT JOIN best USING (query, entity)),
w AS (SELECT query, {sql_tokens("text")} AS w FROM a),
s AS (SELECT query, i, j, len(w) AS n, array_to_string(w[i:j], '') AS k FROM w, range(1, 10) x(i), range(1, 10) y(j) WHERE i <= j AND j <= len(w)),
m AS (SELECT DISTINCT 1 AS policy, query, p_partkey AS entity FROM s JOIN part ON k = {_KEY} UNION ALL
  SELECT DISTINCT p, query, p_partkey FROM s JOIN part ON k = {_KEY}, (VALUES (2), (3)) z(p) WHERE (i = 1 AND j = n) OR (i <= 2 AND contains(p_name, ' '))),
spec AS (SELECT 3 AS policy, 3 AS query, p_partkey AS entity, CASE WHEN p_type = 'STANDARD' THEN 1.0 ELSE 0.5 END AS bonus,
  CASE WHEN p_type = 'STANDARD' THEN 'Power: 12 - 17 MW' ELSE 'Dimensions: Length: 12 cm' END AS fact FROM part WHERE p_size = 12),
f AS (SELECT policy, query, entity, place, semantic_rank, lexical_rank, coalesce(bonus, 0) AS bonus, fact, m.entity IS NOT NULL AS name_match,
  round(CASE WHEN m.entity IS NOT NULL THEN 2 + greatest(-1, least(1, cosine)) ELSE 1.0 / (60 + semantic_rank) + coalesce(2.0 / (60 + lexical_rank), 0) + coalesce(bonus, 0) END, 9) AS score
  FROM r CROSS JOIN (VALUES (1), (2), (3)) v(policy) LEFT JOIN m USING (policy, query, entity) LEFT JOIN spec USING (policy, query, entity)),
t AS (SELECT *, row_number() OVER (PARTITION BY policy, query ORDER BY name_match DESC, score DESC, entity) AS rank,
  CASE WHEN fact IS NOT NULL THEN 'specification' WHEN coalesce(2.0 / (60 + lexical_rank) >= 1.0 / (60 + semantic_rank), false) THEN 'lexical' ELSE 'semantic' END AS chosen,
  CASE WHEN first_value(name_match OR lexical_rank IS NOT NULL) OVER (PARTITION BY policy, query ORDER BY name_match DESC, score DESC, entity) THEN 'candidates' ELSE 'no_supported_match' END AS match_status FROM f)
SELECT query, policy, rank, t.entity, semantic_rank, lexical_rank, score, round(bonus, 6) AS bonus, name_match, match_status, chosen,
  coalesce(fact, CASE WHEN chosen = 'lexical' THEN d.text END) AS snippet FROM t LEFT JOIN d ON d.place = t.place AND d.entity = t.entity WHERE rank <= {DEPTH}"""

QUERIES = {"hybrid_search": (hybrid_search, HYBRID_SEARCH)}
