"""Evaluation queries: labels of embeddings are what a search is expected to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.values import millionths
from strata.operators import evaluation as V
from strata.operators import retrieval as R
from strata.plans.search import _SQL_VIEWS, _views
from strata.plans.tables import read


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranked results of each label's first view, and the other views of the label that it should find."""
    rows, queries = _views(spark, sf_dir)
    hits = R.nearest(queries, rows).where("id <> self").withColumn("score", F.round("cosine", 6)).withColumnRenamed("id", "doc")
    found = R.ranked(hits, "query", F.col("score").desc(), F.col("doc")).select("query", "doc", "score", "rank")
    expected = queries.join(rows, F.col("query") == F.col("label")).where("id <> self").select("query", F.col("id").alias("doc"))
    return found, expected


_SQL_RANKS = f"""{_SQL_VIEWS},
r AS (SELECT query, vec_id, label, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM s WHERE vec_id <> self),
m AS (SELECT query, min(rank) FILTER (label = query) AS rank, CASE WHEN query < 5 THEN 'low' ELSE 'high' END AS cohort FROM r GROUP BY query)"""
_SQL_METRICS = "count(*) AS n, round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS recall5, round(avg(CASE WHEN rank <= 20 THEN 1.0 / rank ELSE 0 END), 6) AS mrr20"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ranks_of_expected(*_results(spark, sf_dir)).withColumn("cohort", F.when(F.col("query") < 5, "low").otherwise("high"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if c in names else c for c in rows.columns])


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.metrics(_ranks(spark, sf_dir)), "top1", "recall5", "mrr20")


RETRIEVAL_METRICS = f"WITH {_SQL_RANKS} SELECT {_SQL_METRICS} FROM m"


def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.metrics(_ranks(spark, sf_dir), "cohort", "query"), "top1", "recall5", "mrr20").select("cohort", "query", "n", "top1", "recall5", "mrr20")


METRICS_GROUPING = f"WITH {_SQL_RANKS} SELECT cohort, query, {_SQL_METRICS} FROM m GROUP BY GROUPING SETS ((), (cohort), (query))"


def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("query", F.col("rank").cast("long").alias("rank"))


FIRST_RANKS = f"WITH {_SQL_RANKS} SELECT query, rank FROM m"


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _results(spark, sf_dir)
    return V.margins(found).select("query", "doc", "score", F.round("margin", 6).alias("margin"))


MARGINS = f"""WITH {_SQL_RANKS}
SELECT a.query, a.vec_id AS doc, a.cosine AS score, round(a.cosine - coalesce(b.cosine, 0), 6) AS margin FROM r a LEFT JOIN r b ON b.query = a.query AND b.rank = 2 WHERE a.rank = 1"""


def ab_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine against cosine cut to one digit, as two systems."""
    found, expected = _results(spark, sf_dir)
    coarse = R.ranked(found.drop("rank").withColumn("score", F.round("score", 1)), "query", F.col("score").desc(), F.col("doc"))
    return V.changes(V.ranks_of_expected(coarse, expected), V.ranks_of_expected(found, expected))


AB_CHANGES = f"""WITH {_SQL_RANKS},
c AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 1) DESC, vec_id) AS rank FROM r),
k AS (SELECT query, min(rank) FILTER (label = query) AS rank FROM c GROUP BY query)
SELECT count(*) FILTER (m.rank < k.rank) AS improved, count(*) FILTER (m.rank > k.rank) AS worse, count(*) FILTER (m.rank = k.rank) AS same FROM m JOIN k USING (query)"""


def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gates(V.metrics(_ranks(spark, sf_dir)), {"top1_min": 0.5, "recall5_min": 0.75, "mrr20_max": 0.999, "n_min": 10})


ACCEPTANCE_GATES = f"""WITH {_SQL_RANKS}, v AS (SELECT {_SQL_METRICS} FROM m)
SELECT 'top1_min' AS gate, top1 >= 0.5 AS passed FROM v UNION ALL SELECT 'recall5_min', recall5 >= 0.75 FROM v UNION ALL SELECT 'mrr20_max', mrr20 <= 0.999 FROM v UNION ALL SELECT 'n_min', n >= 10 FROM v"""


def group_all_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts in which every query finds an expected view among its first five."""
    return _ranks(spark, sf_dir).groupBy("cohort").agg(F.bool_and(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("all_correct"), F.count("*").alias("n"))


GROUP_ALL = f"WITH {_SQL_RANKS} SELECT cohort, bool_and(coalesce(rank <= 5, false)) AS all_correct, count(*) AS n FROM m GROUP BY cohort"


def p95_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, nearest-rank 95th percentile and maximum of the events' values, by type."""
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median(v), 6).alias("median"), V.nearest_rank("value", 0.95).alias("p95"), F.max(v).alias("most"), F.count("*").alias("n"))


P95_LATENCY = "SELECT event_type, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(*) AS n FROM events GROUP BY event_type"


def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of toxic documents by language with its 95 % interval."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("hits"), F.count("*").alias("total"))
    return _rounded(V.intervals(rows, "hits", "total"), "rate", "low", "high")


_Z = 1.959963984540054
WILSON = f"""SELECT lang, hits, total, round(p, 6) AS rate, round((p + {_Z * _Z} / (2 * total) - s) / (1 + {_Z * _Z} / total), 6) AS low, round((p + {_Z * _Z} / (2 * total) + s) / (1 + {_Z * _Z} / total), 6) AS high FROM (
  SELECT *, {_Z} * sqrt(p * (1 - p) / total + {_Z * _Z} / (4.0 * total * total)) AS s FROM (SELECT lang, sum(toxic)::BIGINT AS hits, count(*) AS total, sum(toxic) * 1.0::DOUBLE / count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang))"""


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of assistants that users also said, test texts among documents, and ids in both."""
    turns = read(spark, sf_dir, "conversations")
    said = lambda role: turns.where(F.col("role") == role).select(F.sha2("text", 256).alias("key"))
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    checks = {
        "roles": said("assistant").join(said("user"), "key", "left_semi"),
        "texts": items.join(docs.select("text"), "text", "left_semi"),
        "ids": items.join(docs.select(F.col("doc_id").alias("item_id")), "item_id", "left_semi"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


LEAKAGE = """SELECT 'roles' AS "check", count(*) AS n FROM conversations WHERE role = 'assistant' AND text IN (SELECT text FROM conversations WHERE role = 'user')
UNION ALL SELECT 'texts', count(*) FROM benchmark WHERE text IN (SELECT text FROM documents) UNION ALL SELECT 'ids', count(*) FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)"""


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", millionths(F.col("p_retailprice") / 7).alias("price"))


QUANTISED = "SELECT p_partkey, round(p_retailprice / 7 * 1e6)::BIGINT AS price FROM part"


def calibrated_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose score and margin reach the thresholds of their profile."""
    found, _ = _results(spark, sf_dir)
    signals = V.margins(found).select("query", F.when(F.col("query") < 5, "low").otherwise("high").alias("profile"), millionths(F.col("score")).alias("score"), millionths(F.round("margin", 6)).alias("margin"))
    profiles = spark.createDataFrame([("low", 500_000, 1_000)], "profile string, score long, margin long")
    return V.decide(signals, profiles, ["score", "margin"]).select("query", "profile", "accepted")


CALIBRATED = f"""WITH {_SQL_RANKS}
SELECT a.query, CASE WHEN a.query < 5 THEN 'low' ELSE 'high' END AS profile, a.query < 5 AND a.cosine >= 0.5 AND round(a.cosine - coalesce(b.cosine, 0), 6) >= 0.001 AS accepted FROM r a LEFT JOIN r b ON b.query = a.query AND b.rank = 2 WHERE a.rank = 1"""


def fitted_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on price and size that accept most promotional parts and few others."""
    cases = read(spark, sf_dir, "part").select((F.col("p_type") == "PROMO").alias("good"), F.col("p_size").alias("size"), F.floor("p_retailprice").cast("int").alias("price"))
    found = V.fit_thresholds(cases, ["size", "price"], most_false=0.2, grid=16) or {}
    return spark.createDataFrame(sorted(found.items()), "feature string, threshold long")


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour through a stream with a watermark, drained once."""
    from strata.streaming.events import drained_windows

    return drained_windows(spark, f"{sf_dir}/events.parquet")


STREAM_STATES = "SELECT date_trunc('hour', ts) AS \"begin\", event_type, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {
    "retrieval_metrics": (retrieval_metrics, RETRIEVAL_METRICS), "metrics_grouping_sets": (metrics_grouping_sets, METRICS_GROUPING), "first_ranks": (first_ranks, FIRST_RANKS),
    "margins": (margins, MARGINS), "ab_changes": (ab_changes, AB_CHANGES), "acceptance_gates": (acceptance_gates, ACCEPTANCE_GATES), "group_all_correct": (group_all_correct, GROUP_ALL),
    "p95_latency": (p95_latency, P95_LATENCY), "wilson_interval": (wilson_interval, WILSON), "leakage": (leakage, LEAKAGE), "quantised": (quantised, QUANTISED),
    "calibrated_decision": (calibrated_decision, CALIBRATED), "fitted_thresholds": (fitted_thresholds, None), "stream_states": (stream_states, STREAM_STATES),
}
