"""The corpus pipeline: raw documents to packed training sequences.

Every stage takes documents with any further columns, whatever they are called, and all but the last give
back the same columns.  No rows give no rows.  A null text counts as an empty one, a null doc_id is an id
like any other, and repeated rows are rows of their own until the near-duplicate stage, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm.decontaminate import drop_contaminated
from strata.llm.neardup import keep_one_of_each
from strata.llm.packing import pack_documents
from strata.llm.pii import mask
from strata.llm.quality import keep_quality
from strata.llm.session import remove, shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and very long texts are scored like others; repeated rows go or stay together.  Without usable labels
    all scores are alike, and none is rejected or all are, as the threshold says.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles) stays.

    It is the one of the least doc_id; of repeated rows one stays.  Texts without words are linked with none.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Each row is judged by its own text; null and empty texts stay; without benchmark items all stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked; every document stays.  Null texts stay null, repeated rows repeated."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences: an empty or null text is the end token alone, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packing),
]

#: Fitted classifiers and tokenizers are not SQL: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
