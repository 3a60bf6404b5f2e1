"""Fitting a classifier on a bounded sample of labelled rows, and scoring every row.

The bound (rows, and words of the sampled texts) is a parameter of each
classifier.  The sample is written to the shared folder; one executor task
streams it, keeps compact arrays only and returns the fitted model as bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.session import texts
from strata.llm.text import flat


def held_out() -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, target: str, learn: Callable, rows: int) -> object | None:
    """What ``learn(batches of (bytes, offsets, labels))`` returns, or None without labelled rows.

    The sample is the ``rows`` labelled documents that come first by a hash of
    doc_id.  Rows with a null label or doc_id are not learned from, and a
    doc_id labelled twice counts once, with the larger label.
    """
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    sample = texts(docs).join(F.broadcast(wanted), "doc_id").select("text", "label").checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learn((*flat(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def score(docs: DataFrame, model: object | None, scores: Callable[[np.ndarray, np.ndarray, object], np.ndarray], threshold: float) -> DataFrame:
    """docs' columns, held_out, score and predicted for every row; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            found = scores(data, offsets, model) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
