"""Quality classifier: random-indexing word vectors, pooled, through a two-layer network.

Every word falls into one of ``BUCKETS`` by its hash and so does its shape
(letters and digits replaced by their class).  A bucket's vector is the sum of
the fixed sparse ternary index vectors of the words around it in the sample;
a document is the mean of its words' vectors beside the mean of their shapes'.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm import fitting
from strata.llm.fitting import sigmoid
from strata.llm.session import prepare, table
from strata.llm.text import SPACED, Words, flat

#: Bounds of the labelled sample: documents, and words in all.
SAMPLE_ROWS, SAMPLE_WORDS = 6000, 4_000_000
THRESHOLD = 0.3
BUCKETS, DIM, NONZERO, SPAN, HIDDEN = 1 << 14, 48, 6, 2, 32

SHAPE = np.arange(256, dtype=np.uint8)
for _lo, _hi, _to in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x41), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x61)):
    SHAPE[_lo:_hi] = _to


def index_vectors(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape buckets of all words, and where each text's begin."""
    words = Words(data, offsets, SPACED, None, SHAPE)
    low = np.uint64(BUCKETS - 1)
    shape = (words.shape & low).astype(np.int32)
    for gap in (3, 2, 1):  # a word again after so many words: a shape of its own
        again = words.hash[gap:] == words.hash[:-gap]
        shape[gap:][again] = gap
    return (words.hash & low).astype(np.int32), shape, words.text


def word_vectors(rows: list[np.ndarray]) -> np.ndarray:
    """Random indexing over lists of buckets: unit vectors (words never seen keep their index vector)."""
    index = index_vectors()
    total = index.copy()
    for words in rows:
        for gap in range(1, SPAN + 1):
            if len(words) <= gap:
                continue
            for at, near in ((words[:-gap], words[gap:]), (words[gap:], words[:-gap])):
                for a in range(0, len(at), 50_000):
                    order = np.argsort(at[a : a + 50_000], kind="stable")
                    key = at[a : a + 50_000][order]
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    total[key[first]] += np.add.reduceat(index[near[a : a + 50_000][order]], first, axis=0)
    total = np.sign(total) * np.log1p(np.abs(total))
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


def pooled(words: np.ndarray, shapes: np.ndarray, text: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row for each text: mean word vector, mean shape vector, log of the number of words."""
    count = np.diff(text)
    out = np.zeros((len(count), 2 * DIM + 1), np.float32)
    full = np.flatnonzero(count)
    step = 20_000
    for half, (ids, table_) in enumerate(((words, vectors[0]), (shapes, vectors[1]))):
        for a in range(0, len(ids), step):  # pieces of all words: memory is bounded for any text
            b = min(a + step, len(ids))
            lo, hi = np.searchsorted(text, a, "right") - 1, np.searchsorted(text, b, "left")
            rows = [r for r in range(lo, hi) if text[r] < text[r + 1]]
            out[rows, half * DIM : (half + 1) * DIM] += np.add.reduceat(table_[ids[a:b]], [max(0, text[r] - a) for r in rows], axis=0)
    out[full, : 2 * DIM] /= count[full, None]
    out[:, 2 * DIM] = np.log1p(count)
    return out


class Network:
    """Two layers (tanh, logistic) fitted by Adam; its temperature is fitted on rows kept apart."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        z = ((x - self.mean) / self.scale).clip(-6, 6)
        apart = rng.random(len(y)) < 0.2
        if y[apart].min(initial=1) == y[apart].max(initial=0) or y[~apart].min(initial=1) == y[~apart].max(initial=0):
            apart[:] = False
        train, target = z[~apart], y[~apart].astype(np.float64)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for a in range(0, len(order), 64):
                rows = order[a : a + 64]
                h = np.tanh(train[rows] @ p[0] + p[1])
                e = (sigmoid(h @ p[2] + p[3]) - target[rows]) / len(rows)
                back = np.outer(e, p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((train[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()]))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if apart.any():
            logits, truth = self.logits(x[apart]), y[apart]
            loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-6, 6)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def learn(batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict | None:
    words, shapes, labels, total = [], [], [], 0
    for data, offsets, label in batches:
        w, s, text = buckets(data, offsets)
        for i, y in enumerate(label):
            if total < SAMPLE_WORDS:
                words.append(w[text[i] : text[i + 1]])
                shapes.append(s[text[i] : text[i + 1]])
                labels.append(y)
                total += text[i + 1] - text[i]
    if not labels:
        return None
    vectors = word_vectors(words), word_vectors(shapes)
    y = np.array(labels)
    ends = np.cumsum([0, *map(len, words)])
    x = pooled(np.concatenate(words), np.concatenate(shapes), ends, vectors)
    if y.min() == y.max():
        return {"constant": (y.sum() + 1) / (len(y) + 2)}
    return {"vectors": tuple(v.astype(np.float16) for v in vectors), "network": Network().fit(x, y)}


def scores(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(offsets) - 1, model["constant"])
    if "ready" not in model:
        model["ready"] = tuple(v.astype(np.float32) for v in model["vectors"])
    return model["network"].probability(pooled(*buckets(data, offsets), model["ready"]))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null text scores as the empty text; a null doc_id is scored and counts as
    not held out; repeated rows are scored each.  Without any usable label all
    scores are 0.5, with one class only its smoothed share.
    """
    prepare(docs.sparkSession)
    return fitting.score(docs, fitting.fit(docs, labels, "quality", learn, rows), scores, THRESHOLD)


def keep_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with docs' own columns."""
    prepare(docs.sparkSession)
    model = fitting.fit(docs, labels, "quality", learn, rows)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(*flat(batch.column(at)), model) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
