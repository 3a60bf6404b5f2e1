"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labelled sample: hashed words and word
beginnings that are far commoner in toxic texts, graded by how much.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strata.llm import fitting
from strata.llm.fitting import sigmoid
from strata.llm.session import prepare, table
from strata.llm.text import ALNUM, LOWER, VALUE, Words, mix

#: Bounds of the labelled sample: documents, and words in all.
SAMPLE_ROWS, SAMPLE_WORDS = 8000, 4_000_000
THRESHOLD = 0.5
BUCKETS = 1 << 20
STEMS = (4, 5, 6)
#: Words that address the reader, by language.
SECOND_PERSON = (
    "you your yours yourself u ur",
    "tu te toi ton ta tes vous votre vos",
    "du dich dir dein deine ihr euch sie",
    "ti tú usted ustedes vosotros su",
)
#: Digits and signs that stand for letters.
LEET = np.arange(256, dtype=np.uint8)
for _from, _to in zip(b"013457@$!", b"oieastasi"):
    LEET[_from] = _to
LEET_LOWER = LEET[LOWER]
INSIDE = ALNUM.copy()
INSIDE[list(b"@$!*")] = True


def _hash(words: Iterable[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return np.unique(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM).hash)


_ADDRESS = _hash(" ".join(SECOND_PERSON).split())


class Tokens:
    """Words of a batch with the lexicon buckets of the whole word and of its first bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        w = Words(data, offsets, ALNUM)
        self.words, self.count, self.text = w, w.count, w.text
        keys = [w.hash]
        size = w.end - w.first
        h = np.zeros(len(size), np.uint64)
        for k in range(max(STEMS)):
            ok = size > k
            h[ok] = (h[ok] * np.uint64(0x5851F42D4C957F2D)) + VALUE[LOWER[data[w.first[ok] + k]]]
            if k + 1 in STEMS:
                keys.append(np.where(size > k + 1, mix(h + np.uint64(k + 1)), np.uint64(0)))
        self.keys = [np.where(k == 0, 0, (k % np.uint64(BUCKETS - 1)) + np.uint64(1)).astype(np.int32) for k in keys]


class Lexicon:
    """Weight of each bucket: log odds between toxic and other texts, where sure and large; else 0."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        seen = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
        for keys, label in zip(rows, y):
            seen[int(label)][keys] += 1
        n = np.bincount(y, minlength=2)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        sure = (seen[1] >= 3) & (odds > 2.0)
        sure[0] = False
        self.at = np.flatnonzero(sure)  # at most BUCKETS
        self.weight = odds[self.at].astype(np.float32)

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.at] = self.weight
        return out


def features(tokens: Tokens, lexicon: np.ndarray) -> np.ndarray:
    """One dense row for each text."""
    data, offsets, text = tokens.data, tokens.offsets, tokens.text
    n, words, size = len(offsets) - 1, tokens.count, np.diff(offsets)

    def per_text(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(flag, dtype=np.float64)])
        return total[ends[1:]] - total[ends[:-1]]

    def bytes_of(chars: bytes | range) -> np.ndarray:
        member = np.zeros(256, bool)
        member[list(chars)] = True
        return per_text(member[data], offsets)

    grade = [lexicon[k] for k in tokens.keys]
    best = np.maximum.reduce(grade)
    hits = [best > 2, best > 4, grade[0] > 2, np.maximum.reduce(grade[1:]) > 2]
    out = [per_text(h, text) for h in hits]
    top = np.zeros(n)
    if len(best):
        full = np.flatnonzero(words)
        top[full] = np.maximum.reduceat(best, text[:-1][full])
    address = np.isin(tokens.words.hash, _ADDRESS)
    near = np.zeros(len(best), bool)
    for gap in range(1, 5):
        near[gap:] |= address[:-gap]
        near[:-gap] |= address[gap:]
    odd = Words(data, offsets, INSIDE, LEET_LOWER)
    masked = per_text(np.isin(odd.hash, tokens.words.hash[best > 4]) if len(odd.hash) else np.zeros(0), odd.text) if len(best) else np.zeros(n)
    symbols, upper, letters = bytes_of(b"@$*#%&"), bytes_of(range(65, 91)), bytes_of(range(97, 123))
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    out += [out[0] / per_word, out[1] / per_word, per_text(best, text) / per_word, top, per_text(hits[0] & near, text), per_text(address, text) / per_word]
    out += [upper / np.maximum(upper + letters, 1), bytes_of(b"!") / per_byte, bytes_of(b"?") / per_byte, bytes_of(b".,;:") / per_byte, symbols / per_byte, (masked - out[1]).clip(0) / per_word]
    out += [bytes_of(range(48, 58)) / per_byte, np.log1p(words), size / per_word]
    return np.stack(out, axis=1).astype(np.float32)


class Trees:
    """Boosted trees of a fixed depth over binned features (logistic loss, second order)."""

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = np.full(len(y), self.start)
        for _ in range(rounds):
            p = sigmoid(raw)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, 255, np.int32)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                k = 2**level
                local = node - (k - 1)
                best = np.zeros(k)
                for f in range(x.shape[1]):
                    at = local * 256 + b[:, f]
                    gl = np.bincount(at, g, k * 256).reshape(k, 256).cumsum(1)
                    hl = np.bincount(at, h, k * 256).reshape(k, 256).cumsum(1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[:, -1:] ** 2 / (hl[:, -1:] + 1)
                    gain[(hl < 1) | (hr < 1)] = 0
                    c = gain.argmax(1)
                    for q in np.flatnonzero(gain[np.arange(k), c] > best + 1e-9):
                        best[q], feature[k - 1 + q], cut[k - 1 + q] = gain[q, c[q]], f, c[q]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            self.trees.append((feature, cut, value))
            raw += value[leaf]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.int32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(feature) > node.max(initial=0):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots for interpolation, with a pseudo-row of each class at the ends."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([s, s, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0], top[1], blocks[-1][2] + top[2], blocks[-1][3] + top[3]]
    xs = np.array([v for b in blocks for v in b[:2]])
    ys = np.array([v for b in blocks for v in [(b[2] + 0.5 * b[2] / b[3]) / (b[3] + 0.5)] * 2])
    return xs, ys.clip(0.002, 0.998)


def learn(batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict | None:
    kept, keys, labels, total = [], [], [], 0
    for data, offsets, label in batches:
        if total >= SAMPLE_WORDS:
            continue
        t = Tokens(data, offsets)
        total += len(t.words.hash)
        kept.append((data.copy(), offsets))
        keys += [np.unique(np.concatenate([k[t.text[i] : t.text[i + 1]] for k in t.keys])) for i in range(len(label))]
        labels.append(label)
    if not labels:
        return None
    y = np.concatenate(labels).astype(np.int64)
    if y.min() == y.max():
        return {"constant": (y.sum() + 1) / (len(y) + 2)}
    # The lexicon of each half is made from the other half, so that trees see hit rates as new texts have them.
    half = np.arange(len(y)) % 2
    rows, x = np.cumsum([0, *map(len, labels)]), []
    tables = [Lexicon([k for k, q in zip(keys, half) if q != h], y[half != h]).table() for h in (0, 1)]
    for i, (data, offsets) in enumerate(kept):
        t = Tokens(data, offsets)
        both = [features(t, w) for w in tables]
        x.append(np.where((half[rows[i] : rows[i + 1]] == 0)[:, None], both[0], both[1]))
    x = np.concatenate(x)
    fold = np.random.default_rng(3).integers(0, 3, len(y))
    apart = np.zeros(len(y))
    for f in range(3):
        if len(set(y[fold != f])) == 2 and (fold == f).any():
            apart[fold == f] = Trees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    trees = Trees().fit(x, y)
    raw = trees.raw(x)
    knots = isotonic(apart if apart.any() else raw, y)
    return {"lexicon": Lexicon(keys, y), "trees": trees, "knots": knots}


def scores(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(offsets) - 1, model["constant"])
    if "table" not in model:
        model["table"] = model["lexicon"].table()
    raw = model["trees"].raw(features(Tokens(data, offsets), model["table"]))
    # Isotonic plateaus tie many scores: a trace of the raw score keeps the trees' order.
    return np.interp(raw, *model["knots"]) * 0.999 + 0.001 * sigmoid(raw)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null text scores as the empty text; a null doc_id is scored and counts as
    not held out; repeated rows are scored each.  Without any usable label all
    scores are 0.5, with one class only its smoothed share.
    """
    prepare(docs.sparkSession)
    return fitting.score(docs, fitting.fit(docs, labels, "toxic", learn, rows), scores, THRESHOLD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
