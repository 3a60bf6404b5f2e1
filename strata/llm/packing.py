"""Best-fit packing of tokenised documents with dominance reduction.

Packing only depends on how many pieces there are of each length, and a length
is at most the capacity: the driver solves the histogram (at most ``capacity``
counts, whatever the corpus holds) into patterns with multiplicities, and the
pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.session import partitions, prepare, table, texts

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LATIN = re.compile(r"[\x00-\xff]*")
_TAIL = ".,"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is
    visible in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)}


_LETTERS = _byte_letters()


class ChunkEncoder:
    """Token ids of whole texts from the ids of their space-separated chunks.

    The vocabulary never joins characters across white space, so a text's ids
    are those of its chunks in turn; each chunk goes through the tokenizer once
    while it stays in a cache of bounded size.
    """

    def __init__(self, path: str, chunks: int = 600_000, ids: int = 6_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_chunks, self.most_ids = Tokenizer.from_file(path), chunks, ids
        self.model = self.tokenizer.model
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used, self.tails = 0, {}

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks.  A lower-case Latin-1 word is one pre-token, so only the merges are left to do;
        full stops or commas behind it are another one.  Other chunks go through the whole tokenizer."""
        out: list[list[int]] = []
        others: list[int] = []
        merges, known = self.model.tokenize, self.index.get
        for chunk in chunks:
            word = chunk.rstrip(_TAIL)
            if not (word.isalpha() and word.islower() and (word.isascii() or _LATIN.fullmatch(word))):
                others.append(len(out))
                out.append([])
                continue
            k = known(word) if len(word) < len(chunk) else None
            if k is not None:
                ids = self.flat[self.start[k] : self.start[k] + self.size[k]].tolist()
            else:
                ids = [t.id for t in merges(word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))]
            if len(word) < len(chunk):
                tail = chunk[len(word) :]
                if tail not in self.tails:
                    self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
                ids += self.tails[tail]
            out.append(ids)
        for k, e in zip(others, self.tokenizer.encode_batch_fast([chunks[k] for k in others], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _add(self, chunks: list[str]) -> None:
        found = self._ids(chunks)
        n, size = len(self.index), np.fromiter(map(len, found), np.int64, len(found))
        end = self.used + int(size.sum())
        while n + len(chunks) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = list(chain.from_iterable(found))
        self.size[n : n + len(chunks)] = size
        self.start[n : n + len(chunks)] = self.used + np.cumsum(size) - size
        self.index.update(zip(chunks, range(n, n + len(chunks))))
        self.used = end

    def __call__(self, text: str) -> np.ndarray:
        if len(self.index) > self.most_chunks or self.used > self.most_ids:
            self._reset()
        if text.isascii() or _LATIN.fullmatch(text):  # the tokenizer lower-cases these in the same way, and fewer chunks differ
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        if (missing := np.flatnonzero(at < 0)).size:
            self._add(list(dict.fromkeys(chunks[i] for i in missing)))
            at[missing] = [self.index[chunks[i]] for i in missing]
        size = self.size[at]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[at] - before, size) + np.arange(int(size.sum()))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker: its cache serves the tasks that follow as well."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` tokens.

    A document's ids are the tokenizer's, without special tokens added, then 0;
    a null or empty text is the one id 0.  Repeated rows are packed each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path())
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                rows += [(doc, k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


Pattern = tuple[tuple[int, int], ...]


def reduce_dominated(counts: list[int], capacity: int) -> list[tuple[int, Pattern]]:
    """Martello-Toth reduction over a histogram; takes what it fixes from ``counts``.

    A set with the largest piece dominates all others with it when (a) nothing
    else fits, (b) one piece fills the rest exactly, or (c) the largest piece
    that fits is at least as long as any two that fit together.  Such sets can
    be fixed without making the best packing worse.
    """
    fixed: list[tuple[int, Pattern]] = []
    changed = True
    while changed:
        changed = False
        present = [n for n in range(1, capacity + 1) if counts[n]]
        for size in reversed(present):
            while counts[size]:
                rest = capacity - size
                counts[size] -= 1
                low = next((n for n in present if n <= rest and counts[n]), None)
                best = rest if rest and counts[rest] else None
                if low is not None and best is None:
                    top = next(n for n in reversed(present) if n <= rest and counts[n])
                    two = 0
                    i, j = 0, bisect_left(present, rest)
                    j = min(j, len(present) - 1)
                    while i <= j:  # the longest two that fit together
                        a, b = present[i], present[j]
                        if not counts[a]:
                            i += 1
                        elif not counts[b] or a + b > rest or (i == j and counts[a] < 2):
                            j -= 1
                        else:
                            two, i = max(two, a + b), i + 1
                    best = top if top >= two else None
                counts[size] += 1
                if low is None:
                    times, pattern = counts[size], ((size, 1),)
                elif best is None:
                    break
                elif best == size:
                    times, pattern = counts[size] // 2, ((size, 2),)
                else:
                    times, pattern = min(counts[size], counts[best]), ((size, 1), (best, 1))
                if low is not None and best < rest:
                    times = 1 if best == size else min(times, 1 if counts[best] <= 2 else counts[best] - 2)
                if not times:
                    break
                for n, k in pattern:
                    counts[n] -= times * k
                fixed.append((times, pattern))
                changed = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit, longest first, over a histogram: equal pieces and equal bins are moved together."""
    bins: dict[int, list[tuple[int, Pattern]]] = {capacity: []}
    rooms: list[int] = []  # rooms that some bin has, ascending

    def put(room: int, times: int, pattern: Pattern) -> None:
        if not bins.get(room):
            bins[room] = []
            insort(rooms, room)
        bins[room].append((times, pattern))

    for size in range(capacity, 0, -1):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                times, pattern = bins[room].pop()
                if not bins[room]:
                    rooms.pop(k)
            else:
                room, times, pattern = capacity, left, ()
            each = min(room // size, left)
            used = min(times, left // each)
            if times > used and pattern:
                put(room, times - used, pattern)
            put(room - each * size, used, (*pattern, (size, each)))
            left -= used * each
        counts[size] = 0
    return [x for room in bins.values() for x in room]


def solve(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """Patterns with multiplicities that hold every piece counted (index: length)."""
    counts = list(counts)
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, patterns: list[tuple[int, Pattern]], capacity: int):
        rows: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        used, sequence = [0] * (capacity + 1), 0
        for times, pattern in patterns:
            offset = 0
            for size, each in pattern:
                rows[size].append((used[size], each, sequence, offset))
                used[size] += times * each
                offset += size * each
            sequence += times
        self.rows = [np.array(x, np.int64).reshape(-1, 4) for x in rows]

    def __call__(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows[size]
        first, each, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].T
        return sequence + (rank - first) // each, offset + (rank - first) % each * size


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence and a place in it.  ``found``: rows of ``pieces``."""
    spark = found.sparkSession
    found = found.withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    chunks = 4 * partitions(spark)
    found = found.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    sizes = found.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    counts = [0] * (capacity + 1)
    for size, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most one row for each length
        counts[size] = n
    places = Places(solve(counts, capacity), capacity)
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n"))
    # names of their own: columns that both sides inherit are taken for one and dropped
    before = before.select(F.col("chunk").alias("part"), F.col("length").alias("size"), "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        first = dict(zip(offsets["size"].to_pylist(), offsets["before"].to_pylist()))
        rows = rows.sort_by("uid")
        size = rows["length"].to_numpy()
        order = np.argsort(size, kind="stable")
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        kinds, starts = np.unique(size[order], return_index=True)
        for kind, at in zip(kinds.tolist(), np.split(order, starts[1:])):
            sequence[at], offset[at] = places(kind, first[kind] + np.arange(len(at)))
        return rows.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return found.groupBy("chunk").cogroup(before.groupBy("part")).applyInArrow(place, PLACED)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents; one row per piece.

    Empty and null texts are one token; an empty table packs into no sequence.
    """
    prepare(docs.sparkSession)
    return pack(pieces(docs, path, capacity), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
