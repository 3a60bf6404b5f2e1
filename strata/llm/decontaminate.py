"""Benchmark decontamination through a stored, distributed positional inverted index.

Documents are dealt into blocks of about ``BLOCK_BYTES`` as they are read.  The
index is a table in the shared folder with a row for each term of a block: its
postings there (positions in the block, ascending) and their number; a frequent
term has many blocks, so no list of postings grows with the corpus.  One row of
a block lists its documents.

A window of a test item is looked up by joins alone: document frequencies come
from the index's (term, n), each window's terms are ordered by them, a window
meets the blocks that have its rarest term, and within a block the lists of its
terms are intersected, rarest first: adjusted by their offsets for exact phrases,
within a stretch of words for proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.neardup import text_digest
from strata.llm.session import prepare, shared_path, table, texts
from strata.llm.text import ALNUM, LOWER, Words, flat
from strata.operators.skew import free_name

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: The words of a window lie within so many times its length for a proximity match.
STRETCH = 2
#: Bytes of text after which a block ends (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Windows that a task holds at once; more are searched in as many parts as it takes.
WINDOWS_AT_ONCE = 500_000
#: Bytes of terms, or of digests, that may be broadcast; larger sides are joined by shuffles.
BROADCAST_BYTES = 32 << 20
#: Candidates that are followed at once.
_STEP = 1 << 21

INDEX = "block long, term binary, n long, postings binary, docs array<struct<doc_id:long,digest:string,n_words:long>>"
_DOC = pa.struct([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64())])
_RUN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the pieces of ``data`` that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as 7 bits a byte, and the byte after each."""
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 9):
        size += gaps >= (1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        have = np.flatnonzero(size > k)
        out[ends[have] - size[have] + k] = ((gaps[have] >> (7 * k)) & 127) | np.where(size[have] > k + 1, 128, 0)
    return out, ends


def decode(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def index_block(block: int, ids: list[pa.Array], digests: list[pa.Array], bodies: list[pa.Array]) -> pa.RecordBatch:
    """The rows of a block: one with its documents, one for each term."""
    data, offsets = flat(pa.chunked_array(bodies))
    words = Words(data, offsets, ALNUM)
    order = np.argsort(words.hash, kind="stable")
    ranked = words.hash[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(order) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(order)))
    gaps = np.diff(order, prepend=0)
    gaps[first] = order[first]
    coded, ends = encode(gaps)
    word = order[first]
    size = words.end[word] - words.first[word]
    at = np.repeat(words.first[word] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    terms = binaries(LOWER[data[at]], np.cumsum(size))
    lists = binaries(coded, ends[first + n - 1] if len(first) else first)
    listed = pa.StructArray.from_arrays([pa.chunked_array(ids).combine_chunks(), pa.chunked_array(digests).combine_chunks(), pa.array(words.count, pa.int64())], fields=list(_DOC))
    own = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
    docs = pa.concat_arrays([own, pa.nulls(len(first), own.type)])
    one = lambda x, t: pa.concat_arrays([pa.array([x], t)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, block)), pa.concat_arrays([one(None, pa.binary()), terms]), pa.array(np.concatenate([[len(listed)], n])),
            pa.concat_arrays([one(None, pa.binary()), lists]), docs,
        ],
        names=["block", "term", "n", "postings", "docs"],
    )


def build(docs: DataFrame, digests: bool = False) -> DataFrame:
    """The positional index of docs, stored in the shared folder and read from there.

    Every row of docs is in one block once, a repeated row as often as it is there; a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, got = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            # rows of a batch are parted where they come to a block
            size = np.cumsum(np.diff(flat(batch.column(1))[1]))
            start = 0
            while start < batch.num_rows:
                before = int(size[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + BLOCK_BYTES - held, "right")))
                part = batch.slice(start, stop - start)
                got.append(part)
                held += int(size[stop - 1]) - before
                start = stop
                if held >= BLOCK_BYTES or start < batch.num_rows:
                    yield index_block(block, *([p.column(k) for p in got] for k in (0, 2, 1)))
                    block, held, got = block + 1, 0, []
        if got:
            yield index_block(block, *([p.column(k) for p in got] for k in (0, 2, 1)))

    digest = text_digest("text") if digests else F.lit(None).cast("string")
    path = shared_path(docs.sparkSession, "positional-index")
    texts(docs).withColumn("digest", digest).mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w, item_id, terms): the windows of test items, each once an item; w is a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            words = Words(data, offsets, ALNUM)
            ids, terms = [], []
            for item, s, e in zip(batch.column(0).to_pylist(), words.text.tolist(), words.text[1:].tolist()):
                own = [LOWER[data[a:b]].tobytes() for a, b in zip(words.first[s:e], words.end[s:e])]
                n = min(window, len(own))
                for a in range(len(own) - n + 1 if n and item is not None else 0):
                    ids.append(item)
                    terms.append(own[a : a + n])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, terms array<binary>").distinct().withColumn("w", F.monotonically_increasing_id()).checkpoint()


def _small(rows: DataFrame, size: Column) -> DataFrame:
    """rows, to be broadcast where they are known to be small."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


class Lists:
    """The postings of some terms of a block: one ascending array of (slot, position)."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, n: np.ndarray, n_words: np.ndarray):
        """ids: ascending; data: their postings behind each other; n: how many each has; n_words: of the documents."""
        self.ids, self.n = ids, n
        self.text = np.concatenate([[0], np.cumsum(n_words)])
        self.width = int(self.text[-1]) + 1
        gaps, self.first = decode(data), np.cumsum(n) - n
        total = np.cumsum(gaps)
        self.at = total - np.repeat(total[self.first] - gaps[self.first], n) if len(n) else gaps
        self.keys = self.at + np.repeat(np.arange(len(n)) * self.width, n)

    def slots(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(ids.shape, -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def nearest(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each slot has a posting from low to high."""
        at = np.searchsorted(self.keys, slot * self.width + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= slot * self.width + high)

    def candidates(self, slots: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(window, position of its rarest term, first and last word of the stretch about it that all its terms are in).

        slots, k: for each window its terms, rarest first, and their offsets.
        """
        reach = STRETCH * slots.shape[1] - 1
        n = self.n[slots[:, 0]]
        parts = np.searchsorted(np.cumsum(n), np.arange(_STEP, int(n.sum()) + _STEP, _STEP), "left") + 1
        for part in np.split(np.arange(len(n)), np.unique(np.minimum(parts, len(n)))[:-1]):
            of = np.repeat(part, n[part])
            at = self.at[np.arange(len(of)) + np.repeat(self.first[slots[part, 0]] - np.cumsum(n[part]) + n[part], n[part])]
            doc = np.searchsorted(self.text, at, "right") - 1
            low, high = np.maximum(at - reach, self.text[doc]), np.minimum(at + reach, self.text[doc + 1] - 1)
            for j in range(1, slots.shape[1]):
                keep = self.nearest(slots[of, j], low, high)
                of, at, low, high = of[keep], at[keep], low[keep], high[keep]
            yield of, at, low, high

    def phrases(self, slots: np.ndarray, k: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates (window, start) whose terms stand at their offsets, in one document."""
        start = at - k[of, 0]
        doc = np.searchsorted(self.text, at, "right") - 1
        keep = (start >= self.text[doc]) & (start + slots.shape[1] <= self.text[doc + 1])
        of, start = of[keep], start[keep]
        for j in range(1, slots.shape[1]):
            there = start + k[of, j]
            keep = self.nearest(slots[of, j], there, there)
            of, start = of[keep], start[keep]
        return of, start

    def within(self, slots: np.ndarray, low: int, high: int) -> bool:
        """Whether some stretch between low and high has all of the terms."""
        length = STRETCH * len(slots)
        found = []
        for s in np.unique(slots):
            a, b = np.searchsorted(self.keys, [s * self.width + low, s * self.width + high + 1])
            found.append(self.at[a:b])
        starts = np.unique(np.concatenate(found))
        good = np.ones(len(starts), bool)
        for x in found:
            i = np.searchsorted(x, starts)
            good &= (i < len(x)) & (x[np.minimum(i, len(x) - 1)] < starts + length)
        return bool(good.any())


FOUND = "block long, row int, whole boolean, doc_id long, digest string, n_words long, hits array<struct<start:long,end:long>>, items array<long>, near array<long>"


def search_block(index: pa.Table, wanted: pa.Table) -> pa.Table:
    """For each document of a block its hit words, and the items that occur, exactly and by proximity.

    index: (id, n, postings, docs) of the block, with a row without an id that lists its documents; wanted: windows (item_id, terms:
    structs of n, k, id, rarest first) that are looked for.
    """
    heads = index.filter(pa.compute.is_null(index["id"]))
    lists = index.filter(pa.compute.is_valid(index["id"])).sort_by("id")
    docs = heads["docs"].combine_chunks().flatten()
    n_words = docs.field("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
    found = Lists(lists["id"].to_numpy(), flat(lists["postings"])[0], lists["n"].to_numpy(), n_words)
    change = np.zeros(int(found.text[-1]) + 1, np.int32)
    items: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}
    if wanted.num_rows:
        terms = wanted["terms"].combine_chunks()
        size = np.diff(terms.offsets.to_numpy())
        parts = terms.flatten()
        ids, k = parts.field("id").to_numpy(), parts.field("k").to_numpy()
        item = wanted["item_id"].to_numpy()
        begin = np.cumsum(size) - size
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            place = begin[own][:, None] + np.arange(n)
            slots = found.slots(ids[place])
            whole = (slots >= 0).all(axis=1)
            own, slots, offsets = own[whole], slots[whole], k[place][whole]
            if not len(own):
                continue
            for of, at, low, high in found.candidates(slots, offsets):
                exact, start = found.phrases(slots, offsets, of, at)
                np.add.at(change, start, 1)
                np.add.at(change, start + n, -1)
                doc = np.searchsorted(found.text, start, "right") - 1
                for d, i in set(zip(doc.tolist(), item[own[exact]].tolist())):
                    items.setdefault(d, set()).add(i)
                    near.setdefault(d, set()).add(i)
                if n == 1:
                    continue
                doc = np.searchsorted(found.text, at, "right") - 1
                for d, i, w, a, b in zip(doc.tolist(), item[own[of]].tolist(), of.tolist(), low.tolist(), high.tolist()):
                    if i not in near.get(d, ()) and found.within(slots[w], a, b):
                        near.setdefault(d, set()).add(i)
    hit = np.cumsum(change[:-1]) > 0
    base, rows = index["block"][0].as_py(), len(docs)
    whole = index["whole"][0].as_py()
    out = []
    for i in range(rows):
        runs = []
        if i in items:
            edge = np.flatnonzero(np.diff(np.r_[False, hit[found.text[i] : found.text[i + 1]], False].astype(np.int8)))
            runs = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
        if whole or i in near:
            out.append((i, runs, sorted(items.get(i, ())), sorted(near.get(i, ()))))
    take = docs.take(pa.array([r[0] for r in out], pa.int64()))
    return pa.table(
        [
            pa.array([base] * len(out), pa.int64()), pa.array([r[0] for r in out], pa.int32()), pa.array([whole] * len(out), pa.bool_()), *(take.field(c) for c in ("doc_id", "digest", "n_words")),
            pa.array([r[1] for r in out], pa.list_(_RUN)), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int64())),
        ],
        names=["block", "row", "whole", "doc_id", "digest", "n_words", "hits", "items", "near"],
    )


def search(index: DataFrame, wanted: DataFrame, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """A row for each document of the index: doc_id, digest, n_words, hits (runs of word positions), items that occur
    exactly, and near: those and the items of which all words of a window lie within STRETCH times its length."""
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    named = index.where("term IS NOT NULL")
    vocabulary = named.select("term", "n").join(_small(terms, F.octet_length("term") + 32), "term").groupBy("term").agg(F.sum("n").alias("df"))
    vocabulary = vocabulary.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    known = _small(vocabulary.select("term", "id"), F.octet_length("term") + 32)
    # a window's terms, rarest first; a window with a term that no document has goes
    placed = wanted.select("w", "item_id", F.size("terms").alias("size"), F.posexplode("terms").alias("k", "term")).join(vocabulary, "term")
    plan = placed.groupBy("w", "item_id", "size").agg(F.sort_array(F.collect_list(F.struct(F.col("df").alias("n"), F.col("k").cast("long").alias("k"), "id"))).alias("terms"))
    plan = plan.where(F.size("terms") == F.col("size")).drop("size").checkpoint()
    parts = max(1, -(-plan.count() // at_once))
    part = F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int")
    rarest = plan.select("item_id", "terms", part.alias("part"), F.col("terms")[0]["id"].alias("id"))
    lists = named.select("block", "term", "n", "postings").join(known, "term").select("block", "id", "n", "postings", F.lit(None).cast("array<struct<doc_id:long,digest:string,n_words:long>>").alias("docs"))
    alive = named.select("block", "term").join(known, "term").select("block", "id").join(rarest, "id").select(F.col("block").alias("at"), F.col("part").alias("its"), "item_id", "terms")
    heads = index.where("term IS NULL").select("block", F.lit(None).cast("long").alias("id"), "n", "postings", "docs")
    # every part of the windows meets the lists of the block; the first one also names all documents
    dealt = heads.unionByName(lists).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("whole", F.col("part") == 0)
    found = dealt.groupBy("block", "part").cogroup(alive.groupBy("at", "its")).applyInArrow(search_block, FOUND)
    if parts == 1:
        return found.drop("block", "row", "whole")
    gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    doc = F.first(F.when(F.col("whole"), F.struct("doc_id", "digest", "n_words")), ignorenulls=True).alias("d")
    return found.groupBy("block", "row").agg(doc, gather("hits"), gather("items"), gather("near")).select("d.*", "hits", "items", "near")


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, at_once: int = WINDOWS_AT_ONCE, digests: bool = False) -> DataFrame:
    """For each row of docs: doc_id, digest (of the text, where asked for), n_words, hits, items and near, as of ``search``.

    Null texts have no words; items without an id or words are left out.  Every row is judged once by itself, whatever
    the number of windows searched at once: also repeated rows, and rows whose doc_id is null or has other texts too.
    No rows give no rows; without items nothing is hit.  Columns other than doc_id, item_id and text are not looked at.
    """
    prepare(docs.sparkSession)
    return search(build(docs, digests), windows(items, window), at_once)


def _n_hit() -> Column:
    """Words in the union of sorted runs."""
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], h["end"]).alias("to")
    )
    return F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with proximity matches) of every row,
    with the text's digest where asked for.  Rows are judged as by ``find_items``."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    found = find_items(docs, items, digests=digests).withColumn("n_hit", _n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
        *(["digest"] if digests else []),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with docs' own columns, whatever they are called.

    A row goes by its text: repeated rows go or stay together, and rows with the same or no doc_id do not share a fate.
    Null and empty texts stay; no rows give no rows.
    """
    bad = decontaminate(docs, items, digests=True).where("contaminated").select("digest").distinct().checkpoint()
    name = free_name(docs, "digest")
    bad = _small(bad.withColumnRenamed("digest", name), F.lit(64))
    return docs.withColumn(name, text_digest("text")).join(bad, name, "left_anti").select(*docs.columns)


def near_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): proximity matches, exact ones among them; a row for each row of docs."""
    return find_items(docs, items).select("doc_id", F.explode("near").alias("item_id"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
