"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document is the set of its word shingles.  Equal sets (by 128 bits of digest) become one node.  A
node's signature has ``BUCKETS`` registers, each the leading-zero count and the
first mantissa bits of the least hash in its bucket.  Nodes that agree on all
registers of a band meet; each goes to the least node of its band bucket if the
estimated similarity allows it, else to the least of those left over, and so
on.  The clusters so connected are compared on their full sets, once each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.graph import components
from strata.llm.session import partitions, prepare, table, texts
from strata.llm.text import SPACED, Words, flat, shingles
from strata.operators.skew import free_name, spread_join

SHINGLE = 5
#: Documents are linked with share[1] * intersection >= share[0] * union: op3's share, and the pipeline's.
SHARE, STAGE_SHARE = (85, 100), (80, 100)
BUCKETS, MANTISSA = 128, 10
#: Registers in a band: two sets at the threshold of 0.85 miss each other in all 32 bands once in 10^10, at 0.8 once in 10^7.
ROWS = 4
#: A node joins the cluster of its bucket's least node from this estimate on.
LOOSE = 0.37
#: Rounds of leftovers before what remains is taken without an estimate.
ROUNDS = 3
#: Nodes of a cluster that one task compares; larger clusters are compared in pairs of blocks.
BLOCK = 4096
_TOP = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)
_DONORS = np.random.default_rng(5).integers(0, BUCKETS, (48, BUCKETS))


def tight(share: tuple[int, int]) -> float:
    """The estimate below which a node is also left over for the next round.

    Linked sets differ in a share of 1 - s of their registers, at most in ``apart`` at six sigma: their estimates
    against a third set are never further apart, so of a linked pair both join or both are left over, but for
    LOOSE to here, where a node does both.
    """
    s = share[0] / share[1]
    apart = 1 - s + 6 * (s * (1 - s) / BUCKETS) ** 0.5
    return LOOSE + apart


def register(least: np.ndarray) -> np.ndarray:
    """16 bits: leading zeros of a 57-bit hash, then the bits after its first one."""
    part, exponent = np.frexp(np.maximum(least & np.uint64((1 << 57) - 1), np.uint64(1)).astype(np.float64))
    return ((58 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | ((2 * part - 1) * (1 << MANTISSA)).astype(np.uint16)


def signature(ordered: np.ndarray) -> np.ndarray:
    """Registers of an ascending set of hashes; empty buckets take over another one's, chosen by a fixed rule."""
    at = np.searchsorted(ordered, _TOP)
    full = at < np.append(at[1:], len(ordered))
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = register(ordered[at[full]])
    if not full.all():
        empty, filled = np.flatnonzero(~full), full.copy()
        for donors in _DONORS:
            take = full[donors[empty]]
            out[empty[take]] = out[donors[empty[take]]]
            filled[empty[take]] = True
            empty = empty[~take]
            if not len(empty):
                break
        if len(empty):
            have = np.flatnonzero(full)
            out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
    return out


def set_id(ordered: np.ndarray) -> bytes:
    return hashlib.blake2b(ordered.tobytes(), digest_size=16).digest()


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The ascending shingle set of each text."""
    words = Words(*flat(column), SPACED)
    for a, b in zip(words.text, words.text[1:]):
        yield np.unique(shingles(words.hash[a:b], SHINGLE))


def signatures(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, digest (of the text, where asked for), n_shingles, set (digest of the set; null if empty) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, sig = [], [], []
            for found in sets(batch.column(1)):
                n.append(len(found))
                ids.append(set_id(found) if len(found) else None)
                sig.append(signature(found).tobytes() if len(found) else None)
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_shingles", "set", "sig"])

    digest = text_digest("text") if digests else F.lit(None).cast("string")
    return texts(docs).withColumn("digest", digest).mapInArrow(run, "doc_id long, digest string, n_shingles long, set binary, sig binary")


def text_digest(text: str) -> Column:
    """128 bits of a text (null: empty): rows with equal digests have equal texts."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of sets without anything in common agree."""
    zeros = np.arange(0, 40)
    p = [np.exp(-np.maximum(x, BUCKETS)[:, None] / BUCKETS * 2.0 ** -(zeros + 1)) - np.exp(-np.maximum(x, BUCKETS)[:, None] / BUCKETS * 2.0**-zeros) for x in (n, m)]
    return (p[0] * p[1]).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of rows of registers."""
    c = chance(n, m)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def _bands() -> Column:
    """One key for each band of a binary signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // ROWS - 1)), lambda i: F.xxhash64(i, F.substr(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _stars(rows: DataFrame, total: int) -> DataFrame:
    """(key, node, hub) of the band buckets with at least two nodes; hub is the least node of each."""
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    return spread_join(rows, hubs, "key", "size", total).where("node <> hub")


def _estimated(pairs: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """(node, hub, near) of distinct pairs."""
    left = nodes.select("node", F.col("n_shingles").alias("n"), F.col("sig").alias("s"))
    right = nodes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("m"), F.col("sig").alias("t"))
    right = pairs.groupBy("hub").agg(F.count("*").alias("size")).join(right, "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("s", "t"))
            near = estimate(s, t, b.column("n").to_numpy(), b.column("m").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("hub"), pa.array(near)], names=["node", "hub", "near"])

    whole = spread_join(pairs.join(left, "node"), right, "hub", "size", total)
    return whole.select("node", "hub", "n", "m", "s", "t").mapInArrow(run, "node long, hub long, near double")


def _to_least(pairs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what (node, hub) connects: a node, and what else it meets, with the least it meets.

    A node meets a hub for each band at most.  Nodes of a group mostly meet the same hubs, so few edges are left.
    """
    met = pairs.groupBy("node").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    return met.select(F.col("hubs")[0].alias("a"), F.explode(F.concat(F.slice("hubs", 2, BUCKETS // ROWS), F.array("node"))).alias("b")).distinct()


def clusters(nodes: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(node, cluster) of the nodes that may be linked with another; linked nodes are in one cluster."""
    rows = nodes.select("node", F.explode(_bands()).alias("key"))
    edges, total = None, BUCKETS // ROWS * nodes.count()
    for turn in range(ROUNDS):
        stars = _stars(rows, total)
        near = _estimated(stars.select("node", "hub").distinct(), nodes, total).checkpoint()
        found = _to_least(near.where(F.col("near") >= LOOSE))
        edges = found if edges is None else edges.unionByName(found)
        left = near.where(F.col("near") < tight(share)).drop("near")
        rows = stars.join(left, ["node", "hub"]).select("node", "key").checkpoint()
        if rows.isEmpty():
            break
    else:
        edges = edges.unionByName(_to_least(_stars(rows, total)))
    return components(edges).withColumnRenamed("label", "cluster")


def links(members: list[np.ndarray], block: np.ndarray | None = None, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Labels of the exact components among ascending sets (least position of each).

    Only sets that share enough with any others are compared.  ``block``: sets
    of equal blocks need not be compared.
    """
    k = len(members)
    label = np.arange(k)
    size = np.array([len(x) for x in members])
    of = np.repeat(np.arange(k), size)
    _, item = np.unique(np.concatenate(members), return_inverse=True)
    df = np.bincount(item)
    shared = np.bincount(of, df[item] > 1, k)
    alive = shared * share[1] >= share[0] * size  # what a linked set shares is at least so much of either
    keep = alive[of] & (df[item] > 1)
    item, of = item[keep], of[keep]
    order = np.argsort(item, kind="stable")
    posting, start = of[order], np.searchsorted(item[order], np.arange(len(df) + 1))
    first = np.searchsorted(of, np.arange(k + 1))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def overlaps(x: int) -> np.ndarray:
        mine = item[first[x] : first[x + 1]]
        a, n = start[mine], start[mine + 1] - start[mine]
        return np.bincount(posting[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=k)

    done = np.zeros(k, bool)
    for x in np.flatnonzero(alive).tolist():
        if done[x]:
            continue
        # x and, in turn, what is linked with it: a component is walked through once
        todo = [x]
        done[x] = True
        while todo:
            y = todo.pop()
            both = overlaps(y)
            linked = (both * share[1] >= share[0] * (size[y] + size - both)) & alive
            if block is not None:
                linked &= block != block[y]
            for z in np.flatnonzero(linked).tolist():
                a, b = root(y), root(z)
                label[max(a, b)] = min(a, b)
                if not done[z]:
                    done[z] = True
                    todo.append(z)
    return np.array([root(x) for x in range(k)], np.int64) if k else label


def _verified(docs: DataFrame, nodes: DataFrame, found: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, label) of nodes that are linked with another: one node of the component."""
    spark = docs.sparkSession
    sizes = found.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tasks = 4 * partitions(spark)
    small = F.array(F.struct(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("cluster").alias("task"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = (
        found.join(sizes, "cluster").join(nodes.select("node", "set", "rep"), "node")
        .withColumn("p", F.explode(F.when(F.col("blocks") == 1, small).otherwise(pairs)))
        .select("node", "set", "rep", "cluster", "p.*", F.when(F.col("blocks") > 1, own).otherwise(-1).alias("own"))
    )
    body = texts(docs).withColumnRenamed("doc_id", "rep").join(placed, "rep").select("task", "i", "j", "own", "cluster", "node", "set", "rep", "text")

    def run(rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        rows = rows.sort_by([("cluster", "ascending"), ("rep", "ascending")])
        cluster, node, own = (rows[c].to_numpy() for c in ("cluster", "node", "own"))
        wanted = rows["set"].to_pylist()
        for part in np.split(np.arange(len(cluster)), np.flatnonzero(np.diff(cluster)) + 1):
            members = list(sets(rows["text"].slice(part[0], len(part)).combine_chunks()))
            # a doc_id may stand for several texts: only the node's own counts, once
            good = {wanted[p]: q for q, (m, p) in reversed(list(enumerate(zip(members, part)))) if set_id(m) == wanted[p]}
            at = sorted(good.values())
            if len(at) > 1:
                # blocks: within a block (i = j) all, between two blocks only across
                b = own[part][at] if rows["i"][0].as_py() != rows["j"][0].as_py() else None
                label = links([members[q] for q in at], b, share)
                out += [(int(node[part[q]]), int(node[part[at[t]]])) for q, t in zip(at, label)]
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["node", "label"])

    made = body.groupBy("task", "i", "j").applyInArrow(run, "node long, label long").checkpoint()
    if found.isEmpty() or sizes.agg(F.max("blocks")).first()[0] == 1:
        return made
    # pieces of a large cluster: nodes with a label in common are one component
    return components(made.select(F.col("node").alias("a"), F.col("label").alias("b")))


def _labelled(docs: DataFrame, share: tuple[int, int], digests: bool = False) -> DataFrame:
    """doc_id, digest, n_shingles, component (a node; null without words) and component_id of every row."""
    prepare(docs.sparkSession)
    rows = signatures(docs, digests).checkpoint()
    nodes = rows.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).checkpoint()  # written once, so the numbers stay
    labels = _verified(docs, nodes, clusters(nodes, share), share)
    placed = nodes.select("node", "set", "rep", "copies").join(labels, "node", "left").select("set", "rep", "copies", F.coalesce("label", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    total = rows.count()
    ids = spread_join(placed.drop("rep"), least, "component", "size", total)
    out = spread_join(rows.drop("sig"), ids, "set", "copies", total, "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null and empty texts have no shingles and are components of their own;
    equal sets (with them all repeated rows) are linked.  A null doc_id only
    stands for its component if no other row is in it.  No rows give no rows;
    columns of docs other than doc_id and text are not looked at.
    """
    return _labelled(docs, share).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, share: tuple[int, int] = STAGE_SHARE) -> DataFrame:
    """One row of ``docs`` for each component, with docs' own columns, whatever they are called.

    It is the row of the least doc_id (null only if there is no other), of rows with that the one whose
    text has the least digest, of rows with the same doc_id and text any one.  Null and empty texts and those without words
    are linked with nothing: of each doc_id one of them stays.
    """
    rows = _labelled(docs, share, digests=True).groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    # of a component the least; a text without words stands for itself
    itself = [F.when(F.col("component").isNull(), F.col(c)).alias(f"own_{c}") for c in ("doc_id", "digest")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("p")
    stay = rows.groupBy("component", *itself).agg(first).select(F.col("p.doc_id").alias("i"), F.col("p.digest").alias("d"), F.col("p.n").alias("n")).checkpoint()
    names = [free_name(docs, n) for n in ("stay_doc", "text_digest", "stay_n", "stay_digest")]
    keyed = docs.withColumn(names[1], text_digest("text"))
    found = stay.select(*(F.col(c).alias(n) for c, n in zip(("i", "d", "n"), (names[0], names[3], names[2]))))
    kept = keyed.join(found, keyed["doc_id"].cast("long").eqNullSafe(found[names[0]]) & (keyed[names[1]] == found[names[3]]))
    if not stay.where("n > 1").isEmpty():
        once, more = kept.where(F.col(names[2]) == 1), kept.where(F.col(names[2]) > 1)
        kept = once.unionByName(more.dropDuplicates([names[0], names[1]]))
    return kept.select(*(kept[c] for c in docs.columns))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
