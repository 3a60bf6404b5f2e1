"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of letter groups: runs of up to ``LETTERS`` characters of a
word, one of a script without spaces.  A k-mer of ``K`` groups is an anchor if, of
the s-mers inside it, the one with the least hash is the first or the last.
Whether it is depends on nothing around it, so texts share the anchors of what
they share, and any ``K - S`` k-mers that follow each other hold one.

A fingerprint is all anchors of a text with their positions, in order, whatever
the length of the text.  Without positions they tell how alike two texts are,
with them what stands in the same place, or how far it has moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.session import partitions, prepare, table

K, S = 5, 2
#: s-mers in a k-mer.
SPAN = K - S + 1
LETTERS = 6
_SINGLE = r"\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
GROUP = rf"[{_SINGLE}]|[^\s{_SINGLE}]{{1,{LETTERS}}}+"
_LOW, _ALL = 0xFFFFFFFF, 1 << 30


def groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GROUP), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def anchors(tokens: Column, first: Column | None = None) -> Column:
    """Anchors of an array of groups, in order: position (from ``first`` on) in the high, hash in the low 32 bits."""
    base = F.lit(0) if first is None else first

    def smers(h: Column) -> Column:
        return F.zip_with(h, F.slice(h, 2, F.lit(_ALL)), lambda x, y: F.xxhash64(x, y))

    def select(g: Column) -> Column:
        edge = lambda x, i: F.least(x, F.get(g, i + (SPAN - 1))) <= F.least(*(F.get(g, i + j) for j in range(1, SPAN - 1)))
        packed = lambda x, i: F.shiftleft((base + i).cast("long"), 32).bitwiseOR(F.xxhash64(x, *(F.get(g, i + j) for j in range(1, SPAN))).bitwiseAND(F.lit(_LOW)))
        found = F.transform(F.slice(g, 1, F.size(g) - (K - 1)), lambda x, i: F.when(edge(x, i), packed(x, i)))
        return F.when(F.size(g) >= K, F.filter(found, lambda x: x.isNotNull())).otherwise(_none())

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.transform(F.array(hashes), smers), select))


def whole(tokens: Column) -> Column:
    """The one anchor of fewer than K groups: all of them.  No groups have none."""
    return F.when(F.size(tokens) > 0, F.array(F.xxhash64(tokens).bitwiseAND(F.lit(_LOW)))).otherwise(_none())


def as_text(fp: Column) -> Column:
    """Nine hex digits for each anchor: how many groups after the one before it starts, and its hash."""
    before = lambda i: F.coalesce(F.shiftleft(F.shiftright(F.get(fp, i - 1), 32), 32), F.lit(0))
    return F.array_join(F.transform(fp, lambda x, i: F.lpad(F.hex(x - before(i)), 9, "0")), "")


def hashes(fp: Column) -> Column:
    """The distinct hashes of a fingerprint's anchors."""
    return F.array_distinct(F.transform(fp, lambda x: x.bitwiseAND(F.lit(_LOW))))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of hashes; two texts without anchors are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def in_place(a: Column, b: Column) -> Column:
    """Share of a fingerprint's anchors that another one has in the same place; 1 without anchors."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def moved(a: Column, b: Column) -> Column:
    """(at, to) of each of a fingerprint's anchors that another one has: its position, and the hash's first one there."""
    kind = "map<bigint,int>"
    first = F.aggregate(
        F.array_distinct(F.transform(b, lambda x: x.bitwiseAND(F.lit(_LOW)))), F.array().cast("array<struct<key:bigint,value:int>>"),
        lambda acc, h: F.concat(acc, F.array(F.struct(h.alias("key"), F.shiftright(F.element_at(F.filter(b, lambda y: y.bitwiseAND(F.lit(_LOW)) == h), 1), 32).cast("int").alias("value")))),
    )
    places = F.map_from_entries(first).cast(kind)
    pairs = F.transform(a, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("at"), F.try_element_at(places, x.bitwiseAND(F.lit(_LOW))).alias("to")))
    return F.filter(pairs, lambda p: p["to"].isNotNull())


def _rank_bounds(ids: DataFrame, n: int) -> list[int]:
    """About ``n`` doc_ids that part the rows evenly."""
    share = [i / n for i in range(1, n)]
    found = ids.agg(F.percentile_approx("doc_id", share, max(10_000, 20 * n))).first()[0] if share else None
    return sorted(set(found or []))


def _bucket(at: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``at``: found among every 32nd bound first."""
    if not bounds:
        return F.lit(0)
    many, few = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::32]))
    base = (F.size(F.filter(few, lambda b: b <= at)) - 1) * 32
    return F.when(base < 0, F.lit(0)).otherwise(base + F.size(F.filter(F.slice(many, base + 1, F.lit(32)), lambda b: b <= at)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, guest, tie) such that within a bucket, by (doc_id, tie), the row after
    each non-guest is its next document; guests are the first rows of the bucket after."""
    spark = docs.sparkSession
    low = -(1 << 63)
    ids = docs.select("doc_id")
    bounds = _rank_bounds(ids, 4 * partitions(spark))
    at = F.coalesce("doc_id", F.lit(low))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _bucket(at, bounds).alias("bucket"))
    firsts = sorted((r[0], r[1]) for r in ids.groupBy(_bucket(at, bounds).alias("bucket")).agg(F.min(at)).collect())  # a row for each bucket
    guests = [(first, firsts[i - 1][0], i == 0) for i, (_, first) in enumerate(firsts)]
    if not guests:
        return keyed.withColumn("guest", F.lit(0)).withColumn("tie", F.xxhash64("text"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    also = F.map_from_arrays(F.array(*[F.lit(g[0]) for g in guests]), F.array(*[F.struct(F.lit(g[1]).alias("bucket"), F.lit(2 if g[2] else 1).alias("guest")) for g in guests]))
    key = F.coalesce("doc_id", F.lit(low))
    places = F.when(key.isin([g[0] for g in guests]), F.array(own, F.element_at(also, key))).otherwise(F.array(own))
    return keyed.withColumn("p", F.explode(places)).select("doc_id", "text", "p.bucket", "p.guest", F.xxhash64("text").alias("tie"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many of the next document by ascending doc_id (after the last: the
    first); null doc_ids come first, equal ones are taken by a hash of their text, repeated rows in any order.  A null
    text is empty; it has no anchors, and two of those are alike.  No rows give no rows; columns other than doc_id and
    text are not looked at.
    """
    prepare(docs.sparkSession)
    order = Window.partitionBy("bucket").orderBy(F.expr("guest = 2"), F.col("guest"), F.col("doc_id").asc_nulls_first(), "tie")
    rows = with_next(docs).withColumn("next", F.lead("text").over(order)).withColumn("n", F.char_length("text"))
    part = F.floor(F.col("n") / 4).cast("int")
    own, n = F.col("guest") == 0, F.col("n")
    rows = rows.withColumn("kept", F.substr(F.col("text"), F.lit(1), n - part))
    rows = rows.withColumn("edited", F.concat("kept", F.substr(F.coalesce("next", F.lit("")), F.lit(1), part)))
    rows = rows.select(
        "doc_id", "bucket", "guest", "tie", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), groups(F.col("text")).alias("x"),
        F.when(own, groups(F.col("edited"))).alias("y"),
        # groups that both texts begin with: all whole ones of the part kept
        F.greatest(F.size(groups(F.col("kept"))) - 1, F.lit(0)).alias("same"),
    )
    cut = F.greatest(F.col("same") - (K - 2), F.lit(1))  # the first k-mer that is not of these groups alone
    rows = rows.select(
        "doc_id", "bucket", "guest", "tie", "n", "edited_sha256", F.when(F.size("x") < K, whole(F.col("x"))).alias("short"), F.when(F.size("y") < K, whole(F.col("y"))).alias("edited_short"),
        anchors(F.slice("x", F.lit(1), F.col("same"))).alias("a"), anchors(F.slice("x", cut, F.lit(_ALL)), cut - 1).alias("b"), F.when(own, anchors(F.slice("y", cut, F.lit(_ALL)), cut - 1)).alias("c"),
    )
    rows = rows.select("doc_id", "bucket", "guest", "tie", "n", "edited_sha256", F.coalesce("short", F.concat("a", "b")).alias("fp"), F.coalesce("edited_short", F.concat("a", "c")).alias("efp"))
    rows = rows.withColumn("nfp", F.lead("fp").over(order)).where(own)
    rows = rows.select("*", hashes(F.col("fp")).alias("h"), hashes(F.col("efp")).alias("eh"), hashes(F.coalesce("nfp", "fp")).alias("nh"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"), likeness(F.col("h"), F.col("nh")).alias("near_next"), in_place(F.col("fp"), F.col("efp")).alias("edited_in_place"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
