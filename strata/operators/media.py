"""Duplicate images, families, diverse selection and budgets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.urls import dot

#: Bands of a 64-bit hash: five of 11 bits and one of 9.  Six bands and at most
#: five differing bits leave one band equal.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 11), (55, 9))
NEAR = 5


def exact_duplicates(rows: DataFrame, content: str, item: str) -> DataFrame:
    """Groups of more than one item with the same content: its digest, size and least item."""
    keyed = rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(item).alias("first"))
    return keyed.where("n > 1")


def near_duplicates(rows: DataFrame, item: str = "id", bits: str = "hash") -> DataFrame:
    """Unordered pairs of items whose 64-bit hashes differ in at most five bits.

    Items of equal hash are one side of a pair only once, through their least
    item; the pairs of items with equal hashes are exact duplicates.
    """
    nodes = rows.groupBy(bits).agg(F.min(item).alias("id"))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col(bits), start).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for i, (start, n) in enumerate(BANDS)])
    keyed = nodes.select("id", F.col(bits).alias("h"), F.explode(bands).alias("b")).select("id", "h", "b.band", "b.value")
    left, right = keyed.select(F.col("id").alias("left"), F.col("h").alias("lh"), "band", "value"), keyed.select(F.col("id").alias("right"), F.col("h").alias("rh"), "band", "value")
    distance = F.bit_count(F.col("lh").bitwiseXOR(F.col("rh"))).cast("int")
    return left.join(right, ["band", "value"]).where("left < right").withColumn("distance", distance).where(F.col("distance") <= NEAR).select("left", "right", "distance").distinct()


def families(edges: DataFrame) -> DataFrame:
    """(node, family): least node reachable, by propagating least labels until none changes."""
    both = edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct().checkpoint()
    labels = both.groupBy(F.col("left").alias("node")).agg(F.min("right").alias("m")).select("node", F.least("node", "m").alias("family")).checkpoint()
    while True:
        heard = both.join(labels.withColumnRenamed("node", "right"), "right").groupBy(F.col("left").alias("node")).agg(F.min("family").alias("m"))
        new = labels.join(heard, "node").select("node", F.least("family", "m").alias("new"), "family")
        # pointer jumping: the label of the label
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("jumped"))
        new = new.join(jump, "new").select("node", F.least("new", "jumped").alias("new"), "family").checkpoint()
        if new.where("new <> family").isEmpty():
            return new.select("node", F.col("new").alias("family"))
        labels = new.select("node", F.col("new").alias("family"))


def farthest_first(rows: DataFrame, entity: str, item: str, vector: str, most: int = 8) -> DataFrame:
    """Up to ``most`` views of each entity: the least item, then always the one least similar to those chosen
    (of equals the least item).

    Each round aggregates the best candidate of an entity and joins it back, so
    no entity's views are ever gathered.
    """
    left = rows.select(F.col(entity).alias("e"), F.col(item).alias("i"), F.col(vector).alias("v"), F.lit(float("-inf")).alias("near"))
    chosen = None
    for turn in range(1, most + 1):
        first = F.min_by(F.struct("i", "v"), F.struct("near", "i"))
        best = left.groupBy("e").agg(first.alias("b")).select("e", F.col("b.i").alias("ci"), F.col("b.v").alias("cv")).checkpoint()
        found = best.select(F.col("e").alias(entity), F.col("ci").alias(item), F.lit(turn).alias("turn"))
        chosen = found if chosen is None else chosen.unionByName(found)
        left = left.join(best, "e").where("i <> ci").select("e", "i", "v", F.greatest("near", dot(F.col("v"), F.col("cv"))).alias("near"))
    return chosen


def within_budget(rows: list[tuple[object, int]], budget: int) -> list[object]:
    """Greedy, in order: what does not fit is passed over and the rest goes on."""
    kept, used = [], 0
    for name, size in rows:
        if used + size <= budget:
            kept.append(name)
            used += size
    return kept


def parts(rows: Iterator[tuple[object, int]], limit: int) -> Iterator[tuple[object, int]]:
    """(item, part): a part is closed when the next item would go over its limit."""
    part, used = 0, 0
    for name, size in rows:
        if used and used + size > limit:
            part, used = part + 1, 0
        used += size
        yield name, part
