"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.skew import spread_join

#: Edges that a task takes at least: of few edges, many shuffle partitions would only make many small files.
EDGES = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node reachable, for every node of the edge list (longs).

    Alternates large-star and small-star steps and cuts the lineage at each
    round.  Least neighbours are partial aggregates, and the edges of a hub are
    dealt over many tasks.
    """
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v").distinct().checkpoint()
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(pairs)
    if not seen[0]:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    few = lambda x: x.coalesce(4 + seen[0] // EDGES)  # noqa: E731 (edges never become more)
    while True:
        pairs = few(pairs)
        # large star: neighbours above a node go to the least of its neighbours and itself
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("size")).select("v", F.least("v", "m").alias("m"), "size")
        large = few(spread_join(both.where("u > v"), least, "v", "size", 2 * seen[0])).select(F.col("m").alias("v"), "u").where("u > v").distinct()
        large = few(large).checkpoint()  # it is read three times
        # small star: neighbours below a node, and itself, go to the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = few(spread_join(large, lowest, "u", "size", 2 * seen[0])).select(F.col("m").alias("v"), F.explode(F.array("v", "u")).alias("u")).where("u > v").distinct()
        small = few(small).checkpoint()
        now = mark(small)
        if now == seen:
            break
        pairs, seen = small, now
    return small.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
