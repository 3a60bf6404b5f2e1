"""Retrieval metrics, acceptance gates and calibrated decisions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.values import wilson


def ranks_of_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query, rank): the first place of an expected document, null if none is in the results."""
    hits = results.join(expected, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return expected.select("query").distinct().join(hits, "query", "left")


def metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """top1, recall at 5 and mean reciprocal rank at 20, overall and for each value of each column in ``by``."""
    hit = lambda k: F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    found = [F.count("*").alias("n"), F.avg(hit(1)).alias("top1"), F.avg(hit(5)).alias("recall5"), F.avg(F.when(F.col("rank") <= 20, 1 / F.col("rank")).otherwise(0.0)).alias("mrr20")]
    if not by:
        return ranks.agg(*found)
    return ranks.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by]).agg(*found)


def gates(values: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Whether each limit, named metric_min or metric_max, holds for a one-row table of metrics."""
    test = lambda name: F.col(name[:-4]) >= limits[name] if name.endswith("_min") else F.col(name[:-4]) <= limits[name]
    rows = [F.struct(F.lit(n).alias("gate"), F.coalesce(test(n), F.lit(False)).alias("passed")) for n in limits]
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def intervals(rows: DataFrame, hits: str, total: str) -> DataFrame:
    """A rate with its 95 % Wilson interval."""
    h, n = F.col(hits).cast("double"), F.col(total).cast("double")
    return rows.withColumn("rate", h / n).withColumn("low", wilson(h, n, False)).withColumn("high", wilson(h, n, True))


def nearest_rank(column: str, share: float) -> Column:
    """The ceil(share * n)-th smallest value."""
    return F.percentile_disc(column, share) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def margins(results: DataFrame) -> DataFrame:
    """How far each query's first score is from its second (from 0 if there is none)."""
    two = results.withColumn("next", F.lead("score").over(Window.partitionBy("query").orderBy("rank"))).where("rank = 1")
    return two.select("query", "doc", "score", (F.col("score") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many queries rank better, worse and the same in ``after``; null ranks are last."""
    far = F.lit(1 << 30)
    both = before.select("query", F.coalesce("rank", far).alias("a")).join(after.select("query", F.coalesce("rank", far).alias("b")), "query")
    return both.agg(F.count_if(F.col("b") < F.col("a")).alias("improved"), F.count_if(F.col("b") > F.col("a")).alias("worse"), F.count_if(F.col("b") == F.col("a")).alias("same"))


def decide(signals: DataFrame, profiles: DataFrame, features: list[str]) -> DataFrame:
    """accepted where a query's profile exists and all of its features reach their thresholds; features are integers."""
    limits = profiles.select("profile", *[F.col(f).alias(f"least_{f}") for f in features])
    ok = F.lit(True)
    for f in features:
        ok = ok & (F.col(f) >= F.col(f"least_{f}"))
    return signals.join(F.broadcast(limits), "profile", "left").withColumn("accepted", F.coalesce(ok, F.lit(False))).drop(*limits.columns[1:])


def fit_thresholds(cases: DataFrame, features: list[str], most_false: float = 0.05, grid: int = 64) -> dict[str, int] | None:
    """Thresholds that accept most good cases with at most ``most_false`` of the bad ones accepted.

    The grid has at most ``grid`` values a feature, taken by rank over all cases;
    every combination is counted in one pass of partial aggregates.  cases: good
    (boolean) and the integer features.
    """
    shares = [i / (grid - 1) for i in range(grid)]
    found = cases.agg(*[F.percentile_approx(f, shares).alias(f) for f in features]).first()
    grids = [sorted(set(found[f] or [])) for f in features]
    if not all(grids):
        return None
    # A case accepts the combinations at or below its own cell: count cells, then sum the small grid on the driver.
    cell = [_cell(f, g) for f, g in zip(features, grids)]
    counted = cases.select("good", *[c.alias(f"c{i}") for i, c in enumerate(cell)]).groupBy("good", *[f"c{i}" for i in range(len(cell))]).count().collect()
    total = {True: sum(r["count"] for r in counted if r.good), False: sum(r["count"] for r in counted if not r.good)}
    best: tuple | None = None
    for combo in product(*[range(1, len(g) + 1) for g in grids]):
        n = {True: 0, False: 0}
        for r in counted:
            if all(r[f"c{i}"] >= c for i, c in enumerate(combo)):
                n[bool(r.good)] += r["count"]
        if n[False] <= most_false * max(total[False], 1):
            rank = (n[True], -n[False], tuple(-c for c in combo))
            if best is None or rank > best[0]:
                best = (rank, combo)
    return {f: g[c - 1] for f, g, c in zip(features, grids, best[1])} if best else None


def _cell(feature: str, grid: list[int]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda x: x <= F.col(feature)))
