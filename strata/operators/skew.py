"""Joins of many rows with one row for each key, where a few keys hold many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is dealt over several tasks, and the most such keys there may be.
HOT, MOST_HOT = 10_000, 1_000_000
#: Parts over which rows without a key are dealt: they find no partner anywhere.
_NOWHERE = 1 << 16


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of the frame is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(many: DataFrame, one: DataFrame, on: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with the at most one row that ``one`` has for each key; ``size`` is dropped.

    ``one``'s column ``size`` says how many rows of ``many`` have the key, ``total`` how many rows that is in all
    (an upper bound will do).  Keys with more than ``max(HOT, total / MOST_HOT)`` rows are dealt over as many tasks
    as it takes, and their row of ``one`` is repeated.  There are at most MOST_HOT of those, so they are broadcast.
    Rows without a key have no partner and are dealt evenly.  Without such keys this is a plain join.
    """
    limit = max(HOT, total // MOST_HOT)
    if total <= limit or (how == "inner" and one.where(F.col(size) > limit).isEmpty()):
        return many.join(one.drop(size), on, how)
    hot = F.broadcast(one.where(F.col(size) > limit).select(on, F.ceil(F.col(size) / limit).cast("int").alias("_copies")))
    rest = F.xxhash64(*many.columns)
    salt = F.when(F.col(on).isNull(), F.pmod(rest, F.lit(_NOWHERE))).when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(rest, F.col("_copies")))
    left = many.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("_copies")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(size) / limit).cast("int") - 1)))
    right = one.withColumn("_salt", copies).drop(size)
    return left.join(right, [on, "_salt"], how).drop("_salt")
