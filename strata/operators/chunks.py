"""Overlapping windows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, STRIDE = 192, 144


def windows(rows: DataFrame, item: str, text: str, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """(item, chunk, words): the last window is the first that reaches the end; texts without words have none."""
    words = F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    split = rows.select(item, words.alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.ceil((F.size("words") - size) / stride), F.lit(0)).cast("int")
    return split.select(item, "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(item, "chunk", F.slice("words", F.col("chunk") * stride + 1, F.lit(size)).alias("words"))
