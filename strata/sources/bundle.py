"""Immutable snapshots: tables, a manifest with digests, and a pointer that is swapped last."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(rows: DataFrame, without: tuple[str, ...] = ()) -> dict[str, str | int]:
    """Number of rows and a digest that does not depend on their order; columns by name, those in ``without`` left out."""
    columns = sorted(c for c in rows.columns if c not in without)
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    halves = [F.conv(F.substr(row, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)") for i in range(2)]
    found = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"s{i}") for i, h in enumerate(halves)]).first()
    return {"rows": found.n, "digest": hashlib.sha256(f"{columns}|{found.n}|{found.s0}|{found.s1}".encode()).hexdigest()}


def write_snapshot(spark: SparkSession, folder: str, tables: dict[str, DataFrame], recipe: str = "", volatile: tuple[str, ...] = ()) -> dict:
    """Write the tables under a new name, then their manifest, then the pointer.

    Content and recipe that the current snapshot has already are not written again."""
    found = {n: content_digest(t, volatile) for n, t in sorted(tables.items())}
    whole = hashlib.sha256(json.dumps([found, recipe], sort_keys=True).encode()).hexdigest()
    current = read_manifest(spark, folder)
    if current and current["id"] == whole:
        return current
    name = f"{whole[:24]}-{uuid.uuid4().hex[:8]}"
    for n, t in tables.items():
        t.write.parquet(f"{folder}/{name}/{n}")
    manifest = {"id": whole, "name": name, "recipe": recipe, "tables": found, "volatile": list(volatile)}
    text = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1)
    text.write.text(f"{folder}/{name}/manifest")
    text.write.mode("overwrite").text(f"{folder}/current")
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    try:
        row = spark.read.text(f"{folder}/current").first()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return json.loads(row.value) if row else None


def read_snapshot(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{read_manifest(spark, folder)['name']}/{table}")


def verify(spark: SparkSession, folder: str) -> list[str]:
    """Tables whose rows are not those of the manifest."""
    manifest = read_manifest(spark, folder)
    if manifest is None:
        return ["manifest"]
    return [n for n, want in manifest["tables"].items() if content_digest(spark.read.parquet(f"{folder}/{manifest['name']}/{n}"), tuple(manifest["volatile"])) != want]


def check_shrink(before: int, after: int, least: int = 1, most: float = 0.1) -> None:
    """A snapshot has a least size and never loses more than a share of its entities."""
    if after < least or after < before * (1 - most):
        raise ValueError(f"{after} entities after {before}")
