"""Reading the input tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder where none is named, as in tests; a cluster has to name one."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strata-"))
