from __future__ import annotations

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_stream_drains(spark):
    found = entry.queries()["stream_states"](spark, "/root/testdata/sf0.001")
    assert found.groupBy().sum("n").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
