"""Beats of long records, made in pieces of time."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tachygraph.operators import scans
from tachygraph.sources import fixtures

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def written(spark, tmp_path, n):
    """Events of five keys, one of them null, with equal times, null times, and null values at the beginning and within."""
    start = datetime(2024, 1, 1)
    rows = [(k, None if k % 50 == 7 else start + timedelta(seconds=k * 7919 % n // 3), None if k % 11 == 0 else k % 9, "a", None if k % 13 == 0 or k % 4 == 3 and k % 3 else k % 97 / 2) for k in range(n)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    return rows


@pytest.mark.parametrize("kind", [fixtures.rr, fixtures.rr_dirty])
def test_pieces_give_what_one_window_gives(spark, tmp_path, monkeypatch, kind):
    written(spark, tmp_path, 600)
    whole = sorted(map(tuple, kind(spark, str(tmp_path)).collect()), key=str)
    monkeypatch.setattr(scans, "CHUNK", 64)
    assert sorted(map(tuple, kind(spark, str(tmp_path)).collect()), key=str) == whole and len(whole) == 600
    assert whole[0][3:] != whole[1][3:]


def test_a_long_record_is_many_tasks(spark, tmp_path, monkeypatch):
    """Rows of one record are made in several tasks."""
    monkeypatch.setattr(scans, "CHUNK", 5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.range(40_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(4).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
        got = fixtures.rr(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("count"), F.max("right_ms"), F.max("seq")).collect()
        assert len(got) > 1 and sum(r["count"] for r in got) == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
