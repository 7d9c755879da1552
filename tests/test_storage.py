"""Splittable signals, bucketed tables and nested catalogues."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tachygraph.sources import catalogue, matfile, recordings, signals


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "sub dir"
    at.mkdir()
    for name, n in (("a", 10_000), ("b", 250), ("none", 0)):
        (at / f"{name}.mat").write_bytes(matfile.dumps({"ts": [0.0], "raw_data": np.arange(n) / 4, "frequency": [256], "r_peaks": [1, 2]}))
    plain = matfile.dumps({"raw_data": np.arange(50), "frequency": [64]})
    packed, rest = b"", plain[128:]
    while rest:
        size = struct.unpack("<II", rest[:8])[1] + 8
        data = zlib.compress(rest[:size])
        packed, rest = packed + struct.pack("<II", 15, len(data)) + data, rest[size:]
    (at / "packed.mat").write_bytes(plain[:128] + packed)
    (at / "bad.mat").write_bytes(b"nothing")
    (at / "no_signal.mat").write_bytes(matfile.dumps({"frequency": [64]}))
    (at / "no_rate.mat").write_bytes(matfile.dumps({"raw_data": [1.0, 2.0]}))
    (at / "other.txt").write_bytes(b"x")
    return str(tmp_path)


def test_signals_by_ranges(spark, folder):
    signals.register(spark)
    df = spark.read.format("mat_signals").option("chunk", 100).option("rows", 7).load(folder)
    rows = df.collect()
    for name, n, freq, step in (("a", 10_000, 256, 4), ("b", 250, 256, 4), ("packed", 50, 64, 1)):
        own = sorted((r for r in rows if r["record_id"] == name), key=lambda r: r["chunk"])
        assert [r["start_sample"] for r in own] == list(range(0, n, 100)) and {r["freq"] for r in own} == {freq}
        assert [x for r in own for x in r["raw"]] == (np.arange(n) / step).tolist()
    assert {r["record_id"] for r in rows} == {"a", "b", "packed"}
    #: Fifteen ranges of the long file, one of the others that have a signal.
    assert df.rdd.getNumPartitions() == 15 + 1 + 1


def test_filters_leave_out_ranges(spark, folder):
    signals.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("mat_signals").option("chunk", 100).option("rows", 7).option("pushdown", "true").load(folder)
        got = df.filter((F.col("record_id") == "a") & (F.col("start_sample") >= 700) & (F.col("start_sample") < 1500))
        assert sorted(r["start_sample"] for r in got.collect()) == list(range(700, 1500, 100)) and got.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_mat_files_are_written_where_they_are_read(spark, tmp_path):
    rows = [("x", 8, [1, 2], [0.0], [float(k) for k in range(20)]), ("y", 8, [], None, [1.0])]
    recordings.write_mat(spark.createDataFrame(rows, "record_id string, freq int, r_peaks array<long>, ts array<double>, raw array<double>"), f"file://{tmp_path}/new")
    signals.register(spark)
    got = {r["record_id"]: r["raw"] for r in spark.read.format("mat_signals").load(f"file://{tmp_path}/new").collect()}
    assert got == {"x": [float(k) for k in range(20)], "y": [1.0]}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(5000).select((F.col("id") % 3).alias("record_id"), F.col("id").alias("row"), (F.col("id") * 2).alias("a"))
    right = spark.range(0, 5000, 2).select((F.col("id") % 3).alias("record_id"), F.col("id").alias("row"), (F.col("id") * 3).alias("b"))
    x, y = (recordings.write_bucketed(df, f"{tmp_path}/{k}", 4, "record_id", "row") for k, df in enumerate((left, right)))
    got = x.hint("merge").join(y, ["record_id", "row"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, ["record_id", "row"]).collect()))
    assert "Exchange" not in x.groupBy("record_id", "row").count()._jdf.queryExecution().executedPlan().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_catalogue_entries_by_path(spark, tmp_path):
    lines = ['{"7": {"patient_id": 3, "paths": {"sensor": "a", "more": [1, 2]}}, "8": {"patient_id": "4"}}', "{}", "not json", "[1, 2]", '{"9": null}', "", '{"10": {"paths": {"sensor": 5}}}']
    (tmp_path / "c.json").write_text("\n".join(lines))
    got = catalogue.catalogue_entries(spark, str(tmp_path / "c.json"), patient="$.patient_id:long", sensor="$.paths.sensor:string", second="$.paths.more[1]:int")
    assert sorted(map(tuple, got.collect())) == [("10", None, "5", None), ("7", 3, "a", 2), ("8", 4, None, None), ("9", None, None, None)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("objects_")]
