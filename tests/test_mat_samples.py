"""Signals written from rows of samples, and read in a bounded number of partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tachygraph.sources import matfile, recordings, signals


def test_samples_become_whole_files(spark, tmp_path):
    """Several pieces a record, rows in any order, numbers that don't begin at 0 or have gaps, and nulls."""
    n = {1: 1000, 2: 1, 3: 64}
    rows = [(r, 4, 10 + 3 * k, None if k == 5 else float(k * r), float(k + r)) for r, m in n.items() for k in range(m)]
    df = spark.createDataFrame(rows, "record_id long, freq int, seq long, raw double, r_peak double").orderBy(F.xxhash64("seq", "record_id"))
    recordings.write_mat_samples(df, f"file://{tmp_path}/new", 64)
    for r, m in n.items():
        blob = (tmp_path / f"new/{r}.mat").read_bytes()
        want = np.array([np.nan if k == 5 else k * r for k in range(m)], float)
        assert blob == matfile.dumps({"frequency": [4], "ts": [0.0], "raw_data": want, "r_peaks": np.arange(m) + float(r)})
    assert len(list((tmp_path / "new").glob("*.mat"))) == 3


def test_no_row_holds_a_record(spark, tmp_path, monkeypatch):
    """The query's signals are written from samples, not from one row a record."""
    from tachygraph.queries import QUERIES

    monkeypatch.delattr(recordings, "write_mat")
    assert QUERIES["signal_chunks"](spark, "/root/testdata/sf0.001").count() > 0


def test_partitions_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(signals, "PARTITIONS", 10)
    (tmp_path / "a.mat").write_bytes(matfile.dumps({"raw_data": np.arange(5000.0), "frequency": [4]}))
    (tmp_path / "b.mat").write_bytes(matfile.dumps({"raw_data": np.arange(30.0), "frequency": [4]}))
    signals.register(spark)
    parts = signals.Reader(str(tmp_path), 10, 2).partitions()
    assert len(parts) <= 12 and sum(s.last - s.first for s in parts) == 5030
    assert all(s.first % 10 == 0 for s in parts)
