"""Scans, spacing and detection over records that are cut into many chunks, held against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tachygraph.operators import correction, detect, intervals, scans


def greedy(xs, least):
    out, free = [], None
    for x in sorted(set(xs)):
        if free is None or x >= free:
            out.append(x)
            free = x + least
    return out


@pytest.mark.parametrize("least,chunk,fan", [(1, 8, 2), (3, 8, 4), (7, 8, 3), (60, 64, 2), (10, 4, 5)])
def test_spacing_across_chunks(spark, least, chunk, fan):
    rng = np.random.default_rng(least)
    keys = {k: sorted(rng.choice(900, n, replace=False).tolist()) for k, n in ((0, 1), (1, 20), (2, 300), (3, 880))}
    keys[4] = [*range(0, 30), *range(500, 520), 899]
    df = spark.createDataFrame([(k, x) for k, v in keys.items() for x in v], "k long, x long")
    got = intervals.spaced(df.unionByName(df.limit(5)), ["k"], "x", least, chunk, fan).collect()
    assert {k: sorted(r["x"] for r in got if r["k"] == k) for k in keys} == {k: greedy(v, least) for k, v in keys.items()}
    assert len(got) == sum(len(greedy(v, least)) for v in keys.values())


def test_scan_across_chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(x), int(rng.integers(0, 9))) for k in range(3) for x in rng.choice(200, 90, replace=False)] + [(None, 5, 1), (None, 250, 2)]
    df = spark.createDataFrame(rows, "k long, x long, v long")
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v"))}
    for upto in (0, -1):
        got = {(r["k"], r["x"]): (r["total"], r["most"]) for r in scans.scanned(df, ["k"], "x", values, 16, upto=upto).collect()}
        for k, x, _ in rows:
            before = [v for a, b, v in rows if a == k and (b < x or b == x and upto == 0)]
            assert got[k, x] == (sum(before), max(before, default=None))
    got = {(r["k"], r["x"]): r["i"] for r in scans.numbered(df, ["k"], "x", "i", 16).collect()}
    assert all(got[k, x] == sum(a == k and b < x for a, b, _ in rows) for k, x, _ in rows)


def test_sessions_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", 32)
    rng = np.random.default_rng(5)
    rows = [(int(k), float(t)) for k in range(3) for t in np.cumsum(rng.exponential(3, 200)).round(1)] + [(9, 1.0), (8, 2.0), (8, 2.0)]
    got = sorted(map(tuple, intervals.sessions(spark.createDataFrame(rows, "k long, t double"), ["k"], "t", 5, 1, 2, "n").select("k", "n", "start", "end").collect()))
    want = []
    for k in {k for k, _ in rows}:
        ts, spans = sorted(t for a, t in rows if a == k), []
        if len(ts) < 2:
            continue
        for t in ts:
            if spans and t - spans[-1][1] <= 5:
                spans[-1][1] = t
            else:
                spans.append([t, t])
        want += [(k, n, a - 1, z + 2) for n, (a, z) in enumerate(spans)]
    assert [(k, n, round(a, 6), round(z, 6)) for k, n, a, z in got] == [(k, n, round(a, 6), round(z, 6)) for k, n, a, z in sorted(want)]


def loops(values, least=3, max_gap=2, jump=60):
    """The chain for one record, row by row."""
    v = values.copy()
    ones = np.flatnonzero(values == 1)
    for a, z in zip(ones, ones[1:]):
        if 1 < z - a <= max_gap + 1 and (values[a + 1 : z] == 0).all():
            v[a + 1 : z] = 1
    filled, k = v.copy(), 0
    while k < len(v):
        tile = v[k : k + least]
        if v[k] == 1 and len(tile) == least and (tile >= 0).all():
            if not (tile == 1).all():
                v[k : k + least] = 0
            k += least
        else:
            k += 1
    starts, free = [], 0
    for k in range(len(v) - least + 1):
        if k >= free and (v[k : k + least] == 1).all():
            starts.append(k)
            free = k + jump
    return filled, v, starts


def test_one_record_of_a_million_rows(spark):
    """Many tasks share one record, and the result is that of the loop."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("record_id"), F.col("id").alias("row"), F.when(F.pmod(F.xxhash64("id"), F.lit(50)) == 0, -1).otherwise((F.pmod(F.hash(F.floor(F.col("id") / 4)), F.lit(10)) < 6).cast("int")).alias("value"))
    values = np.array([r[0] for r in rows.orderBy("row").select("value").collect()])
    filled, smooth, starts = loops(values)
    in_order = lambda df: np.array([r[0] for r in df.orderBy("row").select("value").collect()])
    assert (in_order(detect.gaps_filled(rows)) == filled).all()
    done = detect.smoothed(detect.gaps_filled(rows))
    assert (in_order(done) == smooth).all()
    got = detect.block_starts(done)
    assert sorted(r["start_row"] for r in got.collect()) == starts
    #: No window of rows spans the record: each is over a chunk, or over one row for each chunk.
    for df in (detect.gaps_filled(rows), done, got, scans.numbered(rows.select("record_id", "row"), ["record_id"], "row", "i")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("chunk_" in line for line in windows)


def test_splice_and_audit_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", 64)
    peaks = spark.range(1000).select(F.lit(7).cast("long").alias("record_id"), F.col("id").alias("idx"), (F.col("id") * 0.8 - F.when(F.col("id") % 64 == 0, 2.0).otherwise(0.0)).alias("t_s"))
    slices = peaks.filter("idx between 100 and 300").withColumn("segment_id", F.lit(0).cast("long"))
    fixed = spark.createDataFrame([(7, 0, [81.0, 82.0])], "record_id long, segment_id long, peaks array<double>")
    got = [r["t_s"] for r in correction.spliced(peaks, slices, fixed).orderBy("seq").collect()]
    times = [r["t_s"] for r in peaks.orderBy("idx").collect()]
    assert got == times[:100] + [81.0, 82.0] + times[301:]
    audit = correction.negative_intervals(peaks.withColumnRenamed("idx", "seq")).collect()
    assert [r["n_negative"] for r in audit] == [sum(b <= a for a, b in zip(times, times[1:]))]
