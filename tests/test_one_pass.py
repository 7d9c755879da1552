"""Sweeps, draws and tensors that are made in one pass, against the plain way."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tachygraph.operators import features, sampling
from tachygraph.operators.evaluate import cohort_metrics
from tachygraph.plans.evaluation import evaluate, sweep
from tachygraph.plans.study import threshold_sweep
from tachygraph.queries import _package, _scores_in_order

SF = "/root/testdata/sf0.001"


def test_thresholds_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 11)) / 10, int(rng.integers(0, 2))) for _ in range(300)] + [(None, 1), (None, 0), (0.5, None), (1.0, 7)]
    thresholds = [0.5, 0.0, 0.5, 1.1, 0.3, -1.0]
    got = {r["trial"]: r for r in threshold_sweep(spark.createDataFrame(rows, "score double, label int"), thresholds).collect()}
    assert sorted(got) == list(range(6))
    for k, t in enumerate(thresholds):
        share = [sum(s is not None and s >= t for s, y in rows if y == label) / sum(y == label for _, y in rows) for label in (1, 0)]
        assert got[k]["threshold"] == t and got[k]["Total_Sensitivity"] == pytest.approx(100 * share[0]) and got[k]["Total_FAR"] == pytest.approx(share[1])
    none = threshold_sweep(spark.createDataFrame([(0.5, 1)], "score double, label int"), [0.4]).first()
    assert none["Total_Sensitivity"] == 100 and none["Total_FAR"] is None


def test_a_sweep_reads_its_rows_once(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("value").alias("score"), (F.col("user_id") % 2).alias("label"))
    leaves = threshold_sweep(rows, [k * 1.0 for k in range(50)])._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaves.size() == 1


def test_sweep_equals_one_evaluation_for_each_threshold(spark):
    rows, onsets, recs = _package(spark, SF)
    scores = _scores_in_order(rows, "score").withColumn("score", F.col("score") * 0.6 + F.pmod("i", F.lit(5)) / 20).persist()
    thresholds = [0.1, 0.6, 0.75, 2.0]
    got = {r["threshold"]: r.asDict() for r in sweep(rows, scores, onsets, recs, F.col("valid"), thresholds, 50).collect()}
    assert sorted(got) == thresholds
    for t in thresholds:
        one = cohort_metrics(evaluate(rows, scores, onsets, recs, F.col("valid"), t, 50)["patients"]).first().asDict()
        assert {k: v for k, v in got[t].items() if k != "threshold"} == pytest.approx(one)


@pytest.mark.parametrize("block", [55, 64, 512])
def test_tensor_steps_from_blocks(spark, block):
    """Rows with gaps in their numbers, records shorter than a tensor, and blocks of any size."""
    rows = [(0, k, float(k)) for k in range(0, 400, 2)] + [(1, k, k / 2) for k in range(54)] + [(2, k, k / 2) for k in range(55)]
    got = {(r["record_id"], r["row"]): [s["v"] for s in r["steps"]] for r in features.feature_steps(spark.createDataFrame(rows, "record_id long, row long, v double"), block=block).collect()}
    want = {}
    for record in (0, 1, 2):
        own = [x for x in rows if x[0] == record]
        want |= {(record, own[k][1]): [v for _, _, v in own[k : k + 55]] for k in range(len(own) - 54)}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 37, 700, 10_000])
def test_draw_by_hash_counts(spark, n):
    rows = [(r, k) for r in range(3) for k in range(400)] + [(9, 1)]
    df = spark.createDataFrame(rows, "record_id long, row long").withColumns({"quality": F.when(F.col("row") % 7 == 0, 10).otherwise(90), "without_seizure": F.col("row") % 11 != 0})
    got = sorted(map(tuple, sampling.regular_samples(df, n, 50).select("record_id", "row").collect()))
    good = [(r, k) for r, k in rows if k % 7 and k % 11]
    want = sorted(good, key=lambda x: (x[0], hashlib.md5(f"42:{x[0]}:{x[1]}".encode()).hexdigest(), x[1]))[:n]
    assert got == sorted(want)
    counted = spark.range(n).agg(F.count("*")).scalar()
    assert sorted(map(tuple, sampling.regular_samples(df, counted, 50).select("record_id", "row").collect())) == sorted(want)
