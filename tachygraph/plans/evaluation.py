"""Scores to metrics in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tachygraph.operators.detect import detect
from tachygraph.operators.evaluate import cohort_metrics, flagged_detections, flagged_onsets, matches, patient_metrics, record_metrics
from tachygraph.operators.quality import deficiency


def evaluate(rows: DataFrame, scores: DataFrame, onsets: DataFrame, records: DataFrame, valid: Column, threshold: float | Column, bad_quality: float) -> dict[str, DataFrame]:
    """The tables ``seizures``, ``detections``, ``records``, ``patients`` and ``cohort``.

    rows: (record_id, row, quality, ...); scores: (record_id, i, score) of the valid rows; onsets: (onset_id, record_id,
    patient_id, onset_ms); records: (record_id, patient_id, record_duration_s).
    """
    found = detect(rows, scores, valid, threshold).withColumn("start_ms", F.col("start_s") * 1000).withColumn("det_id", F.concat_ws(":", "record_id", "start_s"))
    pairs = matches(onsets.select("onset_id", "record_id", "onset_ms"), found.select("det_id", "record_id", "start_ms"))
    seizures, detections = flagged_onsets(onsets, pairs, "onset_id"), flagged_detections(found, pairs, "det_id")
    by_record = record_metrics(records, detections, deficiency(rows, bad_quality))
    by_patient = patient_metrics(by_record, seizures)
    return {"seizures": seizures, "detections": detections, "records": by_record, "patients": by_patient, "cohort": cohort_metrics(by_patient)}


def sweep(rows: DataFrame, scores: DataFrame, onsets: DataFrame, records: DataFrame, valid: Column, thresholds: list[float], bad_quality: float) -> DataFrame:
    """(threshold, ...): the cohort's metrics at each threshold, in one plan; the tables are those of ``evaluate``, their ids not negative.

    Every id becomes one for each threshold, so records are detected on side by side and nothing is asked of the driver between them.
    """
    n = len(thresholds)
    each = lambda df, *ids: df.withColumn("k_", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({c: F.col(c) * n + F.col("k_") for c in ids}).drop("k_")
    own = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), (F.col("record_id") % n + 1).cast("int"))
    onsets, records = each(onsets, "record_id", "patient_id", "onset_id"), each(records, "record_id", "patient_id")
    found = evaluate(each(rows, "record_id"), each(scores, "record_id"), onsets, records, valid, own, bad_quality)
    patients = found["patients"].withColumn("threshold", F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), (F.col("patient_id") % n + 1).cast("int")))
    return cohort_metrics(patients, "threshold")
