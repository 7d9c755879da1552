"""Detections against annotated onsets: tolerance matches, and metrics by record, patient and cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachygraph.operators.intervals import band_join

TOLERANCE_MS = 300_000


def matches(onsets: DataFrame, found: DataFrame, by: str = "record_id", tolerance: int = TOLERANCE_MS, x: str = "onset_ms", y: str = "start_ms") -> DataFrame:
    """All pairs of an onset and a detection of one record whose starts are at most ``tolerance`` apart."""
    return band_join(onsets, found, [by], x, y, tolerance)


def flagged_onsets(onsets: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Onsets with ``is_detected``."""
    hit = pairs.select(key).distinct().withColumn("hit_", F.lit(True))
    return onsets.join(hit, key, "left").withColumn("is_detected", F.coalesce("hit_", F.lit(False))).drop("hit_")


def flagged_detections(found: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Detections with ``result``: tp or fp."""
    hit = pairs.select(key).distinct().withColumn("hit_", F.lit("tp"))
    return found.join(hit, key, "left").withColumn("result", F.coalesce("hit_", F.lit("fp"))).drop("hit_")


def record_metrics(records: DataFrame, found: DataFrame, lost: DataFrame) -> DataFrame:
    """(record_id, patient_id, record_duration_s, deficiency_s, n_det_fp, n_det_tp); records without detections have 0."""
    counts = found.groupBy("record_id").agg(F.count_if(F.col("result") == "fp").alias("fp_"), F.count_if(F.col("result") == "tp").alias("tp_"))
    out = records.join(counts, "record_id", "left").join(lost, "record_id", "left")
    return out.select(
        "record_id", "patient_id", "record_duration_s", F.coalesce("deficiency_s", F.lit(0)).alias("deficiency_s"), F.coalesce("fp_", F.lit(0)).alias("n_det_fp"),
        F.coalesce("tp_", F.lit(0)).alias("n_det_tp"),
    )


def patient_metrics(records: DataFrame, onsets: DataFrame) -> DataFrame:
    """(patient_id, n_tp, n_fn, n_fp, days, ppv, sensitivity, f1, far): hits and misses of seizures, false alarms of detections; 0 for 0 / 0."""
    r = records.groupBy("patient_id").agg(F.sum("n_det_fp").alias("n_fp"), (F.sum("record_duration_s") / 86400.0).alias("days"))
    s = onsets.groupBy("patient_id").agg(F.count_if("is_detected").alias("n_tp"), F.count_if(~F.col("is_detected")).alias("n_fn"))
    j = r.join(s, "patient_id", "full").na.fill(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = j.withColumn("ppv", zero(F.try_divide("n_tp", F.col("n_tp") + F.col("n_fp")))).withColumn("sensitivity", zero(F.try_divide("n_tp", F.col("n_tp") + F.col("n_fn"))))
    j = j.withColumn("f1", zero(F.try_divide(2 * F.col("ppv") * F.col("sensitivity"), F.col("ppv") + F.col("sensitivity")))).withColumn("far", zero(F.try_divide("n_fp", "days")))
    return j.select("patient_id", "n_tp", "n_fn", "n_fp", "days", "ppv", "sensitivity", "f1", "far")


def cohort_metrics(patients: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of ``by``: total sensitivity in percent, total false alarms a day, medians over patients and totals."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return patients.groupBy(*by).agg(
        zero(100 * F.try_divide(F.sum("n_tp"), F.sum("n_tp") + F.sum("n_fn"))).alias("Total_Sensitivity"), zero(F.try_divide(F.sum("n_fp"), F.sum("days"))).alias("Total_FAR"),
        F.median("f1").alias("med_F1"), F.median("far").alias("med_FAR"), F.median("n_fp").alias("med_FP"), F.median("ppv").alias("med_PPV"), F.median("sensitivity").alias("med_Sensitivity"),
        F.sum("n_tp").alias("n_tp"), F.sum("n_fn").alias("n_fn"), F.sum("n_fp").alias("n_fp"), F.sum(F.col("n_tp") + F.col("n_fn")).alias("n_seizures"),
    )


def seizure_rows(onsets: DataFrame) -> DataFrame:
    """(patient_id, record_id, seizure_id, is_detected) of flagged onsets."""
    return onsets.select("patient_id", "record_id", "seizure_id", "is_detected")


def detection_rows(found: DataFrame, records: DataFrame) -> DataFrame:
    """(patient_id, record_id, result) of flagged detections."""
    return found.join(records.select("record_id", "patient_id"), "record_id", "left").select("patient_id", "record_id", "result")


def seizure_evaluations(seizures: DataFrame) -> DataFrame:
    """Seizures with the five flags of an evaluation, all false where they are not given."""
    flags = ("is_correct_type", "has_valid_data", "is_event", "is_detectable", "is_detected")
    return seizures.withColumns({f: F.coalesce(F.col(f), F.lit(False)) if f in seizures.columns else F.lit(False) for f in flags})
