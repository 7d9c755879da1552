"""Explicit schemas of the data model. Clocks are integer milliseconds from a record's start."""

from __future__ import annotations

from pyspark.sql import types as T

RECORDING = "record_id string, freq int, start_ts timestamp_ntz, chunk int, raw array<float>"
RPEAK = "record_id string, idx int, sample long, t_ms long, cls tinyint"
RR = "record_id long, seq long, left_ms long, right_ms long, rr_ms long"
RECORD = "record_id string, patient_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, path string, unmasked string, seizures array<string>"
CATALOGUE_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("patient_id", "record_start_sen", "record_end_sen", "path_sensor", "seizure_json")])
#: Times in example logs may be anonymised to impossible dates, so they stay strings.
SEIZURE_LOG = "seizure_id int, seizure_start string, seizure_end string, is_correct_type string, recording_center string, has_valid_data boolean, is_event boolean, is_detectable boolean, is_detected boolean, duration_seconds double"
DETECTION_STATUS = ("tp", "fp", "other_seizure", "bad_quality")
RUNS = "run_id string, experiment string, ts timestamp, params map<string,string>, metrics map<string,double>"
