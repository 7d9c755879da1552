"""Sources, sinks and messages, against files written here."""

from __future__ import annotations

import json
import logging
import random
import re

import numpy as np
import pytest

from tachygraph.functions import logs, scalars
from tachygraph.operators import models
from tachygraph.plans.study import pareto, run_study
from tachygraph.sources import catalogue, matfile, recordings


def test_catalogue_and_lookups(spark, tmp_path):
    entries = {str(k): {"patient_id": f"p{k % 2}", "record_start_sen": "2024-01-01", "record_end_sen": "2024-01-02", "path_sensor": f"x/{k}", "seizure_json": f"a\\b{k}"} for k in range(4)}
    (tmp_path / "c.json").write_text(json.dumps(entries))
    got = catalogue.read_catalogue(spark, str(tmp_path / "c.json"))
    assert {r["seizure_id"]: r["path_sensor"] for r in got.collect()} == {k: v["path_sensor"] for k, v in entries.items()}
    assert catalogue.seizure_info(got, "3").first()["seizure_json"] == "a/b3" and catalogue.seizure_info(got, "9").count() == 0
    assert [catalogue.location_of(p) for p in ("a/b", "a\\b\\", "b")] == ["b", "b", "b"]
    recs = spark.createDataFrame([("r1", "p"), ("r2", "q")], "record_id string, patient_id string")
    sound = spark.createDataFrame([("r1", 100)], "record_id string, freq int")
    assert catalogue.with_recording(recs, None).count() == 2
    assert {r["record_id"]: r["freq"] for r in catalogue.with_recording(recs, sound).collect()} == {"r1": 100, "r2": None}
    assert catalogue.with_recording(recs, sound, "inner").count() == 1


def test_logs_and_summaries(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        "seizure_id,seizure_start,seizure_end,is_correct_type,recording_center,has_valid_data,is_event,is_detectable,is_detected,duration_seconds\n"
        "1,2024-01-01 10:00:00,2024-13-77 99:00:00,x,UKA,true,true,false,true,12.5\n2,,,,,,,,,\n"
    )
    rows = {r["seizure_id"]: r for r in catalogue.read_seizure_log(spark, str(tmp_path / "log.csv")).collect()}
    assert rows[1]["start_ts"] is not None and rows[1]["end_ts"] is None and rows[1]["seizure_end"].startswith("2024-13") and rows[2]["is_detected"] is None
    (tmp_path / "s.csv").write_text("run,n_tp,med_F1,Total_FAR,model\na,22,10.9,,T\nb,x,,3.5,\n")
    got = {r["run"]: r for r in catalogue.read_summary(spark, str(tmp_path / "s.csv")).collect()}
    assert (got["a"]["n_tp"], got["a"]["Total_FAR"], got["b"]["n_tp"], got["b"]["Total_FAR"], got["b"]["model"]) == (22.0, None, None, 3.5, None)


def test_tables_runs_and_models(spark, tmp_path):
    table = spark.createDataFrame([(1, 2, True, 99.5)], "record_id long, row long, without_nan boolean, quality double")
    catalogue.write_filter_table(table, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).collect() == table.collect()
    for k in range(2):
        catalogue.log_run(spark, str(tmp_path / "runs"), f"r{k}", "e", {"a": str(k)}, {"m": k / 2})
    runs = {r["run_id"]: r for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert runs["r1"]["params"] == {"a": "1"} and runs["r1"]["metrics"] == {"m": 0.5} and len(runs) == 2
    rows = spark.createDataFrame([(float(k), float(k % 2 == 0)) for k in range(40)], "a double, label double")
    model = models.create(models.ModelConfig(0, "Logistic")).fit(rows, ["a"])
    catalogue.save_model(model.stages, str(tmp_path / "m"))
    again = catalogue.load_model(str(tmp_path / "m")).transform(rows).select("prediction").collect()
    assert again == model.stages.transform(rows).select("prediction").collect()
    assert set(models.MODELS) == {"RandomForest", "Logistic", "Transformer"}
    assert models.create(models.ModelConfig(0, "Logistic")).predict(rows).filter("score <> 0").count() == 0


def test_records_and_recordings(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, "f"), ("r2", 2, "g")], "record_id string, x int, source_file string")
    recordings.write_records(df, str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p"))
    assert set(got.columns) == {"x", "record_id"} and got.filter("record_id = 'r2'").first()["x"] == 2
    (tmp_path / "out").mkdir()
    sound = spark.createDataFrame([("r1", 50, [3, 9], [0.0], [1.0, 2.5])], "record_id string, freq int, r_peaks array<long>, ts array<double>, raw array<double>")
    recordings.write_mat(sound, str(tmp_path / "out"))
    back = recordings.read_mat(spark, str(tmp_path / "out")).first()
    assert (back["record_id"], back["freq"], back["r_peaks"], back["raw"], back["start_sample"]) == ("r1", 50, [3, 9], [1.0, 2.5], 3)
    (tmp_path / "out/none.mat").write_bytes(matfile.dumps({"raw_data": [1.0], "frequency": [10]}))
    assert recordings.read_mat(spark, str(tmp_path / "out")).filter("record_id = 'none'").first()["start_sample"] == 0


def test_messages(spark, caplog):
    with caplog.at_level(logging.INFO, "tachygraph"):
        logs.say(True, "one")
        logs.say(False, "two")
        logs.timed("three")
        assert logs.said_if(True, True, "four") and not logs.said_if(False, True, "five") and logs.said_if(True, False, "six")
    said = [r.getMessage() for r in caplog.records]
    assert said[0] == "one" and said[2] == "four" and len(said) == 3 and re.fullmatch(r"\d{4}_\d\d_\d\d__\d\d_\d\d_\d\d three", said[1])
    assert re.fullmatch(r"\d{4}_\d\d_\d\d__\d\d_\d\d_\d\d_\d{6}", scalars.now_microseconds()) and scalars.clean_name("a b/c") == "a_b_c"
    assert "7" in logs.preview(spark.range(9), 8) and "8" not in logs.preview(spark.range(9), 8).split("id")[1].split("7")[-1]
    logs.set_seed(5)
    first = random.random(), np.random.rand()
    logs.set_seed(5)
    assert first == (random.random(), np.random.rand())


def test_study(spark):
    seen = []

    def objective(params):
        seen.append(params["a"])
        return params["a"] % 5, params["a"] // 5

    got = run_study(spark, objective, [{"a": k} for k in range(30)])
    assert seen == list(range(20)) and got.count() == 20
    assert [r["trial"] for r in pareto(got).collect()] == [4]


@pytest.mark.parametrize("bins", [1, 3, 1024])
def test_pareto_front(spark, monkeypatch, bins):
    from tachygraph.plans import study

    monkeypatch.setattr(study, "BINS", bins)
    rng = random.Random(bins)
    rows = [(k, rng.randint(0, 40) * 1.0, rng.randint(0, 40) * 1.0) for k in range(120)]
    got = study.pareto(spark.createDataFrame(rows, "trial int, Total_Sensitivity double, Total_FAR double")).collect()
    want = [k for k, s, f in rows if not any(a >= s and b <= f and (a > s or b < f) for _, a, b in rows)]
    assert sorted(r["trial"] for r in got) == want
