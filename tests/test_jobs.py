"""The jobs over growing input, odd rows and again, and their SQL."""

from __future__ import annotations

import datetime
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import beat_features, common, report_passages
from jobs.queries import ORACLES, QUERIES
from tests.test_oracles import norm

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert got == sorted(tuple(map(norm, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()) and got


def rows_of(df):
    return sorted(tuple(map(norm, r)) for r in df.select(*sorted(df.columns)).collect())


def files_of(folder):
    return sorted(str(p) for p in Path(folder).rglob("*.parquet"))


def test_beats_arrive_in_parts(spark, tmp_path):
    """Late beats, beats that come twice and broken rows: two runs give what one run over all gives; a run without news changes no file."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, parts = tmp_path / "in", {}
    parts[0] = events.filter("event_id % 3 <> 0")
    broken = spark.createDataFrame([(None, datetime.datetime(2024, 1, 2), 1, 5.0), (10**7, None, 1, 5.0), (10**7 + 1, datetime.datetime(2024, 1, 2), None, 5.0), (10**7 + 2, datetime.datetime(2024, 1, 2), 1, None)], "event_id long, ts timestamp_ntz, user_id long, value double")
    parts[1] = events.filter("event_id % 3 = 0 or event_id % 50 = 1").select("event_id", "ts", "user_id", "value").unionByName(broken)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    parts[0].coalesce(1).write.mode("append").parquet(str(source))
    first = beat_features.run(spark, str(source), out, mark)
    assert first["stored"] == parts[0].count() and first["rejected"] == 0 and first["batches"] == 1
    before = rows_of(beat_features.read_features(spark, out))

    parts[1].coalesce(1).write.mode("append").parquet(str(source))
    second = beat_features.run(spark, str(source), out, mark)
    #: Only the new file was read.
    assert second["stored"] + second["rejected"] == parts[1].count() and second["rejected"] == 4
    after = rows_of(beat_features.read_features(spark, out))
    assert after != before

    files = files_of(out)
    third = beat_features.run(spark, str(source), out, mark)
    assert third["batches"] == 0 and files_of(out) == files

    whole = str(tmp_path / "whole")
    beat_features.run(spark, str(source), whole, str(tmp_path / "mark2"), beat_features.Config(max_files=1))
    assert rows_of(beat_features.read_features(spark, whole)) == after


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "value")
    out = str(tmp_path / "out")
    for part in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        number = int(part.first()["event_id"] % 2)
        got = [beat_features.handle_batch(part, number, out, beat_features.Config()) for _ in range(2)]
        assert got[0] == got[1]
    stored = spark.read.parquet(f"{out}/beats").filter("whole = 'true'")
    assert stored.count() == events.count()


def test_detections_are_those_of_the_plain_chain(spark):
    """Windows of a fast rate and good quality, through the chain row by row."""
    import numpy as np

    from tests.test_long_records import loops

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    config = beat_features.Config(records=2, rate=70.5)
    beats = beat_features.beats_of(events, config)
    got = beat_features.features_of(beats, config).toPandas()
    assert got["detected"].sum() > 5
    for _, g in got.groupby(["day", "record"]):
        values = np.full(int(g["row"].max()) + 1, -1)
        fast = (60000 / g["avg"] >= 70.5).astype(int)
        values[g["row"]] = np.where(g["quality"].fillna(0) >= 75, fast, -1)
        assert sorted(g.loc[g["detected"], "row"]) == loops(values)[2]


def test_jobs_leave_no_passing_tables(spark, tmp_path):
    from tachygraph.sources import shared

    kept = shared.stored(spark.range(3), "kept")
    before = list(shared._written)
    beat_features.run(spark, f"{SF}/events.parquet", str(tmp_path / "out"), str(tmp_path / "mark"))
    report_passages.run(spark, f"{SF}/documents.parquet", str(tmp_path / "reports"))
    assert shared._written == before and kept.count() == 3


def test_a_folder_and_a_file_are_both_sources(spark, tmp_path):
    got = [beat_features.run(spark, f"{SF}/events.parquet", str(tmp_path / "a"), str(tmp_path / "ma"))["stored"]]
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    got.append(beat_features.run(spark, str(tmp_path / "events"), str(tmp_path / "b"), str(tmp_path / "mb"))["stored"])
    assert got[0] == got[1] and rows_of(beat_features.read_features(spark, str(tmp_path / "a"))) == rows_of(beat_features.read_features(spark, str(tmp_path / "b")))


def test_reports_with_odd_rows(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    hit = "this was with les. " * 8
    odd = [(None, hit, "en", "s"), (800_001, None, "en", "s"), (800_002, "", None, None), (800_003, hit, None, None), (800_003, hit, None, None), (800_004, hit, "en", "s"), (800_004, "Nothing here at all. " + hit, "en", "s"),
           (800_005, "this was. this with les que. this was this. this was mit. no. no words wanted here.", "en", "s"), (800_006, "x" * 50_000, "en", "s"), (800_007, "this was with. " * 5_000, "en", "s")]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns({c: F.lit(1) for c in ("row", "value", "record_id", "score")})
    docs.write.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "out")
    counts = report_passages.run(spark, str(tmp_path / "docs"), out)
    assert counts["left_out"] == 2 and counts["reports"] == docs.count() - 3
    got = report_passages.read_passages(spark, out)
    mine = sorted(map(tuple, got.filter("doc_id >= 800000").select("doc_id", "first", "last", "n_hits", "lang").collect()))
    assert [m for m in mine if m[0] == 800_003] == [(800_003, 0, 7, 8, "none")]
    assert [m for m in mine if m[0] == 800_004] == [(800_004, 0, 7, 8, "en"), (800_004, 1, 8, 8, "en")]
    #: Too few words: not scored, so no gap is filled across.
    assert [m for m in mine if m[0] == 800_005] == [(800_005, 1, 5, 3, "en")]
    assert [m[1:] for m in mine if m[0] == 800_007] == [(k, min(k + 19, 4999), 20, "en") for k in range(0, 5000, 20)]
    before = rows_of(got)
    assert report_passages.run(spark, str(tmp_path / "docs"), out) == counts and rows_of(report_passages.read_passages(spark, out)) == before
    summary = spark.read.parquet(f"{out}/summary")
    assert summary.agg(F.sum("n_passages")).first()[0] == report_passages.read_passages(spark, out).count() == counts["passages"]
    assert summary.count() == base.filter("text is not null").select("lang", "source").distinct().count() + 2


def test_empty_reports(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "docs"))
    assert report_passages.run(spark, str(tmp_path / "docs"), str(tmp_path / "out")) == {"reports": 0, "left_out": 0, "passages": 0}
    assert report_passages.read_passages(spark, str(tmp_path / "out")).count() == 0


def test_configuration(spark, tmp_path):
    for kind, name in ((beat_features.Config, "beat_features"), (report_passages.Config, "report_passages")):
        assert common.configured(kind, spark, str(ROOT / "jobs" / f"{name}.json")) == kind()
    Path(tmp_path / "x.json").write_text('{"widht": 3}')
    with pytest.raises(ValueError, match="widht"):
        common.configured(report_passages.Config, spark, str(tmp_path / "x.json"))


def test_command_line(spark, tmp_path):
    args = ["--source", f"{SF}/events.parquet", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark"), "--config", "jobs/beat_features.json"]
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    for batches in (1, 0):
        said = subprocess.run([sys.executable, "-m", "jobs.beat_features", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert said.returncode == 0, said.stderr[-2000:]
        assert f"batches {batches}" in said.stderr
    assert beat_features.read_features(spark, str(tmp_path / "out")).count() > 0
