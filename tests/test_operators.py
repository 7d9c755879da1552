"""Discrete operators against sequential models of their prose."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tachygraph.operators import detect, features, intervals, models, quality, rr

V = [800, 810, 790, 1000, 805, 795, 700, 812, 799, 803]


def rows_of(spark, vectors):
    return spark.createDataFrame([(r, k, v) for r, x in enumerate(vectors) for k, v in enumerate(x)], "record_id long, row long, value int")


def back(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("record_id", "row").collect():
        out[r[0]].append(r[2])
    return out


def fill(x, gap=2):
    x, ones = list(x), [k for k, v in enumerate(x) if v == 1]
    for a, b in zip(ones, ones[1:]):
        if 0 < b - a - 1 <= gap and -1 not in x[a:b]:
            x[a:b] = [1] * (b - a)
    return x


def smooth(x, n=3):
    """Each one in turn begins a tile unless it lies in the last one."""
    x, free = list(x), -1
    for k in [k for k, v in enumerate(x) if v == 1]:
        if k < free:
            continue
        if k + n > len(x):
            break
        if -1 in x[k : k + n]:
            continue
        if x[k : k + n] != [1] * n:
            x[k : k + n] = [0] * n
        free = k + n
    return x


def blocks(x, n=3, jump=60):
    out, k = [], 0
    while k + n <= len(x):
        if x[k : k + n] == [1] * n:
            out.append(k)
            k += jump
        else:
            k += 1
    return out


def test_detection_steps(spark):
    rng = random.Random(3)
    vectors = [[rng.choices([1, 0, -1], [5, 4, 1])[0] for _ in range(rng.randint(1, 90))] for _ in range(120)] + [[1] * 130, [1, 1, 0, 0, 1], [1, 0, -1, 1], [0], [-1, -1]]
    df = rows_of(spark, vectors)
    filled = detect.gaps_filled(df)
    assert back(filled, len(vectors)) == [fill(x) for x in vectors]
    smoothed = detect.smoothed(filled)
    assert back(smoothed, len(vectors)) == [smooth(fill(x)) for x in vectors]
    got = [[] for _ in vectors]
    for r in detect.block_starts(smoothed).orderBy("record_id", "start_row").collect():
        got[r[0]].append(r[1])
    assert got == [blocks(smooth(fill(x))) for x in vectors]


@pytest.mark.parametrize(("least", "gap"), [(1, 0), (2, 3), (4, 0), (4, 2), (5, 6)])
def test_detection_steps_with_other_parameters(spark, least, gap):
    rng = random.Random(31)
    vectors = [[rng.choices([1, 0, -1], [6, 4, 1])[0] for _ in range(rng.randint(1, 60))] for _ in range(80)]
    filled = detect.gaps_filled(rows_of(spark, vectors), gap)
    assert back(filled, len(vectors)) == [fill(x, gap) for x in vectors]
    smoothed = detect.smoothed(filled, least)
    assert back(smoothed, len(vectors)) == [smooth(fill(x, gap), least) for x in vectors]
    got = [[] for _ in vectors]
    for r in detect.block_starts(smoothed, least, 7).orderBy("record_id", "start_row").collect():
        got[r[0]].append(r[1])
    assert got == [blocks(smooth(fill(x, gap), least), least, 7) for x in vectors]


def test_shape_features_slide_over_chunks(spark):
    """However records are cut, each window has the features of its own beats."""
    import numpy as np

    from tachygraph.functions.registry import FRACTAL, SPECTRAL

    rng = random.Random(12)
    rows, windows = [], {}
    for record in (0, 1):
        t, beats = 0, []
        for k in range(rng.randint(700, 900)):
            x = rng.randint(500, 1200)
            beats.append((record, k, t, t + x, x))
            t += x
        rows += beats
        for row in range(max((t // 1000 - 300) // 5, 1)):
            windows[record, row] = np.array([b[4] for b in beats if b[2] >= row * 5000 and b[3] <= row * 5000 + 300_000], float)
    df = spark.createDataFrame(rows, "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    one = {(r["record_id"], r["row"]): list(r)[2:] for r in features.shape_features(df).collect()}
    assert one.keys() == windows.keys()
    from tachygraph.functions.fractal import fractal_features
    from tachygraph.functions.spectral import spectral_features

    for key in list(windows)[::7]:
        want = spectral_features(windows[key]) | fractal_features(windows[key])
        assert one[key] == pytest.approx([want[k] for k in (*SPECTRAL, *FRACTAL)], rel=1e-9)
    two = {(r["record_id"], r["row"]): list(r)[2:] for r in features.shape_features(df, chunk_rows=70).collect()}
    assert two.keys() == one.keys() and all(two[k] == pytest.approx(one[k]) for k in one)
    assert features.shape_features(df.limit(0)).count() == 0


def test_regular_samples_across_blocks(spark, monkeypatch):
    from tachygraph.operators import sampling

    rows = spark.createDataFrame([(r, k, 100, True) for r in range(9) for k in range(5)], "record_id long, row long, quality int, without_seizure boolean")
    whole = sorted(map(tuple, sampling.regular_samples(rows, 23, 50).select("record_id", "row").collect()))
    monkeypatch.setattr(sampling, "RECORDS_BLOCK", 2)
    assert sorted(map(tuple, sampling.regular_samples(rows, 23, 50).select("record_id", "row").collect())) == whole
    assert [sum(r == k for r, _ in whole) for k in range(9)] == [5, 5, 5, 5, 3, 0, 0, 0, 0]


def test_slices_or_missing(spark):
    beats = spark.createDataFrame([(0, k, k * 400_000, k * 400_000 + 400_000, 400_000) for k in range(9)], "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    spans = [(0, 0, 400_000), (0, 100, 900_000), (0, 399_999, 2_000_000), (1, 5, 9), (0, 0, 400_000), (0, 3_600_000, 9_000_000)]
    got = sorted(map(tuple, rr.slice_or_missing(spark.createDataFrame(spans, "record_id long, start long, end long"), beats).collect()), key=str)
    want = []
    for r, a, z in spans:
        inside = [(k * 400_000, k * 400_000 + 400_000, 400_000) for k in range(9) if r == 0 and k * 400_000 >= a and k * 400_000 + 400_000 <= z]
        want += [(r, a, z, *x) for x in inside or [(a, z, None)]]
    assert got == sorted(want, key=str)


def test_sessions(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 5, 10, 16)] + [("b", t) for t in (0, 5, 1000)] + [("c", 3)], "k string, t int")
    got = sorted(tuple(r) for r in intervals.sessions(df, ["k"], "t").select("k", "start", "end").collect())
    assert got == [("a", -60, 316), ("b", -60, 305), ("b", 940, 1300)]


def test_band_join(spark):
    rng = random.Random(5)
    a = [(rng.randint(0, 2), rng.randint(0, 4000)) for _ in range(80)]
    b = [(rng.randint(0, 2), rng.randint(0, 4000)) for _ in range(80)]
    got = intervals.band_join(spark.createDataFrame(a, "k int, x long"), spark.createDataFrame(b, "k int, y long"), ["k"], "x", "y", 100)
    assert sorted((r.k, r.x, r.y) for r in got.collect()) == sorted((k, x, y) for k, x in a for j, y in b if k == j and abs(x - y) <= 100)


def test_deficiency(spark):
    rows = spark.createDataFrame([(0, k, 0 if k in (3, 4, 10) else 100) for k in range(20)], "record_id long, row long, quality int")
    assert quality.deficiency(rows, 50).first()[1] == 605


def test_hand_vector(spark):
    left = [sum(V[:k]) for k in range(len(V))]
    df = spark.createDataFrame([(0, k, left[k], left[k] + v, v) for k, v in enumerate(V)], "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    got = features.time_features(df, 30).first().asDict()
    want = {"avg": 811.4, "sd": 70.0745317502, "skew": 1.5424637287, "kurt": 2.8872496502, "rmssd": 107.7440382470, "rmssd_dt": 107.8830395825, "nnx": 4, "pnnx": 4 / 9, "triangular_index": 10 / 3, "quantile_25": 796, "quantile_50": 801.5, "quantile_75": 808.75, "sd1": 76.1861754739, "sd2": 63.3762310860, "csi": 0.8318599889, "csim": 210.8806035575, "cvi": 4.8879225639, "slope": 0.3, "hr_diff": -4, "hr_diff_filtered": -1.5}
    assert all(got[k] == pytest.approx(v, abs=1e-9, rel=1e-9) for k, v in want.items())


def test_scaling_metamorphic(spark):
    rng = random.Random(8)
    x = [rng.randint(600, 1100) for _ in range(60)]
    make = lambda v: spark.createDataFrame([(0, k, sum(v[:k]), sum(v[: k + 1]), a) for k, a in enumerate(v)], "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    one, two = features.time_features(make(x), 300).first(), features.time_features(make([2 * a for a in x]), 300).first()
    assert all(two[k] == pytest.approx(2 * one[k]) for k in ("avg", "sd", "rmssd")) and all(two[k] == pytest.approx(one[k]) for k in ("skew", "kurt", "csi"))


def test_chunks_make_no_difference(spark):
    rng = random.Random(2)
    x = [rng.randint(600, 1100) for _ in range(100)]
    df = spark.createDataFrame([(r, k, sum(x[:k]), sum(x[: k + 1]), a) for r in (0, 1) for k, a in enumerate(x)], "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    rows = lambda n: sorted(map(str, features.looked_back(df, n).collect()))
    assert rows(13) == rows(8) == rows(1000)


def test_edges(spark):
    empty = spark.createDataFrame([], "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    assert features.time_features(empty, 30).count() == 0 and rr.validated(empty).count() == 0
    flat = spark.createDataFrame([(0, k, 800 * k, 800 * k + 800, 800) for k in range(20)], "record_id long, seq long, left_ms long, right_ms long, rr_ms long")
    got = features.time_features(flat, 30).first()
    assert got["sd"] == 0 and got["csi"] is None and got["skew"] is None
    with pytest.raises(TypeError):
        rr.from_timestamps(spark.createDataFrame([(0, 1.5)], "record_id long, t_ms double"))


def test_models(spark):
    with pytest.raises(ValueError):
        models.create(models.ModelConfig(0, "InceptionTime"))
    with pytest.raises(ValueError):
        models.ModelConfig(0, input_shape=(1, 2, 3))
    with pytest.raises(ValueError):
        quality.agreement(F.lit(1), F.lit(1), F.lit(1), "other")


def test_robust_parameters_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    columns = {"a": rng.normal(size=501), "b": np.round(rng.exponential(size=501) * 3), "c": np.full(501, 7.0), "d": np.concatenate([np.zeros(500), [1e9]]), "e": rng.normal(size=501)}
    rows = [tuple(float(columns[c][k]) if (c, k) != ("e", 3) else None for c in columns) for k in range(501)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    for bins in (3, 4096):
        got = {r["feature"]: (r["centre"], r["scale"]) for r in models.robust_parameters(df, list(columns), bins).collect()}
        for c, x in columns.items():
            x = np.delete(x, 3) if c == "e" else x
            q = np.percentile(x, [25, 50, 75])
            assert got[c] == pytest.approx((q[1], q[2] - q[0] or 1.0))
    assert models.robust_parameters(df.limit(0), ["a"]).count() == 0


def test_models_are_stored_and_loaded(spark, tmp_path):
    rng = random.Random(4)
    rows = [(0, k, [[rng.gauss(k % 2 * 2, 1) for _ in range(3)] for _ in range(4)], float(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "record_id long, row long, x array<array<double>>, label double")
    config = models.ModelConfig(0, "Transformer", input_shape=(4, 3), params={"d_model": 8, "d_ff": 16, "n_heads": 2})
    model = models.create(config).fit(df)
    scores = {r["row"]: r["score"] for r in model.predict(df).collect()}
    assert sum(scores[k] for k in range(1, 60, 2)) / 30 > sum(scores[k] for k in range(0, 60, 2)) / 30 + 0.3
    model.save(str(tmp_path / "t"))
    again = models.create(config).load_internals(str(tmp_path / "t"))
    assert {r["row"]: r["score"] for r in again.predict(df).collect()} == pytest.approx(scores)
    flat = df.selectExpr("record_id", "row", "x[0][0] as a", "x[1][0] as b", "label")
    forest = models.create(models.ModelConfig(0, "RandomForest", params={"n_estimators": 5})).fit(flat, ["a", "b"])
    forest.save(str(tmp_path / "f"))
    loaded = models.create(models.ModelConfig(0, "RandomForest")).load_internals(str(tmp_path / "f"))
    key = lambda m: sorted((r["row"], round(r["score"], 9)) for r in m.predict(flat).select("row", "score").collect())
    assert key(loaded) == key(forest)


def test_corrected_beats_are_written_back(spark, tmp_path):
    from tachygraph.sources import matfile, recordings

    (tmp_path / "a.mat").write_bytes(matfile.dumps({"raw_data": list(range(300)), "frequency": [100], "r_peaks": [5, 250]}))
    (tmp_path / "b.mat").write_bytes(matfile.dumps({"raw_data": list(range(150)), "frequency": [100], "r_peaks": [7]}))
    recs = recordings.read_mat(spark, str(tmp_path))
    recordings.write_corrected(recs.drop("error"), spark.createDataFrame([("a", 2.0), ("a", 0.5), ("x", 1.0)], "record_id string, t_s double"), str(tmp_path / "out"))
    assert {r["record_id"]: r["r_peaks"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": [50, 200], "b": [7]}
    chunks = {(r["record_id"], r["chunk"]): (r["start_sample"], r["raw"]) for r in recordings.read_mat_chunks(spark, str(tmp_path), 1).collect()}
    assert len(chunks) == 5 and chunks["b", 1] == (100, [float(x) for x in range(100, 150)])
    again = recordings.chunk_signal(recs, 100).collect()
    assert {(r["record_id"], r["chunk"]): (r["start_sample"], r["raw"]) for r in again} == chunks


def test_labelled_beats_and_tensor(spark):
    from tachygraph.queries import QUERIES
    from tachygraph.sources import fixtures

    sf = "/root/testdata/sf0.001"
    beats = fixtures.rr(spark, sf)
    want = {(r["record_id"], r["right_ms"]) for r in beats.collect()}
    got = [(r["record_id"], r["sample"] / 128 * 1000) for r in QUERIES["auto_labelled"](spark, sf).collect()]
    near = [min(abs(t - w) for r, w in want if r == record) for record, t in got]
    assert len(want) * 0.9 <= len(got) <= len(want) * 1.1 and sum(x < 40 for x in near) >= 0.9 * len(near)
    rows = QUERIES["feature_tensor"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all((r["n_steps"], r["n_features"]) == (55, 38) for r in rows)
    step = {(r["record_id"], r["row"]): r for r in QUERIES["feature_steps"](spark, "/root/testdata/sf0.01").collect()}
    first = {(r["record_id"], r["row"]): r for r in features.time_features(fixtures.rr(spark, "/root/testdata/sf0.01"), 60).collect()}
    assert all(r["mean_avg"] == pytest.approx(step[r["record_id"], r["row"]]["mean_avg"], abs=1e-5) and r["first_sd1"] == pytest.approx(first[r["record_id"], r["row"]]["sd1"], abs=1e-5) for r in rows)


def test_bad_status_fails(spark):
    df = spark.createDataFrame([(1, "maybe")], "id int, s string")
    with pytest.raises(Exception, match="unknown status"):
        detect.with_status(df, F.col("s")).collect()


def test_catalogue_and_recordings(spark, tmp_path):
    import json

    import numpy as np

    from tachygraph.operators.peaks import auto_label
    from tachygraph.sources import catalogue, matfile, recordings

    (tmp_path / "c.json").write_text(json.dumps({"7": {"patient_id": "p", "record_start_sen": "2024-01-01", "record_end_sen": "2024-01-02", "path_sensor": "x", "seizure_json": "a\\b"}}))
    got = catalogue.read_catalogue(spark, str(tmp_path / "c.json"))
    assert catalogue.seizure_info(got, "7").first()["seizure_json"] == "a/b" and catalogue.location_of("a\\b\\c") == "c"
    t = np.arange(10 * 128) / 128
    signal = sum(np.exp(-((t - k - 0.5) ** 2) / (2 * 0.015**2)) for k in range(10))
    (tmp_path / "m").mkdir()
    (tmp_path / "m/r1.mat").write_bytes(matfile.dumps({"raw_data": signal, "frequency": [128], "r_peaks": [64.9, 192.0], "ts": [0.0]}))
    (tmp_path / "m/bad.mat").write_bytes(b"nothing")
    rows = {r["record_id"]: r for r in recordings.read_mat(spark, str(tmp_path / "m")).collect()}
    assert rows["r1"]["r_peaks"] == [64, 192] and rows["bad"]["error"]
    chunks = recordings.chunk_signal(recordings.read_mat(spark, str(tmp_path / "m")).filter("error is null"), 640)
    assert chunks.count() == 2 and auto_label(chunks, "wqrs").count() >= 8
    with pytest.raises(ValueError):
        recordings.write_records(got, "x.mat")


def test_live_rates(spark, tmp_path):
    from tachygraph.streaming.live import live_rates

    df = spark.range(60).selectExpr("id % 2 as record_id", "timestamp_seconds(1704067200 + id) as ts", "800L as rr_ms")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live_rates(stream).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").filter("mean_rate = 75").count() > 0
