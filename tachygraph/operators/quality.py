"""Signal quality: agreement of two detectors, rules on intervals, moving averages, and time lost to bad quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.operators.intervals import islands

WINDOW_S, STEP_S = 10, 5


def match_peaks(ori: np.ndarray, other: np.ndarray, limit: float) -> tuple[int, int, int]:
    """(matched, left of ori, left of other): each of ``ori`` in order takes the nearest free one within ``limit``, of equal ones the first."""
    free = np.ones(len(other), bool)
    hits = 0
    for p in ori:
        a, b = np.searchsorted(other, p - limit), np.searchsorted(other, p + limit, side="right")
        near = [k for k in range(a, b) if free[k]]
        if near:
            free[min(near, key=lambda k: (abs(other[k] - p), k))] = False
            hits += 1
    return hits, len(ori) - hits, int(free.sum())


def agreement(tp: Column, n1: Column, n2: Column, mode: str = "n_double") -> Column:
    """The score of two detectors with n1 and n2 peaks of which tp match; 0 if either has none."""
    if mode == "simple":
        score = F.try_divide(tp, n1) * 100
    elif mode == "matching":
        score = F.try_divide(2 * tp, n1 + n2)
    elif mode == "n_double":
        score = F.coalesce(F.try_divide(tp, n1 + n2 - tp), F.lit(1.0))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when((n1 == 0) | (n2 == 0), F.lit(0.0)).otherwise(score)


def peaks_in_windows(peaks: DataFrame, at: str, seconds: int = WINDOW_S, step: int = STEP_S) -> DataFrame:
    """Peaks (times in ms) for each window (column ``row``) strictly inside which they lie."""
    first = F.greatest(F.floor((F.col(at) - seconds * 1000) / (step * 1000)) + 1, F.lit(0))
    last = F.ceil(F.col(at) / (step * 1000)) - 1
    return peaks.withColumn("first_", first).withColumn("last_", last).filter("first_ <= last_").withColumn("row", F.explode(F.sequence("first_", "last_"))).drop("first_", "last_")


def rule_inputs(peaks: DataFrame, at: str) -> DataFrame:
    """(record_id, row, n, mean_rate, longest, shortest) of each window, from the peaks strictly inside it."""
    inside = peaks_in_windows(peaks, at)
    w = Window.partitionBy("record_id", "row").orderBy(at)
    gaps = inside.withColumn("gap", (F.col(at) - F.lag(at).over(w)).cast("double"))
    return gaps.groupBy("record_id", "row").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("gap").isNotNull(), 60000.0 / F.greatest("gap", F.lit(1e-6)))).alias("mean_rate"), F.max("gap").alias("longest"),
        F.min("gap").alias("shortest"),
    )


def verdict(n1: Column, n2: Column, rate: Column, longest: Column, shortest: Column, score: Column) -> Column:
    """Quality from 0 to 100: 0 by any rule, else the agreement."""
    ratio = longest / F.greatest(shortest, F.lit(1e-6))
    bad = (n1 < 3) | (n2 < 3) | (rate <= 40) | (rate >= 180) | (longest > 3000) | (ratio >= 2.2)
    return F.when(bad, F.lit(0.0)).otherwise(F.round(100 * score, 2))


def matched(first: DataFrame, second: DataFrame, at: str, limit_ms: float = 150.0) -> DataFrame:
    """(record_id, row, n1, n2, tp): greedy matches in each window; a window holds a few beats, so its arrays are short."""
    left = peaks_in_windows(first, at).groupBy("record_id", "row").agg(F.array_sort(F.collect_list(at)).alias("one"))
    right = peaks_in_windows(second, at).groupBy("record_id", "row").agg(F.array_sort(F.collect_list(at)).alias("two"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [match_peaks(np.asarray(a), np.asarray(b), limit_ms)[0] for a, b in zip(pdf["one"], pdf["two"], strict=True)]
            yield pd.DataFrame({"record_id": pdf["record_id"], "row": pdf["row"], "n1": pdf["one"].map(len), "n2": pdf["two"].map(len), "tp": got})

    both = left.join(right, ["record_id", "row"], "full").withColumn("one", F.coalesce("one", F.array().cast("array<bigint>"))).withColumn("two", F.coalesce("two", F.array().cast("array<bigint>")))
    return both.select("record_id", "row", "one", "two").mapInPandas(run, "record_id long, row long, n1 long, n2 long, tp long")


def quality_series(first: DataFrame, second: DataFrame, at: str = "t_ms") -> DataFrame:
    """(record_id, row, quality): each window that ends before the record's last peak."""
    last = first.groupBy("record_id").agg(F.max(at).alias("last_"))
    rules = rule_inputs(first, at).drop("n")
    rows = matched(first, second, at).join(rules, ["record_id", "row"], "left").join(last, "record_id").filter(F.col("row") * STEP_S * 1000 < F.col("last_") - WINDOW_S * 1000)
    score = agreement(F.col("tp"), F.col("n1"), F.col("n2"))
    return rows.select("record_id", "row", verdict(F.col("n1"), F.col("n2"), F.col("mean_rate"), F.col("longest"), F.col("shortest"), score).alias("quality"))


def spread_over_rows(series: DataFrame, rows: DataFrame, width: int = 60) -> DataFrame:
    """(record_id, row, quality): row r gets the mean of the ``width`` scores from r - 1 on where all exist; other rows 0."""
    w = Window.partitionBy("record_id").orderBy("row").rowsBetween(0, width - 1)
    n = F.max("row").over(Window.partitionBy("record_id")) + 1
    means = series.select("record_id", (F.col("row") + 1).alias("row"), F.avg("quality").over(w).alias("mean_"), F.col("row").alias("i_"), n.alias("n_")).filter(F.col("i_") <= F.col("n_") - width - 1)
    return rows.join(means.select("record_id", "row", "mean_"), ["record_id", "row"], "left").withColumn("quality", F.coalesce("mean_", F.lit(0.0))).drop("mean_")


def binary(rows: DataFrame) -> DataFrame:
    """``rule_inputs`` with ``good``: 1 if rate, longest interval and ratio pass; a window without intervals fails."""
    ratio = F.col("longest") / F.greatest("shortest", F.lit(1e-6))
    good = (F.col("mean_rate") > 40) & (F.col("mean_rate") < 180) & (F.col("longest") <= 3000) & (ratio < 2.2)
    return rows.withColumn("good", F.coalesce(good, F.lit(False)).cast("int"))


def good_fraction(rows: DataFrame, width: int = 60) -> DataFrame:
    """(record_id, row, fraction): share of good rows in each full window that ends at ``row``."""
    w = Window.partitionBy("record_id").orderBy("row").rowsBetween(1 - width, 0)
    return rows.select("record_id", "row", F.avg("good").over(w).alias("fraction"), F.count("*").over(w).alias("n_")).filter(F.col("n_") == width).drop("n_")


def deficiency(rows: DataFrame, threshold: float) -> DataFrame:
    """(record_id, deficiency_s): runs of rows below ``threshold``, five seconds for each further row and 300 for each run."""
    runs = islands(rows.filter(F.col("quality") < threshold), ["record_id"], "row")
    lost = runs.groupBy("record_id").agg(F.sum((F.col("n") - 1) * 5 + 300).cast("long").alias("lost_"))
    return rows.select("record_id").distinct().join(lost, "record_id", "left").select("record_id", F.coalesce("lost_", F.lit(0)).alias("deficiency_s"))
