"""Windowed variability features.

Windows lie every STEP_MS from a record's start. A beat is sent to the windows that hold it by arithmetic, not by a join;
what looks back (differences, running medians) is computed once for each beat and counts in a window if all that it looks
back on is inside. One shuffle by window then gives all time-domain and geometric features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.functions.fractal import fractal_batch
from tachygraph.functions.registry import FEATURES_30, FEATURES_60, FRACTAL, SPECTRAL
from tachygraph.functions.spectral import spectral_batch
from tachygraph.operators.scans import numbered, overlapping

STEP_MS = 5000
MEDIAN_BEATS = 7
CHUNK_BEATS = 50_000
SHAPE_ROWS = 120
#: Feature rows in a block from which tensors are sliced.
BLOCK_ROWS = 512
#: Fixed values of the triangular index: bin width and the last bin's index.
BIN_MS, LAST_BIN = 7.8125, 318


def window_counts(rr: DataFrame, seconds: int) -> DataFrame:
    """(record_id, rows): windows of a record: one for each step of its duration less the width, one at least."""
    last = F.max("right_ms")
    return rr.groupBy("record_id").agg(F.greatest(F.floor((F.floor(last / 1000) - seconds) / 5), F.lit(1)).cast("long").alias("rows"))


def in_windows(rr: DataFrame, seconds: int) -> DataFrame:
    """``rr``'s rows for each window (column ``row``) that holds them whole."""
    first = F.greatest(F.ceil((F.col("right_ms") - seconds * 1000) / STEP_MS), F.lit(0))
    last = F.least(F.floor(F.col("left_ms") / STEP_MS), F.col("rows") - 1)
    counted = rr.join(window_counts(rr, seconds), "record_id").withColumn("first_", first).withColumn("last_", last).filter("first_ <= last_")
    return counted.withColumn("row", F.explode(F.sequence("first_", "last_"))).drop("first_", "last_", "rows")


def looked_back(rr: DataFrame, chunk: int = CHUNK_BEATS) -> DataFrame:
    """``rr`` with the interval before, the running median of MEDIAN_BEATS and the one before, and where each begins.

    Records are cut into chunks of beats, each with a few beats of the chunk before, so that a long record is many tasks' work.
    """
    own = F.floor(F.col("seq") / chunk)
    reach = F.when(F.col("seq") % chunk >= chunk - MEDIAN_BEATS, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rr.withColumn("own_", own).withColumn("chunk_", F.explode(reach))
    w = Window.partitionBy("record_id", "chunk_").orderBy("seq")
    run = w.rowsBetween(1 - MEDIAN_BEATS, 0)
    out = rows.withColumn("prev", F.lag("rr_ms").over(w)).withColumn("prev_left", F.lag("left_ms").over(w))
    out = out.withColumn("med", F.percentile("rr_ms", F.lit(0.5)).over(run)).withColumn("med_left", F.lag("left_ms", MEDIAN_BEATS - 1).over(w))
    out = out.withColumn("prev_med", F.lag("med").over(w)).withColumn("prev_med_left", F.lag("left_ms", MEDIAN_BEATS).over(w))
    return out.filter("chunk_ = own_").drop("own_", "chunk_")


def _pair(sd: Column, sd_diff: Column) -> tuple[Column, Column]:
    inner = 2 * sd * sd - sd_diff * sd_diff / 2
    return sd_diff / F.sqrt(F.lit(2.0)), F.when(inner >= 0, F.sqrt(inner))


def _most_equal(values: Column) -> Column:
    """How often the most frequent value of a sorted array stands in it; a window's array is short."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(x.cast("long").alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(values, start, step, lambda a: a["best"])


def time_features(rr: DataFrame, seconds: int) -> DataFrame:
    """(record_id, row, n_beats, ...): the 28 time-domain and geometric features of each window with beats."""
    rows = in_windows(looked_back(rr), seconds)
    start = F.col("row") * STEP_MS
    d = F.when(F.col("prev_left") >= start, F.col("rr_ms") - F.col("prev")).cast("double")
    m = F.when(F.col("med_left") >= start, F.col("med"))
    md = F.when(F.col("prev_med_left") >= start, F.col("med") - F.col("prev_med"))
    x = F.col("rr_ms").cast("double")
    rows = rows.withColumn("x", x).withColumn("d", d).withColumn("m", m).withColumn("md", md)
    pair = F.when(F.col("d").isNotNull(), F.col("rr_ms") + F.col("prev"))
    pair_m = F.when(F.col("md").isNotNull(), F.col("med") + F.col("prev_med"))
    seq_if = lambda c: F.when(c.isNotNull(), F.col("seq"))
    slope = F.regr_slope("x", F.col("seq").cast("double"))
    bin_ = F.when(F.col("rr_ms").between(0, BIN_MS * (LAST_BIN + 1)), F.least(F.floor(F.col("rr_ms") / BIN_MS), F.lit(LAST_BIN)))
    a = rows.groupBy("record_id", "row").agg(
        F.count("*").alias("n_beats"), F.avg("x").alias("avg"), F.stddev_pop("x").alias("sd"), F.var_pop("x").alias("variance"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.avg("d").alias("d_avg"), F.avg(F.col("d") * F.col("d")).alias("d_sq"), F.count("d").alias("n_d"), slope.alias("trend"),
        F.count_if(F.abs("d") >= 50).alias("nnx"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop("d").alias("sd_d"),
        F.regr_slope("m", F.col("seq").cast("double")).alias("slope"), F.stddev_pop("m").alias("sd_m"), F.stddev_pop("md").alias("sd_md"), F.count("m").alias("n_m"),
        F.max_by(pair, seq_if(pair)).alias("last_two"), F.min_by(pair, seq_if(pair)).alias("first_two"),
        F.max_by(pair_m, seq_if(pair_m)).alias("last_m"), F.min_by(pair_m, seq_if(pair_m)).alias("first_m"), F.sort_array(F.collect_list(bin_)).alias("bins"),
    )
    a = a.withColumn("triangular_index", F.try_divide(F.size("bins"), _most_equal(F.col("bins")))).drop("bins")
    sd1, sd2 = _pair(F.col("sd"), F.col("sd_d"))
    fsd1, fsd2 = _pair(F.col("sd_m"), F.col("sd_md"))
    csi, csim = F.try_divide(F.col("sd2"), F.col("sd1")), F.try_divide(F.pow(4 * F.col("sd2"), F.lit(2)), 4 * F.col("sd1"))
    a = a.withColumn("sd1", sd1).withColumn("sd2", sd2).withColumn("fsd1", fsd1).withColumn("fsd2", fsd2)
    fcsi, fcsim = F.try_divide(F.col("fsd2"), F.col("fsd1")), F.try_divide(F.pow(4 * F.col("fsd2"), F.lit(2)), 4 * F.col("fsd1"))
    product = 16 * F.col("sd1") * F.col("sd2")
    hr = F.when(F.col("n_beats") >= 3, (F.col("last_two") - F.col("first_two")) / 2).otherwise(F.lit(0.0))
    hrf = F.when(F.col("n_m") >= 3, (F.col("last_m") - F.col("first_m")) / 2).otherwise(F.lit(0.0))
    return a.select(
        "record_id", "row", "n_beats", "avg", "sd", "rmssd", F.sqrt(F.greatest(F.col("d_sq") - 2 * F.col("trend") * F.col("d_avg") + F.col("trend") * F.col("trend"), F.lit(0.0))).alias("rmssd_dt"),
        "skew", "kurt", F.try_divide(
            F.col("nnx"), F.col("n_d"),
        ).alias("pnnx"), "nnx", "triangular_index", F.col("q")[0].alias("quantile_25"), F.col("q")[1].alias("quantile_50"), F.col("q")[2].alias("quantile_75"), "variance",
        csi.alias("csi"), csim.alias("csim"), F.when(product > 0, F.log10(product)).alias("cvi"), "sd1", "sd2", (F.col("slope") * csi).alias("csi_slope"), (F.col("slope") * csim).alias("csim_slope"),
        fcsi.alias("csi_filtered"), fcsim.alias("csim_filtered"), (F.col("slope") * fcsi).alias("csi_filtered_slope"), (F.col("slope") * fcsim).alias("csim_filtered_slope"),
        hr.alias("hr_diff"), (hr * F.col("slope")).alias("hr_diff_slope"), hrf.alias("hr_diff_filtered"), (hrf * F.col("slope")).alias("hr_diff_filtered_slope"), "slope",
    )


def shape_features(rr: DataFrame, seconds: int = 300, chunk_rows: int = SHAPE_ROWS) -> DataFrame:
    """(record_id, row, ...): the six spectral and four multifractal features of each window with beats, by numpy.

    A record is cut into chunks of ``chunk_rows`` windows. A beat goes once to each chunk whose windows may hold it (two at most, as
    long as a chunk spans a window), and the windows slide over the chunk's sorted beats.
    """
    names = (*SPECTRAL, *FRACTAL)
    step, width = chunk_rows * STEP_MS, seconds * 1000
    first = F.greatest(F.floor((F.col("right_ms") - width) / step), F.lit(0))
    last = F.floor(F.col("left_ms") / step)
    beats = rr.join(window_counts(rr, seconds), "record_id").select(
        "record_id", "rows", "seq", "left_ms", "right_ms", F.col("rr_ms").cast("double").alias("x"), F.explode(F.sequence(first, last)).alias("chunk"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        record, chunk = key
        pdf = pdf.sort_values("seq")
        left, right, x = (pdf[c].to_numpy() for c in ("left_ms", "right_ms", "x"))
        rows = np.arange(chunk * chunk_rows, min((chunk + 1) * chunk_rows, int(pdf["rows"].iloc[0])))
        a, b = np.searchsorted(left, rows * STEP_MS), np.searchsorted(right, rows * STEP_MS + width, side="right")
        held = b > a
        rows, windows = rows[held], [x[i:j] for i, j in zip(a[held], b[held], strict=True)]
        if not len(rows):
            return pd.DataFrame({"record_id": [], "row": [], **{k: [] for k in names}})
        values = np.hstack([spectral_batch(windows), fractal_batch(windows)])
        return pd.DataFrame({"record_id": record, "row": rows, **{k: values[:, i] for i, k in enumerate(names)}})

    return beats.groupBy("record_id", "chunk").applyInPandas(run, f"record_id long, row long, {', '.join(f'{k} double' for k in names)}")


def _stepped(features: DataFrame, steps: int, block: int) -> DataFrame:
    """(record_id, row, first, steps): each row's values as a struct, and those of the ``steps`` rows from it on; rows with fewer after them have none.

    A record's rows are stored in blocks of ``block`` with the rows that the last of them needs after it, so a row is shuffled and held
    once or twice; a step's array is a slice of its block's, made where it is used.
    """
    values = F.struct(*[c for c in features.columns if c not in ("record_id", "row")])
    ranked = numbered(features.select("record_id", "row", values.alias("x")), ["record_id"], "row", "k_")
    near = overlapping(ranked, "k_", ahead=steps - 1, width=block)
    blocks = near.groupBy("record_id", "chunk_").agg(F.array_sort(F.collect_list(F.struct("k_", "row", "x"))).alias("held_"))
    last = F.least(F.lit(block), F.size("held_") - steps + 1)
    starts = blocks.withColumn("all_", F.transform("held_", lambda h: h["x"])).filter(F.size("held_") >= steps).withColumn("i_", F.explode(F.sequence(F.lit(1), last)))
    at = F.element_at("held_", F.col("i_"))
    return starts.select("record_id", at["row"].alias("row"), at["x"].alias("first"), F.slice("all_", F.col("i_"), steps).alias("steps"))


def feature_steps(features: DataFrame, steps: int = 55, block: int = BLOCK_ROWS) -> DataFrame:
    """(record_id, row, steps, n_steps): each row with the feature rows of its ``steps`` following windows, for a model's tensor."""
    return _stepped(features, steps, block).drop("first").withColumn("n_steps", F.size("steps"))


def feature_tensor(rr: DataFrame, steps: int = 55, block: int = BLOCK_ROWS) -> DataFrame:
    """(record_id, row, x): for each 300-s window with all its ``steps`` 30-s rows, an array of steps, each the 38 features in their order.

    A step has the features of its own 30-s and 60-s windows and those of the whole 300 s; what can't be had is 0.
    """
    short, middle = time_features(rr, 30), time_features(rr, 60)
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    one = short.select("record_id", "row", F.array(*[zero(c) for c in FEATURES_30]).alias("a"))
    two = middle.select("record_id", "row", F.array(*[zero(c) for c in FEATURES_60]).alias("b"))
    whole = shape_features(rr, 300).select("record_id", "row", F.array(*[zero(c) for c in (*SPECTRAL, *FRACTAL)]).alias("c"))
    empty = F.array_repeat(F.lit(0.0), len(FEATURES_60))
    rows = one.join(two, ["record_id", "row"], "left").join(whole, ["record_id", "row"], "left").select("record_id", "row", F.concat("a", F.coalesce("b", empty)).alias("f"), "c")
    stepped = _stepped(rows, steps, block).filter("first.c is not null")
    return stepped.select("record_id", "row", F.transform("steps", lambda x: F.concat(x["f"], F.col("first.c"))).alias("x"))


def add_clock(rows: DataFrame, start: str = "start_ts") -> DataFrame:
    """The time of each row: five seconds a row from the record's start."""
    return rows.withColumn("row_ts", F.timestamp_add("SECOND", (F.col("row") * 5).cast("int"), F.col(start)))


def row_of(ts: Column, start: Column) -> Column:
    """The row of a time: its whole seconds from the start by five, rounded down."""
    return F.floor(F.timestamp_diff("SECOND", start, ts) / 5)
