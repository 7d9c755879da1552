"""The filter table, event filters, and labelled training samples around onsets and from regular rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.functions.scalars import check_windows
from tachygraph.sources.shared import stored

#: Records whose counts one task adds up.
RECORDS_BLOCK = 10_000
EVENT_FILTERS: dict[str, Callable[[dict], Column]] = {}


def event_filter(name: str) -> Callable[[Callable[[dict], Column]], Callable[[dict], Column]]:
    """Registers an event filter: parameters -> a condition on a row's array ``avgs`` of mean intervals."""

    def add(f: Callable[[dict], Column]) -> Callable[[dict], Column]:
        EVENT_FILTERS[name] = f
        return f

    return add


@event_filter("filter_longterm_tachycardy")
def longterm_tachycardy(params: dict) -> Column:
    """More than a share of the steps have a mean rate above the threshold."""
    fast = F.filter("avgs", lambda x: F.try_divide(F.lit(60000.0), x) > params["hr_threshold"])
    return F.try_divide(F.size(fast), F.size("avgs")) > params["tachycardy_fraction"]


def with_event_filters(rows: DataFrame, filters: dict[str, dict], column: str = "is_event") -> DataFrame:
    """``column`` is true where all filters hold; without any it is true."""
    ok = F.lit(True)
    for name, params in filters.items():
        ok = ok & F.coalesce(EVENT_FILTERS[name](params), F.lit(False))
    return rows.withColumn(column, ok)


def filter_table(rows: DataFrame, n_filters: int = 1, quality: DataFrame | None = None) -> DataFrame:
    """Rows with the default flags and ``quality``: from ``quality`` (record_id, row, quality), 0 where it has none, or 1 without it."""
    flags = {"without_nan": F.lit(True), "without_seizure": F.lit(True), "label_seizures": F.lit(False)} | {f"event_filter_{k}": F.lit(True) for k in range(n_filters)}
    if quality is None:
        return rows.withColumns(flags).withColumn("quality", F.lit(1.0))
    scores = quality.select("record_id", "row", F.col("quality").alias("q_"))
    return rows.join(scores, ["record_id", "row"], "left").withColumns(flags).withColumn("quality", F.coalesce("q_", F.lit(0.0))).drop("q_")


def prediction_rows(rows: DataFrame, quality: float, filter_id: int | None = None) -> DataFrame:
    """Rows of sufficient quality (and, if given, that the event filter passes)."""
    kept = rows.filter(F.col("quality") >= quality)
    return kept if filter_id is None else kept.filter(F.col(f"event_filter_{filter_id}"))


def sampling_windows(anchors: DataFrame, rows: DataFrame, windows: list[int], quality: float, step_rows: int = 1) -> DataFrame:
    """Rows at ``windows`` (0 and before) steps from each anchor's row, of sufficient quality and passing ``is_event``."""
    check_windows(windows)
    wanted = anchors.withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows]))).withColumn("row", F.col("row") + F.col("window") * step_rows)
    return wanted.join(rows.filter((F.col("quality") >= quality) & F.col("is_event")), ["record_id", "row"])


def seizure_samples(onsets: DataFrame, rows: DataFrame, windows: list[int], quality: float) -> DataFrame:
    """(record_id, row, window, seizure_id, label 1): anchors are the onsets' rows; onsets without a time are skipped."""
    anchors = onsets.filter("onset_ms is not null").select("record_id", "seizure_id", F.floor(F.col("onset_ms") / 5000).alias("row"))
    got = sampling_windows(anchors, rows, windows, quality)
    return got.select("record_id", "row", "window", "seizure_id", F.lit(1).alias("label"))


def regular_samples(rows: DataFrame, n: int | Column, quality: float, seed: int = 42) -> DataFrame:
    """(record_id, row, window, seizure_id, label 0): up to ``n`` rows, in each record those of the least hashes, records in order.

    Each record's count before it decides how many it still gives, so no global sort is needed: counts are summed by blocks of
    RECORDS_BLOCK ids, then within each block. Counts by the hash's first three digits tell below which of them all of a record's rows are
    drawn, so only the rows of one more are put in order. ``n`` may be a scalar subquery.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), "record_id", "row"))
    good = rows.filter(F.col("without_seizure") & (F.col("quality") >= quality)).select("record_id", "row", key.alias("key_"), F.substring(key, 1, 3).alias("prefix_"))
    good = stored(good, "good")
    counts = good.groupBy("record_id", "prefix_").agg(F.count("*").alias("n_"))
    sizes = counts.groupBy("record_id").agg(F.sum("n_").alias("n_")).withColumn("block_", F.floor(F.col("record_id") / RECORDS_BLOCK))
    n = n if isinstance(n, Column) else F.lit(n)
    upto = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("block_").agg(F.sum("n_").alias("n_")).select("block_", upto(Window.orderBy("block_")).alias("blocks_before_"))
    sizes = sizes.join(blocks.filter(F.col("blocks_before_") < n), "block_")
    before = F.col("blocks_before_") + upto(Window.partitionBy("block_").orderBy("record_id"))
    quota = sizes.select("record_id", F.least(n - before, F.col("n_")).alias("quota_")).filter("quota_ > 0")
    below = upto(Window.partitionBy("record_id").orderBy("prefix_"))
    asked = counts.withColumn("below_", below).join(quota, "record_id").filter("below_ < quota_").select("record_id", "prefix_", (F.col("quota_") - F.col("below_")).alias("take_"))
    order = F.row_number().over(Window.partitionBy("record_id", "prefix_").orderBy("key_", "row"))
    drawn = good.join(asked, ["record_id", "prefix_"]).withColumn("k_", order).filter(F.col("k_") <= F.col("take_"))
    return drawn.select("record_id", "row", F.lit(0).alias("window"), F.lit(None).cast("long").alias("seizure_id"), F.lit(0).alias("label"))


def training_set(positive: DataFrame, rows: DataFrame, records: DataFrame, class_ratio: float, quality: float, seed: int = 42) -> DataFrame:
    """Positives, ``class_ratio`` times as many regular samples, and their patients. The positives are written once; their count is part of the plan."""
    positive = stored(positive, "positives")
    n = positive.agg((F.lit(class_ratio) * F.count("*")).cast("long")).scalar()
    both = positive.unionByName(regular_samples(rows, n, quality, seed))
    return both.join(records.select("record_id", "patient_id"), "record_id", "left")
