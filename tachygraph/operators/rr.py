"""Inter-beat intervals: built from beats, sliced, split, joined and validated. Key: record_id, order: seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_samples(peaks: DataFrame, freq: Column | float) -> DataFrame:
    """(record_id, sample, rr_ms): intervals of beats in samples, stamped at the later beat."""
    w = Window.partitionBy("record_id").orderBy("sample")
    rr = (F.col("sample") - F.lag("sample").over(w)) / freq * 1000
    return peaks.select("record_id", "sample", rr.alias("rr_ms")).filter("rr_ms is not null")


def from_timestamps(peaks: DataFrame) -> DataFrame:
    """(record_id, seq, left_ms, right_ms, rr_ms) of beats at whole milliseconds ``t_ms``."""
    if dict(peaks.dtypes)["t_ms"] not in ("bigint", "int"):
        raise TypeError("beats must be at whole milliseconds")
    w = Window.partitionBy("record_id").orderBy("t_ms")
    rows = peaks.select("record_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("t_ms").alias("left_ms"), F.lead("t_ms").over(w).alias("right_ms"))
    return rows.filter("right_ms is not null").withColumn("rr_ms", F.col("right_ms") - F.col("left_ms"))


def sliced(rr: DataFrame, start: Column | int, end: Column | int, inclusive_end: bool = False) -> DataFrame:
    """Intervals within [start, end]; the last of them is left out unless ``inclusive_end``."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    inside = rr.filter((F.col("left_ms") >= start) & (F.col("right_ms") <= end))
    if inclusive_end:
        return inside
    last = F.max("seq").over(Window.partitionBy("record_id"))
    return inside.withColumn("last_", last).filter(F.col("seq") < F.col("last_")).drop("last_")


def slice_or_missing(spans: DataFrame, rr: DataFrame, width: int = 600_000) -> DataFrame:
    """Each span (record_id, start, end) with its intervals, or one null interval as long as the span.

    Intervals meet spans in buckets of ``width`` ms, by where they begin.
    """
    key = ["record_id", "start", "end"]
    cover = spans.select(*key).distinct().withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    own = rr.select("record_id", "left_ms", "right_ms", "rr_ms").withColumn("bucket_", F.floor(F.col("left_ms") / width))
    inside = cover.join(own, ["record_id", "bucket_"]).filter((F.col("left_ms") >= F.col("start")) & (F.col("right_ms") <= F.col("end"))).drop("bucket_")
    joined = spans.select(*key).join(inside, key, "left")
    return joined.select(*key, F.coalesce("left_ms", "start").alias("left_ms"), F.coalesce("right_ms", "end").alias("right_ms"), "rr_ms")


def split_in_two(rr: DataFrame, which: Column, left: Column | None = None) -> DataFrame:
    """Chosen intervals in two; the left part is half of them (half-even) unless given."""
    half = (F.bround(F.col("rr_ms") / 2) if left is None else left).cast("long")
    whole = F.array(F.struct("left_ms", "right_ms", "rr_ms"))
    two = F.array(
        F.struct(F.col("left_ms").alias("left_ms"), (F.col("left_ms") + half).alias("right_ms"), half.alias("rr_ms")),
        F.struct((F.col("left_ms") + half).alias("left_ms"), F.col("right_ms").alias("right_ms"), (F.col("rr_ms") - half).alias("rr_ms")),
    )
    return _renumbered(rr.select("record_id", "seq", F.posexplode(F.when(which, two).otherwise(whole)).alias("k", "x")).select("record_id", "seq", "k", "x.*"))


def split_in_many(rr: DataFrame, fills: str) -> DataFrame:
    """Intervals with an array in column ``fills`` are replaced by parts of those lengths; they must add up."""
    ok = F.coalesce(F.aggregate(fills, F.lit(0).cast("long"), lambda a, x: a + x), F.col("rr_ms")) == F.col("rr_ms")
    checked = rr.withColumn("rr_ms", F.when(ok, F.col("rr_ms")).otherwise(F.raise_error(F.lit("the parts do not add up to the interval"))))
    parts = checked.select("record_id", "seq", "left_ms", F.posexplode(F.coalesce(fills, F.array("rr_ms"))).alias("k", "part"))
    run = F.sum("part").over(Window.partitionBy("record_id", "seq").orderBy("k"))
    return _renumbered(parts.select("record_id", "seq", "k", (F.col("left_ms") + run - F.col("part")).alias("left_ms"), (F.col("left_ms") + run).alias("right_ms"), F.col("part").alias("rr_ms")))


def join_two(rr: DataFrame, at: Column) -> DataFrame:
    """Interval ``at`` and the one after it as one."""
    group = F.col("seq") - (F.col("seq") > at).cast("long")
    return rr.groupBy("record_id", group.alias("seq")).agg(F.min("left_ms").alias("left_ms"), F.max("right_ms").alias("right_ms"), F.sum("rr_ms").alias("rr_ms"))


def _renumbered(parts: DataFrame) -> DataFrame:
    w = Window.partitionBy("record_id").orderBy("seq", "k")
    return parts.select("record_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "left_ms", "right_ms", "rr_ms")


def validated(rr: DataFrame) -> DataFrame:
    """(record_id, n, lengths_ok, chained_ok, valid): lengths equal right - left (missing ones are exempt) and intervals join on."""
    rows = rr.withColumn("next_", F.lead("left_ms").over(Window.partitionBy("record_id").orderBy("seq")))
    ok = F.coalesce(F.col("rr_ms") == F.col("right_ms") - F.col("left_ms"), F.lit(True))
    chained = F.coalesce(F.col("next_") == F.col("right_ms"), F.lit(True))
    return rows.groupBy("record_id").agg(
        F.count("*").alias("n"), F.bool_and(ok).alias("lengths_ok"), F.bool_and(chained).alias("chained_ok"),
    ).withColumn("valid", F.col("lengths_ok") & F.col("chained_ok"))


def bounded(rr: DataFrame, least: float, most: float) -> DataFrame:
    """Intervals outside [least, most] as null."""
    return rr.withColumn("rr_ms", F.when(F.col("rr_ms").between(least, most), F.col("rr_ms")))


def durations(rr: DataFrame) -> DataFrame:
    """(record_id, duration_s): whole seconds from the first to the last beat."""
    return rr.groupBy("record_id").agg(F.floor((F.max("right_ms") - F.min("left_ms")) / 1000).alias("duration_s"))
