"""Job 1: heart-rate features and quality of recordings, kept up with beats as their files arrive.

    python -m jobs.beat_features --source EVENTS --out FOLDER --checkpoint FOLDER [--config jobs/beat_features.json]

A file stream takes the files of ``source`` that its checkpoint has not seen (availableNow: all there are, then it ends). Each batch

1. is stored in ``out``/beats, partitioned by day and batch: a batch that is run again after a failure replaces its own partitions only;
   rows without a time, a value or an id are kept apart (whole=false) and used no further;
2. names the days that it touches, late ones too; of these days all stored beats are read again (other days' partitions are pruned),
   and intervals, 30-second features, signal quality and detections are made anew: windows of a fast rate and good quality go
   through the chain that makes detections of a model's scores, and those at which a detection of five minutes begins are marked;
3. replaces these days' partitions of ``out``/features (dynamic overwrite). Beats that were delivered twice count once.

So a run without new files changes nothing, and any order and cut of the same files ends in the same features.

A recording is one of ``records`` channels on one day. The days of a batch are told apart by Spark alone; nothing but counts comes to
the driver. A channel's day is cut by time where running sums are made, so that a busy one is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configured, log, main
from tachygraph.operators import detect, features, quality, scans
from tachygraph.sources.shared import passing, stored

#: Channels' numbers within a day's recording ids.
CHANNELS = 1_000_000


@dataclass(frozen=True)
class Config:
    """records: channels. base_ms: what is added to an event's value to make an interval. seconds: width of a window. max_files: files in a batch.

    rate: beats a minute from which a window counts as fast. min_quality: windows below are not judged.
    """

    records: int = 4
    base_ms: int = 600
    seconds: int = 30
    max_files: int = 1000
    rate: float = 72.0
    min_quality: float = 75.0


def beats_of(events: DataFrame, config: Config) -> DataFrame:
    """(day, record_id, event_id, ts, rr_ms) of events; null where a part is missing. A recording's id holds its day and channel."""
    day = F.col("ts").cast("date")
    record = F.unix_date(day).cast("long") * CHANNELS + F.pmod("user_id", F.lit(config.records))
    return events.select(day.alias("day"), record.alias("record_id"), "event_id", "ts", (config.base_ms + F.floor("value")).cast("long").alias("rr_ms"))


def intervals_of(beats: DataFrame) -> DataFrame:
    """(record_id, event_id, seq, left_ms, right_ms, rr_ms): a recording's intervals end to end, in the order of their times."""
    once = beats.dropDuplicates(["record_id", "event_id"]).withColumn("at_", F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts")))
    #: An hour is a piece.
    hour = 3_600_000_000
    rows = scans.scanned(once, ["record_id"], "at_", {"seq": ("sum", F.lit(1)), "right_ms": ("sum", F.col("rr_ms"))}, hour, ["event_id"])
    right = F.col("right_ms").cast("long")
    return rows.select("record_id", "event_id", (F.col("seq") - 1).cast("long").alias("seq"), (right - F.col("rr_ms")).alias("left_ms"), right.alias("right_ms"), "rr_ms")


def features_of(beats: DataFrame, config: Config) -> DataFrame:
    """(day, record, row, n_beats, avg, sd, rmssd, quality, detected) of the windows of the recordings in ``beats``."""
    rr = stored(intervals_of(beats), "intervals")
    made = features.time_features(rr, config.seconds).select("record_id", "row", "n_beats", "avg", "sd", "rmssd")
    rules = quality.rule_inputs(rr.select("record_id", "event_id", F.col("right_ms").alias("t_ms")), "t_ms")
    verdict = quality.verdict(F.col("n"), F.col("n"), F.col("mean_rate"), F.col("longest"), F.col("shortest"), F.lit(1.0))
    windows = stored(made.join(rules.select("record_id", "row", verdict.alias("quality")), ["record_id", "row"], "left"), "windows")
    starts = detections_in(features.window_counts(rr, config.seconds), windows, config).withColumn("detected", F.lit(True))
    joined = windows.join(starts, ["record_id", "row"], "left")
    day: Column = F.date_from_unix_date(F.floor(F.col("record_id") / CHANNELS).cast("int"))
    return joined.select(
        day.alias("day"), (F.col("record_id") % CHANNELS).alias("record"), "row", "n_beats", "avg", "sd", "rmssd", "quality", F.coalesce("detected", F.lit(False)).alias("detected"),
    )


def detections_in(counts: DataFrame, windows: DataFrame, config: Config) -> DataFrame:
    """(record_id, row): the windows at which a detection begins. counts: (record_id, rows), all windows; those without beats are not judged."""
    rows = counts.select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    good = F.coalesce(F.col("quality") >= config.min_quality, F.lit(False))
    value = F.when(good, detect.thresholded(F.try_divide(F.lit(60000.0), F.col("avg")), config.rate)).otherwise(-1)
    judged = stored(rows.join(windows, ["record_id", "row"], "left").select("record_id", "row", value.alias("value")), "judged")
    return detect.block_starts(detect.smoothed(detect.gaps_filled(judged))).withColumnRenamed("start_row", "row")


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions of ``path`` that ``df`` has rows for."""
    df.hint("rebalance", by[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def handle_batch(batch: DataFrame, number: int, out: str, config: Config) -> dict[str, int]:
    """Stores one batch and makes the days that it touches anew."""
    spark = batch.sparkSession
    beats = beats_of(batch, config).withColumn("batch", F.lit(number))
    whole = F.col("day").isNotNull() & F.col("record_id").isNotNull() & F.col("event_id").isNotNull() & F.col("rr_ms").isNotNull()
    marked = beats.withColumn("whole", F.coalesce(whole, F.lit(False)))
    _replace(marked, f"{out}/beats", "whole", "day", "batch")
    every = spark.read.schema(marked.schema).parquet(f"{out}/beats")
    #: The batch's own partitions; counts come from the files' footers.
    own = every.filter(F.col("batch") == number)
    counts = {"stored": own.filter("whole").count(), "rejected": own.filter("not whole").count(), "windows": 0}
    if counts["stored"]:
        days = own.filter("whole").select("day").distinct()
        #: At most one row for each day there is.
        touched = every.filter("whole").join(F.broadcast(days), "day", "left_semi")
        with passing(spark):
            _replace(features_of(touched, config), f"{out}/features", "day")
        counts["windows"] = read_features(spark, out).join(F.broadcast(days), "day", "left_semi").count()
    log.info("batch %d: %s, to %s", number, ", ".join(f"{k} {v}" for k, v in counts.items()), out)
    return counts


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: Config | None = None, config_path: str | None = None) -> dict[str, int]:
    """Takes all files of ``source`` that ``checkpoint`` has not seen; gives the sums of the batches' counts."""
    config = config or configured(Config, spark, config_path)
    schema = spark.read.parquet(source).select("event_id", "ts", "user_id", "value").schema
    #: A stream takes a folder or a pattern; as a pattern, a plain path may be a single file too.
    pattern = source if any(c in source for c in "*?[{") else f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files).parquet(pattern)
    total = {"batches": 0, "stored": 0, "rejected": 0, "windows": 0}

    def each(batch: DataFrame, number: int) -> None:
        got = handle_batch(batch, number, out, config)
        total["batches"] += 1
        for k, v in got.items():
            total[k] += v

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %s", source, ", ".join(f"{k} {v}" for k, v in total.items()))
    return total


def read_features(spark: SparkSession, out: str) -> DataFrame:
    """The job's output."""
    columns = "record long, row long, n_beats long, avg double, sd double, rmssd double, quality double, detected boolean, day date"
    return spark.read.schema(columns).parquet(f"{out}/features")


if __name__ == "__main__":
    main("beat_features", __doc__.splitlines()[0], ("source", "out", "checkpoint"), run)
