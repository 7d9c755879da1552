"""Recordings, catalogues and scores derived from the general test tables, in whole numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.operators import scans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _beats(events: DataFrame, length) -> DataFrame:
    """Intervals in the order of time. The four records are longer than a task should hold, so a table of more than CHUNK rows is cut by time."""
    order = ["ts", "event_id"]
    rows = events.select((F.col("user_id") % 4).alias("record_id"), "ts", "event_id", "event_type", length.cast("long").alias("rr_ms"))
    n = -(-events.count() // scans.CHUNK)
    if n > 1:
        rows = rows.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id())
        values = {"seq": F.lit(1).cast("long"), "right_ms": F.col("rr_ms"), "some_": F.col("rr_ms").isNotNull().cast("long")}
        rows = scans.scanned(rows, ["record_id"], "part_", {k: ("sum", v) for k, v in values.items()}, 1, order)
        rows = rows.withColumn("seq", F.col("seq") - 1).withColumn("right_ms", F.when(F.col("some_") > 0, F.col("right_ms")))
    else:
        by = Window.partitionBy("record_id").orderBy(*order)
        rows = rows.withColumn("seq", (F.row_number().over(by) - 1).cast("long")).withColumn("right_ms", F.sum("rr_ms").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("record_id", "event_id", "event_type", "seq", (F.col("right_ms") - F.col("rr_ms")).alias("left_ms"), "right_ms", "rr_ms")


def rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean intervals of four records: 600 ms and the event's value."""
    return _beats(table(spark, sf_dir, "events"), 600 + F.floor("value"))


def rr_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals with gaps, extra and missed beats, so that every quality rule fires."""
    b, e = 600 + F.floor("value"), F.col("event_id")
    block = F.floor(e / 100) % 20
    length = F.when(e % 997 == 0, 12000).when(e % 499 == 0, 4600).when(
        block == 0, F.floor(b * 5 / 2),
    ).when(block == 1, F.floor(b / 4)).when(e % 97 == 0, 3 * b).when(e % 89 == 0, F.floor(b / 3)).otherwise(b)
    return _beats(table(spark, sf_dir, "events"), length)


def second_detector(beats: DataFrame) -> DataFrame:
    """(record_id, t_ms): the beats as another detector sees them: shifted by up to 200 ms, some missing."""
    return beats.filter("event_id % 17 <> 0").select("record_id", (F.col("right_ms") + (F.col("event_id") * 37) % 400 - 200).alias("t_ms"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seizure_id, patient_id, record_start, record_end, path): one seizure for each order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seizure_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("record_start"),
        F.date_add(F.col("o_orderdate").cast("date"), 1).alias("record_end"), F.concat(F.lit("rec/"), F.col("o_orderkey").cast("string")).alias("path"),
    )


def scored_rows(beats: DataFrame) -> DataFrame:
    """(record_id, row, valid, hit): a deterministic 0/1 score for each 30-second row."""
    from tachygraph.operators.features import window_counts

    rows = window_counts(beats, 30).select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    hit = (F.floor(F.col("row") / 5) * 2654435761 + F.col("record_id") * 97) % 1000 >= 450
    return rows.select("record_id", "row", (F.col("row") % 29 != 0).alias("valid"), F.when(F.col("row") % 13 == 0, 0).otherwise(hit.cast("int")).alias("hit"))


def signal(beats: DataFrame, freq: int = 128, seconds: int = 60) -> DataFrame:
    """(record_id, freq, chunk, start_sample, raw): signals with a narrow wave at each beat, in chunks that share no beat's wave."""
    length = seconds * 1000

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        record, chunk = key
        t = np.arange(seconds * freq) / freq + chunk * seconds
        raw = np.zeros(len(t))
        for at in pdf["right_ms"].to_numpy() / 1000:
            a, b = np.searchsorted(t, (at - 0.1, at + 0.1))
            raw[a:b] += np.exp(-((t[a:b] - at) ** 2) / (2 * 0.015**2))
        return pd.DataFrame({"record_id": [record], "freq": [freq], "chunk": [chunk], "start_sample": [chunk * seconds * freq], "raw": [raw]})

    rows = beats.select("record_id", F.floor(F.col("right_ms") / length).cast("int").alias("chunk"), "right_ms")
    return rows.groupBy("record_id", "chunk").applyInPandas(run, "record_id long, freq int, chunk int, start_sample long, raw array<double>")
