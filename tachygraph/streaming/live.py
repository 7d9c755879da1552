"""Five-minute and thirty-second rates of live beats, with late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_rates(beats: DataFrame, at: str = "ts", seconds: int = 30, step: int = 5, late: str = "2 minutes") -> DataFrame:
    """(record_id, start, n_beats, avg_rr, mean_rate) of epoch-aligned sliding windows of beats (record_id, ts, rr_ms)."""
    w = F.window(at, f"{seconds} seconds", f"{step} seconds")
    rates = F.avg(F.try_divide(F.lit(60000.0), F.col("rr_ms")))
    return beats.withWatermark(at, late).groupBy("record_id", w).agg(
        F.count("*").alias("n_beats"), F.avg("rr_ms").alias("avg_rr"), rates.alias("mean_rate"),
    ).select("record_id", F.col("window.start").alias("start"), "n_beats", "avg_rr", "mean_rate")
