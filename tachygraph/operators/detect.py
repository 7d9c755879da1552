"""From window scores to detections: threshold, scatter over rows, gap filling, smoothing, spaced blocks.

A row's value is 1, 0 or -1 (not scored). Rows are numbered without gaps. A record is worked on in chunks, with a few rows of overlap
where rows look around. Possible tiles and starts are written to the shared folder, as choosing among them reads them several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.operators.intervals import spaced
from tachygraph.operators.scans import numbered, overlapping, owned
from tachygraph.sources.shared import stored


def thresholded(score: Column, threshold: float | Column) -> Column:
    """1 at or above the threshold, else 0."""
    return F.when(score >= threshold, 1).otherwise(0)


def scattered(rows: DataFrame, predictions: DataFrame, valid: Column) -> DataFrame:
    """(record_id, row, value): predictions (record_id, i, value) in order on the valid rows; -1 on others and where they run out."""
    ranked = numbered(rows.filter(valid).select("record_id", "row"), ["record_id"], "row", "i")
    placed = ranked.join(predictions.select("record_id", "i", F.col("value").alias("v_")), ["record_id", "i"], "left").select("record_id", "row", "v_")
    return rows.select("record_id", "row").join(placed, ["record_id", "row"], "left").select("record_id", "row", F.coalesce("v_", F.lit(-1)).cast("int").alias("value"))


def gaps_filled(rows: DataFrame, max_gap: int = 2) -> DataFrame:
    """Zeros between two ones become ones if they are at most ``max_gap`` and none of the rows between is -1.

    Rows are numbered without gaps, so the ones on both sides are within ``max_gap`` rows of a zero that may be filled.
    """
    near = overlapping(rows.select("record_id", "row", "value"), "row", max_gap, max_gap)
    w = Window.partitionBy("record_id", "chunk_").orderBy("row")
    at = lambda v, f, a, z: f(F.when(F.col("value") == v, F.col("row"))).over(w.rowsBetween(a, z))
    one_before, one_after = at(1, F.max, -max_gap, -1), at(1, F.min, 1, max_gap)
    unknown_before, unknown_after = at(-1, F.max, -max_gap, -1), at(-1, F.min, 1, max_gap)
    marked = near.withColumns({"a_": one_before, "z_": one_after, "ua_": unknown_before, "uz_": unknown_after})
    fill = (F.col("value") == 0) & (F.col("z_") - F.col("a_") - 1 <= max_gap) & (F.coalesce("ua_", F.col("a_") - 1) < F.col("a_")) & (F.coalesce("uz_", F.col("z_") + 1) > F.col("z_"))
    return owned(marked).select("record_id", "row", F.when(fill, 1).otherwise(F.col("value")).alias("value"))


def smoothed(rows: DataFrame, least: int = 3) -> DataFrame:
    """Ones are covered from the left by tiles of ``least`` rows; a tile that is not all ones becomes zeros.

    A tile begins at a one, not before the last tile's end, and only where it stays within the record and holds no -1.
    """
    ahead = Window.partitionBy("record_id", "chunk_").orderBy("row").rowsBetween(0, least - 1)
    tiles = overlapping(rows.select("record_id", "row", "value"), "row", ahead=least - 1)
    tiles = tiles.withColumn("low_", F.min("value").over(ahead)).withColumn("n_", F.count("*").over(ahead)).withColumn("ones_", F.count_if(F.col("value") == 1).over(ahead))
    may = owned(tiles).filter((F.col("value") == 1) & (F.col("low_") >= 0) & (F.col("n_") == least)).select("record_id", "row", "ones_")
    may = stored(may, "tiles")
    begun = spaced(may.select("record_id", "row"), ["record_id"], "row", least)
    short = may.filter(F.col("ones_") < least).select("record_id", "row").join(begun, ["record_id", "row"])
    gone = short.select("record_id", F.explode(F.sequence("row", F.col("row") + least - 1)).alias("row"), F.lit(True).alias("gone_"))
    return rows.join(gone, ["record_id", "row"], "left").select("record_id", "row", F.when(F.col("gone_"), 0).otherwise(F.col("value")).alias("value"))


def block_starts(rows: DataFrame, least: int = 3, jump: int = 60) -> DataFrame:
    """(record_id, start_row): from the left, rows that begin ``least`` ones, each at least ``jump`` after the one before."""
    ahead = Window.partitionBy("record_id", "chunk_").orderBy("row").rowsBetween(0, least - 1)
    near = overlapping(rows.select("record_id", "row", "value"), "row", ahead=least - 1)
    full = F.sum((F.col("value") == 1).cast("int")).over(ahead) == least
    starts = owned(near.withColumn("full_", full)).filter("full_").select("record_id", "row")
    return spaced(stored(starts, "starts"), ["record_id"], "row", jump).withColumnRenamed("row", "start_row")


def detections(starts: DataFrame, record_start: Column | None = None, row_s: int = 5, length_s: int = 300) -> DataFrame:
    """(record_id, start_s, end_s[, timestamps]): a detection of five minutes from each start row."""
    out = starts.select("*", (F.col("start_row") * row_s).cast("long").alias("start_s")).withColumn("end_s", F.col("start_s") + length_s)
    if record_start is None:
        return out.drop("start_row")
    return out.select(
        "record_id", F.timestamp_add("SECOND", F.col("start_s").cast("int"), record_start).alias("timestamp_start"),
        F.timestamp_add("SECOND", F.col("end_s").cast("int"), record_start).alias("timestamp_end"),
    )


def detect(rows: DataFrame, scores: DataFrame, valid: Column, threshold: float | Column, least: int = 3, max_gap: int = 2) -> DataFrame:
    """Scores (record_id, i, score) of the valid rows to detections."""
    predictions = scores.withColumn("value", thresholded(F.col("score"), threshold))
    return detections(block_starts(smoothed(gaps_filled(scattered(rows, predictions, valid), max_gap), least), least))


def with_status(found: DataFrame, status: Column) -> DataFrame:
    """Detections with a status; other values than the known ones fail the query."""
    ok = status.isin("tp", "fp", "other_seizure", "bad_quality")
    return found.withColumn("status", F.when(ok, status).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(status, F.lit("null"))))))
