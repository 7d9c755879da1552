"""Records assembled from the seizure catalogue, and lookups between seizures, records and patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build_records(catalogue: DataFrame, excluded: DataFrame | None = None, id_mode: str = "dense", legacy_key: bool = False) -> DataFrame:
    """(record_id, patient_id, start, end, path, seizures, unmasked): seizures with one start (and patient) are one record.

    The first seizure (by id) gives patient, end and path. ``excluded``: patient ids whose seizures found no record; with
    ``legacy_key`` records are keyed by start alone and all seizures of that start belong to them. id_mode: ``dense`` or ``start``.
    """
    key = ["record_start"] if legacy_key else ["patient_id", "record_start"]
    kept = catalogue if excluded is None else catalogue.join(excluded, "patient_id", "left_anti")
    first = kept.groupBy(*key).agg(*[F.min_by(c, "seizure_id").alias(c) for c in ("patient_id", "record_end", "path") if c not in key])
    members = (catalogue if legacy_key else kept).groupBy(*key).agg(F.sort_array(F.collect_list("seizure_id")).alias("seizures"), F.max("seizure_id").alias("last_seizure"))
    out = first.join(members, key)
    if id_mode == "dense":
        return _numbered(out, key).withColumn("unmasked", F.concat(F.col("last_seizure").cast("string"), F.lit("/unmasked"))).drop("last_seizure")
    return out.withColumn("record_id", F.col("record_start").cast("string")).withColumn("unmasked", F.concat(F.col("last_seizure").cast("string"), F.lit("/unmasked"))).drop("last_seizure")


def _numbered(records: DataFrame, key: list[str]) -> DataFrame:
    """Dense ids from 0 in the order of ``key``: ranks within each start's year and month, and the months' counts before."""
    month = F.date_format("record_start", "yyyyMM")
    rows = records.withColumn("month_", month)
    before = Window.orderBy("month_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("month_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    order = ["record_start", *[k for k in key if k != "record_start"]]
    rank = F.row_number().over(Window.partitionBy("month_").orderBy(*order)) - 1
    return rows.join(F.broadcast(sums.select("month_", "before_")), "month_").withColumn("record_id", (F.col("before_") + rank).cast("long")).drop("month_", "before_")


def by_patient(records: DataFrame) -> DataFrame:
    """(patient_id, n_records, n_seizures): the two-level grouping; the records themselves stay flat."""
    return records.groupBy("patient_id").agg(F.count("*").alias("n_records"), F.sum(F.size("seizures")).cast("long").alias("n_seizures"))


def patients_of(seizures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct patients of the given seizure ids."""
    return catalogue.join(seizures, "seizure_id", "left_semi").select("patient_id").distinct()


def seizure_times(ids: DataFrame, info: DataFrame, onset: str, offset: str) -> DataFrame:
    """Each id with the first onset and offset of its annotation, null if there is none; ids may be text."""
    first = info.groupBy(F.col("seizure_id").cast("long").alias("key_")).agg(F.min_by(F.struct(onset, offset), F.col("ord")).alias("t_"))
    return ids.join(first, F.expr("try_cast(seizure_id as bigint)") == F.col("key_"), "left").select(*ids.columns, F.col("t_")[onset].alias("onset"), F.col("t_")[offset].alias("offset"))


def seizures_of(records: DataFrame, info: DataFrame, onset: str, offset: str) -> DataFrame:
    """(record_id, seizure_id, onset, offset, has_valid_data, is_event) of all records' seizures."""
    ids = records.select("record_id", F.explode("seizures").alias("seizure_id"))
    return seizure_times(ids, info, onset, offset).withColumn("has_valid_data", F.lit(True)).withColumn("is_event", F.lit(True))


def with_patient(samples: DataFrame, records: DataFrame) -> DataFrame:
    """Samples with their record's patient."""
    return samples.join(records.select("record_id", "patient_id"), "record_id", "left")


def of_record(rows: DataFrame, record_id: Column | int | str) -> DataFrame:
    """Rows of one record."""
    return rows.filter(F.col("record_id") == record_id)
