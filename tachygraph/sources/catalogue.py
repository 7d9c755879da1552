"""The seizure catalogue, annotations, result tables, tracked runs and model artifacts."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tachygraph.sources.schemas import CATALOGUE_ENTRY, RUNS, SEIZURE_LOG


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by seizure id as rows (seizure_id, patient_id, record_start_sen, ...)."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), CATALOGUE_ENTRY))
    return text.select(F.explode(parsed).alias("seizure_id", "entry")).select("seizure_id", "entry.*")


def catalogue_entries(spark: SparkSession, path: str, **paths: str) -> DataFrame:
    """(seizure_id, ...): the entries of JSON objects keyed by seizure id, one object a line; each named column is a path in the entry and a type.

    For large catalogues: objects are parsed to variants, and only the ``paths`` (such as location="$.path_sensor:string") are taken out of
    them, whatever else the entries hold. What an entry lacks, or has in another type, is null; lines that are no object have no rows.
    """
    objects = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null and schema_of_variant(v) like 'OBJECT%'")
    objects.createOrReplaceTempView(view := f"objects_{uuid.uuid4().hex}")
    entries = spark.sql(f"select e.key as seizure_id, e.value as entry from {view}, lateral variant_explode(v) e")
    spark.catalog.dropTempView(view)
    taken = [F.try_variant_get("entry", p.rsplit(":", 1)[0], p.rsplit(":", 1)[1]).alias(c) for c, p in paths.items()]
    return entries.select("seizure_id", *taken)


def location_of(path: str) -> str:
    """The location's name: the last part of a path with either kind of slash."""
    return path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]


def seizure_info(catalogue: DataFrame, seizure_id: str) -> DataFrame:
    """The entry of one seizure, its file's path with forward slashes."""
    return catalogue.filter(F.col("seizure_id") == seizure_id).withColumn("seizure_json", F.translate("seizure_json", "\\", "/"))


def with_recording(records: DataFrame, recordings: DataFrame | None, how: str = "left") -> DataFrame:
    """Records with their recordings; columns that are not used later are pruned, so this is also the lookup without data."""
    return records if recordings is None else records.join(recordings, "record_id", how)


def read_seizure_log(spark: SparkSession, path: str) -> DataFrame:
    """Per-seizure log CSV with its ten columns; impossible times parse to null in start_ts and end_ts."""
    log = spark.read.csv(path, header=True, schema=SEIZURE_LOG)
    return log.withColumn("start_ts", F.try_to_timestamp("seizure_start")).withColumn("end_ts", F.try_to_timestamp("seizure_end"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Run summary CSV; all columns are nullable strings but those that name a count or a metric."""
    table = spark.read.csv(path, header=True)
    number = [c for c in table.columns if c.startswith(("n_", "med_", "Total_"))]
    return table.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in number})


def write_filter_table(table: DataFrame, path: str) -> None:
    """The filter table with its quality column."""
    table.write.mode("overwrite").parquet(path)


def log_run(spark: SparkSession, path: str, run_id: str, experiment: str, params: dict[str, str], metrics: dict[str, float]) -> None:
    """Appends one run to the table of runs."""
    import datetime

    spark.createDataFrame([(run_id, experiment, datetime.datetime.now(datetime.UTC), params, metrics)], RUNS).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline with its configuration."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
