"""A training corpus from the documents table in five stages, each one operator of ``tachygraph.llm``.

Every stage works on all that the stage before kept. The rows between stages are written as Parquet and read again; what an operator
writes on its way is deleted once its stage is stored. All stages but the last return the columns that they were given, whatever
their names, and an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tachygraph.llm.decontam import keep_clean
from tachygraph.llm.fertility import quality_filter
from tachygraph.llm.line_dedup import drop_lines
from tachygraph.llm.near_dedup import keep_one
from tachygraph.llm.packing import best_fit
from tachygraph.llm.scratch import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the fertility bands keep.

    A null or empty text fails the base rule; repeated rows stay or go together; ties of the bands' quantiles give one band.
    """
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars`` counts what is left.

    No document goes, not even one of which no line is left. A null text stays null, a null source is one host; repeated rows
    are treated alike.
    """
    got = drop_lines(docs, "source")
    chars = F.when(F.col(got.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return got.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one of each repeated row.

    The smallest doc_id of a group stays, of equal rows the first by their other columns. Documents without words and rows without an
    id are near to nothing.
    """
    return keep_one(docs, repeats=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of.

    A null text holds none; with an empty benchmark all stay; repeated rows stay or go together.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each part of each document in bins of equal capacity.

    Null and empty texts are parts of 0 words; ties go by doc_id and part; no document is left out.
    """
    return best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenising, minhashing and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
