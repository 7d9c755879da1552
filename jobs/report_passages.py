"""Job 2: passages of written reports that are dense in wanted terms, as candidates for annotation.

    python -m jobs.report_passages --source DOCUMENTS --out FOLDER [--config jobs/report_passages.json]

Who annotates recordings reads reports for what they say of events. This job finds the places: each sentence has a score, the share
of its words that are wanted terms, by weight, and the chain that turns a model's scores into detections turns these into passages: threshold,
short gaps filled, lone sentences dropped, and starts kept apart. Sentences of too few words are not scored.

``out``/scores holds the sentences' scores, ``out``/passages is partitioned by language, ``out``/summary has one row for each source and
language. All are overwritten as a whole, so a run again gives the same. Texts are shuffled only where they hold passages; what goes through the chain are numbers.

Rows without a doc_id or text are left out and counted. Repeated rows are one report; reports that share a doc_id are told apart by
their text. Null languages and sources are written as "none".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configured, log, main
from tachygraph.operators import detect
from tachygraph.sources.shared import passing

#: What ends a sentence, and what separates words; ASCII capitals are folded.
SENTENCE_END, WORD_GAP = r"[.!?\n]+", r"[\x20\x09-\x0D,;:]+"


@dataclass(frozen=True)
class Config:
    """terms: weight by word. threshold: least score. min_words: fewer are not scored. max_gap, least, jump: as in ``operators.detect``."""

    terms: dict[str, float] = field(default_factory=lambda: {"was": 1.0, "with": 1.0, "from": 1.0, "this": 1.0, "und": 1.0, "mit": 1.0, "que": 1.0, "les": 1.0, "para": 1.0})
    threshold: float = 0.1
    min_words: int = 3
    max_gap: int = 2
    least: int = 3
    jump: int = 20


def _sentences(text):
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def reports_of(documents: DataFrame) -> DataFrame:
    """(record_id, doc_id, lang, source, text): a report's key is a hash of its id and text."""
    named = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    kept = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return kept.select(F.xxhash64("doc_id", "text").alias("record_id"), "doc_id", named("lang"), named("source"), "text")


def scored(reports: DataFrame, config: Config) -> DataFrame:
    """(record_id, row, score): each sentence's score; null where it has too few words."""
    weights = F.create_map(*[F.lit(x) for pair in sorted(config.terms.items()) for x in pair])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(F.translate("sentence", upper, upper.lower()), WORD_GAP), lambda w: w != "")
    rows = reports.select("record_id", F.posexplode(_sentences(F.col("text"))).alias("row", "sentence")).select("record_id", F.col("row").cast("long").alias("row"), words.alias("words"))
    hit = F.aggregate("words", F.lit(0.0), lambda a, w: a + F.coalesce(weights[w], F.lit(0.0)))
    return rows.select("record_id", "row", F.when(F.size("words") >= config.min_words, hit / F.size("words")).alias("score")).distinct()


def passages_of(reports: DataFrame, scores: DataFrame, config: Config) -> DataFrame:
    """(lang, source, doc_id, first, last, n_hits, score, text): each passage, its sentences from 0, and how many of them reach the threshold."""
    value = F.when(F.col("score").isNull(), -1).otherwise(detect.thresholded(F.col("score"), config.threshold))
    rows = scores.withColumn("value", value)
    chain = detect.smoothed(detect.gaps_filled(rows.select("record_id", "row", "value"), config.max_gap), config.least)
    starts = detect.block_starts(chain, config.least, config.jump)
    #: The rows of a passage are few: as many as starts are apart.
    inside = starts.select("record_id", "start_row", F.explode(F.sequence("start_row", F.col("start_row") + config.jump - 1)).alias("row")).join(rows, ["record_id", "row"])
    found = inside.groupBy("record_id", "start_row").agg(F.max("row").alias("last"), F.count_if(F.col("value") == 1).alias("n_hits"), F.avg("score").alias("score"))
    once = reports.dropDuplicates(["record_id"])
    text = F.array_join(F.slice(_sentences(F.col("text")), (F.col("start_row") + 1).cast("int"), (F.col("last") - F.col("start_row") + 1).cast("int")), ". ")
    return once.join(found, "record_id").select("lang", "source", "doc_id", F.col("start_row").alias("first"), "last", "n_hits", "score", text.alias("text"))


def run(spark: SparkSession, source: str, out: str, config: Config | None = None, config_path: str | None = None) -> dict[str, int]:
    """Writes the passages of the reports at ``source`` and their summary; gives counts."""
    config = config or configured(Config, spark, config_path)
    documents = spark.read.parquet(source).select("doc_id", "text", "lang", "source")
    reports = reports_of(documents)
    scored(reports, config).write.mode("overwrite").parquet(f"{out}/scores")
    scores = spark.read.schema("record_id long, row long, score double").parquet(f"{out}/scores")
    with passing(spark):
        passages_of(reports, scores, config).hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/passages")

    passages = read_passages(spark, out)
    sizes = reports.groupBy("record_id", "lang", "source").agg(F.count("*").alias("rows")).groupBy("lang", "source").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_reports"))
    hits = passages.groupBy("lang", "source").agg(F.count_distinct("doc_id").alias("n_with"), F.count("*").alias("n_passages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = sizes.join(hits, ["lang", "source"], "left").select("lang", "source", "n_rows", "n_reports", zero("n_with"), zero("n_passages"))
    summary.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/summary")
    written = spark.read.schema(summary.schema).parquet(f"{out}/summary")
    rows, n_reports, n_passages = (x or 0 for x in written.agg(F.sum("n_rows"), F.sum("n_reports"), F.sum("n_passages")).first())
    got = {"reports": n_reports, "left_out": documents.count() - rows, "passages": n_passages}
    log.info("read %s: %d reports, %d rows left out; wrote %d passages to %s", source, got["reports"], got["left_out"], got["passages"], out)
    return got


def read_passages(spark: SparkSession, out: str) -> DataFrame:
    """The job's main output."""
    return spark.read.schema("source string, doc_id long, first long, last long, n_hits long, score double, text string, lang string").parquet(f"{out}/passages")


if __name__ == "__main__":
    main("report_passages", __doc__.splitlines()[0], ("source", "out"), run)
