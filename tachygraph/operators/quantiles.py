"""Exact quantiles of many groups, without a task that holds all values of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_quantiles(rows: DataFrame, by: str, value: str, qs: tuple[float, ...], bins: int = 4096) -> DataFrame:
    """(by, n, q): each group's number of values and a map of its quantiles, linear between ranks; null and NaN do not count.

    Counts by equal bins between the least and the largest value tell in which bins the wanted ranks lie; only the values of those
    bins are looked at one by one. The result is that of a full sort.
    """
    long = rows.select(F.col(by), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = long.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = long.join(ends, by).withColumn("bin", place)
    counts = binned.groupBy(by, "bin").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    upto = F.sum("k").over(Window.partitionBy(by).orderBy("bin"))
    #: For each quantile the two ranks (from 0) between which it lies, and the bins that hold them.
    wanted = F.array(*[F.struct(
        F.lit(q).alias("q"), (f(F.lit(q) * (F.col("n") - 1))).cast("long").alias("rank"), (F.lit(q) * (F.col("n") - 1)).alias("at"),
    ) for q in qs for f in (F.floor, F.ceil)])
    holding = counts.withColumn("before", upto - F.col("k")).select(by, "bin", "n", "before", "k", F.explode(wanted).alias("w")).filter("w.rank >= before and w.rank < before + k")
    holding = holding.select(by, "bin", "n", "w.q", "w.at", "w.rank", (F.col("w.rank") - F.col("before")).alias("inside"))
    chosen = holding.groupBy(by, "bin").agg(F.first("n").alias("size"), F.collect_set(F.struct("q", "at", "rank", "inside")).alias("asked"))
    order = Window.partitionBy(by, "bin").orderBy("v")
    found = binned.select(by, "bin", "v").join(chosen, [by, "bin"]).withColumn("i", F.row_number().over(order) - 1)
    found = found.select(by, "size", "v", F.explode(F.filter("asked", lambda x: x["inside"] == F.col("i"))).alias("x"))
    ends_of = found.groupBy(by, "x.q").agg(F.first("size").alias("n"), F.min(F.struct("x.rank", "v")).alias("a"), F.max(F.struct("x.rank", "v")).alias("b"), F.first("x.at").alias("at"))
    result = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("at") - F.floor("at"))
    return ends_of.groupBy(by).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("q"), result.alias("value")))).alias("q"))
