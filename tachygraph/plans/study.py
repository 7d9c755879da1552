"""Studies: trials with two objectives, and the trials that no other one beats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1024


def pareto(trials: DataFrame, up: str = "Total_Sensitivity", down: str = "Total_FAR") -> DataFrame:
    """Trials for which no other is at least as good in both objectives and better in one.

    With two objectives a sweep does it: in each group of equal ``up`` the least ``down`` counts, and it must lie below that
    of all higher groups. The groups are summed up first; the sweep goes over BINS equal ranges of ``up``, then within each, so that no
    task sees all groups.
    """
    best = trials.groupBy(up).agg(F.min(down).alias("down_"))
    ends = F.broadcast(best.agg(F.min(up).cast("double").alias("lo_"), F.max(up).cast("double").alias("hi_")))
    share = (F.col(up) - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))
    best = best.join(ends).withColumn("bin_", F.when(F.col("hi_") > F.col("lo_"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)))
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = best.groupBy("bin_").agg(F.min("down_").alias("least_"))
    bins = F.broadcast(bins.select("bin_", F.min("least_").over(above(Window.orderBy(F.col("bin_").desc()))).alias("beyond_")))
    higher = F.min("down_").over(above(Window.partitionBy("bin_").orderBy(F.col(up).desc())))
    front = best.withColumn("higher_", higher).join(bins, "bin_").filter("(higher_ is null or down_ < higher_) and (beyond_ is null or down_ < beyond_)")
    return trials.join(front.select(F.col(up).alias("up_"), "down_"), (F.col(up) == F.col("up_")) & (F.col(down) == F.col("down_"))).drop("up_", "down_")


def threshold_sweep(rows: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(trial, threshold, Total_Sensitivity, Total_FAR) of each threshold, all from one pass: a trial for each place in ``thresholds``.

    Each row is counted once, by how many of the sorted thresholds its score reaches; a trial's hits are those of all counts that reach it.
    So what is summed up after the pass is one small row for each number of thresholds. Total_Sensitivity is the share of rows of
    label 1 at or above the threshold, in percent, Total_FAR that of label 0; null where there are none. Null scores reach nothing.
    """
    order = sorted(range(len(thresholds)), key=lambda k: thresholds[k])
    levels = F.array(*[F.lit(float(thresholds[k])) for k in order])
    reached = F.size(F.filter(levels, lambda t: t <= F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))))
    found = rows.groupBy(reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    trials = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(k).alias("trial"), F.lit(float(thresholds[k])).alias("threshold")) for n, k in enumerate(order, 1)])
    over = lambda c: F.sum(F.when(F.col("reached") >= F.col("t.level"), F.col(c)).otherwise(0))
    sums = found.select("reached", "ones", "zeros", F.explode(trials).alias("t")).groupBy("t.trial", "t.threshold")
    return sums.agg((100 * F.try_divide(over("ones"), F.sum("ones"))).alias("Total_Sensitivity"), F.try_divide(over("zeros"), F.sum("zeros")).alias("Total_FAR"))


def run_study(spark: SparkSession, objective: Callable[[dict], tuple[float, float]], space: list[dict], n_trials: int = 20) -> DataFrame:
    """Up to ``n_trials`` points of ``space``, scored one after the other: (trial, params, Total_Sensitivity, Total_FAR)."""
    rows = []
    for k, params in enumerate(space[:n_trials]):
        sensitivity, far = objective(params)
        rows.append((k, {a: str(b) for a, b in params.items()}, float(sensitivity), float(far)))
    return spark.createDataFrame(rows, "trial int, params map<string,string>, Total_Sensitivity double, Total_FAR double")
