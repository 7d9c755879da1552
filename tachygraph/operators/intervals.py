"""Interval algebra: sessions, merging, islands, band joins, greedy spacing. No window of rows spans a whole key (see ``scans``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.operators import scans

#: Positions in a chunk that is handled as one array, and chunks whose functions are composed in one step.
PIECE, FAN = 4096, 1024


def sessions(points: DataFrame, by: list[str], at: str, gap: float = 5, before: float = 60, after: float = 300, number: str | None = None) -> DataFrame:
    """(by..., start, end): runs of points whose gaps are at most ``gap``, padded, and merged where they touch or overlap.

    A key with a single point has none. Padded runs touch where the gap between them is at most ``before`` + ``after``, so that is what
    splits. ``number`` adds a span's number in its key, from 0, under that name. Keys are cut by time into pieces of CHUNK / 16 gaps.
    """
    reach = max(gap, before + after)
    width = reach * scans.CHUNK / 16
    sizes = points.groupBy(*by).agg(F.count("*").alias("n_")).filter("n_ >= 2").select(*by)
    near = scans.overlapping(points.select(*by, at), at, behind=reach, width=width)
    prev = F.lag(at).over(Window.partitionBy(*by, "chunk_").orderBy(at, F.col("own_")))
    marked = scans.owned(near.withColumn("new_", F.coalesce((F.col(at) - prev > reach).cast("int"), F.lit(1)))).join(sizes, by, "left_semi")
    runs = scans.scanned(marked, by, at, {"run_": ("sum", F.col("new_"))}, width, [F.col("new_").desc()])
    spans = runs.groupBy(*by, "run_").agg((F.min(at) - before).alias("start"), (F.max(at) + after).alias("end"))
    return spans.select(*by, "start", "end", *([(F.col("run_") - 1).cast("long").alias(number)] if number else []))


def merged(spans: DataFrame, by: list[str], width: float | None = None) -> DataFrame:
    """(by..., start, end): spans that touch or overlap as one. Keys are cut by their spans' starts into pieces of ``width``."""
    marked = scans.scanned(spans.select(*by, "start", "end"), by, "start", {"reach_": ("max", F.col("end"))}, width, ["end"], -1)
    marked = marked.withColumn("new_", F.coalesce((F.col("start") > F.col("reach_")).cast("int"), F.lit(1)))
    runs = scans.scanned(marked, by, "start", {"run_": ("sum", F.col("new_"))}, width, ["end", "reach_"])
    return runs.groupBy(*by, "run_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run_")


def islands(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by..., first, last, n): runs of consecutive integers in ``at``."""
    runs = scans.numbered(rows.select(*by, at), by, at, "k_").withColumn("run_", F.col(at) - F.col("k_"))
    return runs.groupBy(*by, "run_").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("run_")


def band_join(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, width: int) -> DataFrame:
    """Pairs with |x - y| <= width: an equi-join on buckets of ``width``, each left row probing its own and its two neighbours."""
    bucket = F.floor(F.col(x) / width)
    probes = left.withColumn("bucket_", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    keyed = right.withColumn("bucket_", F.floor(F.col(y) / width))
    return probes.join(keyed, [*by, "bucket_"]).filter(F.abs(F.col(x) - F.col(y)) <= width).drop("bucket_")


def contained(points: DataFrame, spans: DataFrame, by: list[str], at: str, width: int = 600_000) -> DataFrame:
    """Points strictly inside spans (start, end), by buckets that each span covers."""
    cover = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return points.withColumn("bucket_", F.floor(F.col(at) / width)).join(cover, [*by, "bucket_"]).filter((F.col(at) > F.col("start")) & (F.col(at) < F.col("end"))).drop("bucket_")


def _in_turn(functions: Column, start: Column, step: Callable[[Column, Column], Column], first: Column) -> Column:
    """Folds sorted (n, f): the state is ``start`` before number ``first``; over numbers that are missing it becomes 0s.

    Gives the state at the end, the number that would come ``next``, and what was ``met``: for each n its first state before and after.
    """

    def fold(acc: Column, x: Column) -> Column:
        state = F.when(x["n"] == acc["next"], acc["state"]).otherwise(F.transform(acc["state"], lambda s: F.lit(0)))
        done = step(state, x)
        met = F.struct(x["n"].alias("n"), state[0].alias("state"), done[0].alias("after"))
        return F.struct((x["n"] + 1).alias("next"), done.alias("state"), F.array_append(acc["met"], met).alias("met"))

    none = F.array().cast("array<struct<n:bigint,state:int,after:int>>")
    return F.aggregate(functions, F.struct(first.cast("long").alias("next"), start.alias("state"), none.alias("met")), fold)


def spaced(points: DataFrame, by: list[str], at: str, least: int, chunk: int = PIECE, fan: int = FAN) -> DataFrame:
    """(by..., at): of each key's integers in order, the first and then each that is at least ``least`` after the last taken one.

    Each choice hangs on the one before, by one number only: how far into a chunk nothing may be taken yet. It is less than ``least``, so a
    chunk is a function of ``least`` values; functions of FAN chunks on end are composed to one, a key's composed ones are
    followed from its first on, and the numbers go back to the chunks, which then take their integers independently.
    """
    chunk = max(chunk, least)
    pieces = points.select(*by, F.col(at).cast("long").alias(at)).withColumn("chunk_", scans.chunk_of(at, chunk))
    pieces = pieces.groupBy(*by, "chunk_").agg(F.array_sort(F.collect_set(at)).alias("xs")).withColumn("begin_", F.col("chunk_") * chunk)
    until = lambda start: F.aggregate("xs", start, lambda free, x: F.when(x >= free, x + least).otherwise(free))
    jump = lambda s: F.greatest(until(F.col("begin_") + s) - F.col("begin_") - chunk, F.lit(0)).cast("int")
    waits = F.sequence(F.lit(0), F.lit(least - 1))
    functions = pieces.select(*by, "chunk_", F.transform(waits, jump).alias("f"), F.floor(F.col("chunk_") / fan).alias("group_"))
    held = functions.groupBy(*by, "group_").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_").alias("n"), "f"))).alias("fs"))
    whole = _in_turn(F.col("fs"), waits, lambda s, x: F.transform(s, lambda v: F.get(x["f"], v)), F.col("group_") * fan)
    #: A group that ends before its last chunk leaves nothing to wait for.
    whole = F.when(whole["next"] == (F.col("group_") + 1) * fan, whole["state"]).otherwise(F.array_repeat(F.lit(0), least))
    groups = held.select(*by, F.struct(F.col("group_").alias("n"), whole.alias("f")).alias("g")).groupBy(*by).agg(F.array_sort(F.collect_list("g")).alias("gs"))
    follow = lambda s, x: F.array(F.get(x["f"], s[0]))
    begins = groups.select(*by, F.explode(_in_turn(F.col("gs"), F.array(F.lit(0)), follow, F.col("gs")[0]["n"])["met"]).alias("m"))
    begins = begins.select(*by, F.col("m.n").alias("group_"), F.col("m.state").alias("from_"))
    inside = _in_turn(F.col("fs"), F.array("from_"), follow, F.col("group_") * fan)["met"]
    after = held.join(begins, [*by, "group_"]).select(*by, F.explode(inside).alias("m")).select(*by, (F.col("m.n") + 1).alias("chunk_"), F.col("m.after").alias("wait_"))
    free = F.col("begin_") + F.coalesce("wait_", F.lit(0))
    none = F.array().cast("array<bigint>")
    take = lambda a, x: F.when(x >= a["free"], F.struct((x + least).alias("free"), F.array_append(a["out"], x).alias("out"))).otherwise(a)
    taken = F.aggregate("xs", F.struct(free.alias("free"), none.alias("out")), take, lambda a: a["out"])
    return pieces.join(after, [*by, "chunk_"], "left").select(*by, F.explode(taken).alias(at))
