"""Best-fit packing with conflicts.

Documents are packed into bins of CAPACITY words. No bin holds two documents of one source or of one duplicate cluster.
Rows are dealt at random (by hash) into units of about UNIT_ROWS; each unit is packed by itself, largest document first:
the bins stand in order of their residual space and carry bitmaps of their sources and clusters; the search begins at the
tightest bin that is large enough and goes on to its successors until one has no conflict, else a new bin opens. The
number of units grows with the rows, so a task's memory and time do not.

Bins with at most OPEN of their capacity left are closed. Those with more are opened again, from all units, and what they held is
dealt anew and packed together in a further round, until one unit holds it all or ROUNDS have passed. So a closed bin is
full but for OPEN, and only the last round's units have ends of their own: without conflicts, each has at most one bin that is
not more than half full.

A document longer than CAPACITY is cut into full bins and a rest, which is packed as the others are. Nulls: a null or
wordless text is one part of 0 words; a null source or cluster conflicts with nothing; a null doc_id is packed as any.
Ties go by doc_id, part, and order of bins. Repeated rows share a cluster, so they never meet in a bin. An empty table
gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachygraph.llm.scratch import table
from tachygraph.llm.textwords import SPACE, count_words, lower_ascii

CAPACITY = 2048
UNIT_ROWS = 4096
ROUNDS = 3
OPEN = 1 / 64


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each item, in the given order. A negative source or cluster conflicts with nothing."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_bits[order[at][1]] & s or cluster_bits[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        insort(order, (residual - size, b))
        out.append(b)
    return out


def _codes(values: pd.Series) -> list[int]:
    return pd.factorize(values)[0].tolist()


def best_fit(docs: DataFrame, capacity: int = CAPACITY, source: str = "source", cluster: str | None = None, unit_rows: int = UNIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each part of each document: (doc_id, part, n_words, start_word, bin, bin_free).

    cluster: the column of duplicate clusters; without one, texts that are equal but for case and white space form one.
    """
    same = F.md5(lower_ascii(F.regexp_replace(F.trim(F.col("text")), SPACE, " "))) if cluster is None else F.col(cluster).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_words(F.col("text")).alias("words"), F.col(source).cast("string").alias("source"), same.alias("cluster"))
    #: Rows without an id would all meet if they are alike.
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "cluster", "words", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    full = F.floor(F.greatest(F.col("words") - 1, F.lit(0)) / capacity).cast("int")
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), full)))
    parts = parts.withColumn("n_words", F.least(F.col("words") - F.col("part") * F.lit(capacity), F.lit(capacity)).cast("long"))
    left = table(parts.select("doc_id", "part", "n_words", "source", "cluster", "deal"), "parts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "cluster", "part"], ascending=[False, True, True, True], na_position="last", kind="stable").reset_index(drop=True)
        bins = pd.Series(pack(pdf["n_words"].tolist(), _codes(pdf["source"]), _codes(pdf["cluster"]), capacity))
        used = pdf["n_words"].groupby(bins).transform("sum")
        return pdf.drop(columns="unit").assign(bin=pdf["unit"].astype(str) + "-" + bins.astype(str), bin_free=capacity - used)

    done = None
    for turn in range(rounds):
        units = max(1, -(-left.count() // unit_rows))
        dealt = left.withColumn("unit", F.pmod(F.xxhash64("deal", "part", F.lit(turn)), F.lit(units)))
        packed = dealt.groupBy("unit").applyInPandas(run, "doc_id long, part int, n_words long, source string, cluster string, deal long, bin string, bin_free long")
        last = units == 1 or turn == rounds - 1
        packed = packed if last else table(packed, "packed")
        open_bin = F.col("bin_free") > int(OPEN * capacity)
        closed = packed if last else packed.filter(~open_bin)
        closed = closed.select("doc_id", "part", "n_words", (F.col("part").cast("long") * capacity).alias("start_word"), F.concat(F.lit(f"{turn}-"), "bin").alias("bin"), "bin_free")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        left = packed.filter(open_bin).select(*left.columns)
    return done
