"""Connected components by label propagation with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachygraph.llm.scratch import table


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of ``edges`` (a, b: long), the smallest id that it is linked with, itself included.

    Each round joins the labels to the edges, takes the least label of each node's neighbours (partial sums first, so that
    a hub costs no more than its edges) and then jumps to the label's own label. It ends when no label changes. Nothing
    but a count of changed labels comes to the driver. Null ends are ignored; no edges give an empty table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null and a <> b").distinct()
    both = table(both, "edges")
    labels = table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        roots = labels.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        moved = moved.join(roots, moved["next"] == roots["root"], "left").select("id", "old", F.least("next", F.coalesce("jump", "next")).alias("component"))
        moved = table(moved, "labels")
        labels = moved.select("id", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
