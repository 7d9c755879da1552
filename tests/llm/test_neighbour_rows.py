"""Cells give back what may be among a query's nearest, however many shards it is sent to."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tachygraph.llm import neighbours
from tachygraph.llm.neighbours import nearest


def test_few_rows_come_back_from_many_shards(spark, monkeypatch):
    """Short shards, so that a query meets dozens; the nearest are all found, as all lists are searched."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 32)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "PRUNE", 100.0)
    rng = np.random.default_rng(9)
    centres = 3 * rng.normal(size=(30, 8))
    x = np.float32(centres[np.arange(3000) % 30] + rng.normal(size=(3000, 8)))
    given, plain = [], neighbours._best

    def counted(place, wanted):
        run, total = plain(place, wanted), spark.sparkContext.accumulator(0)
        given.append(total)

        def again(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = run(queries, rows)
            total.add(len(out))
            return out

        return again

    monkeypatch.setattr(neighbours, "_best", counted)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest(rows).collect()}
    full = x.astype(float)
    for q in range(0, 3000, 20):
        score = full @ full[q]
        score[q] = -np.inf
        assert [got[q, k] for k in range(1, 21)] == np.lexsort((np.arange(3000), -score))[:20].tolist()
    #: A full answer from each of some fifty shards would be 1,000 rows a query.
    assert 0 < sum(t.value for t in given) < 150 * 250
