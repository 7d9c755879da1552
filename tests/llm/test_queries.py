"""The registered queries, their SQL, and the pipeline."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tachygraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__

    have = __spark_entry__.queries()
    assert {int(k[2:].split("_")[0]) for k in have if k.startswith("op")} == set(range(1, 13)) and "pipeline" in have


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_all_rows(spark, name):
    table = {"op2_quotation": "conversations", "op9_html_extract": "pages", "op11_neighbours": "embeddings", "op12_prefix_trie": "conversations"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = QUERIES[name](spark, SF).count()
    if name == "op11_neighbours":
        #: Twenty for each twentieth row, as long as there are as many others.
        assert got == -(-n // 20) * min(20, n - 1)
    elif name == "op12_prefix_trie":
        assert got > n / 2
    else:
        assert got >= n if name == "op5_best_fit" else got == n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


def test_pipeline_stages(spark, docs):
    """Each stage keeps the columns, works on what came before, and equals its operator."""
    import corpus_pipeline
    from tachygraph.llm.decontam import contamination
    from tachygraph.llm.fertility import judged
    from tachygraph.llm.near_dedup import near_duplicates
    from tachygraph.llm.scratch import table

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    have = spark.read.parquet(f"{SF}/documents.parquet")
    columns = have.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, have = have, table(stage(spark, have, SF), name)
        assert have.columns == columns
        counts[name] = (before, have)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(counts["quality_rules"][1]) == ids(judged(counts["quality_rules"][0], ["doc_id"]).filter("kept"))
    assert ids(counts["line_dedup"][1]) == ids(counts["line_dedup"][0])
    assert ids(counts["near_dedup"][1]) == ids(near_duplicates(counts["near_dedup"][0]).filter("kept"))
    found = contamination(counts["decontamination"][0], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(counts["decontamination"][1]) == sorted(r[0] for r in found.filter("not contaminated").select("doc.doc_id").collect())
    last = corpus_pipeline.STAGES[-1][1](spark, have, SF)
    assert sorted({r[0] for r in last.select("doc_id").collect()}) == ids(have)
    assert corpus_pipeline.run(spark, SF).count() == last.count()


def test_pipeline_on_odd_rows(spark, docs, empty):
    """Nulls, repeated rows, long and empty texts, and columns with the operators' own names pass all stages; an empty table stays empty."""
    import corpus_pipeline
    from tachygraph.llm.scratch import stored

    for have in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, have = have, stored(lambda stage=stage, have=have: stage(spark, have, SF), name)
            assert have.columns == docs.columns and have.count() <= before.count()
            if name == "line_dedup":
                assert have.count() == before.count()
        got = corpus_pipeline.STAGES[-1][1](spark, have, SF)
        assert got.select("doc_id").distinct().count() == have.select("doc_id").distinct().count()
    #: Each stage on the odd rows themselves, as no quality rule would let them pass.
    rows = docs.count()
    by = dict(corpus_pipeline.STAGES)
    lines = by["line_dedup"](spark, docs, SF)
    assert lines.count() == rows and lines.filter("text is null").count() == docs.filter("text is null").count()
    once = by["near_dedup"](spark, docs, SF).collect()
    assert sum(r["doc_id"] == 900_010 for r in once) == 1 and {900_001, 900_002, 900_003} <= {r["doc_id"] for r in once}
    assert sum(r["doc_id"] in (900_004, 900_005, 900_006) for r in once) == 1
    clean = by["decontamination"](spark, docs, SF).collect()
    assert sum(r["doc_id"] == 900_010 for r in clean) == 2 and {900_001, 900_002, None} <= {r["doc_id"] for r in clean}
    parts = by["packing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in parts} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_tables_can_be_dropped(spark):
    from tachygraph.llm.scratch import drop_tables, table

    path = table(spark.range(3), "x").inputFiles()[0]
    assert drop_tables(spark) >= 1 and not Path(path.removeprefix("file:")).exists()


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tachygraph.llm import scratch

    thin = scratch.table(spark.range(5000), "thin")
    fat = scratch.table(spark.range(50).select(F.sha2(F.col("id").cast("string"), 512).alias("x"), F.expr("transform(sequence(1, 200), k -> sha2(cast(id * 1000 + k as string), 256))").alias("y")), "fat")
    assert scratch.is_small(thin) and scratch.is_small(fat) and not scratch.is_small(thin, 4999)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 50_000)
    assert scratch.is_small(thin) and not scratch.is_small(fat)
