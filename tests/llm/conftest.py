"""Documents of the smallest scale with every awkward row that the operators must take."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

ODD = [
    (None, "a row without an id " * 3, "en", "src1"),
    (900_001, None, "en", "src1"),
    (900_002, "", "en", None),
    (900_003, " \t\n ", None, "src2"),
    (900_004, "one two three", "en", "src2"),
    (900_005, "one two three", "en", "src2"),
    (900_006, "One  two\nTHREE", "xx", "src2"),
    (900_007, "x" * 60_000, "en", "src3"),
    (900_008, "word " * 30_000, "en", "src3"),
    (900_009, "Ünïcödé Ärger 漢字 слово " * 20, "de", "src3"),
    (900_010, "mail a@b.c_d@e.f tel +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.256 10.0.0.255", "en", "src4"),
    (900_010, "mail a@b.c_d@e.f tel +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.256 10.0.0.255", "en", "src4"),
    (900_011, "@" * 500 + "1" * 500 + "+" * 500, "en", "src4"),
]
#: Extra columns with names that operators use for themselves.
CLASHING = ("tid", "found", "kept", "key", "host_key", "bad_lines", "doc", "hits", "n_words", "id", "component_id", "page_row", "kept_row", "n_dropped_lines", "unit", "spans")


@pytest.fixture(scope="session")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD, base.schema)
    both = base.unionByName(odd).withColumn("n_chars", F.length("text").cast("long"))
    return both.withColumns({c: F.lit(7) for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def bench_items(spark):
    base = spark.read.parquet(f"{SF}/benchmark.parquet")
    return base.unionByName(spark.createDataFrame([(5001, "one two three"), (5002, None), (5003, " . "), (5004, "漢字")], base.schema))
