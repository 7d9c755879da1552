"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.fertility import judged

    return judged(_read(spark, sf_dir, "documents"), ["doc_id"])


def op2_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.quotation import reply_order

    return reply_order(_read(spark, sf_dir, "conversations"))


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.sanitise import KINDS, personal_data, sanitised, span_text

    got = sanitised(personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    counts = [F.coalesce(F.size(f"{k}_spans"), F.lit(0)).cast("long") for k in KINDS]
    counts = [F.greatest(c, F.lit(0)).alias(f"n_{k}") for c, k in zip(counts, KINDS, strict=True)]
    return got.select(F.col("doc.doc_id").alias("doc_id"), *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"), "clean")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.shards import minimax_shards

    return minimax_shards(_read(spark, sf_dir, "documents"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.packing import best_fit

    return best_fit(_read(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.decontam import contamination

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    got = contamination(docs, _read(spark, sf_dir, "benchmark"))
    return got.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.toxicity import scored

    return scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.html_extract import extracted

    return extracted(_read(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.line_dedup import drop_lines

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, "source")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.neighbours import nearest

    return nearest(_read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tachygraph.llm.prefix_trie import prefix_trie

    return prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fertility, op2_quotation, op3_sanitise, op4_shards, op5_best_fit, op6_decontam, op7_near_dedup, op8_toxicity, op9_html_extract,
        op10_line_dedup, op11_neighbours, op12_prefix_trie,
    )
}

ORACLES = {
    "op10_line_dedup": """
with d as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
     totals as (select source, count(*) as pages from d where text is not null group by source),
     ln as (select source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) as line from d where text is not null),
     freq as (select source, line, count(*) as n from ln group by source, line),
     bad as (select f.source, list(f.line) as bad from freq f join totals t on f.source is not distinct from t.source
             where f.n >= 2 and f.n > t.pages * 0.02 group by f.source)
select d.doc_id, d.source,
       case when bad.bad is null then d.text
            else array_to_string(list_filter(d.lines, lambda x: trim(x) = '' or not list_contains(bad.bad, trim(x))), chr(10)) end as text,
       case when bad.bad is null or d.text is null then 0
            else len(list_filter(d.lines, lambda x: trim(x) <> '' and list_contains(bad.bad, trim(x)))) end::bigint as n_dropped_lines
from d left join bad on d.source is not distinct from bad.source""",
    "op12_prefix_trie": r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as k
           from conversations where conv_id is not null),
     c as (select conv_id, conv_id - conv_id % 20 as base,
                  xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a // 2, 3988292384 * (a % 2))))) % 4 as h
           from (select distinct conv_id from t)),
     r as (select c.conv_id, t.k, t.role, t.text from c join t on t.conv_id = c.base and t.k < c.h
           union all
           select c.conv_id, t.k - c.h + least(c.h, (select count(*) from t b where b.conv_id = c.base)), t.role, t.text from c join t on t.conv_id = c.conv_id and t.k >= c.h),
     chained as (select conv_id, k + 1 as depth, text, list(md5(length(role)::varchar || ':' || role || text)) over (partition by conv_id order by k) as path from r),
     paths as (select conv_id, depth, text, path from chained union all select conv_id, 0, '', [] from c),
     lens as (select conv_id, max(depth) as len from paths group by conv_id),
     nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(text) as text,
                      string_agg(conv_id::varchar, ',' order by conv_id) filter (len = depth) as ends
               from paths join lens using (conv_id) group by path, depth),
     named as (select p.conv_id as member, p.depth, n.conv_id, n.n_convs from paths p join nodes n using (path, depth)),
     kids as (select p.conv_id, p.depth, count(*) as n_children from nodes n join named p on p.member = n.conv_id and p.depth = n.depth - 1 group by all),
     full_ as (select n.conv_id, n.depth, n.n_convs, n.ends, coalesce(k.n_children, 0) as n_children,
                      (n.n_convs - 1) * len(list_filter(regexp_split_to_array(n.text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as saves
               from nodes n left join kids k using (conv_id, depth)),
     sums as (select p.conv_id, p.depth, sum((f.n_children = 0)::bigint) as n_leaves, sum(f.saves) as saved_tokens
              from full_ f join named p on p.member = f.conv_id and p.depth <= f.depth group by all)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens,
       sha256(coalesce(f.ends, '')) as ends_sha256
from full_ f join sums s using (conv_id, depth) left join named p on p.member = f.conv_id and p.depth = f.depth - 1""",
}
