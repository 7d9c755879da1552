"""The jobs as queries: each runs twice into a new folder, and gives its output as it stands then; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import beat_features, report_passages
from tachygraph.oracles import BLOCKS_SQL, FILL_SQL, PEAKS_SQL, RULES_SQL, SMOOTH_SQL, windows_sql
from tachygraph.sources.shared import fresh


def job1_beat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all recordings; the second run finds nothing new."""
    at = fresh(spark, "job1")
    for _ in range(2):
        beat_features.run(spark, f"{sf_dir}/events.parquet", f"{at}/out", f"{at}/checkpoint", beat_features.Config())
    got = beat_features.read_features(spark, f"{at}/out")
    return got.select("day", "record", "row", "n_beats", "detected", *[F.round(c, 6).alias(c) for c in ("avg", "sd", "rmssd", "quality")])


def job2_report_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents; the second run writes the same."""
    at = fresh(spark, "job2")
    for _ in range(2):
        report_passages.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", report_passages.Config())
    got = report_passages.read_passages(spark, f"{at}/out")
    return got.select("lang", "source", "doc_id", "first", "last", "n_hits", F.round("score", 6).alias("score"), "text")


QUERIES = {f.__name__: f for f in (job1_beat_features, job2_report_passages)}

_TERMS = ", ".join(f"'{t}'" for t in sorted(report_passages.Config().terms))

ORACLES = {
    "job1_beat_features": f"""
with ev as (select datediff('day', date '1970-01-01', ts::date) * 1000000 + user_id % 4 as record_id, event_id, ts, (600 + floor(value))::bigint as rr_ms from events),
rr as (select record_id, event_id, seq, right_ms - rr_ms as left_ms, right_ms, rr_ms from (
  select *, row_number() over w - 1 as seq, (sum(rr_ms) over (partition by record_id order by ts, event_id rows unbounded preceding))::bigint as right_ms
  from ev window w as (partition by record_id order by ts, event_id))),
{windows_sql(30)}, {PEAKS_SQL}, {RULES_SQL},
f as (select record_id, row, count(*) as n_beats, avg(x) as avg, stddev_pop(x) as sd, sqrt(avg(d * d)) as rmssd from inw group by record_id, row),
v0 as (select record_id, row, case when coalesce(q.quality, 0) < 75 or f.avg is null then -1 when 60000.0 / f.avg >= 72 then 1 else 0 end as value
       from win left join f using (record_id, row) left join q using (record_id, row)),
{FILL_SQL}, {SMOOTH_SQL}, {BLOCKS_SQL}
select date '1970-01-01' + (f.record_id // 1000000)::int as day, f.record_id % 1000000 as record, row, n_beats, blocks.start_row is not null as detected,
       round(avg, 6) as avg, round(sd, 6) as sd, round(rmssd, 6) as rmssd, round(q.quality, 6) as quality
from f left join q using (record_id, row) left join blocks on blocks.record_id = f.record_id and blocks.start_row = f.row""",
    "job2_report_passages": f"""
with s0 as (select doc_id as record_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
                   list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') as sentences
            from documents where doc_id is not null and text is not null),
s1 as (select record_id, u.k - 1 as row, list_filter(regexp_split_to_array(translate(sentences[u.k], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D,;:]+'), lambda w: w <> '') as words
       from s0, unnest(range(1, len(sentences) + 1)) as u(k)),
s2 as (select record_id, row, case when len(words) >= 3 then len(list_filter(words, lambda w: w in ({_TERMS})))::double / len(words) end as score from s1),
v0 as (select record_id, row, score, case when score is null then -1 when score >= 0.1 then 1 else 0 end as value from s2),
{FILL_SQL}, {SMOOTH_SQL}, {BLOCKS_SQL.replace("+ 60", "+ 20")},
hits as (select b.record_id, b.start_row, max(v.row) as last, count(*) filter (v.value = 1) as n_hits, avg(v.score) as score
         from blocks b join v0 v on v.record_id = b.record_id and v.row between b.start_row and b.start_row + 19 group by all)
select lang, source, record_id as doc_id, start_row as first, last, n_hits, round(score, 6) as score, array_to_string(sentences[start_row + 1:last + 1], '. ') as text
from hits join s0 using (record_id)""",
}
