"""DuckDB SQL for the registered queries that SQL can express, written independently of the Spark plans."""

from __future__ import annotations

_RR = """
rr as (select record_id, event_id, event_type, seq, right_ms - rr_ms as left_ms, right_ms, rr_ms from (
  select user_id % 4 as record_id, event_id, event_type, row_number() over w - 1 as seq, (600 + floor(value))::bigint as rr_ms,
         (sum((600 + floor(value))::bigint) over (partition by user_id % 4 order by ts, event_id rows unbounded preceding))::bigint as right_ms
  from events window w as (partition by user_id % 4 order by ts, event_id)))"""

_DIRTY = """
len_ as (select *, (600 + floor(value))::bigint as b from events),
cut_ as (select user_id % 4 as record_id, event_id, event_type, ts, (case when event_id % 997 = 0 then 12000 when event_id % 499 = 0 then 4600
   when (event_id // 100) % 20 = 0 then (b * 5) // 2 when (event_id // 100) % 20 = 1 then b // 4 when event_id % 97 = 0 then 3 * b
   when event_id % 89 = 0 then b // 3 else b end)::bigint as rr_ms from len_),
rr as (select record_id, event_id, event_type, seq, right_ms - rr_ms as left_ms, right_ms, rr_ms from (
  select *, row_number() over (partition by record_id order by ts, event_id) - 1 as seq,
         (sum(rr_ms) over (partition by record_id order by ts, event_id rows unbounded preceding))::bigint as right_ms from cut_))"""


def windows_sql(w: int) -> str:
    return f"""
n_ as (select record_id, greatest((max(right_ms) // 1000 - {w}) // 5, 1)::bigint as rows from rr group by record_id),
win as (select record_id, u.row, u.row * 5000 as a, u.row * 5000 + {w * 1000} as z from n_, unnest(range(rows)) as u(row)),
inw as (select win.record_id, win.row, rr.seq, rr.rr_ms::double as x, row_number() over p - 1 as i, count(*) over (partition by win.record_id, win.row) as n,
        rr.rr_ms - lag(rr.rr_ms) over p as d
        from win join rr on rr.record_id = win.record_id and rr.left_ms >= a and rr.right_ms <= z window p as (partition by win.record_id, win.row order by rr.seq))"""


_F = """
base as (select record_id, row, count(*) as n_beats, avg(x) as avg, stddev_pop(x) as sd, var_pop(x) as variance, sqrt(avg(d * d)) as rmssd,
         case when stddev_pop(x) = 0 then null else skewness(x) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) end as skew, kurtosis_pop(x) as kurt,
         regr_slope(x, i) as b, count(*) filter (abs(d) >= 50) as nnx, quantile_cont(x, 0.25) as quantile_25, quantile_cont(x, 0.5) as quantile_50,
         quantile_cont(x, 0.75) as quantile_75, stddev_pop(d) as sd_d from inw group by record_id, row),
det as (select record_id, row, sqrt(avg(pow(inw.d - base.b, 2))) as rmssd_dt from inw join base using (record_id, row) where inw.d is not null group by record_id, row),
his as (select record_id, row, sum(h)::double / max(h) as triangular_index from (select record_id, row, least(floor(x / 7.8125), 318) as k, count(*) as h from inw where x <= 2492.1875 group by all) group by record_id, row)"""

_F60 = """
med as (select * from (select record_id, row, i, n, x, quantile_cont(x, 0.5) over (partition by record_id, row order by seq rows 6 preceding) as m from inw) where i >= 6),
medd as (select *, m - lag(m) over (partition by record_id, row order by i) as md, row_number() over (partition by record_id, row order by i) - 1 as j from med),
fil as (select record_id, row, regr_slope(m, j) as slope, stddev_pop(m) as sd_m, stddev_pop(md) as sd_md, count(*) as n_m, list(m order by i) as ms from medd group by record_id, row),
xs as (select record_id, row, list(x order by i) as l from inw group by record_id, row),
sd_ as (select record_id, row, n_beats, sd_d / sqrt(2) as sd1, case when 2 * sd * sd - sd_d * sd_d / 2 >= 0 then sqrt(2 * sd * sd - sd_d * sd_d / 2) end as sd2,
        sd_md / sqrt(2) as f1, case when 2 * sd_m * sd_m - sd_md * sd_md / 2 >= 0 then sqrt(2 * sd_m * sd_m - sd_md * sd_md / 2) end as f2, slope,
        case when n_beats >= 3 then (l[-1] + l[-2] - l[1] - l[2]) / 2 else 0 end as hr, case when coalesce(n_m, 0) >= 3 then (ms[-1] + ms[-2] - ms[1] - ms[2]) / 2 else 0 end as hrf
        from base join xs using (record_id, row) left join fil using (record_id, row)),
csi_ as (select *, sd2 / nullif(sd1, 0) as csi, pow(4 * sd2, 2) / nullif(4 * sd1, 0) as csim, f2 / nullif(f1, 0) as fcsi, pow(4 * f2, 2) / nullif(4 * f1, 0) as fcsim from sd_)"""

PEAKS_SQL = """
pk as (select record_id, event_id, right_ms as t from rr),
inp as (select record_id, u.row, t from pk, unnest(range(greatest(t // 5000 - 3, 0), t // 5000 + 2)) as u(row) where u.row * 5000 < t and t < u.row * 5000 + 10000)"""

RULES_SQL = """
gp as (select record_id, row, t, t - lag(t) over (partition by record_id, row order by t) as gap from inp),
rules as (select record_id, row, count(*) as n, avg(case when gap is not null then 60000.0 / greatest(gap, 1e-6) end) as mean_rate, max(gap)::double as longest, min(gap)::double as shortest from gp group by record_id, row),
q as (select *, case when n < 3 or mean_rate <= 40 or mean_rate >= 180 or longest > 3000 or longest / greatest(shortest, 1e-6) >= 2.2 then 0.0 else 100.0 end::double as quality from rules)"""

_MATCH = """
p2_ as (select record_id, u.row, t from (select record_id, right_ms + (event_id * 37) % 400 - 200 as t from rr where event_id % 17 <> 0), unnest(range(greatest(t // 5000 - 3, 0), t // 5000 + 2)) as u(row) where u.row * 5000 < t and t < u.row * 5000 + 10000),
l1 as (select record_id, row, list(t order by t) as one from inp group by 1, 2), l2 as (select record_id, row, list(t order by t) as other from p2_ group by 1, 2),
both_ as (select record_id, row, coalesce(one, []) as one, coalesce(other, []) as other from l1 full join l2 using (record_id, row)),
mt as (with recursive g as (
  select record_id, row, one, other, 0 as i, []::bigint[] as used from both_
  union all
  select record_id, row, one, other, i + 1, case when best is null then used else list_append(used, best) end from (
    select *, list_sort(list_transform(list_filter(range(1, len(other) + 1), lambda k: not list_contains(used, k) and abs(other[k] - one[i + 1]) <= 150), lambda k: [abs(other[k] - one[i + 1]), k]))[1][2] as best from g where i < len(one)))
  select record_id, row, len(one) as n1, len(other) as n2, len(used) as tp from g where i = len(one))"""

_SCORE = """
n_ as (select record_id, greatest((max(right_ms) // 1000 - 30) // 5, 1)::bigint as rows from rr group by record_id),
sr as (select record_id, u.row, u.row % 29 <> 0 as valid, case when u.row % 13 = 0 then 0 when ((u.row // 5) * 2654435761 + record_id * 97) % 1000 >= 450 then 1 else 0 end as hit from n_, unnest(range(rows)) as u(row)),
v0 as (select record_id, row, case when valid then hit else -1 end as value from sr)"""

FILL_SQL = """
lists as (select record_id, list(value order by row) as l from v0 group by record_id),
ones as (select record_id, row, lead(row) over (partition by record_id order by row) as nxt from v0 where value = 1),
gap as (select record_id, row as a, nxt as z from ones where nxt - row between 2 and 3 and not exists (select 1 from v0 where v0.record_id = ones.record_id and v0.row > ones.row and v0.row < ones.nxt and v0.value = -1)),
v1 as (select v0.record_id, v0.row, case when v0.value = 0 and exists (select 1 from gap where gap.record_id = v0.record_id and v0.row > a and v0.row < z) then 1 else v0.value end as value from v0)"""

SMOOTH_SQL = """
runs as (select record_id, min(row) as s, count(*) as l from (select record_id, row, row - row_number() over (partition by record_id order by row) as g from v1 where value = 1) group by record_id, g),
tails as (select record_id, s + 3 * (l // 3) as a, s + l - 1 as z from runs where l % 3 <> 0),
gone as (select t.record_id, t.a, t.z from tails t join (select record_id, max(row) as e from v1 group by 1) m using (record_id) where t.a + 2 <= m.e
         and not exists (select 1 from v1 where v1.record_id = t.record_id and v1.row between t.a and t.a + 2 and v1.value = -1)),
v2 as (select record_id, row, case when exists (select 1 from gone g where g.record_id = v1.record_id and v1.row between g.a and g.z) then 0 else value end as value from v1)"""

BLOCKS_SQL = """
cand as (select record_id, list(row order by row) as l from (select record_id, row from (select record_id, row, value, lead(value, 1) over w as b, lead(value, 2) over w as c from v2 window w as (partition by record_id order by row)) where value = 1 and b = 1 and c = 1) group by record_id),
blocks as (select record_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: case when x[1] >= acc[-1] + 60 then list_concat(acc, x) else acc end)) as start_row from cand)"""

_TABLE = """
f_ as (select record_id, row, avg(x) as avg from inw group by record_id, row),
tab as (select record_id, row, avg, quality, avg > 650 as is_event, row % 11 <> 0 as without_seizure from f_ join q using (record_id, row))"""

_EVAL = """
onsets as (select event_id as onset_id, user_id as record_id, epoch_us(ts) // 1000 as onset_ms from events where event_type = 'error'),
dets as (select event_id as det_id, user_id as record_id, epoch_us(ts) // 1000 as start_ms from events where event_type = 'purchase'),
pairs as (select record_id, onset_id, onset_ms, det_id, start_ms from onsets join dets using (record_id) where abs(onset_ms - start_ms) <= {tol}),
hits as (select o.onset_id, o.record_id, exists (select 1 from pairs p where p.onset_id = o.onset_id) as is_detected from onsets o),
res as (select d.det_id, d.record_id, case when exists (select 1 from pairs p where p.det_id = d.det_id) then 'tp' else 'fp' end as result from dets d)"""

_RECORDS = """
rec as (select record_id, patient_id, (epoch_us(max_ts) - epoch_us(min_ts)) // 1000000 as record_duration_s, (record_id % 3 * 300)::bigint as deficiency_s,
        (select count(*) from res where res.record_id = r.record_id and result = 'fp') as n_det_fp, (select count(*) from res where res.record_id = r.record_id and result = 'tp') as n_det_tp
        from (select user_id as record_id, user_id % 10 as patient_id, max(ts) as max_ts, min(ts) as min_ts from events group by 1, 2) r)"""

_PATIENTS = """
rp as (select patient_id, sum(n_det_fp)::bigint as n_fp, sum(record_duration_s) / 86400.0 as days from rec group by 1),
sp as (select record_id % 10 as patient_id, count(*) filter (is_detected) as n_tp, count(*) filter (not is_detected) as n_fn from hits group by 1),
pj as (select patient_id, coalesce(n_tp, 0) as n_tp, coalesce(n_fn, 0) as n_fn, coalesce(n_fp, 0) as n_fp, coalesce(days, 0) as days from rp full join sp using (patient_id)),
pm as (select *, coalesce(2 * ppv * sensitivity / nullif(ppv + sensitivity, 0), 0) as f1 from (select *, coalesce(n_tp::double / nullif(n_tp + n_fp, 0), 0) as ppv, coalesce(n_tp::double / nullif(n_tp + n_fn, 0), 0) as sensitivity, coalesce(n_fp / nullif(days, 0), 0) as far from pj))"""

_CAT = """
cat as (select o_orderkey as seizure_id, o_custkey as patient_id, o_orderdate::date as record_start, o_orderdate::date + 1 as record_end, 'rec/' || o_orderkey as path from orders)"""
_BUILD = """
built as (select row_number() over (order by record_start, patient_id) - 1 as record_id, patient_id, record_start, arg_min(record_end, seizure_id) as record_end, arg_min(path, seizure_id) as path,
          string_agg(seizure_id::varchar, ',' order by seizure_id) as seizures, max(seizure_id)::varchar || '/unmasked' as unmasked from cat group by patient_id, record_start)"""


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


ORACLES: dict[str, str] = {
    "rr_sections": _with(_RR) + " select record_id, seq, left_ms, right_ms, right_ms - left_ms as rr_ms from (select record_id, seq, right_ms as left_ms, lead(right_ms) over (partition by record_id order by seq) as right_ms from rr) where right_ms is not null",
    "rr_intervals": _with(_RR) + " select record_id, right_ms as sample, round((right_ms - p) / 256.0 * 1000, 6) as rr_ms from (select *, lag(right_ms) over (partition by record_id order by seq) as p from rr) where p is not null",
    "rr_slice": _with(_RR) + " select record_id, seq, left_ms, right_ms, rr_ms from (select *, max(seq) over (partition by record_id) as m from rr where left_ms >= 60000 and right_ms <= 240000) where seq < m",
    "rr_slice_or_missing": _with(_RR) + """, sp as (select distinct record_id, u.a as start, u.a + 20000 as "end" from rr, unnest([0::bigint, 9000000000::bigint]) as u(a))
      select sp.record_id, sp.start, sp."end", coalesce(rr.left_ms, sp.start) as left_ms, coalesce(rr.right_ms, sp."end") as right_ms, rr.rr_ms from sp left join rr on rr.record_id = sp.record_id and rr.left_ms >= sp.start and rr.right_ms <= sp."end" """,
    "rr_split": _with(_RR) + """, h as (select *, round_even(rr_ms / 2.0, 0)::bigint as h from rr), p as (
      select record_id, seq, 0 as k, left_ms, case when seq % 10 = 3 then left_ms + h else right_ms end as right_ms, case when seq % 10 = 3 then h else rr_ms end as rr_ms from h
      union all select record_id, seq, 1, left_ms + h, right_ms, rr_ms - h from h where seq % 10 = 3)
      select record_id, row_number() over (partition by record_id order by seq, k) - 1 as seq, left_ms, right_ms, rr_ms from p""",
    "rr_split_many": _with(_RR) + """, p as (select record_id, seq, left_ms, case when seq % 10 = 4 then [rr_ms // 3, rr_ms // 3, rr_ms - 2 * (rr_ms // 3)] else [rr_ms] end as f from rr),
      u as (select record_id, seq, left_ms, k, f[k] as part, list_sum(f[1:k])::bigint as upto from p, unnest(range(1, len(f) + 1)) as t(k))
      select record_id, row_number() over (partition by record_id order by seq, k) - 1 as seq, left_ms + upto - part as left_ms, left_ms + upto as right_ms, part as rr_ms from u""",
    "rr_join": _with(_RR) + " select record_id, seq - (seq > 5)::bigint as seq, min(left_ms) as left_ms, max(right_ms) as right_ms, sum(rr_ms)::bigint as rr_ms from rr group by 1, 2",
    "rr_validate": _with(_RR) + """, n as (select *, lead(left_ms) over (partition by record_id order by seq) as nx from rr)
      select record_id, count(*) as n, bool_and(rr_ms = right_ms - left_ms) as lengths_ok, bool_and(coalesce(nx = right_ms, true)) as chained_ok, bool_and(rr_ms = right_ms - left_ms and coalesce(nx = right_ms, true)) as valid from n group by 1""",
    "rr_bounded": _with(_DIRTY) + " select record_id, seq, case when rr_ms between 300 and 2000 then rr_ms end as rr_ms from rr",
    "record_duration": _with(_RR) + " select record_id, (max(right_ms) - min(left_ms)) // 1000 as duration_s from rr group by 1",
    "rr_plot_points": _with(_RR) + " select record_id, seq, (left_ms + right_ms) / 2.0 as mid_ms, rr_ms from rr",
    "records_build": _with(_CAT, _BUILD) + " select record_id, patient_id, record_start, record_end, path, seizures, unmasked from built",
    "records_build_legacy": _with(_CAT) + """, first_ as (select record_start, arg_min(patient_id, seizure_id) as patient_id, arg_min(path, seizure_id) as path from cat where patient_id not in (select c_custkey from customer where c_acctbal < 0) group by 1),
      all_ as (select record_start, string_agg(seizure_id::varchar, ',' order by seizure_id) as seizures, max(seizure_id)::varchar || '/unmasked' as unmasked from cat group by 1)
      select record_start::varchar as record_id, patient_id, path, seizures, unmasked from first_ join all_ using (record_start)""",
    "records_by_patient": _with(_CAT) + " select patient_id, count(distinct record_start) as n_records, count(*) as n_seizures from cat group by 1",
    "patients_distinct": _with(_CAT) + " select distinct patient_id from cat",
    "seizure_times": _with(_CAT) + " select cat.seizure_id::varchar as seizure_id, e.ts as onset, e.ts + interval 60 seconds as offset from cat left join events e on e.event_id * 3 = cat.seizure_id",
    "seizures_of_record": _with(_CAT, _BUILD) + ' select record_id, cat.seizure_id, e.ts as onset, e.ts + interval 60 seconds as "offset", true as has_valid_data, true as is_event from built join cat using (patient_id, record_start) left join events e on e.event_id * 3 = cat.seizure_id',
    "patient_of_samples": _with(_CAT, _BUILD) + " select record_id, cat.seizure_id, patient_id from built join cat using (patient_id, record_start)",
    "window_counts": _with(_RR) + " select record_id, greatest((max(right_ms) // 1000 - w) // 5, 1)::bigint as rows, w from rr, unnest([30, 60, 300]) as u(w) group by record_id, w",
    "features_30": _with(_RR, windows_sql(30), _F) + " select record_id, row, n_beats, " + _r("avg", "sd", "rmssd", "rmssd_dt", "skew", "kurt") + ", round(nnx::double / nullif(n_beats - 1, 0), 6) as pnnx, nnx, " + _r("triangular_index", "quantile_25", "quantile_50", "quantile_75", "variance") + " from base left join det using (record_id, row) left join his using (record_id, row)",
    "features_60": _with(_RR, windows_sql(60), _F, _F60) + " select record_id, row, n_beats, " + _r("csi", "csim") + ", round(case when sd1 * sd2 > 0 then log10(16 * sd1 * sd2) end, 6) as cvi, " + _r("sd1", "sd2") + ", round(slope * csi, 6) as csi_slope, round(slope * csim, 6) as csim_slope, round(fcsi, 6) as csi_filtered, round(fcsim, 6) as csim_filtered, round(slope * fcsi, 6) as csi_filtered_slope, round(slope * fcsim, 6) as csim_filtered_slope, round(hr, 6) as hr_diff, round(hr * slope, 6) as hr_diff_slope, round(hrf, 6) as hr_diff_filtered, round(hrf * slope, 6) as hr_diff_filtered_slope from csi_",
    "feature_steps": _with(_RR, windows_sql(30)) + ", f as (select record_id, row, avg(x) as avg from inw group by 1, 2), s as (select record_id, row, avg(avg) over w as mean_avg, count(*) over w as n_steps from f window w as (partition by record_id order by row rows between current row and 54 following)) select record_id, row, n_steps::int as n_steps, round(mean_avg, 6) as mean_avg from s where n_steps = 55",
    "row_clock": "select event_id, row, timestamp '2024-01-01 00:00:00' + to_seconds(row * 5) as row_ts from (select event_id, epoch(ts - timestamp '2024-01-01 00:00:00')::bigint // 5 as row from (select event_id, date_trunc('second', ts) as ts from events))",
    "median_filter": _with(_RR) + " select record_id, seq, m as med from (select record_id, seq, quantile_cont(rr_ms, 0.5) over (partition by record_id order by seq rows 6 preceding) as m from rr) where seq >= 6",
    "peak_segments": _with(_RR, PEAKS_SQL) + " select record_id, row, count(*) as n, sum(t)::bigint as sum_ms from inp group by 1, 2",
    "quality_rules": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + " select record_id, row, n, " + _r("mean_rate", "longest", "shortest", "quality") + " from q",
    "bsqi_match": _with(_RR, PEAKS_SQL, _MATCH) + " select record_id, row, n1, n2, tp from mt",
    "quality_series": _with(_DIRTY, PEAKS_SQL, RULES_SQL, _MATCH) + """, e as (select record_id, max(right_ms) as z from rr group by 1)
      select record_id, row, case when n1 < 3 or n2 < 3 or mean_rate <= 40 or mean_rate >= 180 or longest > 3000 or longest / greatest(shortest, 1e-6) >= 2.2 then 0.0 else round(100 * tp::double / (n1 + n2 - tp), 2) end::double as quality
      from mt left join (select record_id, row, mean_rate, longest, shortest from rules) using (record_id, row) join e using (record_id) where row * 5000 < z - 10000""",
    "bsqi_score": """with e as (select event_id, event_id % 7 as tp, event_id % 7 + event_id % 3 as n1, event_id % 7 + event_id % 5 as n2 from events)
      select event_id, round(case when n1 = 0 or n2 = 0 then 0 else tp * 100.0::double / n1 end, 6) as simple, round(case when n1 = 0 or n2 = 0 then 0 else 2.0::double * tp / (n1 + n2) end, 6) as matching, round(case when n1 = 0 or n2 = 0 then 0 else tp::double / (n1 + n2 - tp) end, 6) as n_double from e""",
    "quality_300s": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + """, m as (select record_id, row, avg(quality) over (partition by record_id order by row rows between current row and 59 following) as mean_, max(row) over (partition by record_id) + 1 as n_ from q)
      select q.record_id, q.row, round(coalesce(m.mean_, 0), 6) as quality from q left join (select record_id, row + 1 as row, mean_ from m where row <= n_ - 61) m using (record_id, row)""",
    "quality_binary": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + " select record_id, row, coalesce(mean_rate > 40 and mean_rate < 180 and longest <= 3000 and longest / greatest(shortest, 1e-6) < 2.2, false)::int as good from rules",
    "quality_fraction": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + ", g as (select record_id, row, coalesce(mean_rate > 40 and mean_rate < 180 and longest <= 3000 and longest / greatest(shortest, 1e-6) < 2.2, false)::int as good from rules), f as (select record_id, row, avg(good) over w as fraction, count(*) over w as n from g window w as (partition by record_id order by row rows 59 preceding)) select record_id, row, round(fraction, 6) as fraction from f where n = 60",
    "deficiency": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + ", i as (select record_id, row - row_number() over (partition by record_id order by row) as g from q where quality < 75), l as (select record_id, sum((n - 1) * 5 + 300)::bigint as s from (select record_id, g, count(*) as n from i group by 1, 2) group by 1) select record_id, coalesce(s, 0) as deficiency_s from (select distinct record_id from q) left join l using (record_id)",
    "time_pairs": _with(_DIRTY) + """, b as (select record_id, left_ms / 1000.0 as t from rr where rr_ms > 2500), c as (select *, count(*) over (partition by record_id) as n from b),
      s as (select *, sum(f) over (partition by record_id order by t) as g from (select *, case when t - lag(t) over (partition by record_id order by t) <= 5 then 0 else 1 end as f from c where n >= 2)),
      p as (select record_id, min(t) - 60 as a, max(t) + 300 as z from s group by record_id, g), m as (select *, max(z) over (partition by record_id order by a, z rows between unbounded preceding and 1 preceding) as r from p),
      x as (select *, sum(case when a <= r then 0 else 1 end) over (partition by record_id order by a, z) as k from m), y as (select record_id, min(a) as a, max(z) as z from x group by record_id, k)
      select record_id, row_number() over (partition by record_id order by a) - 1 as segment_id, round(a, 6) as start, round(z, 6) as "end" from y""",
    "correction_segments": _with(_DIRTY) + """, b as (select record_id, left_ms / 1000.0 as t from rr where rr_ms > 2500), c as (select *, count(*) over (partition by record_id) as n from b),
      s as (select *, sum(f) over (partition by record_id order by t) as g from (select *, case when t - lag(t) over (partition by record_id order by t) <= 5 then 0 else 1 end as f from c where n >= 2)),
      p as (select record_id, min(t) - 60 as a, max(t) + 300 as z from s group by record_id, g), m as (select *, max(z) over (partition by record_id order by a, z rows between unbounded preceding and 1 preceding) as r from p),
      x as (select *, sum(case when a <= r then 0 else 1 end) over (partition by record_id order by a, z) as k from m), y as (select record_id, k, min(a) as a, max(z) as z from x group by record_id, k),
      i as (select *, row_number() over (partition by record_id order by a) - 1 as segment_id from y)
      select i.record_id, segment_id, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from i join rr on rr.record_id = i.record_id and right_ms / 1000.0 > a and right_ms / 1000.0 < z group by 1, 2 having count(*) >= 2""",
    "splice_segments": _with(_RR) + """, s as (select *, case when seq < 150 then 0 else 1 end as g, row_number() over (partition by record_id, seq < 150 order by seq) - 1 as k from rr where seq between 100 and 140 or seq between 200 and 205),
      k as (select record_id, seq, right_ms::double as t_s from rr where not (seq between 100 and 140 or seq between 200 and 205) union all select record_id, seq, right_ms::double from s where k % 2 = 0)
      select record_id, row_number() over (partition by record_id order by seq) - 1 as seq, t_s from k""",
    "negative_rr_audit": _with(_RR) + " select record_id, count(*) filter (d <= 0) as n_negative from (select record_id, t - lag(t) over (partition by record_id order by seq) as d from (select record_id, seq, right_ms - case when seq % 50 = 0 then 3000 else 0 end as t from rr)) group by 1",
    "interpolated_outliers": _with(_DIRTY) + """, p as (select record_id, list(right_ms / 1000.0 order by seq) as l, median(rr_ms / 1000.0) filter (seq > 0) as med from rr group by 1),
      acc as (with recursive w as (select record_id, 1 as k, l[1] as t, l, med from p union all select record_id, k + 1, case when l[k + 1] - t between 0.3 and 2.0 then l[k + 1] else t + med end, l, med from w where k < len(l)) select record_id, k, t from w)
      select record_id, (k - 1)::bigint as k, round(t, 4) as t_s from acc""",
    "ig_log_density": _with(_RR) + " select record_id, seq, round(ln(greatest(sqrt(12.0 / (2 * pi() * pow(d, 3))) * exp(least(greatest(-12.0 * pow(d - 0.8, 2) / (2 * 0.8 * 0.8 * d), -700), 700)), 1e-30)), 4) as log_f from (select record_id, seq, right_ms / 1000.0 - left_ms / 1000.0 as d from rr)",
    "missed_beat": _with(_DIRTY) + " select record_id, seq, round((left_ms + right_ms) / 2.0, 6) as tau, round(8 * (rr_ms / 100.0) / (pow(1 + rr_ms / 100.0, 2) + 1), 6) as shape from rr where rr_ms > 2000",
    "local_loglik": _with(_RR) + """, u as (select record_id, seq as idx, right_ms / 1000.0::double as t from rr),
      h as (select *, lag(t) over w as pt, t - lag(t) over w as d, 0.4 * (lag(t, 2) over w - lag(t, 3) over w) + 0.2 * (lag(t, 3) over w - lag(t, 4) over w) + 0.2 * (lag(t, 4) over w - lag(t, 5) over w) + 0.1 * (lag(t, 5) over w - lag(t, 6) over w) + 0.1 * (lag(t, 6) over w - lag(t, 7) over w) as m from u window w as (partition by record_id order by idx)),
      f as (select *, ln(greatest(sqrt(12.0 / (2 * pi() * pow(d, 3))) * exp(least(greatest(-12.0 * pow(d - m, 2) / (2 * m * m * d), -700), 700)), 1e-30)) as lf from h),
      p as (select a.record_id, a.t as ev, b.idx, b.t, b.lf, min(b.idx) over (partition by a.record_id, a.t) as lo from u a left join f b on a.record_id = b.record_id and b.t >= a.t - 60 and coalesce(b.pt, b.t) < a.t)
      select record_id, round(ev, 3) as t_s, round(coalesce(sum(case when idx >= lo + 7 then exp(-0.02 * (ev - t)) * lf end), 0), 4) as loglik from p group by record_id, ev""",
    "corrected_samples": _with(_RR) + " select record_id, seq, floor(right_ms / 1000.0::double * 250)::bigint as sample from rr",
    "record_filter": _with(_RR) + " select record_id, seq, rr_ms from rr where record_id = 2",
    "prediction_rows": _with(_DIRTY, windows_sql(30), PEAKS_SQL, RULES_SQL, _TABLE) + " select record_id, row, round(avg, 6) as avg from tab where quality >= 75",
    "event_filter": _with(_RR, windows_sql(30)) + ", f as (select record_id, row, avg(x) as avg from inw group by 1, 2), s as (select record_id, row, avg((60000.0 / avg > 71.0)::int) over w as share, count(*) over w as n from f window w as (partition by record_id order by row rows between current row and 54 following)) select record_id, row, share > 0.5 as is_event from s where n = 55",
    "sampling_windows": _with(_DIRTY, windows_sql(30), PEAKS_SQL, RULES_SQL, _TABLE) + ', a as (select record_id, event_id as seizure_id, left_ms // 5000 as row from rr where event_type = \'error\') select a.record_id, tab.row, w as "window", seizure_id from a, unnest([-6, -3, 0]) as u(w), tab where tab.record_id = a.record_id and tab.row = a.row + w and quality >= 75 and is_event',
    "seizure_samples": _with(_DIRTY, windows_sql(30), PEAKS_SQL, RULES_SQL, _TABLE) + ', a as (select record_id, event_id as seizure_id, left_ms // 5000 as row from rr where event_type = \'error\') select a.record_id, tab.row, w as "window", seizure_id, 1 as label from a, unnest([-2, -1, 0]) as u(w), tab where tab.record_id = a.record_id and tab.row = a.row + w and quality >= 75 and is_event',
    "regular_samples": _with(_DIRTY, windows_sql(30), PEAKS_SQL, RULES_SQL, _TABLE) + """, o as (select *, row_number() over (order by record_id, md5('42:' || record_id || ':' || row), row) as k from tab where without_seizure and quality >= 75)
      select record_id, row, 0 as "window", 0 as label from o where k <= 300""",
    "training_set": _with(_DIRTY, windows_sql(30), PEAKS_SQL, RULES_SQL, _TABLE) + """, a as (select record_id, event_id as seizure_id, left_ms // 5000 as row from rr where event_type = 'error'),
      pos as (select a.record_id, tab.row, 1 as label from a, unnest([-1, 0]) as u(w), tab where tab.record_id = a.record_id and tab.row = a.row + w and quality >= 75 and is_event),
      neg as (select record_id, row, 0 as label from (select *, row_number() over (order by record_id, md5('42:' || record_id || ':' || row), row) as k from tab where without_seizure and quality >= 75) where k <= floor(0.5 * (select count(*) from pos)))
      select record_id + 100 as patient_id, label, count(*) as n, sum(row)::bigint as rows from (select * from pos union all select * from neg) group by 1, 2""",
    "robust_scale": _with(_RR, windows_sql(30), _F) + ", z as (select median(avg) as a0, quantile_cont(avg, .75) - quantile_cont(avg, .25) as a1, median(sd) as s0, quantile_cont(sd, .75) - quantile_cont(sd, .25) as s1, median(rmssd) as r0, quantile_cont(rmssd, .75) - quantile_cont(rmssd, .25) as r1 from base) select record_id, row, round((avg - a0) / a1, 6) as avg, round((sd - s0) / s1, 6) as sd, round((rmssd - r0) / r1, 6) as rmssd from base, z",
    "weighted_bce": "select user_id, round(avg((greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) * case when y = 1 then 5.0 else 1.0 end), 6) as loss from (select user_id, (value - 245) / 100 as z, (event_type = 'error')::int as y from events) group by 1",
    "window_sensitivity": "select user_id, coalesce(round(count(*) filter (1 / (1 + exp(-z)) > 0.5 and y = 1)::double / nullif(count(*) filter (y = 1), 0), 3), 0) as sensitivity from (select user_id, (value - 245) / 100 as z, (event_type = 'error')::int as y from events) group by 1",
    "legacy_scores": "select event_id, round(1 / (1 + exp(-(1 / (1 + exp(-(value - 245) / 100))))), 6) as score from events",
    "pareto_trials": "with t as (select user_id, floor(avg(value))::bigint as \"Total_Sensitivity\", count(*) as \"Total_FAR\" from events group by 1) select * from t where not exists (select 1 from t o where o.\"Total_Sensitivity\" >= t.\"Total_Sensitivity\" and o.\"Total_FAR\" <= t.\"Total_FAR\" and (o.\"Total_Sensitivity\" > t.\"Total_Sensitivity\" or o.\"Total_FAR\" < t.\"Total_FAR\"))",
    "threshold": "select event_id, case when 1 / (1 + exp(-(value - 245) / 100)) >= 0.5 then 1 else 0 end as value from events",
    "chain_scatter": _with(_RR, _SCORE) + " select record_id, row, value::int as value from v0",
    "gap_fill": _with(_RR, _SCORE, FILL_SQL) + " select record_id, row, value::int as value from v1",
    "smooth_runs": _with(_RR, _SCORE, FILL_SQL, SMOOTH_SQL) + " select record_id, row, value::int as value from v2",
    "detection_blocks": _with(_RR, _SCORE, FILL_SQL, SMOOTH_SQL, BLOCKS_SQL) + " select record_id, start_row from blocks",
    "detections": _with(_RR, _SCORE, FILL_SQL, SMOOTH_SQL, BLOCKS_SQL) + " select record_id, start_row * 5 as start_s, start_row * 5 + 300 as end_s from blocks",
    "detections_e2e": _with(_RR, _SCORE, FILL_SQL, SMOOTH_SQL, BLOCKS_SQL) + " select record_id, start_row * 5 as start_s, start_row * 5 + 300 as end_s from blocks",
    "evaluation_e2e": _with(_RR, _SCORE, FILL_SQL, SMOOTH_SQL, BLOCKS_SQL) + """, d as (select record_id, start_row * 5000 as ms from blocks), o as (select event_id, record_id, record_id % 2 as patient_id, left_ms from rr where event_type = 'error'),
      h as (select patient_id, exists (select 1 from d where d.record_id = o.record_id and abs(d.ms - o.left_ms) <= 300000) as hit from o),
      sp as (select patient_id, count(*) filter (hit) as n_tp, count(*) filter (not hit) as n_fn from h group by 1),
      fp as (select record_id % 2 as patient_id, count(*) as n_fp from d where not exists (select 1 from o where o.record_id = d.record_id and abs(d.ms - o.left_ms) <= 300000) group by 1),
      rp as (select record_id % 2 as patient_id, sum(s) / 86400.0 as days from (select record_id, (max(right_ms) - min(left_ms)) // 1000 as s from rr group by 1) group by 1),
      pj as (select patient_id, coalesce(n_tp, 0) as n_tp, coalesce(n_fn, 0) as n_fn, coalesce(n_fp, 0) as n_fp, days from rp left join sp using (patient_id) left join fp using (patient_id)),
      pm as (select *, coalesce(2 * ppv * sensitivity / nullif(ppv + sensitivity, 0), 0) as f1 from (select *, coalesce(n_tp::double / nullif(n_tp + n_fp, 0), 0) as ppv, coalesce(n_tp::double / nullif(n_tp + n_fn, 0), 0) as sensitivity, coalesce(n_fp / nullif(days, 0), 0) as far from pj))
      select patient_id, n_tp, n_fn, n_fp, """ + _r("days", "ppv", "sensitivity", "f1", "far") + " from pm",
    "package_sweep": _with(_RR, _SCORE.replace("v0 as (select record_id, row, case when valid then hit else -1 end as value from sr)", """
th as (select unnest([0.15, 0.35, 0.5, 0.55, 0.8])::double as t, unnest(range(5)) as k),
v0 as (select record_id * 5 + k as record_id, row, case when not valid then -1 when case when hit = 1 then 0.5 + (row % 7)::double / 14 else (row % 5)::double / 10 end >= t then 1 else 0 end as value from sr, th)"""), FILL_SQL, SMOOTH_SQL, BLOCKS_SQL) + """,
      d as (select record_id, start_row * 5000 as ms from blocks), o as (select event_id, record_id * 5 + k as record_id, k, left_ms from rr, th where event_type = 'error'),
      h as (select k, exists (select 1 from d where d.record_id = o.record_id and abs(d.ms - o.left_ms) <= 300000) as hit from o),
      sp as (select k, count(*) filter (hit) as n_tp, count(*) filter (not hit) as n_fn from h group by 1),
      fp as (select record_id % 5 as k, count(*) as n_fp from d where not exists (select 1 from o where o.record_id = d.record_id and abs(d.ms - o.left_ms) <= 300000) group by 1),
      rp as (select sum(s) / 86400.0 as days from (select record_id, (max(right_ms) - min(left_ms)) // 1000 as s from rr group by 1))
      select t as threshold, round(100 * n_tp::double / (n_tp + n_fn), 6) as Total_Sensitivity, round(coalesce(n_fp, 0) / days, 6) as Total_FAR, n_tp, n_fn, coalesce(n_fp, 0) as n_fp
      from th left join sp using (k) left join fp using (k), rp""",
    "signal_chunks": _with(_RR) + """ select record_id::varchar as record_id, 4 as freq, seq // 100 as chunk, seq // 100 * 100 as start_sample, count(*)::int as n, sum(rr_ms)::double as total, arg_min(rr_ms, seq)::double as first
      from rr group by record_id, seq // 100""",
    "bucketed_join": _with(_DIRTY, windows_sql(30), PEAKS_SQL, RULES_SQL) + """, f as (select record_id, row, count(*) as n_beats, avg(x) as avg from inw group by 1, 2)
      select record_id, row, n_beats, round(avg, 6) as avg, quality from f join q using (record_id, row)""",
    "catalogue_json": _with(_CAT) + " select seizure_id::varchar as seizure_id, patient_id, record_start::varchar as start, path as sensor, null::int as missing from cat",
    "event_properties": "select event_type, count(k) as n, sum(k)::bigint as total, min(k) as least, max(k) as most from (select event_type, (props::json->>'$.k')::bigint as k from events) group by 1",
    "seizure_log": _with(_CAT) + """, s as (select *, record_start::varchar || case when seizure_id % 5 = 0 then ' 99:00:00' else ' 10:00:00' end as t from cat)
      select seizure_id::int as seizure_id, t as seizure_start, case when seizure_id % 5 <> 0 then t end as start, seizure_id % 2 = 0 as has_valid_data, seizure_id % 3 = 0 as is_event,
      seizure_id % 7 = 0 as is_detectable, seizure_id % 11 = 0 as is_detected, (seizure_id % 100)::double / 4 as duration_seconds from s""",
    "record_lookup": _with(_CAT, _BUILD) + " select record_id, patient_id, case when patient_id % 3 <> 0 then patient_id % 5 * 64 + 128 end as freq from built",
    "seizure_flags": _with(_EVAL.format(tol=21600000)) + " select onset_id, record_id, is_detected, false as is_correct_type, false as has_valid_data, false as is_event, false as is_detectable from hits",
    "match_detections": _with(_EVAL.format(tol=300000)) + " select record_id, onset_id, onset_ms, det_id, start_ms from pairs",
    "match_detections_wide": _with(_EVAL.format(tol=21600000)) + " select record_id, onset_id, det_id from pairs",
    "seizure_hit_flags": _with(_EVAL.format(tol=21600000)) + " select * from hits",
    "detection_status": _with(_EVAL.format(tol=21600000)) + " select det_id, record_id, case when det_id % 13 = 5 then 'bad_quality' else result end as status from res",
    "study_front": """with l as (select 1 / (1 + exp(-(value - 245) / 100)) as score, (event_type = 'error')::int as label from events),
      t as (select k as trial, k / 20.0::double as threshold, 100 * (count(*) filter (score >= k / 20.0::double and label = 1))::double / count(*) filter (label = 1) as s, (count(*) filter (score >= k / 20.0::double and label = 0))::double / count(*) filter (label = 0) as f
            from l, range(20) as r(k) group by k)
      select trial::int as trial, threshold, round(s, 6) as Total_Sensitivity, round(f, 6) as Total_FAR from t where not exists (select 1 from t o where o.s >= t.s and o.f <= t.f and (o.s > t.s or o.f < t.f))""",
    "detector_slices": _with(_RR) + """, b as (select record_id, right_ms as t_ms, 'first' as which from rr union all select record_id, right_ms + (event_id * 37) % 400 - 200, 'second' from rr where event_id % 17 <> 0),
      e as (select record_id, (max(right_ms) - 50000) // 1000 as z from rr group by 1), s as (select record_id, u.s, row_number() over (partition by record_id order by md5('42:' || record_id || ':' || u.s), u.s) as k from e, unnest(range(z + 1)) as u(s))
      select s.record_id, s * 1000 as start, which, t_ms from s join b on b.record_id = s.record_id and t_ms > s * 1000 and t_ms < s * 1000 + 50000 where k <= 10""",
    "comparison_points": _with(_DIRTY) + """, p as (select record_id, right_ms / 1000.0::double as t, 'original' as which from rr union all select record_id, right_ms / 1000.0::double, 'corrected' from rr where rr_ms >= 400),
      m as (select record_id, which, t, lead(t) over (partition by record_id, which order by t) as u from p) select record_id, which, round((t + u) / 2, 6) as mid, round(u - t, 6) as rr from m where u is not null""",
    "segment_points": _with(_DIRTY) + """, p as (select record_id, right_ms / 1000.0::double as t, 'original' as which from rr union all select record_id, right_ms / 1000.0::double, 'corrected' from rr where rr_ms >= 400),
      mm as (select record_id, which, t, lead(t) over (partition by record_id, which order by t) as u from p), c0 as (select record_id, which, (t + u) / 2 as mid, u - t as r from mm where u is not null),
      b as (select record_id, left_ms / 1000.0 as t from rr where rr_ms > 2500), c as (select *, count(*) over (partition by record_id) as n from b),
      s as (select *, sum(f) over (partition by record_id order by t) as g from (select *, case when t - lag(t) over (partition by record_id order by t) <= 5 then 0 else 1 end as f from c where n >= 2)),
      sp as (select record_id, min(t) - 60 as a, max(t) + 300 as z from s group by record_id, g), m as (select *, max(z) over (partition by record_id order by a, z rows between unbounded preceding and 1 preceding) as r from sp),
      x as (select *, sum(case when a <= r then 0 else 1 end) over (partition by record_id order by a, z) as k from m), y as (select record_id, k, min(a) as a, max(z) as z from x group by record_id, k),
      i as (select *, row_number() over (partition by record_id order by a) - 1 as segment_id from y)
      select i.record_id, segment_id, which, round(mid, 6) as mid, round(r, 6) as rr from i join c0 on c0.record_id = i.record_id and mid > a and mid < z""",
    "filter_table": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + """, m as (select record_id, row, avg(quality) over (partition by record_id order by row rows between current row and 59 following) as mean_, max(row) over (partition by record_id) + 1 as n_ from q),
      q3 as (select q.record_id, q.row, coalesce(m.mean_, 0) as quality from q left join (select record_id, row + 1 as row, mean_ from m where row <= n_ - 61) m using (record_id, row)),
      n3 as (select record_id, greatest((max(right_ms) // 1000 - 300) // 5, 1)::bigint as rows from rr group by record_id), w3 as (select record_id, u.row from n3, unnest(range(rows)) as u(row))
      select record_id, row, true as without_nan, true as without_seizure, false as label_seizures, true as event_filter_0, true as event_filter_1, round(coalesce(quality, 0), 6) as quality from w3 left join q3 using (record_id, row)""",
    "filter_table_stored": _with(_DIRTY, PEAKS_SQL, RULES_SQL) + """, m as (select record_id, row, avg(quality) over (partition by record_id order by row rows between current row and 59 following) as mean_, max(row) over (partition by record_id) + 1 as n_ from q),
      q3 as (select q.record_id, q.row, coalesce(m.mean_, 0) as quality from q left join (select record_id, row + 1 as row, mean_ from m where row <= n_ - 61) m using (record_id, row)),
      n3 as (select record_id, greatest((max(right_ms) // 1000 - 300) // 5, 1)::bigint as rows from rr group by record_id), w3 as (select record_id, u.row from n3, unnest(range(rows)) as u(row))
      select record_id, row, true as without_nan, true as without_seizure, false as label_seizures, true as event_filter_0, true as event_filter_1, round(coalesce(quality, 0), 6) as quality from w3 left join q3 using (record_id, row)""",
    "detection_results": _with(_EVAL.format(tol=21600000)) + " select * from res",
    "record_eval": _with(_EVAL.format(tol=21600000), _RECORDS) + " select record_id, patient_id, record_duration_s, deficiency_s, n_det_fp, n_det_tp from rec",
    "patient_metrics": _with(_EVAL.format(tol=21600000), _RECORDS, _PATIENTS) + " select patient_id, n_tp, n_fn, n_fp, " + _r("days", "ppv", "sensitivity", "f1", "far") + " from pm",
    "cohort_metrics": _with(_EVAL.format(tol=21600000), _RECORDS, _PATIENTS) + ' select round(100.0 * sum(n_tp) / (sum(n_tp) + sum(n_fn)), 6)::double as "Total_Sensitivity", round(sum(n_fp) / sum(days), 6) as "Total_FAR", round(median(f1), 6) as "med_F1", round(median(far), 6) as "med_FAR", median(n_fp) as "med_FP", round(median(ppv), 6) as "med_PPV", round(median(sensitivity), 6) as "med_Sensitivity", sum(n_tp)::bigint as n_tp, sum(n_fn)::bigint as n_fn, sum(n_fp)::bigint as n_fp, sum(n_tp + n_fn)::bigint as n_seizures from pm',
    "header_dates": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as header from events",
    "scalar_functions": """select event_id, epoch(date_trunc('second', ts) - timestamp '2024-01-01')::bigint as seconds, (epoch_us(ts) // 1000 - epoch_ms(timestamp '2024-01-01')) as millis, round(epoch(date_trunc('second', ts) - timestamp '2024-01-01') / 86400, 9) as days,
      strftime(ts, '%Y-%m-%d %H:%M:%S') as sql_string, strftime(ts, '%Y_%m_%d__%H_%M_%S') as file_name, format('{}h {:02d}m {:02d}s', (event_id * 37) // 3600, (event_id * 37) % 3600 // 60, (event_id * 37) % 60) as readable,
      round(case when event_id % 5 = 0 then -1 else value end, 6) as filled, replace(replace(replace(replace(event_type, 'purchase', 'P'), 'error', 'X'), 'view', 'V'), 'err', 'E') as replaced from events""",
    "session_spans": """with b as (select user_id % 8 as record_id, epoch_us(ts) // 1000 as t from events), c as (select *, count(*) over (partition by record_id) as n from b),
      s as (select *, sum(f) over (partition by record_id order by t rows unbounded preceding) as g from (select *, case when t - lag(t) over (partition by record_id order by t) <= 3600000 then 0 else 1 end as f from c where n >= 2)),
      p as (select record_id, min(t) - 60000 as a, max(t) + 300000 as z from s group by record_id, g), m as (select *, max(z) over (partition by record_id order by a, z rows between unbounded preceding and 1 preceding) as r from p),
      x as (select *, sum(case when a <= r then 0 else 1 end) over (partition by record_id order by a, z rows unbounded preceding) as k from m)
      select record_id, min(a) as start, max(z) as "end" from x group by record_id, k""",
}
