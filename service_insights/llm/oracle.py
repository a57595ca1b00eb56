"""DuckDB SQL of the queries that SQL can express."""
from __future__ import annotations

from . import duck, licenses, line_dedup, merkle

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_JACCARD = f"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, {_BLANKS}) as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as g from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all
), l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)
), e as (
  select a, b from l union all select b, a from l
), r(doc_id, m) as (
  select doc_id, doc_id from w union select r.doc_id, e.b from r join e on r.m = e.a
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.m as component_id
from w left join n on w.doc_id = n.doc_id join (select doc_id, min(m) as m from r group by doc_id) c on w.doc_id = c.doc_id
"""

_DECONTAMINATE = f"""
with d as (
  select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from documents
), b as (
  select item_id::varchar as item, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from benchmark
), bw as (
  select distinct item, size, array_to_string(ws[p:p + size - 1], ' ') as k from (
    select item, ws, least(10, len(ws)) as size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from b where len(ws) > 0)
), dw as (
  select doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') as k from (
    select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as p from d, (select distinct size from bw))
), m as (
  select doc_id, p, dw.size, item from dw join bw on dw.k = bw.k and dw.size = bw.size
), h as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from m) group by doc_id
), i as (
  select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id
)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on d.doc_id = h.doc_id left join i on d.doc_id = i.doc_id
"""

_SUBSTRING = f"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), {_BLANKS}) as ws from documents
), w as (
  select doc_id, p, array_to_string(ws[p:p + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from d)
), r as (
  select doc_id, p from (select doc_id, p, min(doc_id) over (partition by k) as low from w) where doc_id > low
), gone as (
  select distinct doc_id, unnest(range(p, p + 13)) as q from r
), kept as (
  select x.doc_id, count(*) as n, string_agg(x.word, ' ' order by x.q) as t
  from (select doc_id, q, ws[q] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as q from d)) x
  anti join gone on x.doc_id = gone.doc_id and x.q = gone.q group by x.doc_id
)
select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

_SPELLING = f"""
with recursive {duck.CRC_TABLE}, r as (
  select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) as r from documents
), h as (
  select r, {duck.crc("coalesce(doc_id::varchar, 'null') || ':' || r")} as h from r, crc_table
), w as materialized (
  select w, count(*) as n from (select case when h % 97 = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as w from h)
  where length(w) >= 5 group by w having count(*) >= 3
), x as materialized (
  select w, n, i, left(w, i - 1) || substr(w, i + 1) as d from (select w, n, unnest(range(1, length(w) + 1))::int as i from w)
), p as materialized (
  select a.w as u, b.w as v, b.n as n from x a join x b on a.d = b.d and a.i = b.i and a.w <> b.w
  union select x.w, w.w, w.n from x join w on x.d = w.w
  union select w.w, x.w, x.n from x join w on x.d = w.w
), b as materialized (
  select u, count(*) as n_near, max(n) as top_n, arg_min(v, (-n, v)) as top from p group by u
), f as materialized (
  select w.w, w.n, case when top_n >= 2 * n then top end as form, case when top_n >= 2 * n then top_n end as form_n, coalesce(n_near, 0) as n_near from w left join b on w.w = b.u
), s(w, here, form) as (
  select w, w, form from f union all select s.w, f.w, f.form from s join f on s.form = f.w
)
select f.w as word, f.form, s.here as root, f.n, f.n_near, f.form_n from f join s on f.w = s.w and s.form is null
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op5_jaccard": _JACCARD,
    "op6_decontaminate": _DECONTAMINATE,
    "op7_licenses": licenses.oracle_sql(),
    "op8_substring": _SUBSTRING,
    "op11_merkle": merkle.oracle_sql(),
    "op13_spelling": _SPELLING,
}
