"""The queries of this package as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import licenses

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from w where len(w) >= 35),
k as (select doc_id, i, md5(array_to_string(w[i:i+34], ' ')) as k from g),
r as (select doc_id, i from k where k in (select k from k group by k having count(*) > 1)),
c as (select distinct doc_id, i + j as i from r, (select unnest(range(35)) as j)),
p as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from p anti join c using (doc_id, i) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join (select doc_id, count(*) as n from c group by doc_id) using (doc_id) left join kept using (doc_id)
"""


def _templates() -> str:
    return ", ".join(f"({tid}, '{label}', {str(phrase).lower()}, {words}, {pairs}, {bit}, {q}, '{a}', '{b}')" for tid, label, phrase, words, pairs, bit, q, a, b, _ in licenses.pairs_of())


OP2 = rf"""
with w as (select doc_id, regexp_extract_all({_LOW}, '{_PLAIN}') as w from documents),
t(tid, label, phrase, words, pairs, bit, q, a, b) as (values {_templates()}),
g as (select doc_id, i - 1 as p, w[i] as x, w[i + 1] as y from (select doc_id, w, unnest(range(1, len(w))) as i from w)),
d as (select doc_id, tid, label, phrase, words, pairs, p - q as diagonal, bit_or(1::bigint << bit) as found, list(distinct p) as places from g join t on x = a and y = b group by all),
m as (select *, case when phrase then 1 when diagonal - lag(diagonal) over (partition by doc_id, tid order by diagonal) <= {licenses.NEAR} then 0 else 1 end as far from d),
n as (select *, sum(far) over (partition by doc_id, tid order by diagonal) as band from m),
s as (select doc_id, label, phrase, bit_count(bit_or(found)) / pairs as share, greatest(min(diagonal), 0) as start, list_distinct(flatten(list(places))) as places from n group by doc_id, tid, label, phrase, words, pairs, band),
all_ok as (select *, list_min(places) as low, list_max(places) + 2 as high from s where case when phrase then share = 1 else share >= {licenses.ENOUGH} end),
ok as (select * from all_ok a where phrase or not exists (select 1 from all_ok o where not o.phrase and o.doc_id = a.doc_id and o.share > a.share and o.low < a.high and a.low < o.high
  and len(list_intersect(a.places, o.places)) >= {licenses.SAME} * len(a.places))),
x as (select doc_id, count(*) filter (phrase) as n_base, min(start) filter (phrase) as first_word, max(start) filter (phrase) as last_word,
  string_agg(distinct label, ',' order by label) filter (phrase) as base_labels, string_agg(distinct label, ',' order by label) as labels,
  max(case when phrase then 1.0::double else share end) as score from ok group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from w left join x using (doc_id)
"""

_CANON = """regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"""

OP3 = f"""
with p as (select page_id, url, html, md5(coalesce(html, '')) as h, {_CANON} as u from pages),
k as (select *, '"' || h || '"' as tag, h[1] as d, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&'), ''), '') as key from p),
given as (select page_id * 2 as record_id, key, page_id * 10 as t, tag, page_id::varchar as modified, html from k where u <> ''),
asked as (select page_id * 2 + 1 as record_id, d, case when u <> '' then key end as key, page_id * 10 + case when d = '1' then -5 else 100003 end as t, page_id::varchar as modified,
  case d when '2' then '"old"' when '3' then null else tag end as tag from k),
j as (select a.record_id, a.key, a.t, case when d <> '4' then g.record_id end as response_id, g.t as response_t, g.tag as stored, g.html,
  case when d = '4' then 'other profile' when g.record_id is null then 'no earlier response' when coalesce(a.tag = g.tag, a.modified = g.modified) then 'resolved'
    when not coalesce(a.tag = g.tag, a.modified = g.modified) then 'validators differ' else 'no validator' end as outcome
  from asked a asof left join given g on a.key = g.key and a.t > g.t)
select record_id, key as url, t as fetched, response_id, outcome,
  case when outcome = 'resolved' then 'cache-control=max-age=60;content-type=text/html;date=' || t || ';etag=' || stored || ';server=s' end as headers,
  case when outcome = 'resolved' then md5(html) end as body_md5 from j
"""

OP5 = """
with c as (select page_id as capture_id, (page_id * 97) % 65536 as t, nullif(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '') as host from pages),
h as (select distinct host, md5(host) as h, string_split(host, '.') as l from c where host is not null),
n as (select *, ('0x' || h[1:4])::bigint as n1, ('0x' || h[5:8])::bigint as n2 from h),
e as (select host as domain, 'block' as action, n1 % 20000 as listed from n
  union all select host, case when h[1] >= 'a' then 'allow' else 'remove' end, n1 % 20000 + n2 % 30000 + 1 from n
  union all select distinct l[-2] || '.' || l[-1], 'block', 40000 from n where len(l) >= 2),
o as (select domain, listed as valid_from, min(action) as action from e group by all),
i as (select *, lead(valid_from) over (partition by domain order by valid_from) as valid_to from o),
s as (select host, array_to_string(l[k:], '.') as domain from (select host, l, unnest(range(1, len(l) + 1)) as k from h)),
m as (select c.capture_id, i.domain, i.action, i.valid_from from c join s using (host) join i using (domain)
  where action <> 'remove' and valid_from <= t and (valid_to is null or t < valid_to)
  qualify row_number() over (partition by capture_id order by length(i.domain) desc) = 1)
select c.capture_id, c.host, c.t as fetched, m.domain, m.action, m.valid_from, coalesce(m.action = 'block', false) as blocked from c left join m using (capture_id)
"""

OP6 = rf"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as most from s),
r as (select *, most / weight as ratio from w),
a as (select *, coalesce(sum(most) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as full_,
  (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double as rest, (sum(source_size) over ())::double as total from r),
l as (select *, (total * 1.5::double - full_) / rest as level from a),
f as (select source, source_size, coalesce(least(most, (select arg_min(level, ratio) from l where level <= ratio) * weight), most) as target from l),
j as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
  ('0x' || md5('mix|' || coalesce(doc_id::varchar, text, ''))[1:13])::bigint / 4503599627370496.0::double as drawn from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when drawn < rate - floor(rate) then 1 else 0 end))::bigint as taken from j
"""

OP7 = rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, '{_PLAIN}') as w from documents),
b as (select item_id, regexp_extract_all({_LOW}, '{_PLAIN}') as w from benchmark),
k as (select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as k from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
g as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as k from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from k) where len(w) >= n)),
h as (select doc_id, i, g.n, item_id from g join k using (n, k)),
c as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from h) group by doc_id),
x as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join x using (doc_id)
"""

OP8 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_SPACED}') as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
n as (select doc_id, len(s) as n from s),
u as (select doc_id, unnest(s) as x from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as shared from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 85 * (na.n + nb.n - shared)),
e as (select a, b from l union all select b, a from l),
c as (select doc_id as id, doc_id as g from n union select e.b, c.g from c join e on e.a = c.id)
select n.doc_id, n.n::bigint as n_shingles, min(g) as component_id, min(g) = n.doc_id as kept from n join c on c.id = n.doc_id group by n.doc_id, n.n
"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op2_license_scan": OP2,
    "op3_warc_revisits": OP3,
    "op5_url_filter": OP5,
    "op6_mixing": OP6,
    "op7_decontamination": OP7,
    "op8_minhash_near_dedup": OP8,
}
