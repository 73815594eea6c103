"""DuckDB statements for the training-data queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, k, list_slice(w, i, i + k - 1) as g
  from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)
), grams as (
  select doc_id, k, i, list_slice(w, i, i + k - 1) as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select distinct k from windows) where len(w) >= k)
), hits as (select doc_id, k, i, item_id from grams join windows using (k, g)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (doc_id) left join found using (doc_id)
"""

MIX_SIZES = rf"""
sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACES}'))::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from sized group by source),
steps as (
  select *, 1.5::double * (sum(source_size) over ())::double as total,
    (coalesce(sum(source_size) over b, 0) * 2)::double as capped,
    (sum(w) over ()) - coalesce(sum(w) over b, 0) as open_w
  from per window b as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)
),
level as (select capped as c, total as t, open_w as o from steps where w * (total - capped) <= 2 * source_size * open_w order by capped limit 1),
targets as (select source, source_size, coalesce(least(2.0::double * source_size, w * (t - c) / o), 2.0::double * source_size) as target from steps left join level on true)
"""

OP9 = f"""
with {MIX_SIZES},
rated as (
  select doc_id, size, sized.source, source_size, target, case when source_size > 0 then target / source_size else 0 end as ratio,
    (('0x' || substr(sha256('20240917:' || doc_id::varchar), 1, 13))::bigint + 0.5) / 4503599627370496.0::double as u
  from sized join targets t on sized.source is not distinct from t.source
),
placed as (
  select *, least(floor(ratio), 2)::int as sure, ratio - least(floor(ratio), 2) as p from rated
),
summed as (
  select *, target - sure * source_size as lack,
    sum(case when p > 0 then size end) over (partition by source order by (u / (1 - u)) / (p / (1 - p)), doc_id, size rows unbounded preceding) as got
  from (select source, doc_id, size, source_size, target, sure, case when p > 0 then p end as p, u from placed)
)
select doc_id, size, source_size, target,
  (size * (sure + case when p > 0 and got - size < lack and abs(got - lack) <= abs(got - size - lack) then 1 else 0 end))::bigint as taken
from summed
"""

def near_sql(k: int, percent: int, source: str = "documents") -> str:
    """(doc_id, n_shingles, component_id, kept) of word shingles by plain set counting."""
    return rf"""
with recursive near_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}') as w from {source}
), near_sets as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) as i from near_words where len(w) > 0)
), near_sizes as (select doc_id, count(*) as n from near_sets group by doc_id),
near_common as (select a.doc_id as x, b.doc_id as y, count(*) as c from near_sets a join near_sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
near_links as (
  select x, y from near_common join near_sizes m on m.doc_id = x join near_sizes n on n.doc_id = y where 100 * c >= {percent} * (m.n + n.n - c)
), near_both as (select x, y from near_links union all select y, x from near_links),
near_reach as (select doc_id as x, doc_id as y from near_words union select r.x, b.y from near_reach r join near_both b on b.x = r.y),
near_least as (select x, min(y) as component_id from near_reach group by x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from near_words left join near_sizes using (doc_id) join near_least on x = doc_id
"""


def _kind_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind, from the running lengths of what the pattern splits and matches."""
    return rf"""
select doc_id, '{kind}' as kind, {order} as ord, (list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0))::bigint as a, len(found[i]) as n
from (
  select doc_id, found, vals, pieces, unnest(range(1, len(found) + 1)) as i
  from (select doc_id, regexp_extract_all(t, '{pattern}') as found, regexp_extract_all(t, '{pattern}', {group}) as vals, string_split_regex(t, '{pattern}') as pieces
        from (select doc_id, coalesce(text, '') as t from documents))
) where len(vals[i]) >= {least}"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP6 = f"""
with found as (
{_kind_sql("assign", 0, _ASSIGN, 2, 6)}
union all {_kind_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
union all {_kind_sql("hex", 2, "[0-9a-f]+", 0, 24)}
), joined as (
  select doc_id, count_if(kind = 'assign') as n_assign, count_if(kind = 'access') as n_access, count_if(kind = 'hex') as n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, ord) as spans
  from found group by doc_id
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join joined using (doc_id)
"""

OP10 = """
with recursive vec_all as (
  select vec_id, embedding::double[] as v, label, row_number() over () as r from embeddings
), vec_good as (
  select *, sqrt(list_dot_product(v, v)) as norm from vec_all
  where label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), vec_pairs as (
  select a.vec_id as x, b.vec_id as y, a.r as rx from vec_good a join vec_good b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), vec_reach as (select vec_id as x, vec_id as y from vec_all union select r.x, p.y from vec_reach r join vec_pairs p on p.x = r.y),
vec_least as (select x, min(y) as component_id from vec_reach group by x)
select vec_id, (select count(*) from vec_pairs where rx = r)::bigint as n_links, component_id, vec_id = component_id as kept
from vec_all join vec_least on x = vec_id
"""

OP5 = """
with payloads as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
), ranked as (
  select *, max(page_id) over (partition by h) as keeper from payloads
)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id = keeper then null else keeper end as refers_to
from ranked
"""

OP2 = """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, ''))::bigint as n from documents),
starts as (select doc_id, i, md5(substr(x, 2 * i + 1, 800)) as h from (select doc_id, x, unnest(range(0, greatest(n - 399, 0))) as i from texts)),
twice as (select h from starts group by h having count(*) > 1),
steps as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) > 400 as gap from starts join twice using (h)),
runs as (select doc_id, i, sum(case when gap then 1 else 0 end) over (partition by doc_id order by i) as g from steps),
spans as (select doc_id, min(i) as a, max(i) + 400 as b from runs group by doc_id, g),
pieces as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
kept as (
  select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as front
  from pieces join texts using (doc_id) group by doc_id
)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from texts left join kept using (doc_id)
"""

ORACLES = {"op1_decontaminate": OP1, "op2_suffix_dedup": OP2, "op5_warc": OP5, "op6_secrets": OP6, "op8_near_duplicates": near_sql(3, 85), "op9_mix": OP9, "op10_embedding_links": OP10}
