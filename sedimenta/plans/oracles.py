"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

O: dict[str, str] = {}

#: What separates words and what ends a line.
WORDS = r"[^\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ENDS = r"(?:\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}])"

_DOC_STATES = """
with a as (select doc_id::varchar as member_key, sha256(concat_ws(chr(1), doc_id::varchar, source, text)) as older_id from documents),
b as (select doc_id::varchar as member_key, sha256(concat_ws(chr(1), doc_id::varchar, case when doc_id % 7 = 0 then upper(source) else source end, text)) as newer_id from documents where doc_id % 10 <> 0),
d as (select member_key, case when older_id is null then 'added' when newer_id is null then 'removed' else 'changed' end as change, older_id, newer_id
  from a full join b using (member_key) where older_id is distinct from newer_id)
"""
O["state_compare_counts"] = _DOC_STATES + "select change, count(*) as n from d group by change"
O["state_compare_sample"] = _DOC_STATES + "select * from d order by member_key limit 100"

_ORDER_STATES = """
with a as (select o_orderkey::varchar as member_key, sha256(concat_ws('|', o_orderkey::varchar, o_orderstatus, o_orderpriority)) as older_id from orders where o_orderkey % 11 <> 0),
b as (select *, sha256(concat_ws('|', member_key, value, o_orderpriority)) as newer_id
  from (select o_orderkey::varchar as member_key, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as value, o_orderpriority from orders where o_orderkey % 13 <> 0)),
d as (select member_key, older_id, newer_id, value, case when older_id is null then 'added' when newer_id is null then 'removed' else 'changed' end as change
  from a full join b using (member_key) where older_id is distinct from newer_id)
"""
O["state_changes"] = _ORDER_STATES + "select member_key, newer_id as occurrence_id, value from d"
O["state_key_changes"] = _ORDER_STATES + "select member_key, change from d"
O["state_narrowed_compare"] = _ORDER_STATES + "select change, count(*) as n from d group by change"
O["selection_overlay"] = _ORDER_STATES + "select member_key, older_id as occurrence_id from a anti join d using (member_key) union all select member_key, newer_id from d where newer_id is not null"

_EDITS = """
with edits as (select user_id::varchar as member_key, event_id as sequence, case when event_type = 'purchase' then 'remove' else 'put' end as action, 'e' || event_id as occurrence_id from events)
"""
O["edit_sequence_validation"] = _EDITS + """
select member_key, sequence from (select *, lag(action) over (partition by member_key order by sequence) as previous from edits)
where action = 'remove' and (previous = 'remove' or (previous is null and member_key not in (select c_custkey::varchar from customer)))"""
O["latest_edit_per_key"] = _EDITS + "select * from edits qualify row_number() over (partition by member_key order by sequence desc) = 1"
O["edits_resolve"] = _EDITS + """
, last as (select * from edits qualify row_number() over (partition by member_key order by sequence desc) = 1)
select c_custkey::varchar as member_key, c_name as occurrence_id from customer where c_custkey::varchar not in (select member_key from last)
union all select member_key, occurrence_id from last where action = 'put'"""
O["upsert_resolve"] = """
select c_custkey::varchar as member_key, null::varchar as value, false as minted from customer where c_custkey % 3 <> 0 and c_custkey % 4 <> 0 and not (c_custkey % 3 = 1 and c_custkey % 4 = 1)
union all select c_custkey::varchar, upper(c_mktsegment), true from customer where c_custkey % 4 = 0"""
O["named_scope_with_absent"] = """
select member_key, p_name as occurrence_id from (select distinct (l_partkey * 3)::varchar as member_key from lineitem) left join part on p_partkey::varchar = member_key"""
O["completeness_anti"] = "select distinct l_orderkey as occurrence_id, l_orderkey::varchar as member_key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 9 <> 0)"
O["duplicate_key_guard"] = "select sha256(text) as digest, count(*) as n from documents group by 1 having count(*) > 1"
O["write_audit"] = "select count(*) as rows, count(distinct sha256(text)) as identities, max(strlen(text))::bigint as largest, bool_or(text is null) as any_null from documents"
O["checkpoint_repack"] = "select min(doc_id) as first_key, sha256(text) as occurrence_id, length(text)::int as value from documents group by sha256(text), length(text)"
O["identity_ranges"] = "select o_orderkey, sha256(o_orderkey::varchar) as record_identity from orders where sha256(o_orderkey::varchar) between '00' and '0f' or sha256(o_orderkey::varchar) between 'a0' and 'a3'"
O["find_members_newest"] = "select distinct o_orderkey::varchar as occurrence_id, o_orderpriority as value from orders where (o_orderkey % 2 = 0 or o_orderkey % 3 = 0) and o_orderkey in (select l_orderkey from lineitem)"

_HEAD = "('0x' || substr(sha256({0}), 1, 16))::ubigint"
O["bucket_assignment"] = f"select c_custkey, ({_HEAD.format('c_custkey::varchar')} % 64)::int as bucket from customer"
O["bucket_counts"] = f"select ({_HEAD.format('doc_id::varchar')} % 16)::int as bucket, count(*) as n from documents group by 1"
O["member_key_at_joined"] = "select l_orderkey, l_linenumber, concat_ws('@', l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), l_linenumber) as member_key from lineitem"
O["member_key_segment"] = "select l_orderkey || '#' || l_linenumber as member_key, l_orderkey::varchar as member, l_linenumber::bigint as index from lineitem"
O["member_key_tuple"] = "select n_nationkey, '[' || to_json(n_name) || ',\"' || n_regionkey || '\"]' as member_key from nation"
_NATION = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""
O["row_digest"] = f"select n_nationkey, {_NATION} as row_json, sha256({_NATION}) as row_digest from nation"
O["row_digest_orders"] = """select o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
  case when microsecond(o_orderdate) % 1000000 = 0 then '' else '.' || lpad((microsecond(o_orderdate) % 1000000)::varchar, 6, '0') end || 'Z","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') as row_digest from orders"""
O["row_spelling_doubles"] = """select l_orderkey, l_linenumber, '{"l_discount":"' || l_discount::varchar || '","l_extendedprice":"' || l_extendedprice::varchar || '","l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}' as row_json from lineitem"""
O["occurrence_identity"] = """
select member_key, row_digest, sha256('["tpch","orders","' || member_key || '","sha256:' || row_digest || '"]') as occurrence_hash
from (select o_orderkey::varchar as member_key, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') as row_digest from orders)"""

_GENERATIONS = """
with spelled as (
  select s_suppkey, gen, name, s_nationkey, s_suppkey::varchar as member_key, sha256('["tpch","supplier","' || s_suppkey || '","sha256:' || sha256('{"s_name":"' || name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') || '"]') as occurrence_hash
  from (select *, 'new' as gen, s_name || case when s_suppkey % 6 = 0 then '*' else '' end as name from supplier where s_suppkey % 8 <> 0
        union all select *, 'old', s_name from supplier where s_suppkey % 9 <> 0)
), n as (select * from spelled where gen = 'new'), o as (select * from spelled where gen = 'old'),
minted as (select n.*, o.member_key is null as added from n left join o using (member_key) where o.member_key is null or n.occurrence_hash <> o.occurrence_hash),
idx as (select distinct occurrence_hash from (select * from o where s_suppkey % 2 = 0 union all select * from n where s_suppkey % 12 = 0))
"""
O["generation_delta"] = _GENERATIONS + """
select (select count(*) from n) - count(*) as carried, count_if(added)::bigint as added, count_if(not added)::bigint as changed,
  (select count(*) from o) + count_if(added)::bigint - (select count(*) from n) as removed,
  count_if(i.occurrence_hash is null)::bigint as generated, count_if(i.occurrence_hash is not null)::bigint as adopted
from minted m left join idx i using (occurrence_hash)"""
O["generation_membership"] = _GENERATIONS + "select member_key, occurrence_hash from n"
O["membership_audit"] = _GENERATIONS + "select member_key from n full join o using (member_key) where n.occurrence_hash is distinct from o.occurrence_hash"
O["index_append"] = "select distinct sha256(text) as occurrence_hash, 'state-2' as first_state from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)"
O["derive_incremental"] = """
with base as (select o_custkey as m, o_orderkey as i, o_orderstatus || '|' as v from orders),
staged as (select o_custkey as m, o_orderkey as i, o_orderstatus || '|' || case when o_orderkey % 3 = 0 then 'new' else '' end as v from orders where o_custkey % 5 = 0 and o_orderkey % 7 <> 0),
touched as (select m from staged union select o_custkey from orders where o_custkey % 5 = 1),
old as (select * from base semi join touched using (m))
select (select count(*) from staged anti join old using (m, i, v)) as written, (select count(*) from (select * from staged anti join old using (m, i, v)) semi join old using (m, i)) as replaced,
  (select count(*) from old anti join staged using (m, i)) as removed, (select count(*) from staged semi join old using (m, i, v)) as unchanged"""
O["lineage_affected"] = "select n_regionkey::varchar as member_key, count(*)::int as sources from nation group by n_regionkey having count_if(n_nationkey % 9 = 0) > 0"
O["row_differences"] = """
select c_custkey, false as added from (select *, case when c_custkey % 10 = 0 then 0.0::double else c_acctbal end as b, case when c_custkey % 17 = 0 then null else c_name end as n from customer)
where b is distinct from c_acctbal or n is distinct from c_name"""

O["select_fields"] = "select event_id, 'present' as k_state, (props ->> '$.k')::bigint as k_value, 'absent' as missing_state from events"
O["multiset_equality"] = """
select event_type, sum(w)::bigint as weight from (select event_type, -1 as w from events where event_id % 10 <> 0 union all select event_type, 1 from events where event_id % 7 <> 0) group by 1 having sum(w) <> 0"""
O["ordered_members_desc"] = "select p_partkey::varchar as member_key, p_size, p_brand from part order by p_size desc, p_brand desc, member_key"

_DIGESTS = "select sha256(text) as k, count(*) as n from documents group by 1"
O["unique_index_abstain"] = f"select sum(n) filter (n = 1)::bigint as indexed, coalesce(sum(n) filter (n > 1), 0)::bigint as ambiguous, 0::bigint as unkeyed from ({_DIGESTS})"
_OUTCOMES = """
with x as (
  select 'order' as join, case when l_linenumber = 7 then 'not-stated' when o_orderkey is null then 'no-match' else 'matched' end as outcome
  from lineitem left join (select o_orderkey from orders where o_orderkey % 10 <> 3) on o_orderkey = l_orderkey
  union all select 'customer', case when o_custkey is null then 'not-stated' when c_custkey is null then 'no-match' else 'matched' end
  from orders left join (select c_custkey from customer where c_custkey % 4 <> 0) on c_custkey = o_custkey
)
"""
O["exact_join_outcomes"] = _OUTCOMES + "select outcome, count(*) as n from x where \"join\" = 'order' group by 1"
O["join_coverage"] = _OUTCOMES + """select "join", count_if(outcome <> 'not-stated')::bigint as eligible, count_if(outcome = 'matched')::bigint as matched, count_if(outcome = 'no-match')::bigint as unmatched, count_if(outcome = 'not-stated')::bigint as null_result from x group by 1"""
O["cross_filed_owner"] = """
select 'A' || o_custkey % 7 || '-' || o_custkey % 50 || '-' || o_orderkey as item, 'A' || o_custkey % 7 || '-' || o_custkey % 50 as docket, 'A' || o_custkey % 7 as agency, 1::bigint as other_filings from orders"""
O["stratified_sample"] = """
with ranked as (
  select *, md5(o_orderkey || ':20240') as h, row_number() over (partition by o_orderpriority, o_orderstatus, year(o_orderdate) order by md5(o_orderkey || ':20240'), o_orderkey) as sample_rank,
    count(*) over (partition by o_orderpriority, o_orderstatus, year(o_orderdate)) as n from orders
)
select o_orderkey, o_orderpriority, sample_rank::int as sample_rank, sample_rank / sqrt(n) as sample_score from ranked
qualify row_number() over (partition by o_orderpriority order by sample_rank / sqrt(n), h, o_orderkey) <= 50"""
O["salted_quota_sample"] = """
with sizes as (select c_mktsegment, c_nationkey, count(*) as population from customer group by all),
shares as (select *, 40 * population / sum(population) over (partition by c_mktsegment) as s from sizes),
floors as (select *, greatest(floor(s), 1) as base, row_number() over (partition by c_mktsegment order by s - floor(s) desc, c_nationkey) as place from shares),
quotas as (select *, least(base + case when place <= greatest(40 - sum(base) over (partition by c_mktsegment), 0) then 1 else 0 end, population) as quota from floors)
select c_custkey, c_mktsegment, c_nationkey, population / quota as design_weight
from (select *, row_number() over (partition by c_mktsegment, c_nationkey order by sha256('s1' || chr(0) || c_custkey), c_custkey) as r from customer join quotas using (c_mktsegment, c_nationkey)) where r <= quota"""
O["stratum_draws"] = """
select stratum, draw::int as draw, c_custkey from (
  select stratum, c_custkey, row_number() over (partition by stratum order by sha256('s2' || chr(0) || c_custkey), c_custkey) as draw
  from (select 'rich' as stratum, c_custkey from customer where c_acctbal > 5000 union all select 'machinery', c_custkey from customer where c_mktsegment = 'MACHINERY' union all select 'low-key', c_custkey from customer where c_custkey < 500)
) where draw <= 25"""
_DECIDED = """
with d as (
  select doc_id, source, case when source like 'src1%' then 1 when toxic is not null and toxic <> 0 then 2 when quality is null then 3 when n_chars < 200 then 4 when quality <> 1 then 5 else 6 end as step
  from documents left join labels using (doc_id)
), decided as (
  select *, ['excluded', 'deleted', 'failed', 'unavailable', 'excluded', 'selected'][step] as disposition,
    ['fixture-source', 'withdrawn', 'metadata-missing', 'too-short', 'low-quality', null][step] as reason_code, least(step, 5)::int as checks from d
)
"""
O["decision_chain"] = _DECIDED + "select doc_id, disposition, reason_code, checks from decided"
O["disposition_tally"] = _DECIDED + "select disposition, reason_code, count(*) as n from decided group by all"
O["budget_running_count"] = _DECIDED + "select doc_id, source, row_number() over (partition by source order by doc_id) as selected_so_far from decided where disposition = 'selected'"
O["budget_first_rows"] = _DECIDED + """
select disposition, in_budget, count(*) as n from (
  select disposition, case when disposition = 'selected' then row_number() over (partition by disposition = 'selected' order by doc_id) <= 60 else false end as in_budget from decided
) group by all"""
O["rendition_preference"] = """
with usable as (select distinct source, lang, 'loc-' || doc_id % 37 as l, list_position(['es', 'de', 'fr', 'en'], lang) as r from documents where lang <> 'en' or source < 'src3')
select source, lang as family, string_agg(l, ',' order by l) as locators from usable where (source, r) in (select source, min(r) from usable group by source) group by source, lang"""
O["catalog_preview_counts"] = """
with a as (select page_id, url, length(html) as size from pages where page_id % 9 <> 0),
b as (select page_id, url, length(html) + case when page_id % 4 = 0 then 1 else 0 end as size from pages where page_id % 6 <> 0)
select case when a.page_id is null then 'added' when b.page_id is null then 'removed' when a.url is distinct from b.url or a.size is distinct from b.size then 'changed' else 'unchanged' end as change, count(*) as n
from a full join b on a.page_id = b.page_id group by 1"""
O["normalized_field_rows"] = """
select doc_id, 'topics' as field, 'normalized' as outcome, i::int as value_index, case i when 0 then lang when 1 then source end as value from documents, (select unnest([0, 1]) as i) where lang = 'en'
union all select doc_id, 'topics', 'normalized', null, null from documents where lang <> 'en' or lang is null"""
O["listing_items"] = """
with p as (select url as key, max(page_id) as id, arg_max(length(html), page_id) as size, 'd' || max(page_id) % 4 as dataset from pages group by url),
x as (select size, case when id % 5 = 0 then 'missing' when id % 7 = 0 then 'undated' when dataset not in ('d0', 'd1', 'd2') then 'out-of-scope' end as reason from p)
select case when reason is null then 'active' when reason = 'missing' then 'deleted' else 'excluded' end as state, reason, count(*) as n, sum(size)::bigint as bytes from x group by all"""
O["normalise_dates"] = """
select o_orderkey, case when o_orderkey % 10 in (0, 1) then null else strftime(o_orderdate, '%Y-%m-%d') end as date_value,
  case when o_orderkey % 10 in (0, 1) then 1 else 0 end as date_rejected, case when o_orderkey % 10 in (0, 1) then null else strftime(o_orderdate, '%Y-%m-%d') end as instant_value from orders"""
O["normalise_strings"] = """
select source, coalesce(string_agg(distinct lang, ',' order by lang) filter (doc_id % 5 <> 0), '') as values, count_if(doc_id % 5 = 0)::int as rejected from documents group by source"""
O["normalise_urls"] = "select page_id, case when page_id % 8 in (0, 1) then null else url end as http_url from pages"

_STATISTICS = f"""'sha256:' || sha256(text) as content_digest, strlen(text)::bigint as byte_count, length(text)::bigint as codepoint_count,
  (len(regexp_extract_all(text, '{ENDS}')) + case when text = '' or regexp_matches(text, '{ENDS}\\z') then 0 else 1 end)::bigint as line_count, len(regexp_extract_all(text, '{WORDS}'))::bigint as word_count"""
O["content_statistics"] = f"select doc_id, {_STATISTICS} from documents"
O["conversation_statistics"] = f"select conv_id, turn, {_STATISTICS} from conversations"
O["paragraph_segments"] = f"""
select doc_id, 0::int as ordinal, strlen(regexp_extract(text, '^[{WORDS[2:-2]}]*'))::bigint as start, (strlen(text) - strlen(regexp_extract(text, '[{WORDS[2:-2]}]*\\z')))::bigint as "end",
  sha256(regexp_replace(regexp_replace(text, '^[{WORDS[2:-2]}]+', ''), '[{WORDS[2:-2]}]+\\z', '')) as content_sha256
from documents where regexp_matches(text, '{WORDS}')"""
O["text_anomalies"] = f"""
select page_id, concat_ws(',', case when regexp_matches(html, '&(?:[A-Za-z]+|#[0-9]+);') then 'entity' end, case when regexp_matches(html, '</?[A-Za-z][^>]*>') then 'markup' end, case when html = url then 'equals-title' end,
  case when regexp_matches(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]') then 'control' end, case when regexp_matches(html, '[A-Z]') and not regexp_matches(html, '[a-z]') then 'upper-case' end,
  case when html <> regexp_replace(regexp_replace(html, '^[{WORDS[2:-2]}]+', ''), '[{WORDS[2:-2]}]+\\z', '') then 'edge-space' end) as anomalies from pages"""
O["interval_coverage"] = """
with s as (select l_orderkey, l_linenumber * 10 as a, (l_linenumber * 10 + l_quantity)::bigint as b from lineitem),
t as (select l_orderkey, a, b, coalesce(max(b) over (partition by l_orderkey order by a, b rows between unbounded preceding and 1 preceding), a) as before from s)
select l_orderkey, sum(greatest(b - greatest(a, before), 0))::bigint as covered, (sum(b - a) - sum(greatest(b - greatest(a, before), 0)))::bigint as duplicated from t group by l_orderkey"""
O["secret_markers"] = "select doc_id, case when doc_id % 3 = 0 then 'credential-assignment' when doc_id % 5 = 0 then 'aws-access-key' else '' end as rules from documents"

O["coverage_census"] = f"""
with x as (select lang, text, length(text) as n, regexp_matches(text, '{WORDS}') as present from documents),
r as (select lang, n, row_number() over (partition by lang order by n) as r, count(*) over (partition by lang) as c from x where present),
p as (select lang, min(n) filter (r >= ceil(0.5 * c)) as p50, min(n) filter (r >= ceil(0.9 * c)) as p90, min(n) filter (r >= ceil(0.99 * c)) as p99 from r group by lang)
select lang, count(*) as rows, count_if(text is null)::bigint as null_rows, count_if(not present)::bigint as blank_rows, count_if(present)::bigint as present_rows, any_value(p50)::int as p50, any_value(p90)::int as p90, any_value(p99)::int as p99
from x left join p using (lang) group by lang"""
O["field_census"] = """
select 'k' as field, count(*) as present, count(*) as non_null, count(*) as non_empty, max(strlen(props ->> '$.k'))::int as largest from events
union all select 'missing', 0, 0, 0, null"""
O["wilson_rates"] = """
with c as (select lang, count(*)::double as n, count_if(toxic = 1)::double as k, 1.959963984540054::double as z from labels join documents using (doc_id) group by lang)
select lang, n::bigint as n, k::bigint as k, k / n as rate,
  ((k / n + z * z / (2 * n)) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) as low,
  ((k / n + z * z / (2 * n)) + z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) as high from c"""
O["phrase_prevalence"] = """
select predicate, count(*) as rows, count(distinct source) as units from (
  select 'licensed' as predicate, source from documents where contains(text, 'licen') union all select 'starts-the', source from documents where starts_with(text, 'The')
  union all select 'digits', source from documents where regexp_matches(text, '[0-9]{4}')) group by 1"""
O["out_of_order"] = "select count_if(b >= ts)::bigint as disordered from (select ts, lag(ts) over (partition by user_id % 8 order by event_id) as b from events)"
O["dependency_closure"] = """
with recursive links as (
  select distinct 'n' || c_nationkey as s, 'c' || c_custkey as t from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders union select 'o' || l_orderkey, 'p' || l_partkey from lineitem
), reach as (select 'n3' as node, 0 as depth union select t, depth + 1 from reach join links on s = node)
select depth, count(*) as nodes from (select node, min(depth)::int as depth from reach group by node) group by depth"""
O["positions_by_key"] = "select doc_id, row_number() over (order by source, doc_id) - 1 as position from documents"
O["ordered_stream_digest"] = """select count(*) as members, 'sha256:' || sha256('[' || string_agg('"' || c_name || '"', ',' order by c_custkey) || ']') as digest from customer"""
O["set_digest"] = """
with g as (select substr(h, 1, 2) as g, sha256(string_agg(h, '' order by h)) as d from (select distinct sha256(o_orderkey::varchar) as h from orders) group by 1)
select sha256(string_agg(d, '' order by g)) as set_digest from g"""


# --- layers, values and evidence ---------------------------------------------------------

_EDITED = """select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then 'Z' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 7 <> 0 or o_orderkey % 10 = 0
union all select -o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 50 = 1"""
O["layer_pinned"] = "select o_orderkey, o_custkey, o_orderstatus from orders"
O["layer_edited"] = O["layer_compacted"] = _EDITED
O["layer_key_ranges"] = f"select * from ({_EDITED}) where o_orderkey between -200 and 100 or o_orderkey between 400 and 500"
O["layer_lookup"] = "select p_partkey, p_brand, p_size from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49)"
O["layer_append_new"] = "select c_custkey, case when c_custkey % 3 = 0 then -1 else c_nationkey end as c_nationkey from customer"
O["encoded_layer_buckets"] = f"""select * from (select c_custkey::varchar as record_identity, ({_HEAD.format('c_custkey::varchar')} % 64)::int as bucket, to_json(c_name)::varchar as record_json, c_custkey from customer)
where bucket in (6, 7) or bucket = 5 and c_custkey % 2 = 1""".replace("select * from (", "select record_identity, bucket, record_json from (", 1)
O["keyed_values"] = "select c_custkey::varchar as member_key, 'e' || c_custkey as occurrence_id, case when c_custkey % 6 <> 0 then to_json(c_name)::varchar end as value from customer"
O["conflicting_values"] = "select 'e' || c_custkey as occurrence_id, to_json(c_name)::varchar as value, to_json(lower(c_name))::varchar as other from customer where c_custkey % 9 = 0 and lower(c_name) <> c_name"
O["unavailable_puts"] = """select 'e' || o_custkey as occurrence_id, o_orderkey::varchar as member_key from orders
where o_orderkey % 4 <> 0 and not exists (select 1 from customer where c_custkey = o_custkey and (c_custkey % 3 = 0 or c_custkey % 5 = 0))"""
O["minted_lookup"] = """select s_suppkey, sha256('{"s_name":' || to_json(s_name) || ',"s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') as row_digest, 'first' as first_state from supplier where s_nationkey < 10"""
O["joined_key_candidates"] = "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (1, 2, 7, 33) and l_linenumber in (1, 2, 3)"
O["spelled_row_size"] = f"select round(avg(strlen({_NATION})), 6) as mean_bytes from nation"
O["normalise_texts"] = """select doc_id, case when doc_id % 4 in (2, 3) and trim(source) <> '' then source end as value,
case when doc_id % 4 = 0 or doc_id % 4 in (2, 3) and trim(source) = '' then 'unparseable' when doc_id % 4 in (2, 3) and source is not null then 'normalized' else 'absent' end as outcome from documents"""
O["normalise_media_types"] = "select p_partkey, lower(trim(p_type)) as media_type from part"
O["normalise_rins"] = "select o_orderkey, lpad((o_orderkey % 10000)::varchar, 4, '0') || case o_orderkey % 3 when 0 then '-AB12' when 2 then '-ZX0Y' end as rin from orders"
O["part_topics"] = """select p_partkey, list_aggregate(list_transform(list_sort(list_distinct([p_type, p_brand])), lambda x: 'market:' || x || '=' || x), 'string_agg', '|') as topics from part"""
O["redacted_turns"] = "select conv_id, turn, case when turn % 5 = 0 then '[redacted: secret-like content]' else text end as text from conversations"
O["segment_identity"] = """select conv_id, turn::int as ordinal, 'sha256:' || sha256(text) as content_digest,
sha256(concat_ws('|', 'turns', conv_id, turn, 0, strlen(text), 'sha256:' || sha256(text))) as name from conversations where text is not null"""
O["unfaithful_segments"] = """select doc_id, upper(substring(text, 5, 12)) as text from documents
where doc_id % 3 = 0 and length(text) >= 20 and strlen(text) = length(text) and upper(substring(text, 5, 12)) <> substring(text, 5, 12)"""
O["page_segments"] = "select conv_id || '/' || turn as key, unnest(range(len(pages)))::int as ordinal, unnest(pages) as text from (select conv_id, turn, string_split(text, '. ') as pages from conversations)"
O["whole_segments"] = "select page_id, 0 as ordinal, 0::bigint as start, strlen(html)::bigint as end, sha256(html) as digest from pages"
O["split_segments"] = "select 'd' || doc_id || ':metadata' as k, lang as metadata, case when doc_id % 3 <> 0 then source end as content from documents"
O["array_or_rejected"] = """select c_custkey, case c_custkey % 5 when 1 then c_custkey || '|"' || c_name || '"' else '' end as items,
case c_custkey % 5 when 2 then '{"k":1}' when 3 then 'not json' else '' end as rejected from customer"""
O["resolved_agencies"] = """select s_suppkey, case when s_suppkey % 7 = 0 then '' else 'federal-register:' || s_suppkey || '=' || s_name || '|' end || 'nation-' || s_nationkey || '=' || s_name as agencies,
case when s_suppkey % 7 = 0 then 2 else 1 end as unparseable from supplier"""
O["named_agency"] = "select c_custkey, c_nationkey, n_name as agency_name, case when n_name is null then c_nationkey end as agency_unparseable from customer left join nation on n_nationkey = c_nationkey and n_nationkey <> 3"
O["withheld_items"] = """
with o as (select o_orderkey, case o_orderkey % 6 when 1 then 'Copyrighted' when 2 then 'Confidential Business Information' when 3 then 'Personally Identifiable Information' when 4 then 'Other' when 5 then 'Secret' end as said,
  case when o_orderkey % 2 = 0 then ' and subtype is ''' || o_orderpriority || '''' else '' end as sub from orders)
select o_orderkey, case when said = 'Secret' then 'failed' else 'unavailable' end as disposition,
  case when said is null then 'source.no-candidate-rendition' when said = 'Secret' then 'source.restrict-reason-unread' else 'source.publisher-withheld.' || replace(lower(said), ' ', '-') end as code,
  case when said is null then 'nothing was acquired' when said = 'Secret' then 'The publisher declares a restrictReasonType this policy does not read: ''Secret''.'
  else 'The publisher withholds this record''s content; restrictReasonType is ''' || said || '''' || coalesce(sub, '') || '.' end as reason from o"""
O["event_instants"] = "select event_id, epoch_us(ts) - 7200000000 + 719163::bigint * 86400000000 as instant from events"
O["own_facts"] = "select p_partkey, (p_size % 4 // 2 + 1)::int as own_facts, array_to_string(range(0, p_size % 4 + 1, 2), ',') as scopes from part"
O["numbered_interpretations"] = """select p_partkey, case i % 2 when 0 then 'topics' else 'joins' end as kind, lpad((i // 2)::varchar, 4, '0') as number, p_brand || i as result
from (select p_partkey, p_brand, unnest(range(0, p_size % 6 + 1)) as i from part)"""
O["listing_coverage"] = """select 'd' || page_id % 4 as dataset, count(*) as objects, sum(length(html))::bigint as bytes, count_if(page_id % 7 <> 0)::bigint as active_objects,
coalesce(sum(length(html)) filter (page_id % 7 <> 0), 0)::bigint as active_bytes from pages group by 1"""
O["matched_items"] = """select c_custkey, coalesce(c_mktsegment = 'BUILDING', false) as matches,
concat_ws(',', case when c_custkey % 2 <> 0 then 'address' end, case when c_custkey % 3 <> 0 then 'phone' end) as unavailable from customer"""
O["framed_digest"] = """select count(*) as records, 'sha256:' || sha256(unhex(hex('example-domain') || '00' || lpad(to_hex(9), 16, '0') || hex('suppliers') || lpad(to_hex(count(*)), 16, '0')
  || string_agg(lpad(to_hex(strlen(s_name)), 16, '0') || hex(s_name), '' order by s_suppkey))) as digest from supplier"""


def oracle_sql() -> dict[str, str]:
    return dict(O)
