"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"

OP5 = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
d as (select doc_id, text, regexp_extract_all(text, {SPACED}) as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {SPACED})) as l from t),
g as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
h as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from r) group by doc_id),
c as (select doc_id, text, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines, len(list_distinct(w))::bigint as n_distinct, coalesce(n, 0)::bigint as n_repeat_words from d left join h using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, length(regexp_replace(text, '[^A-Z]', '', 'g')) as up, length(regexp_replace(text, '[^a-z]', '', 'g')) as low, length(regexp_replace(text, '[^!]', '', 'g')) as marks from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or 10 * n_symbols > n_words or 10 * marks > 3 * n_words or 10 * up > 6 * (up + low) or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words or 20 * n_distinct < n_words) as kept from b"""

OP6 = rf"""
with d as (select doc_id, regexp_extract_all({LOWERED}, {PLAIN}) as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({LOWERED}, {PLAIN}) as w from benchmark where item_id is not null),
s as (select item, w, least(len(w), 10) as n from b where len(w) > 0),
g as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from s)),
k as (select distinct n, g from g),
p as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from k) where len(w) >= n),
h as (select doc_id, i, p.n, k.g from p join k on k.n = p.n and k.g = array_to_string(w[i:i + p.n - 1], ' ')),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from h) group by doc_id),
m as (select doc_id, list_sort(list(distinct item)) as items from h join g using (g, n) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, n_hit is not null as contaminated from d left join c using (doc_id) left join m using (doc_id)"""

OP8 = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWERED}, {SPACED}) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(case when len(w) < 3 then range(1, least(len(w), 1) + 1) else range(1, len(w) - 1) end) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
x as (select a.doc_id as a, b.doc_id as b, count(*) as x from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * x >= 90 * (na.n + nb.n - x)),
e as (select a as x, b as y from l union all select b, a from l),
r(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from r join e on e.x = r.y),
c as (select x as doc_id, min(y) as component_id from r group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from d join c using (doc_id) left join n using (doc_id)"""

OP12 = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as j, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(w[1:i], '') as a, array_to_string(w[i + 1:j], '') as m, array_to_string(w[j + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || a || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from p"""

OP13 = rf"""
with t as (select coalesce(lang, '') as lang, coalesce(source, '') as source, doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term, r from (select *, row_number() over () as r from documents)),
k as (select lang, term from t group by all having count(distinct r) >= 10),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by all),
x as (select lang, source, term, coalesce(c, 0) as c from g join k using (lang) left join c using (lang, source, term)),
p as (select *, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang, source) + 2 * v) as p from x join v using (lang)),
q as (select *, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang) + 2 * v) as p from (select lang, term, sum(c) as c from x group by all) join v using (lang)),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value, row_number() over (partition by a.lang, a.source order by coalesce(value, 0) desc, b.source) as rank from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
m as (select p.lang, p.source, 'term' as part, term as item, ((p.p - q.p) * (p.p - q.p)) // (p.p + q.p) as value from p join q using (lang, term) where p.c > 0 and p.p > q.p),
n as (select *, row_number() over (partition by lang, source order by value desc, item) as rank from m)
select lang, source, part, item, value, rank::int as rank from r union all select lang, source, part, item, value::bigint, rank::int from n where rank <= 10"""

SQL = {"op12_fill_in_middle": OP12, "op13_source_divergence": OP13, "op5_quality_rules": OP5, "op6_benchmark_decontamination": OP6, "op8_ngram_jaccard_join": OP8}
