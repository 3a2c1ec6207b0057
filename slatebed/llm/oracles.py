"""SQL twins of the native operators, for DuckDB."""

from __future__ import annotations

from slatebed.llm.imatch import HASH_DIGITS, LEAST, MOST, NONE, SETS, SUBSETS
from slatebed.llm.quality import BENEFIT, DUP_LINE_SHARE, HIGHEST, SPREADS, SYMBOLS_A_WORD, TIMES_MEAN

_GAP = r"'[ \x09-\x0D]+'"

QUALITY = rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, {_GAP}), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) as ls from d),
i as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w),
g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i+4], ' ')) as times from i),
p as (select doc_id, count(distinct pos) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as pos from g where times > 1) group by doc_id),
c as (select w.doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join p on w.doc_id = p.doc_id),
r as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_symbols > {SYMBOLS_A_WORD} * n_words as symbols_failed, n_dup_lines > {DUP_LINE_SHARE} * n_lines as lines_failed from c),
f as (select source, unnest(['base', 'symbols', 'lines']) as rule, unnest([base_failed, symbols_failed, lines_failed]) as failed from r),
h as (select rule, source, count(*)::double as n, sum(failed::int)::double as k from f group by all),
a as (select rule, sum(n) as n, count(*) as hosts, sum(n * n) as n2, sum(k) / sum(n) as mean from h group by rule),
v as (select rule, any_value(a.n) as n, any_value(hosts) as hosts, any_value(n2) as n2, any_value(mean) as mean, sum(h.n * pow(h.k / h.n - mean, 2)) as spread from h join a using (rule) group by rule),
x as (select *, mean * (1 - mean) as chance, case when mean * (1 - mean) > 0 and n - n2 / n > 0 then (spread - (hosts - 1) * mean * (1 - mean)) / ((n - n2 / n) * mean * (1 - mean)) else 0 end as extra from v),
s as (select rule, mean, chance, greatest(1.0, least(n, case when extra > 0 then 1 / extra - 1 else n end)) as strength from x),
l as (select rule, mean, strength, least({HIGHEST}, greatest({TIMES_MEAN} * mean, mean + {SPREADS} * sqrt(chance / (strength + 1)))) as most from s),
o as (select rule, source, n + strength as weight, (k + strength * mean) / (n + strength) as rate, most from h join l using (rule)),
w2 as (select source, bool_or(rate - {BENEFIT} * sqrt(rate * (1 - rate) / (weight + 1)) > most) as rejected, max(rate) filter (rule = 'base') as base_rate, max(rate) filter (rule = 'symbols') as symbols_rate, max(rate) filter (rule = 'lines') as lines_rate from o group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or rejected) as kept, round(base_rate, 6) as base_rate, round(symbols_rate, 6) as symbols_rate, round(lines_rate, 6) as lines_rate, rejected
from r join w2 on r.source is not distinct from w2.source
"""

_COUNT = "list_sum(list_transform(range(1, {n} + 1), lambda i: ({test})::int))".replace("{n}", str(SUBSETS))
_LIKE = f"({_COUNT.format(test=f"{{a}}[i] = {{b}}[i] and {{a}}[i] <> '{NONE}'")}::double / {_COUNT.format(test=f"{{a}}[i] <> '{NONE}' or {{b}}[i] <> '{NONE}'")})::double"

IMATCH = rf"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
e as (select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nt from d),
f as (select *, substr(t, 1, (n - n // 2)::int) || substr(nt, 1, (n // 2)::int) as ed from e),
x as (select doc_id, 0 as side, t from f union all select doc_id, 1, ed from f),
u as (select doc_id, side, unnest(list_distinct(list_filter(regexp_split_to_array(lower(t), {_GAP}), lambda w: w <> ''))) as term from x),
l as (select term from u where side = 0 group by term
  having count(*) between greatest(2, ceil({LEAST}::double * (select count(*) from d))) and greatest(2, floor({MOST}::double * (select count(*) from d)))),
s as (select term, k from l, range(0, {SUBSETS}) r(k) where ('0x' || substr(md5(k || ':' || term), 1, 3))::int < (4096 >> (k // {SETS} + 1)::int)),
h as (select doc_id, side, k, substr(md5(string_agg(term, ' ' order by term)), 1, {HASH_DIGITS}) as h from u join s using (term) group by doc_id, side, k),
m as (select doc_id, side, map(list(k), list(h)) as hs from h group by doc_id, side),
z as (select x.doc_id, x.side, case when hs is null then list_transform(range(0, {SUBSETS}), lambda i: substr(md5(t), 1, {HASH_DIGITS}))
  else list_transform(range(0, {SUBSETS}), lambda i: coalesce(hs[i], '{NONE}')) end as fp from x left join m on x.doc_id = m.doc_id and x.side = m.side),
y as (select f.doc_id, f.n, sha256(f.ed) as edited_sha256, a.fp as fp, b.fp as efp from f join z a on a.doc_id = f.doc_id and a.side = 0 join z b on b.doc_id = f.doc_id and b.side = 1),
o as (select *, coalesce(lead(fp) over (order by doc_id), first_value(fp) over (order by doc_id)) as nfp from y)
select doc_id, n::bigint as n_chars, edited_sha256, array_to_string(fp, '') as fingerprint, array_to_string(efp, '') as edited_fingerprint,
  {_LIKE.format(a='fp', b='efp')} as near_edited, {_LIKE.format(a='fp', b='nfp')} as near_next from o
"""

# CRC-32 of a number's digits: eight shifts after each digit
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: list_prepend(ascii(x)::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295)"

TRIE = f"""
with x as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select conv_id, turn, role, sha256(strlen(role) || ':' || role || text) as digest, strlen(text) as size from x),
o as (select conv_id, digest, size, row_number() over (partition by conv_id order by turn nulls first, role, digest) - 1 as i from t),
c as (select conv_id, {_CRC} % 9 as h from (select distinct conv_id from o)),
b as (select c.conv_id, 0 as part, i, digest, size from c join o on o.conv_id = c.conv_id - c.conv_id % 5 and i < h
  union all select c.conv_id, 1, i, digest, size from c join o on o.conv_id = c.conv_id and i >= h),
p as (select conv_id, size, string_agg(digest, '') over w as path, row_number() over w as depth, count(*) over (partition by conv_id) as whole from b window w as (partition by conv_id order by part, i)),
r as (select conv_id, depth, size, sha256(path) as node, coalesce(lag(sha256(path)) over (partition by conv_id order by depth), 'root') as parent, whole = depth as ends from p
  union all select conv_id, 0, 0, 'root', null, conv_id not in (select conv_id from b) from c),
n as (select node, any_value(depth) as depth, any_value(size) as size, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
  coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ends from r group by node),
k as (select parent as node, count(*) as n_children from n where parent is not null group by parent),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (node)),
s as (select r.node, sum((m.n_children = 0)::int) as n_leaves, sum((m.n_convs - 1) * m.size) as saved from m join r on r.conv_id = m.conv_id and r.depth <= m.depth group by r.node)
select m.conv_id, m.depth::bigint as depth, q.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(m.ends) as ends_sha256
from m join s using (node) left join m q on q.node = m.parent
"""
