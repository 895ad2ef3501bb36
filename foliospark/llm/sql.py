"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""
with split as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
bare as (
  select *, regexp_replace(regexp_replace(host, '(?s)^.*@|:[0-9]*\z', '', 'g'), '\.+\z', '') as name from split),
suffixed as (
  select *, case when regexp_matches(name, '^[0-9.:\[\]]+\z') or starts_with(name, '[') then ''
    when regexp_extract(name, '([^.]*\.[^.]*)\z', 1) in ('appspot.com', 'azurewebsites.net', 'blogspot.com', 'cloudfront.net', 'firebaseapp.com', 'fly.dev', 'github.io', 'gitlab.io',
      'herokuapp.com', 'id.au', 'me.uk', 'netlify.app', 'pages.dev', 'readthedocs.io', 'vercel.app', 'web.app', 'workers.dev')
      then regexp_extract(name, '([^.]*\.[^.]*)\z', 1)
    when regexp_matches(name, '(?:^|\.)((?:ac|co|com|edu|go|gob|gouv|gov|gv|ltd|mil|ne|net|nhs|nom|or|org|plc|sch)\.[a-z]{2})\z')
      then regexp_extract(name, '(?:^|\.)((?:ac|co|com|edu|go|gob|gouv|gov|gv|ltd|mil|ne|net|nhs|nom|or|org|plc|sch)\.[a-z]{2})\z', 1)
    else regexp_extract(name, '([^.]*)\z', 1) end as suffix
  from bare),
named as (
  select *, case when suffix = '' then name
    else array_to_string(list_slice(string_split(name, '.'), greatest(len(string_split(name, '.')) - len(string_split(suffix, '.')), 1), len(string_split(name, '.'))), '.') end as domain
  from suffixed),
outcome as (select doc_id, max((toxic > 0)::bigint) as bad from labels where toxic is not null group by doc_id),
hosts as (
  select host, domain, suffix, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad
  from named left join outcome on page_id = doc_id group by all),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from hosts group by all),
sums as (
  select 0 as level, sum(n) as n, sum(bad) as bad, sum(n * (bad / n) * (bad / n)) as sq, count(*) as units from suffixes where n > 0
  union all select 1, sum(n), sum(bad), sum(n * (bad / n) * (bad / n)), count(*) from domains where n > 0
  union all select 2, sum(n), sum(bad), sum(n * (bad / n) * (bad / n)), count(*) from hosts where n > 0),
moments as (
  select level, bad / n as p, greatest(sq / n - (bad / n) * (bad / n), 0.0) as spread, (bad / n) * (1 - bad / n) * units / n as noise from sums),
priors as (
  select level, coalesce(p, 0.0) as rate, greatest(1.0, least(1000.0, coalesce(case when spread > noise then (p * (1 - p) - spread) / (spread - noise) else 1000.0 end, 1000.0))) as m from moments),
rs as (select s.suffix, (s.bad + p.m * p.rate) / (s.n + p.m) as r from suffixes s, priors p where p.level = 0),
rd as (select d.suffix, d.domain, (d.bad + p.m * rs.r) / (d.n + p.m) as r from domains d join rs using (suffix), priors p where p.level = 1),
post as (
  select h.host, (h.bad + p.m * rd.r) / (h.n + p.m) as mean, h.n + p.m as size from hosts h join rd using (domain, suffix), priors p where p.level = 2),
judged as (
  select n.page_id, n.host, n.path, round(p.mean, 6) as bad_rate, round(greatest(0.0, p.mean - 1.645 * sqrt(p.mean * (1 - p.mean) / (p.size + 1))), 6) as bad_bound,
    case when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
      when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
      when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
      when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from named n left join post p using (host))
select page_id, host, path, rule,
  case rule when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' when 'net/' then 'block'
    else case when bad_bound > 0.5 then 'block' else 'allow' end end as verdict, bad_rate, bad_bound
from judged
"""

#: Links on full sets of shingles, spelled out; a label goes on to the neighbours with larger ids.
OP5 = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from split where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from starts),
sets as (select doc_id, list(s order by s) as all_s, count(*) as n from shingles group by doc_id),
classes as (select min(doc_id) as node, all_s, any_value(n) as n from sets group by all_s),
held as (select node, n, unnest(all_s) as s from classes),
links as (
  select a.node as a, b.node as b from held a join held b on a.s = b.s and a.node < b.node and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways as (select a, b from links union all select b, a from links),
reach as (
  select node, node as label from classes
  union select ways.b, reach.label from reach join ways on ways.a = reach.node where reach.label < ways.b),
labels as (select node, min(label) as label from reach group by node),
members as (select s.doc_id, l.label, s.n from sets s join classes c on s.all_s = c.all_s join labels l on l.node = c.node)
select d.doc_id, coalesce(m.n, 0)::bigint as n_shingles, coalesce(m.label, d.doc_id) as component_id, coalesce(m.label, d.doc_id) = d.doc_id as kept
from split d left join members m using (doc_id)
"""

#: Every 200-byte string is counted; texts are spelled in hexadecimal, as SQL has no substrings of bytes.
OP6 = r"""
with spelled as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
blocks as (select r, x, unnest(range(0, (len(x) // 2 - 199)::bigint, 500)) as base from spelled where len(x) >= 400),
parts as (select r, base, substring(x, 2 * base + 1, 1398) as part from blocks),
starts as (select r, base, part, unnest(range(0, (len(part) // 2 - 199)::bigint)) as k from parts),
strings as (select r, base + k as i, md5_number(substring(part, 2 * k + 1, 400)) as h from starts),
often as (select h from strings group by h having count(*) > 1),
hit as (select r, i from strings where h in (select h from often)),
edges as (select r, i, coalesce(i > lag(i) over (partition by r order by i) + 200, true)::int as fresh from hit),
runs as (select r, i, sum(fresh) over (partition by r order by i rows unbounded preceding) as run from edges),
spans as (select r, min(i) as a, max(i) + 200 as b from runs group by r, run),
gaps as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from spans),
cut as (
  select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substring(any_value(x), 2 * max(b) + 1) as rest
  from gaps join spelled using (r) group by r)
select doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, x))) as kept_sha256
from spelled left join cut using (r)
"""

#: Every window of every item is looked for in every text.
OP7 = r"""
with split as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_starts as (select item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0),
item_windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from item_starts),
lengths as (select distinct n from item_windows),
text_starts as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from split, lengths where len(w) >= n),
met as (select t.r, t.i, t.n, b.item from (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g from text_starts) t join item_windows b on t.n = b.n and t.g = b.g),
places as (select distinct r, i, n from met),
covered as (select distinct r, word from (select r, unnest(range(i, i + n)) as word from places)),
hits as (select r, count(*) as n_hit from covered group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from met where item is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from split left join hits using (r) left join named using (r)
"""

#: Base counts by windows and lines spelled out; then the lines on more than 20 and a twentieth of a host's distinct texts.
OP8 = r"""
with rowed as (select row_number() over () as r, doc_id, source, text, coalesce(text, '') as t from documents),
split as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from rowed),
windows as (
  select r, i, array_to_string(w[i:i + 2], ' ') as g from (select r, w, unnest(range(1, len(w) - 1)) as i from split where len(w) >= 3)),
twice as (select r, g from windows group by all having count(*) > 1),
again as (
  select r, count(distinct word) as n_repeat_words
  from (select r, unnest(range(i, i + 3)) as word from windows join twice using (r, g)) group by r),
lines as (
  select r, i, parts[i] as line from (select r, string_split(t, chr(10)) as parts, unnest(range(1, len(string_split(t, chr(10))) + 1)) as i from rowed)),
worded as (
  select r, i, line, regexp_replace(regexp_replace(lower(trim(line, ' ')), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') as norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select r, count(*) - count(distinct line) as n_dup_lines from worded group by r),
distinct_docs as (select source, text, min(r) as r from rowed where text is not null and regexp_matches(text, '[^\x20\x09-\x0D]') group by all),
hosts as (select source, count(*) as docs from distinct_docs group by source),
per_line as (select d.source, w.norm, count(distinct d.r) as n from distinct_docs d join worded w using (r) group by all having count(distinct d.r) > 20),
often as (select p.source, p.norm from per_line p join hosts h on p.source is not distinct from h.source where p.n > 0.05 * h.docs),
removed as (
  select w.r, sum(w.n)::bigint as n_words_removed
  from worded w join rowed using (r) join often o on o.source is not distinct from rowed.source and o.norm = w.norm group by w.r),
counted as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_words_removed, 0)::bigint as n_words_removed
  from rowed join split using (r) left join dups using (r) left join again using (r) left join removed using (r)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted)
select *, not base_failed and n_words - n_words_removed >= 0.5 * n_words as kept from failed
"""

#: Turns by number, role and text; what the template adds is counted, and what escaping adds.
OP11 = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
controls as (select ['<s>', '[SYS]', '[/SYS]', '[INST]', '[/INST]', '[OUT]', '</s>', '[ROLE]', '[SAYS]', '[/ROLE]'] as c),
added as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    lead(role) over (partition by conv_id order by turn nulls first, role, text) is null as is_last,
    list_sum(list_transform(c, lambda x: 2 * ((length(text) - length(replace(text, x, ''))) // length(x)))) + length(text) - length(replace(text, '\', '')) as in_text,
    list_sum(list_transform(c, lambda x: 2 * ((length(role) - length(replace(role, x, ''))) // length(x)))) + length(role) - length(replace(role, '\', '')) as in_role
  from rows_, controls),
turns as (
  select *, case role when 'system' then 11 when 'user' then 13 when 'assistant' then 9 else 19 + length(role) + in_role end + length(text) + in_text + case when k = 1 then 3 else 0 end as chars,
    case when k = 1 then role in ('system', 'user') else (before in ('system', 'assistant') and role = 'user') or (before = 'user' and role = 'assistant') end and (not is_last or role = 'assistant') as fine
  from added)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, bool_and(fine) as valid
from turns group by conv_id
"""

#: CRC-32 by its table; near words share what is left when one letter goes, of both or of the longer.
OP12 = r"""
with recursive crc as (
  select list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (
  select coalesce(doc_id::varchar, '') || ':' as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
  from documents),
counted as (select id, run, count(*) as n, hex(encode(id || run)) as x from runs where length(run) >= 6 group by id, run),
bytes as (
  select id, run, n, list_transform(range(0, (len(x) // 2)::bigint), lambda i: 16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) as b
  from counted),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) as h from bytes, crc),
damaged as (select case when h % 199 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from damaged where length(word) >= 6 group by word having sum(n) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from places),
pairs as (
  select distinct a.word as word, b.word as other, b.n as m from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word != b.word
  union select h.word, w.word, w.n from holes h join words w on h.rest = w.word
  union select w.word, h.word, h.n from holes h join words w on h.rest = w.word),
near as (select word, count(*) as n_near, max(m) as m from pairs group by word),
best as (select word, min(other) as other, any_value(near.n_near) as n_near, any_value(near.m) as m from near join pairs using (word) where pairs.m = near.m group by word),
judged as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 5 * w.n then other end as form, case when m >= 5 * w.n then m end::bigint as form_n
  from words w left join best using (word)),
chain as (
  select word, word as at from judged
  union all select chain.word, judged.form from chain join judged on judged.word = chain.at where judged.form is not null),
ends as (select chain.word, chain.at as root from chain join judged on judged.word = chain.at where judged.form is null)
select word, form, root, n, n_near, form_n from judged join ends using (word)
"""

#: Every document that shares a term is scored.
OP13 = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
dn as (select r, doc_id, len(w)::bigint as n from d where len(w) > 0),
sums as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from dn),
items as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select distinct item_id, text from benchmark)),
asked as (select q, t, count(*)::bigint as c from (select q, unnest(w) as t from items) group by all),
held as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) where t in (select t from asked) group by all),
weights as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from held, sums group by t, n_docs),
parts as (select r, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) as part from held join dn using (r), sums),
scores as (select q, r, sum(c * weight * part)::bigint as score from asked join weights using (t) join parts using (t) group by q, r),
ranked as (
  select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score from scores join dn using (r) join items using (q) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
