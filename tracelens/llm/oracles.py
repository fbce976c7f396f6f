"""DuckDB SQL for the corpus queries that SQL can express, by brute force over whole tables."""

#: Exact Jaccard join: all pairs of sets that share a shingle, then components by reachability.
NGRAM_JOIN = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sh as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
st as (select w.doc_id, coalesce(md5(string_agg(s, chr(10) order by s)), '') as k, count(s) as n from w left join sh using (doc_id) group by 1),
se as (select k, min(doc_id) as rep, count(*) as copies, max(n) as n from st group by 1),
rs as (select rep, s, copies, n from se join sh on sh.doc_id = se.rep),
pr as (select a.rep as x, b.rep as y, any_value(a.copies) as cx, any_value(b.copies) as cy from rs a join rs b on a.s = b.s and a.rep < b.rep group by 1, 2 having 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
ed as (select x, y, cy as c from pr union all select y, x, cx from pr),
reach(x, y) as (select rep, rep from se union select r.x, e.y from reach r join ed e on r.y = e.x),
cl as (select x as rep, min(y) as class_id from reach group by 1),
lk as (select x as rep, count(*) as sets, sum(c) as docs from ed group by 1)
select st.doc_id, class_id, se.rep as set_id, cast(copies - 1 + coalesce(docs, 0) as bigint) as n_links, cast(coalesce(sets, 0) as bigint) as n_set_links
from st join se using (k) join cl using (rep) left join lk using (rep)"""

#: Passage removal: every 200-byte string of every text, as hexadecimal.
SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), b as (select doc_id, len(h) // 2 as n, h from d),
k as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(0, n - 199)) as i from b)),
f as (select k from k group by 1 having count(*) > 1),
r as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from k semi join f using (k)),
g as (select *, sum(case when gap is null or gap > 200 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as span from r),
s as (select doc_id, span, min(i) as lo, max(i) + 200 as hi from g group by 1, 2),
e as (select doc_id, lo, hi, lag(hi, 1, 0) over (partition by doc_id order by lo) as before from s),
a as (select e.doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' order by lo) as kept, max(hi) as hi from e join b using (doc_id) group by 1)
select b.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(coalesce(kept || substr(h, 2 * hi + 1), h))) as kept_sha256 from b left join a using (doc_id)"""

#: Words of the corpus contract, A-Z lower-cased or not.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a short text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::bigint)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

#: Base columns of the language model.
LM_BASE = f"""
with d as (select doc_id, cast(doc_id as varchar) as id, list_append({_WORDS.format(_LOWER)}, chr(10)) as ws from documents),
h as (select doc_id, ws, {_CRC.format('id')} % 10 = 0 as held_out from d), t as (select doc_id, held_out, unnest(ws) as w from h),
c as (select w, count(*) as c from t where not held_out group by 1), n as (select sum(c) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast(any_value(n) as bigint) as train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))), 3) as base_score
from t left join c using (w), n group by 1, 2"""

#: Sizes and digests of the media payloads.
MEDIA_PAYLOADS = """
with d as (select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) as n from documents), p as (select *, greatest(1, (n + 191) // 192) * 192 as m from d)
select doc_id, cast(n as bigint) as n_bytes, cast(m as bigint) as payload_bytes, sha256(t || repeat(' ', m - n)) as payload_sha256 from p"""

#: Hosts, paths and rules of all pages; the longest rule that fits.
URL_RULES = """
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
p as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from u),
rl(rule, name, start) as (values ('com/en/', 'com', '/en/'), ('example.com/en/7', 'example.com', '/en/7'), ('net/de/', 'net', '/de/'), ('example.net/de/8', 'example.net', '/de/8'), ('org/es/', 'org', '/es/'))
select page_id, any_value(host) as host, any_value(path) as path, arg_max(rule, length(rule)) as rule from p left join rl on (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by 1"""

#: The plain rules' figures.
QUALITY_BASE = f"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 6)) as i, ws from d where len(ws) >= 8), h as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from g),
f as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from h) where c > 1),
r as (select doc_id, count(*) as n_repeat_words from (select distinct doc_id, i + k as p from f, (select unnest(range(0, 8)) as k)) group by 1),
l as (select doc_id, count(*) - count(distinct x) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ws) < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) as base_failed from d left join r using (doc_id) left join l using (doc_id)"""

#: Texts whose last half is replaced by the start of the next document's.
EDITED_TEXTS = """
with d as (select doc_id, coalesce(text, '') as t from documents), s as (select doc_id, t, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as u from d)
select doc_id, length(t) as n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2)) as edited_sha256 from s"""

#: crc32 of a text of code points below 256, from its UTF-8 bytes, bit by bit.
_CRC_UTF8 = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length({0}) + 1), lambda i: case when ascii({0}[i]) < 128 then [ascii({0}[i])::bigint] else [195::bigint, ascii({0}[i])::bigint - 64] end))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

#: Spelling variants: near words share a deletion at the same place, or one is a deletion of the other.
SPELLING_GROUPS = f"""
with recursive w as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
c as (select w, coalesce(cast(doc_id as varchar), '') || ':' || w as k, count(*) as c from w group by 1, 2), h as (select w, c, {_CRC_UTF8.format('k')} as h from c),
s as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as w, c from h),
v as (select w, cast(sum(c) as bigint) as n from s where length(w) >= 5 group by 1 having sum(c) >= 3),
dl as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) as d from (select w, n, unnest(range(1, length(w) + 1)) as i from v)),
pr as (select a.w as x, v.w as y, v.n from dl a join v on a.d = v.w union select v.w, a.w, a.n from dl a join v on a.d = v.w union select a.w, b.w, b.n from dl a join dl b on a.i = b.i and a.d = b.d and a.w <> b.w),
nr as (select x, count(*) as n_near from pr group by 1), bs as (select x, y, n as form_n from pr qualify row_number() over (partition by x order by n desc, y) = 1),
fm as (select v.w, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then y end as form, case when form_n >= 2 * n then form_n end as form_n from v left join nr on x = w left join bs on bs.x = w),
up(w, root) as (select w, w from fm union all select up.w, form from up join fm on up.root = fm.w where form is not null),
tp as (select up.w, root from up join fm on up.root = fm.w where fm.form is null)
select fm.w as word, form, root, n, cast(n_near as bigint) as n_near, form_n from fm join tp using (w)"""
