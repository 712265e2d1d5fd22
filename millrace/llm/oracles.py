"""DuckDB SQL for the queries that SQL can express: chats, near duplicates, leaks, secrets, cuts, divergences."""

from __future__ import annotations

_SPACE = r"[ \t\n\x0b\f\r]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


OP3 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (
  select *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as n_text,
    length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) as n_role from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n_text + n_role + length('<|im_start|>') + length('<|im_end|>') + 2) as bigint) as formatted_chars
from e group by conv_id"""

OP4 = f"""
with recursive c as (select coalesce(text, '') as text, min(doc_id) as rep, count(*) as copies from documents group by 1),
w as (select rep, {_words("text")} as w from c),
s as (select distinct rep, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select rep, count(*) as n from s group by rep),
i as (select a.rep as a, b.rep as b, count(*) as i from s a join s b on a.s = b.s and a.rep < b.rep group by 1, 2),
p as (select a, b from i join n x on x.rep = a join n y on y.rep = b where i >= 0.8 * (x.n + y.n - i)),
e as (select a, b from p union all select b, a from p),
r(a, b) as (select rep, rep from c union select r.a, e.b from r join e on r.b = e.a),
class as (select a, min(b) as class_id from r group by a),
links as (select e.a, sum(copies) as n from e join c on c.rep = e.b group by 1)
select doc_id, class_id, c.rep as copy_id, cast(copies - 1 + coalesce(links.n, 0) as bigint) as n_links
from documents d join c on coalesce(d.text, '') = c.text join class on class.a = c.rep left join links on links.a = c.rep"""

_PLAIN = r"regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', '', 'g')"
OP5 = f"""
with b as (select item_id, {_words(_PLAIN)} as w from benchmark),
k as (select distinct least(len(w), 5) as k from b where len(w) > 0),
bs as (select distinct item_id, least(len(w), 5) as k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i+least(len(w), 5)-1], ' '))) as s from b where len(w) > 0),
d as (select doc_id, {_words(_PLAIN)} as w from documents),
ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) as s from d, k where len(w) >= k),
n as (select item_id, count(*) as n from bs group by 1)
select doc_id, item_id, count(*) as n_shared, n as n_item, count(*)::double / n as containment
from ds join bs on ds.s = bs.s and ds.k = bs.k join n using (item_id) group by doc_id, item_id, n having count(*) >= 0.8 * n"""


def _spans(kind: str, rank: int, pattern: str, kept: str) -> str:
    """Positions from the pieces between matches: a match starts after as many pieces and the matches before it."""
    return f"""
  select doc_id, {rank} as rank, '{kind}' as kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s, length(m[i]) as n
  from (select doc_id, m, p, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as p from d where regexp_matches(text, '{pattern}'))) where {kept}"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
OP8 = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as ({_spans("assign", 0, _ASSIGN, f"length(regexp_extract(m[i], '{_ASSIGN}', 2)) >= 8")}
  union all {_spans("access", 1, "AKIA[A-Z0-9]+", "length(m[i]) >= 16")}
  union all {_spans("hex", 2, "[0-9a-f]{32,}", "true")}
  union all {_spans("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true")}
  union all {_spans("jwt", 4, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "true")}),
g as (select doc_id, count(*) filter (where rank = 0) as a, count(*) filter (where rank = 1) as b, count(*) filter (where rank = 2) as c,
  string_agg(concat(kind, ':', s, ':', s + n), ',' order by s, rank) filter (where rank < 3) as base, string_agg(concat(kind, ':', s, ':', s + n), ',' order by s, rank) as spans from f group by 1)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""

OP11 = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
r as (select doc_id, text, length(text) as n, list_transform([0, 1, 2, 3], lambda k: cast('0x' || substr(h, 8 * k + 1, 8) as ubigint)) as h from d),
c as (select doc_id, text, n, cast(least(h[1] % (n + 1), h[2] % (n + 1)) as bigint) as a, cast(greatest(h[1] % (n + 1), h[2] % (n + 1)) as bigint) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p"""

OP12 = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by lang, term having count(distinct row) >= 30),
c as (select lang, source, term, count(*) as n from w group by all),
g as (select distinct lang, source from d),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (cast(1000000000 as hugeint) * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) as p from s),
q as (select lang, term, 1 + (cast(1000000000 as hugeint) * (n + 5)) // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang)) as q from k),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
u as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from u where part = 'pair' or rank <= 50"""

SQL = {"op3_chat_format": OP3, "op4_ngram_join": OP4, "op5_decontamination": OP5, "op8_secret_scans": OP8, "op11_fill_in_middle": OP11, "op12_source_divergence": OP12}
