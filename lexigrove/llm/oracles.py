"""DuckDB SQL for the rows of the queries that SQL can express."""

OP2 = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as k
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as place from s0),
s2 as (select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s1),
s3 as (select *, 3 * source_size as lim, (3 * source_size) / weight as ratio from s2),
s4 as (select *, (sum(source_size) over () - coalesce(sum(lim) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0))::double
                 / sum(weight) over (order by ratio, place rows between current row and unbounded following) as lev from s3),
s as (select *, least(lim::double, weight * max(case when lev <= ratio then lev end) over ()) as target from s4),
c as (select d.doc_id, d.size, d.k, s.source_size, s.weight, s.target,
             sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows unbounded preceding) as cum
      from d join s on d.source is not distinct from s.source),
q as (select c.*, p, (p * source_size + cum)::double / weight as fin from c, (values (0), (1), (2)) as t(p) where size > 0),
r as (select *, sum(size) over (order by fin, k, doc_id, size, p rows unbounded preceding) as upto from q),
t as (select doc_id, size, cast(sum(case when upto <= (select sum(size) from d) then size else 0 end) as bigint) as taken from r group by doc_id, size)
select c.doc_id, c.size, c.source_size, c.target, coalesce(t.taken, 0) as taken
from c left join t on c.doc_id is not distinct from t.doc_id and c.size = t.size
"""

OP4 = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
k as (select doc_id, n, k, substring(x, 2000 * k + 1, 2098) as piece from (select doc_id, x, n, unnest(range(0, (n + 999) // 1000)) as k from d)),
b as (select doc_id, n, 1000 * k + j as i, j, piece from (select *, unnest(range(0, least(1000, n - 1000 * k))) as j from k)),
w as (select doc_id, i, substring(piece, 2 * j + 1, 2) as byte, case when i <= n - 50 then substring(piece, 2 * j + 1, 100) end as win from b),
m as (select doc_id, i, byte, win is not null and min(doc_id) over (partition by win) < doc_id as again from w),
g as (select doc_id, i, byte, bool_or(again) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from m),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as begins from g),
a as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_spans, coalesce(string_agg(byte, '' order by i) filter (not gone), '') as kept from s group by doc_id)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join a using (doc_id)
"""

OP7 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
both_ as (select x, y from e union all select y, x from e),
r as (select x, y from both_ union select r.x, b.y from r join both_ b on r.y = b.x),
c as (select x, min(y) as least_ from r group by x)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(least_, w.doc_id)) as component_id, least(w.doc_id, coalesce(least_, w.doc_id)) = w.doc_id as kept
from w left join n using (doc_id) left join c on c.x = w.doc_id
"""

OP6 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') as erole,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as etext,
         contains(text, '<|im_start|>') or contains(text, '<|im_end|>') or regexp_matches(text, '<\\+\|') as clash
  from t),
c as (
  select conv_id, count(*) as n_turns, bool_or(clash) as esc,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
         string_agg('<|im_start|>' || erole || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) as plain,
         string_agg('<|im_start|>' || erole || chr(10) || etext || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) as safe
  from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       length(case when esc then safe else plain end) as formatted_chars
from c
"""

OP10 = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from d group by body)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.body) as text_sha256
from d join g using (body)
"""

OP12 = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as alike, cast(list_inner_product(a.v, r.v) as bigint) as score
      from e a join e r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
"""

OP13 = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
x as (select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from x),
c as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from c
"""


def _op3() -> str:
    from lexigrove.llm.license_scan import LOWER, NOTICES, PHRASES, UPPER

    rows = []
    for base, table in (("true", PHRASES), ("false", NOTICES)):
        for text, label in table.items():
            w = text.split()
            rows += [f"('{text}', '{label}', {base}, {len(w) - 2}, {i}, '{w[i]}', '{w[i + 1]}', '{w[i + 2]}')" for i in range(len(w) - 2)]
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
g as (select doc_id, i - 1 as pos, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
t(template, label, base, need, place, a, b, c) as (values {", ".join(rows)}),
d as (select doc_id, template, label, base, need, pos - place as diagonal, list(distinct place) as places from g join t using (a, b, c) group by all),
n as (select *, case when diagonal - lag(diagonal) over o <= 2 and len(places) < need and coalesce(len(lag(places) over o) < need, true) then 0 else 1 end as begins from d window o as (partition by doc_id, template order by diagonal)),
s as (select *, sum(begins) over (partition by doc_id, template order by diagonal) as span from n),
x as (select doc_id, template, label, base, need, span, len(list_distinct(flatten(list(places))))::double / need as score, min(diagonal) as lo, max(len(places)) as best from s group by doc_id, template, label, base, need, span having score >= 0.6),
f as (select doc_id, count(*) filter (base and best = need) as n_base, min(lo) filter (base and best = need) as first_word, max(lo) filter (base and best = need) as last_word,
        string_agg(distinct label, ',' order by label) filter (base and best = need) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score from x group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0::double) as score
from w left join f using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": _op3(), "op2_source_mix": OP2, "op4_substring_dedup": OP4, "op6_chat_format": OP6, "op7_near_dedup": OP7, "op10_exact_dedup": OP10, "op12_hard_negatives": OP12, "op13_fill_middle": OP13}
