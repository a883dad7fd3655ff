"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP9 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
iw as (select distinct item_id, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') as w, least(10, len(ws)) as n
       from b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as t(k) where len(ws) > 0),
ns as (select distinct n from iw),
dw as (select r, n, k, array_to_string(ws[k:k + n - 1], ' ') as w from d, ns, unnest(range(1, len(ws) - n + 2)) as t(k) where len(ws) >= n),
f as (select r, k, dw.n, item_id from dw join iw on dw.w = iw.w and dw.n = iw.n),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from f) group by r),
i as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as ids from f group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join i using (r)
"""

OP1 = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
g as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
      where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
ok as (select * from g where n > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from c left join n using (vec_id)
"""

OP3 = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[k:k + 4], ' ') as g from w, unnest(range(1, greatest(len(ws) - 3, 2))) as t(k) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from i join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= 80 * (na.n + nb.n - c)),
l as (select a, b from e union all select b, a from e),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id
from w left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) using (doc_id)
"""

#: Levels of the path tree that the SQL spells out; no path of the tables has more segments.
_LEVELS = 6


def _op5() -> str:
    down = "".join(
        f"""v{d} as (select host, p, count(*) as kids, sum(n) as n from (select host, t[1:{d}] as p, t[{d + 1}] as seg, sum(n) as n from g{d} where len(t) > {d} group by all) group by all having count(*) > 20 and sum(n) < 3.0 * count(*)),
g{d + 1} as (select g.host, masked, g.n, labelled, bad, case when v.kids is null then t else list_concat(list_concat(t[1:{d}], ['*']), t[{d + 2}:]) end as t
       from g{d} g left join v{d} v on g.host = v.host and v.p = g.t[1:{d}] and len(g.t) > {d}),
"""
        for d in range(_LEVELS)
    )
    up = "".join(
        f"""h{d} as (select host, t[1:{d}] as c, sum(labelled) as l, sum(bad) as b from s{d} where done = 0 and up in ({d}, {d - 1}) group by all),
q{d} as (select host, c[1:{d - 1}] as p, sum(l) as al, sum(b) as ab from h{d} group by all),
a{d} as (select h.host, h.c from h{d} h join q{d} q on h.host = q.host and q.p = h.c[1:{d - 1}] where al > 0 and l > 0 and abs(b - l * (ab / al)) > 1.96 * sqrt(l * (ab / al) * (1 - ab / al))),
s{d - 1} as (select s.host, t, labelled, bad, case when a.c is null and up = {d} and done = 0 then {d - 1} else up end as up, case when a.c is not null then {d} else done end as done
       from s{d} s left join a{d} a on s.host = a.host and a.c = s.t[1:{d}] and s.done = 0 and s.up in ({d}, {d - 1})),
"""
        for d in range(_LEVELS, 0, -1)
    )
    return rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
r(verdict, h, s) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
k as (select distinct host, path from p),
best as (select host, path, arg_max(h || s, length(h || s)) as rule, arg_max(verdict, length(h || s)) as ruled
         from k join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by host, path),
j as (select p.*, rule, ruled,
             array_to_string(list_transform(str_split(path, '/'), lambda x, i: case when i > 1 then
               regexp_replace(x, '^([0-9]+|[0-9a-fA-F]{{16,}}|[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}})([.]|$)', '*\3') else x end), '/') as masked
      from p left join best using (host, path)),
g0 as (select host, masked, count(*) as n, count(ruled) as labelled, count(*) filter (where ruled = 'block') as bad, str_split(masked, '/') as t from j group by all),
{down}s{_LEVELS} as (select host, t, sum(labelled) as labelled, sum(bad) as bad, len(t) as up, 0 as done from g{_LEVELS} group by all),
{up}m as (select host, t[1:up] as node, done, sum(labelled) as bl, sum(bad) as bb from s0 group by all),
hs as (select host, sum(labelled) as hl, sum(bad) as hb from s0 group by all),
o as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(labelled), 0) + 2) as overall from s0),
jb as (select host, node, done, (bb + 5.0 * ((hb + 5.0 * overall) / (hl + 5.0))) / (bl + 5.0) >= 0.8 and bl > 0 as rejected from m join hs using (host), o)
select page_id, j.host, path, rule, coalesce(ruled, case when rejected then 'block' else 'allow' end) as verdict, array_to_string(g.t, '/') as template
from j join g{_LEVELS} g using (host, masked) join s0 on s0.host = j.host and s0.t = g.t join jb on jb.host = j.host and jb.node = s0.t[1:s0.up] and jb.done = s0.done
"""


OP5 = _op5()



def _op13(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def coded(at: int) -> str:
        return f"""a{at} as (select r, part, arg_min(e, (d, e)) as e, min(d) as d from (
  select p.r, p.part, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from p join c{at} c using (part)) group by r, part),
"""

    steps = "".join(
        coded(k)
        + f"""m{k} as (select part, e, list(x order by i) as v from (
  select part, e, i, cast(floor(sum(v[i]) / count(*)) as bigint) as x from p join a{k} using (r, part), unnest(range(1, len(v) + 1)) as t(i) group by part, e, i) group by part, e),
c{k + 1} as (select c.part, c.e, coalesce(m.v, c.v) as v from c{k} c left join m{k} m using (part, e)),
"""
        for k in range(rounds)
    )
    return f"""
with k as (select row_number() over () as r, vec_id, label, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as q from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select r, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] as v from k, unnest(range({parts})) as t(part)),
s as (select r, row_number() over (order by vec_id, q) - 1 as e from k qualify e < {entries}),
c0 as (select part, e, v from s join p using (r)),
{steps}{coded(rounds)}h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, e)) as codebooks_sha256 from c{rounds}),
o as (select r, lower(string_agg(printf('%02x', e), '' order by part)) as code, cast(sum(d) as bigint) as error from a{rounds} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join o using (r), h
"""


OP13 = _op13()

OP11 = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as q from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
      from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a as anchor_id, p.b as positive_id, cast(row_number() over (partition by p.a, p.b order by s.score desc, s.b) as integer) as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
      from p join s on p.a = s.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select * from n where rank <= 3
"""

ORACLE: dict[str, str] = {
    "op1_embedding_dedup": OP1,
    "op3_ngram_jaccard": OP3,
    "op5_url_filter": OP5,
    "op9_decontaminate": OP9,
    "op11_hard_negatives": OP11,
    "op13_vector_codes": OP13,
}
