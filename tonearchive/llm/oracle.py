"""SQL of the numbered queries that SQL can express."""

from __future__ import annotations

import re

from .secret_scan import ACCESS, ASSIGN, ENDPOINT, HEX, SCOPE, SHORT_ID, SHORT_SECRET

EMBEDDING = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) as n from links group by a), m as (select a, min(b) as m from reach group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, coalesce(vec_id = least(vec_id, coalesce(m, vec_id)), false) as kept
from v left join n on n.a = vec_id left join m on m.a = vec_id
"""

SUBSTRING = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
k as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as words from win),
f as (select words, min(doc_id) as first from k group by words),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as at from k join f using (words) where first < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as at from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.at) as kept, count(*) as n from words left join gone on gone.doc_id = words.doc_id and gone.at = words.at where gone.at is null group by 1)
select d.doc_id, len(w) as n_words, len(w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id
"""


def _any_case(pattern: str) -> str:
    """Groups that ignore case, written out letter by letter: ASCII letters alone."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub(r"[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)


def _quoted(pattern: str) -> str:
    return "'" + _any_case(pattern).replace("'", "''") + "'"


def _found(name: str, rank: int, pattern: str, group: int, least: int, source: str = "d") -> str:
    p = _quoted(pattern)
    return f"""{name}_m as (select doc_id, regexp_extract_all(t, {p}, 0) as m, regexp_extract_all(t, {p}, {group}) as g, string_split_regex(t, {p}) as gaps from {source} where regexp_matches(t, {p})),
{name}_i as (select *, unnest(range(1, len(m) + 1)) as i from {name}_m),
{name} as (select doc_id, {rank} as rank, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as a, length(m[i]) as size from {name}_i where length(g[i]) >= {least})"""


_KINDS = "['assign', 'access', 'hex', 'id', 'secret', 'endpoint']"
_NEAR = f"o.a - (w.a + w.size) <= {SCOPE} and w.a - (o.a + o.size) <= {SCOPE}"
_META = lambda role: f"exists (select 1 from parts o where o.doc_id = w.doc_id and o.role = '{role}' and {_NEAR})"
SECRETS = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
{_found("assign", 0, ASSIGN, 1, 12)},
{_found("access", 1, ACCESS, 1, 18)},
{_found("hex", 2, HEX, 1, 16)},
strong as (select * from assign union all select * from access union all select * from hex),
wd as (select * from d where regexp_matches(t, {_quoted(f"{ACCESS}|{SHORT_ID}")})),
{_found("id", 3, SHORT_ID, 0, 1, "wd")},
{_found("secret", 4, SHORT_SECRET, 0, 1, "wd")},
{_found("endpoint", 5, ENDPOINT, 0, 1, "wd")},
loose as (select * from id union all select * from secret union all select * from endpoint),
weak as (select * from loose w where not exists (select 1 from strong o where o.doc_id = w.doc_id and w.a < o.a + o.size and o.a < w.a + w.size)),
parts as (select *, case when rank in (1, 3) then 'id' when rank = 5 then 'endpoint' else 'secret' end as role from (select * from strong union all select * from weak)),
linked as (select doc_id, rank, a, size from parts w where rank > 2 and case role when 'id' then {_META("secret")} when 'secret' then {_META("id")} else {_META("id")} and {_META("secret")} end),
b as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, string_agg(({_KINDS})[rank + 1] || ':' || a || ':' || (a + size), ',' order by a, rank, size) as spans from strong group by 1),
s as (select doc_id, string_agg(({_KINDS})[rank + 1] || ':' || a || ':' || (a + size), ',' order by a, rank, size) as spans from (select * from strong union all select * from linked) group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.spans, '')) as base_sha256, coalesce(s.spans, '') as spans
from d left join b using (doc_id) left join s using (doc_id)
"""

DIVERGENCE = r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
o as (select doc, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from o group by 1, 2 having count(distinct doc) >= 10),
l as (select lang, count(*) as v, sum(n) as words from k group by 1),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by 1, 2, 3),
s as (select lang, source, sum(n) as words from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (coalesce(s.words, 0) + 2 * l.v))::bigint as p, (1 + 1000000000::hugeint * (k.n + 2) // (l.words + 2 * l.v))::bigint as q
    from g join k using (lang) join l using (lang) left join s using (lang, source) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(f.value, 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source left join f on f.lang = g.lang and f.source = g.source and f.item = h.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
"""

ORACLE_SQL = {"op11_divergence": DIVERGENCE, "op1_embedding": EMBEDDING, "op3_secrets": SECRETS, "op10_substring": SUBSTRING}
