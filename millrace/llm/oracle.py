"""DuckDB SQL for the queries whose results SQL can say."""

from __future__ import annotations

from millrace.llm.secrets import BASE, MORE, Rule


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(r: Rule) -> str:
    """List of (start, end) of a rule's matches: what a split leaves between them gives their places."""
    pattern = _quoted(("(?i)" if r.any_case else "") + r.pattern)
    measured = f"regexp_extract_all(t, {pattern}, {r.group})" if r.group else "w"
    return f"""m_{r.kind} as (select rowid, w, {measured} as g, s from (select rowid, t, regexp_extract_all(t, {pattern}) as w, string_split_regex(t, {pattern}) as s from d)),
    e_{r.kind} as (select rowid, unnest(range(1, len(w) + 1)) as i, w, g, s from m_{r.kind}),
    f_{r.kind} as (select rowid, (coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::bigint as a, length(w[i]) as n, length(g[i]) as k from e_{r.kind})"""


def secrets() -> str:
    rules = BASE + MORE
    all_ = " union all ".join(f"select rowid, {k} as o, '{r.kind}' as kind, a, a + n as b from f_{r.kind} where k >= {max(r.least, 1)}" for k, r in enumerate(rules))
    text = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, o){}, '')"
    base = f" filter (where o < {len(BASE)})"
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    return f"""with d as (select row_number() over () as rowid, doc_id, coalesce(text, '') as t from documents), {", ".join(map(_rule, rules))}, x as ({all_})
    select d.doc_id, {counts}, sha256({text.format(base)}) as base_sha256, {text.format('')} as spans from d left join x using (rowid) group by d.rowid, d.doc_id"""


#: All pairs of one label, and the vectors that each reaches.
EMBEDDING_NEARDUP = """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
    where embedding is not null and label is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, r) as (select vec_id, vec_id from embeddings union select p.b, reach.r from reach join p on p.a = reach.vec_id),
c as (select vec_id, min(r) as component_id from reach group by vec_id), n as (select a as vec_id, count(*) as n_links from p group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)"""

#: The exact neighbours; the operator's search is approximate, and exact on tables of a few blocks.
ANN = """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
    where embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 20"""
