"""SQL twins of the operators that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from .license_scan import ORACLE_SQL as LICENSE
from .quality_lines import BASE, PRIME, SALTS, TRIPLE, WORD_BYTES, Rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all(coalesce({}, ''), '[^ \\t-\\r]+')"


def embeddings(threshold: float = 0.93) -> str:
    return f"""
    with recursive good as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    unit as (select *, sqrt(list_dot_product(v, v)) as norm from good),
    links as (select a.vec_id as x, b.vec_id as y from unit a join unit b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
        where list_dot_product(a.v, b.v) / a.norm / b.norm >= {threshold}),
    reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join links l on r.y = l.x),
    component as (select x as vec_id, min(y) as component_id from reach group by x), degree as (select x as vec_id, count(*) as n from links group by x)
    select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join component using (vec_id) left join degree using (vec_id)
    """


def substrings(window: int = 13) -> str:
    key = " || ' ' || ".join(f"lead(w, {k}) over o" if k else "w" for k in range(window))
    return f"""
    with words as (select doc_id, {WORDS.format('text')} as ws from documents),
    w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from words),
    windows as (select doc_id, p, w, {key} as k from w window o as (partition by doc_id order by p)),
    firsts as (select k, min(doc_id) as first from windows where k is not null group by k),
    starts as (select doc_id, p, w, coalesce(first < doc_id, false) as gone from windows left join firsts using (k)),
    covered as (select doc_id, p, w, max(gone::int) over (partition by doc_id order by p rows between {window - 1} preceding and current row) as gone from starts),
    kept as (select doc_id, sum(gone)::bigint as n_removed, string_agg(case when gone = 0 then w end, ' ' order by p) as t from covered group by doc_id)
    select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from words left join kept using (doc_id)
    """


def quality(rules: Rules = Rules()) -> str:
    norm = f"translate(array_to_string({WORDS.format('line')}, ' '), '{_UPPER}', '{_LOWER}')"
    byte = "('0x' || substr(x, 2 * i + 1, 2))::bigint"
    value = f"(list_reduce(list_prepend(0::bigint, list_transform(range(0, least({WORD_BYTES}, len(x) // 2)), lambda i: {byte})), lambda a, c: (a * {BASE} + c) % {PRIME}) * {BASE} + len(x) // 2) % {PRIME}"
    triple = " + ".join(f"vs[i + {k}] * {m} % {PRIME}" for k, m in enumerate(TRIPLE))
    failed = f"(n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce('i' || doc_id, 't' || text, 't') as document, source, coalesce(text, '') as t, {WORDS.format('text')} as ws from documents),
    w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
    g as (select r, p, case when lead(w, 2) over o is not null then [w, lead(w) over o, lead(w, 2) over o] end as k from w window o as (partition by r order by p)),
    rep as (select r, p, k is not null and count(*) over (partition by r, k) > 1 as again from g),
    cov as (select r, max(again::int) over (partition by r order by p rows between 2 preceding and current row) as c from rep),
    nrep as (select r, sum(c)::bigint as n from cov group by r),
    lines as (select r, document, source, unnest(string_split(t, chr(10))) as line from d),
    full_ as (select r, document, source, line, array_to_string({WORDS.format('line')}, ' ') as raw, {norm} as l, len({WORDS.format('line')}) as n from lines where len({WORDS.format('line')}) > 0),
    dup as (select r, count(*) - count(distinct line) as n from full_ group by r),
    often as (select source, l, count(distinct document) as n from full_ group by source, l having count(distinct document) > {rules.max_docs}),
    held as (select distinct r from full_ f join often o on f.source is not distinct from o.source and f.l = o.l),
    own as (select distinct f.r, f.document, f.source, f.l from full_ f join held using (r)),
    texts as (select l, string_split(l, ' ') as ws from (select distinct l from own)),
    valued as (select l, list_transform(ws, lambda w: list_transform([hex(encode(w))], lambda x: {value})[1]) as vs from texts),
    triples as (select l, list_transform(range(1, len(vs) - 1), lambda i: ({triple}) % {PRIME}) as gs from valued),
    low as (select l, k, coalesce(list_min(list_transform(gs, lambda g: g * salt % {PRIME})), {PRIME}) as v from triples, (values {", ".join(f"({k}, {s}::bigint)" for k, s in enumerate(SALTS))}) s(k, salt)),
    ranked as (select r, document, source, l, k, v, min(v) over (partition by r, k) as v1, row_number() over (partition by r, k order by v) as at from own join low using (l)),
    rest as (select a.document, a.source, a.l, a.k, case when a.at > 1 then a.v1 else coalesce(b.v, {PRIME}) end as v from ranked a left join ranked b on a.r = b.r and a.k = b.k and b.at = 2),
    tops as (select o.source, o.l, o.n, k, v, count(distinct document) as c from rest x join often o on x.source is not distinct from o.source and x.l = o.l group by all),
    grouped as (select source, l, n, k, max(c) as c from tops group by all),
    common as (select source, l from grouped group by source, l, n having min(c) <= {rules.copy_share} * n),
    removed as (select r, sum(f.n)::bigint as n from full_ f join common c on f.source is not distinct from c.source and f.l = c.l group by r),
    all_ as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(nrep.n, 0)::bigint as n_repeat_words, coalesce(removed.n, 0)::bigint as n_template_words from d left join dup using (r) left join nrep using (r) left join removed using (r))
    select *, {failed} as base_failed, not {failed} and n_words - n_template_words >= {rules.min_left} * n_words as kept from all_
    """


ORACLES = {"op1_itq_dedup": embeddings(), "op3_substring_dedup": substrings(), "op4_license_scan": LICENSE, "op7_quality_lines": quality()}
