"""DuckDB SQL that gives the rows of those operators that SQL can express."""

from __future__ import annotations

from .mixing import KEY_BITS, MAX_EPOCHS, SEED, WEIGHTS
from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, WINDOW

WORD = r"[^\x20\x09-\x0D]+"


def _rule_sql(rule) -> str:
    value = f"{rule.numerator}::double" + (f" / nullif({rule.denominator}, 0)" if rule.denominator else "")
    checks = [f"{value} >= {float(rule.low)}"] if rule.low is not None else []
    checks += [f"{value} <= {float(rule.high)}"] if rule.high is not None else []
    return f"coalesce({' and '.join(checks)}, true)"


def quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l
  from documents
), win as (
  select doc_id, i, list_slice(w, i, i + {WINDOW - 1}) as x
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)
), dup as (
  select doc_id, i from win qualify count(*) over (partition by doc_id, x) > 1
), cov as (
  select doc_id, sum(g)::bigint as n from (
    select doc_id, least({WINDOW}, coalesce(lead(i) over (partition by doc_id order by i) - i, {WINDOW})) as g from dup
  ) group by doc_id
), m as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
         len(l)::bigint as n_lines, len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words
  from d left join cov on cov.doc_id = d.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} as base_failed,
       not {failed} and {" and ".join(_rule_sql(r) for r in RULES)} as kept, n_lines, n_stop_words
from m"""


def mixing_sql() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
         ('0x' || substr(md5('{SEED}' || coalesce(doc_id::varchar, '')), 1, {KEY_BITS // 4}))::bigint as k,
         ('0x' || substr(md5(coalesce(text, '')), 1, {KEY_BITS // 4}))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), r as (
  select *, ([{weights}])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as weight,
         sum(source_size) over () as everything
  from s
), o as (
  select *, row_number() over w as i,
         (everything - coalesce(sum({MAX_EPOCHS} * source_size) over (w rows between unbounded preceding and 1 preceding), 0))::double as rest,
         (sum(weight) over (w rows between current row and unbounded following))::double as total
  from r window w as (order by source_size / weight, source nulls last)
), f as (
  select min(i) as i from o where not {MAX_EPOCHS} * source_size <= rest / total * weight
), t as (
  select source, source_size,
         case when (select i from f) is null or o.i < (select i from f) then ({MAX_EPOCHS} * source_size)::double
              else (select rest / total from o join f using (i)) * weight end as target
  from o
), b as (
  select *, floor(target + 0.5)::bigint as budget,
         case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as epochs
  from t
), c as (
  select d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget,
         coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls first, d.size, d.h rows between unbounded preceding and 1 preceding), 0) as before
  from d join b on d.source is not distinct from b.source
)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from c"""


TOP_PRODUCTS_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n, q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score
  from v q join v on v.n <> q.n where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by n order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5"""


EMBEDDING_NEAR_DEDUP_SQL = """
with recursive e as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings
), good as (
  select n, vec_id, x, sqrt(list_inner_product(x, x)) as size from e
  where len(x) > 0 and len(list_filter(x, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(x, lambda v: v <> 0)) > 0
), link as (
  select a.n as a, b.n as b from good a join good b on a.n <> b.n where list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.9
), reach as (
  select n as a, n as b from e union select r.a, l.b from reach r join link l on r.b = l.a
), top as (
  select r.a as n, min(e.vec_id) as component_id from reach r join e on e.n = r.b group by r.a
), k as (
  select a as n, count(*) as n_links from link group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from e join top using (n) left join k using (n)"""


LEXICAL_SEARCH_SQL = r"""
with word as (
  select doc_id, n as row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as n, doc_id, text from documents)
), tf as (
  select row, any_value(doc_id) as doc_id, term, count(*) as tf from word group by row, term
), size as (
  select row, sum(tf)::bigint as n from tf group by row
), total as (
  select count(*) as docs, sum(n)::bigint as len from size
), weight as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term
), asked as (
  select n as item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as n, item_id, text from benchmark)
), norm as (
  select row, 75 + (25 * n * docs) // len as m from size, total
), scored as (
  select item, any_value(item_id) as item_id, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join weight using (term) join tf using (term) join norm using (row)
  group by item, row
)
select item_id, row_number() over (partition by item order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20"""


HARD_NEGATIVES_SQL = """
with v as (
  select row_number() over () as n, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as x
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.n, a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_inner_product(a.x, v.x)::bigint as score
  from v a join v on v.n <> a.n where a.vec_id % 50 = 0
), p as (
  select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id) as place
  from s where same qualify place <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.n, p.place order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.n = p.n and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3"""
