"""Check SQL (DuckDB) of the queries that SQL can express."""

CHECKS: dict[str, str] = {}

#: Words of letters, digits and characters beyond ASCII, A-Z lower-cased.
_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

CHECKS["op3_benchmark_decontamination"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as r(i) where len(w) > 0
),
lengths as (select distinct n from win),
dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from d, lengths, unnest(range(1, len(w) - n + 2)) as r(i) where len(w) >= n
),
hit as (select doc_id, i, win.n, item_id from dw join win using (n, win)),
covered as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + n)) as r(p) group by 1),
items as (
  select doc_id, count(distinct item_id) as n_items,
    sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256
  from hit group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

CHECKS["op10_line_dedup"] = """
with l as (
  select doc_id, text, i as place, string_split(text, chr(10))[i] as line,
    len(list_filter(string_split_regex(string_split(text, chr(10))[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words
  from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as r(i)
),
w as (select *, row_number() over (partition by doc_id order by place) as k from l where words > 0),
s as (
  select *, lead(line) over o as line2, lead(line, 2) over o as line3, lead(words) over o as words2,
    lead(place) over o as place2, lead(place, 2) over o as place3
  from w window o as (partition by doc_id order by k)
),
win as (
  select doc_id, k, [line] as win, [place] as places from s where words >= 50
  union all select doc_id, k, [line, line2], [place, place2] from s where words + words2 >= 50
  union all select doc_id, k, [line, line2, line3], [place, place2, place3] from s where line3 is not null
),
ranked as (select *, row_number() over (partition by win order by doc_id, k) as nth from win),
gone as (select distinct doc_id, unnest(places) as place from ranked where nth > 1),
kept as (
  select l.doc_id, count(g.place) as n_removed,
    coalesce(string_agg(line, chr(10) order by l.place) filter (g.place is null), '') as text
  from l left join gone g on l.doc_id = g.doc_id and l.place = g.place group by 1
)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines,
  coalesce(n_removed, 0)::bigint as n_removed, kept.text
from documents d left join kept using (doc_id)
"""

_SPACED = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

CHECKS["op7_url_filter"] = """
with rules(key, verdict) as (values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
  ('net/es/', 'block'), ('net/fr/', 'block')),
r as (select *, split_part(key, '/', 1) as rule_host, substr(key, instr(key, '/')) as rule_path from rules),
p as (
  select row_number() over () as id, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
),
h as (
  select id, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
),
fits as (
  select id, arg_max(key, len(key)) as rule, arg_max(verdict, len(key)) as verdict
  from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(verdict, case when regexp_matches(host,
  '(^|\\.)(ads-track\\.example\\.com|spam-farm\\.example\\.org|casino-win\\.example\\.net|adult-x\\.example\\.com|cheap-pills\\.example\\.net|free-bets\\.example\\.net)$')
  and starts_with(path, '/') then 'block' end, 'allow') as verdict
from h left join fits using (id)
"""

CHECKS["op8_lm_scores"] = f"""
with d as materialized (select row_number() over () as id, doc_id, {_SPACED.format('text')} as w from documents),
t as materialized (
  select id, i, list_prepend(' ', w)[i - 1] as u, list_prepend(' ', w)[i] as v, w[i] as w
  from d, unnest(range(1, len(w) + 1)) as r(i)
),
c3 as (select u, v, w, count(*) as n3 from t where i > 1 group by all having count(*) >= 2),
c2 as (select v, w, count(*) as n2 from t group by all having count(*) >= 2),
c1 as (select w, count(*) as n1 from t group by all),
s as (
  select t.id, avg(case when n3 is not null then ln(n3 / ctx.n2) when c2.n2 is not null
    then ln(c2.n2 / case when t.v = ' ' then (select count(distinct id) from t) else one.n1 end) + case when i > 1 then ln(0.4) else 0 end
    else ln(c1.n1 / (select count(*) from t)) + least(i, 2) * ln(0.4) end) as score
  from t join c1 on c1.w = t.w left join c2 on c2.v = t.v and c2.w = t.w left join c3 on c3.u = t.u and c3.v = t.v and c3.w = t.w and t.i > 1
    left join c2 ctx on ctx.v = t.u and ctx.w = t.v and t.i > 1 left join c1 one on one.w = t.v
  group by t.id
)
select doc_id, len(w)::bigint as n_words, round(score, 6) as score from d left join s using (id)
"""


def _clustering(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Rounds as one table each; the last has only distances."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
near{turn} as materialized (
  select row_id, vec_id, p, c, x, list_sum(list_transform(range(1, {dims + 1}), lambda i: (p[i] - x[i]) * (p[i] - x[i]))) as d
  from v, c{turn}
),
a{turn} as materialized (select row_id, any_value(vec_id) as vec_id, any_value(p) as p, arg_min(c, d * {k} + c) as c, min(d) as d
  from near{turn} group by row_id)""")
        if turn < rounds:
            steps.append(f"""
m{turn} as (
  select c, list(m order by i) as x from (
    select c, i, floor_div(sum(p[i]), count(*)) as m from a{turn}, unnest(range(1, {dims + 1})) as r(i) group by c, i
  ) group by c
),
c{turn + 1} as materialized (select c, coalesce(m{turn}.x, c{turn}.x) as x from c{turn} left join m{turn} using (c))""")
    floor = "cast(({0}) // ({1}) as bigint) - case when ({0}) < 0 and ({0}) % ({1}) <> 0 then 1 else 0 end"
    body = ",".join(steps).replace("floor_div(sum(p[i]), count(*))", floor.format("sum(p[i])", "count(*)"))
    return f"""
with v as materialized (
  select row_number() over () as row_id, vec_id, list_transform(embedding, lambda e: cast(floor(cast(e as double) * 1024) as bigint)) as p
  from embeddings where len(embedding) = {dims}
    and len(list_filter(embedding, lambda e: e is not null and not isnan(e) and not isinf(e))) = {dims}
),
c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, p as x from v order by sha256('3:' || vec_id) limit {k}
),{body}
select vec_id, cast(a.c as integer) as cluster, cast(d as bigint) as distance,
  cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} using (c)
"""


CHECKS["op11_centroid_clustering"] = _clustering()

CHECKS["op12_phrase_mining"] = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
w as materialized (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
one as materialized (select lang, word, count(*) as f from (select lang, unnest(w) as word from w) group by all),
total as (select lang, sum(f) as n from one group by lang),
grams as materialized (
  select lang, 1 as size, word as phrase, f from one where f >= 30
  union all select * from (""" + " union all ".join(
    f"select lang, {n} as size, array_to_string(w[i:i + {n - 1}], ' ') as phrase, count(*) as f from w, "
    f"unnest(range(1, len(w) - {n} + 2)) as r(i) group by all having count(*) >= 30" for n in (2, 3, 4)
) + """)
),
cuts as (
  select lang, phrase, size, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as x,
    array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') as y
  from grams, unnest(range(1, size)) as r(k) where size > 1
),
scored as (
  select c.lang, c.phrase, a, x.f as l, y.f as r, cast(2000000 * a::hugeint // (x.f + y.f) as bigint) as score,
    row_number() over (partition by c.lang, c.phrase order by 2000000 * a::hugeint // (x.f + y.f), k) as nth
  from cuts c join grams x on x.lang = c.lang and x.phrase = c.x join grams y on y.lang = c.lang and y.phrase = c.y
),
inside as (
  select lang, phrase, max(f) as longer from (
    select lang, f, array_to_string(string_split(phrase, ' ')[i:i + n - 1], ' ') as phrase
    from grams, unnest(range(2, 4)) as s(n), unnest(range(1, 4)) as r(i) where n < size and i + n - 1 <= size
  ) group by all
),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank, s.phrase, a, l, r, n, score
  from scored s join total t on t.lang = s.lang left join inside i on i.lang = s.lang and i.phrase = s.phrase
  where nth = 1 and (longer is null or 100 * longer < 80 * a)
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked where rank <= 2000
"""
