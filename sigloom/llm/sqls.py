"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Product codes: each round assigns every part to its nearest entry and replaces the entries that have parts."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (
  select x.rid, x.part, min(({_squares()}) * {entries} + b.entry) as best
  from part_of x join book{r} b on b.part = x.part group by 1, 2)""")
        if r < rounds:
            steps.append(f"""sum{r} as (
  select n.part, n.best % {entries} as entry, u.pos, sum(x.xs[u.pos]) as s, count(*) as c
  from near{r} n join part_of x using (rid, part), (select unnest(range(1, 17)) as pos) u group by 1, 2, 3)""")
            floored = "cast((s - (((s % c) + c) % c)) // c as bigint)"
            steps.append(f"""new{r} as (select part, entry, list({floored} order by pos) as xs from sum{r} group by 1, 2)""")
            steps.append(f"""book{r + 1} as materialized (
  select b.part, b.entry, coalesce(n.xs, b.xs) as xs from book{r} b left join new{r} n on n.part = b.part and n.entry = b.entry)""")
    last = f"near{rounds}"
    return f"""
with kept as (
  select row_number() over (order by vec_id) - 1 as rid, vec_id, label,
         list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as xs
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part_of as materialized (
  select rid, p.part, xs[p.part * 16 + 1 : p.part * 16 + 16] as xs from kept, (select unnest(range({parts})) as part) p),
book0 as materialized (select part, rid as entry, xs from part_of where rid < {entries}),
{", ".join(steps)},
sha as (
  select sha256(string_agg(array_to_string(xs, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds}),
coded as (
  select rid, string_agg(printf('%02x', best % {entries}), '' order by part) as code, cast(sum(best // {entries}) as bigint) as error
  from {last} group by 1)
select k.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, s.codebooks_sha256
from kept k join coded c using (rid), sha s"""


def _squares(dim: int = 16) -> str:
    return " + ".join(f"(x.xs[{i}] - b.xs[{i}]) * (x.xs[{i}] - b.xs[{i}])" for i in range(1, dim + 1))


CODES = _codes()

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexed: str) -> str:
    """Base32 of 40 hex digits: five hex digits make four of base32."""
    four = " || ".join(f"substr('{BASE32}', (v >> {shift}) % 32 + 1, 1)" for shift in (15, 10, 5, 0))
    return f"array_to_string(list_transform(list_transform(range(8), lambda i: cast('0x' || substr({hexed}, 5 * i + 1, 5) as integer)), lambda v: {four}), '')"


CAPTURES = f"""
with read as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hexed from pages),
heads as (
  select *, row_number() over (partition by hexed order by page_id) as place, min(page_id) over (partition by hexed) as head from read)
select page_id, cast(strlen(html) as bigint) as payload_bytes, {_base32("hexed")} as payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type, case when place > 1 then head end as refers_to
from heads"""

PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as materialized (
  select lang, ws from (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces) where len(ws) > 0),
grams as (
  select lang, m, array_to_string(ws[i : i + m - 1], ' ') as phrase, ws[i : i + m - 1] as p
  from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i
        from words, (select unnest(range(1, 5)) as m) where len(ws) >= m)),
f as materialized (select lang, m, phrase, any_value(p) as p, count(*) as a from grams group by 1, 2, 3 having count(*) >= 30),
totals as (select lang, sum(len(ws)) as n from words group by 1),
cuts as (
  select c.lang, c.phrase, c.a, l.a as l, r.a as r, k, cast((2000000::hugeint * c.a) // (l.a::hugeint + r.a) as bigint) as score
  from (select *, unnest(range(1, m)) as k from f where m > 1) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.p[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.p[k + 1 :], ' ')),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts) where place = 1),
inside as (
  select distinct lang, phrase from (
    select c.lang, array_to_string(c.p[i : i + s - 1], ' ') as phrase, c.a
    from (select *, unnest(range(1, m - s + 2)) as i from (select *, unnest(range(2, m)) as s from f where m > 2)) c) x
  join f y using (lang, phrase) where 100::hugeint * x.a >= 80::hugeint * y.a),
placed as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score
  from lowest anti join inside using (lang, phrase))
select p.lang, p.rank, p.phrase, p.a, p.l, p.r, cast(t.n as bigint) as n, p.score
from placed p join totals t using (lang) where rank <= 2000"""
