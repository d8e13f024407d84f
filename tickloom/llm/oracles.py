"""DuckDB SQL for the queries that SQL can express."""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null
), split as (
  select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from pieces
), sizes as (
  select lang, w, unnest(range(1, 6)) as size from split where len(w) > 0
), places as (
  select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from sizes where len(w) >= size
), f as materialized (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase, count(*) as f from places group by all
), totals as (
  select lang, cast(sum(f) as bigint) as n from f where size = 1 group by lang
), candidates as materialized (
  select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 100
), cuts as (
  select lang, phrase, a, w, size, unnest(range(1, size)) as k from candidates
), scored as (
  select c.lang, c.phrase, c.a, x.f as l, y.f as r, t.n, cast((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f) as bigint) as score, c.k
  from cuts c join totals t on t.lang = c.lang
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), starts as (
  select lang, a, w, size, unnest(range(1, size)) as i from candidates
), ends as (
  select lang, a, w, size, i, unnest(range(i + 1, size + 1)) as j from starts
), inside as (
  select lang, array_to_string(w[i : j], ' ') as phrase, max(a) as most from ends where j - i + 1 < size group by all
), ranked as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.n, b.score, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
  from best b left join inside s on s.lang = b.lang and s.phrase = b.phrase where s.most is null or 100 * s.most < 100 * b.a
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""


def _least(*of: str) -> str:
    out = of[0]
    for x in of[1:]:
        out = f"case when {x} < {out} then {x} else {out} end"
    return out


def _closed(inner: str, keys: str) -> str:
    """Three rounds of insertions over s0 .. s3, structs of (cost c, audit a, repaired lines t)."""

    def insert(q: int, role: str) -> str:
        return f"struct_pack(c := s{q}.c + 3, a := s{q}.a || 'I', t := s{q}.t || chr(10) || '{role}:')"

    for _ in range(3):
        for to, q, role in ((2, 0, "user"), (2, 1, "user"), (3, 2, "assistant"), (2, 3, "user")):
            columns = ", ".join(f"({_least(f's{k}', insert(q, role))}) as s{k}" if k == to else f"s{k}" for k in range(4))
            inner = f"select {keys}, {columns} from ({inner})"
    return inner


def _step() -> str:
    """One row on: D, K and R from each state."""

    def arc(q: int, letter: str, role: str, test: str) -> str:
        price = {"D": "4", "K": "3 * cut", "R": "3 + 3 * cut"}[letter]
        line = "" if letter == "D" else f" || chr(10) || {role} || ':' || text"
        return f"struct_pack(c := s{q}.c + case when {test} then {price} else 1000000000 end, a := s{q}.a || '{letter}', t := s{q}.t{line})"

    kept = "not gone and initial = "
    into = {
        0: [(0, "D", "", "true")],
        1: [(1, "D", "", "true"), (0, "K", "role", f"{kept}'s'")],
        2: [(2, "D", "", "true"), *((q, "K", "role", f"{kept}'u'") for q in (0, 1, 3)), *((q, "R", "'user'", "not gone") for q in (0, 1, 3))],
        3: [(3, "D", "", "true"), (2, "K", "role", f"{kept}'a'"), (2, "R", "'assistant'", "not gone")],
    }
    # the arcs first as columns, so that each is written once
    made = {(to, i): arc(*a) for to, arcs in into.items() for i, a in enumerate(arcs)}
    first = ", ".join(f"{sql} as a{to}_{i}" for (to, i), sql in made.items())
    inner = f"select p.conv, r.pos, {first} from path p join rows r on r.conv = p.conv and r.pos = p.pos + 1"
    return f"select conv, pos, {', '.join(f'({_least(*(f"a{to}_{i}" for i in range(len(arcs))))}) as s{to}' for to, arcs in into.items())} from ({inner})"


_START = "select conv, cast(0 as bigint) as pos, " + ", ".join(f"struct_pack(c := cast({0 if q == 0 else 1000000000} as bigint), a := '', t := '') as s{q}" for q in range(4)) + " from ids"

CONVERSATIONS = rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ascii(c) as bigint)) as bytes
  from conversations
), drawn as (
  select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y:
    list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295) % 20 as k
  from keyed
), damaged as (
  select conv_id as conv, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text, unnest(case when k = 3 then [1, 2] else [1] end) as copy
  from drawn where k <> 0
), numbered as (
  select coalesce(cast(conv as varchar), 'null') as conv, turn, role, text, row_number() over (partition by conv order by turn nulls first, role, text, copy) as pos from damaged
), marked as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv, role, text order by pos) > 1 as again,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') as open, left(role, 1) as initial
  from numbered
), rows as materialized (
  select conv, pos, turn, role, text, initial, blank, not blank and again as again, not blank and not again and open as truncated, blank or again as gone,
    case when not blank and not again and open then 1 else 0 end as cut, initial || coalesce(lead(initial) over (partition by conv order by pos), '-') as pair,
    lead(pos) over (partition by conv order by pos) is not null as followed
  from marked
), ids as (
  select distinct coalesce(cast(conv_id as varchar), 'null') as conv, conv_id from conversations
), path(conv, pos, s0, s1, s2, s3) as (
  {_closed(_START, 'conv, pos')}
  union all
  {_closed(_step(), 'conv, pos')}
), ends as (
  select conv, case when s0 < s3 then s0 else s3 end as best from path qualify row_number() over (partition by conv order by pos desc) = 1
), counted as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate,
    count(*) filter (truncated) as truncated, count(*) filter (followed and pair not in ('su', 'ua', 'au')) as illegal
  from rows group by conv
)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, e.best.c as cost, e.best.a as audit, sha256(substr(e.best.t, 2)) as repaired_sha256
from ids i join ends e on e.conv = i.conv left join counted c on c.conv = i.conv
"""

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

PASSAGES = rf"""
with texts as (
  select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents
), starts as (
  select doc_id, w, unnest(range(1, len(w) - 48)) as pos from texts where len(w) >= 50
), windows as (
  select doc_id, pos, array_to_string(w[pos : pos + 49], ' ') as words from starts
), repeats as materialized (
  select doc_id, pos from windows qualify min(doc_id) over (partition by words) < doc_id
), places as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from texts where len(w) > 0
), covered as (
  select p.doc_id, p.pos, p.word, coalesce(bool_or(r.pos is not null) over (partition by p.doc_id order by p.pos rows between 49 preceding and current row), false) as gone
  from places p left join repeats r on r.doc_id = p.doc_id and r.pos = p.pos
), kept as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (not gone), '') as kept from covered group by doc_id
)
select t.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from texts t left join kept k on k.doc_id = t.doc_id
"""

NEAR_COPIES = rf"""
with recursive texts as (
  select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), starts as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0
), sets as materialized (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle from starts
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as materialized (
  select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)
), ways as (
  select x, y from links union all select y, x from links
), reach(doc_id, least) as (
  select doc_id, doc_id from texts union select ways.y, reach.least from reach join ways on ways.x = reach.doc_id where reach.least < ways.y
)
select t.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id from texts t left join sizes s on s.doc_id = t.doc_id
join (select doc_id, min(least) as component_id from reach group by doc_id) r on r.doc_id = t.doc_id
"""

STRINGS = r"""
with texts as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), starts as (
  select doc_id, h, unnest(range(1, length(h) // 2 - 398)) as pos from texts where length(h) >= 800
), named as (
  select doc_id, pos, md5(substr(h, 2 * pos - 1, 800)) as name from starts
), repeats as materialized (
  select doc_id, pos from named qualify count(*) over (partition by name) > 1
), edges as (
  select doc_id, pos, pos > lag(pos, 1, -1000) over (partition by doc_id order by pos) + 400 as opens from repeats
), runs as (
  select doc_id, pos, sum(cast(opens as int)) over (partition by doc_id order by pos) as run from edges
), spans as (
  select doc_id, run, min(pos) as lo, max(pos) + 399 as hi from runs group by all
), gaps as (
  select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as before from spans
), kept as (
  select t.doc_id, count(*) as n_spans, sum(hi - lo + 1) as n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (lo - before - 1)), '' order by lo) || substr(any_value(h), 2 * max(hi) + 1) as kept
  from gaps g join texts t on t.doc_id = g.doc_id group by t.doc_id
)
select t.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id
"""
