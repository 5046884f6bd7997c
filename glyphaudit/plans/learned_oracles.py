"""The learned code-page model (``operators.code_pages``) as plain SQL (DuckDB dialect): its sample, its likelihoods and its choice."""

from __future__ import annotations

from ..functions.arrow import _decode
from ..functions.charsets import CODEC_OF
from ..functions.constants import SAMPLE_BYTES
from ..operators.code_pages import PRIOR, ROWS, SHARE, UNIT
from .fixtures import ALPHABETS, KEPT, PAGES, scripted
from .page_oracles import CONTROL, LONG, NONE, _char, _forms, _pending, _points, _tables

MULTIPLE = ["shift_jis", "euc-jp", "euc-kr"]
FIRST = PAGES.index(MULTIPLE[0])   # the multi-byte pages come last
MASK = "18446744073709551615::uhugeint"
P1, P2, P3, P4, P5 = (f"{p}::uhugeint" for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SEED = 42


def _rotated(x: str, r: int) -> str:
    return f"((({x}) << {r} & {MASK}) | (({x}) >> {64 - r}))"


def _number(word: str, width: int) -> str:
    """A little-endian word given in hexadecimal."""
    digits = "||".join(f"substring({word},{2 * width - 1 - 2 * i},2)" for i in range(width))
    return f"('0x'||{digits})::ubigint::uhugeint"


def _lane(i: int) -> str:
    start = f"{(SEED + [int(P1[:-10]) + int(P2[:-10]), int(P2[:-10]), 0, -int(P1[:-10])][i]) % 2**64}::uhugeint"
    mixed = f"((a + ({_number('w', 8)} * {P2} & {MASK})) & {MASK})"
    return f"list_reduce(l[{i + 1}:n//32*4:4], lambda a, w: {_rotated(mixed, 31)} * {P1} & {MASK}, {start})"


def hashed(source: str, name: str) -> str:
    """CTEs from ``source`` (..., text) to ``name``: Spark's ``xxhash64(text)``, plus 2 ** 63 as an unsigned number, as ``h``."""
    merged = "h"
    for i in range(4):
        lane = f"({_rotated(f'(v{i} * {P2} & {MASK})', 31)} * {P1} & {MASK})"
        merged = f"((xor({merged}, {lane}) * {P1} & {MASK}) + {P4} & {MASK})"
    eight = f"xor(a, {_rotated(f'({_number(chr(119), 8)} * {P2} & {MASK})', 31)} * {P1} & {MASK})"
    four, one = f"xor(a, {_number('w', 4)} * {P1} & {MASK})", f"xor(a, {_number('w', 1)} * {P5} & {MASK})"
    return f"""{name}_words as (select *, octet_length(encode(text)) as n, hex(encode(text)) as hx from {source}),
 {name}_lanes as (select *, {', '.join(f"{_lane(i)} as v{i}" for i in range(4))} from (select *, case when n >= 32 then regexp_extract_all(hx, '.{{16}}') end as l from {name}_words)),
 {name}_merged as (select *, (case when n < 32 then {SEED} + {P5} else {merged} end + n::uhugeint) & {MASK} as h0, substring(hx, n//32*64 + 1) as tail
  from (select *, ({_rotated('v0', 1)} + {_rotated('v1', 7)} + {_rotated('v2', 12)} + {_rotated('v3', 18)}) & {MASK} as h from {name}_lanes)),
 {name}_eights as (select *, list_reduce(regexp_extract_all(tail, '.{{16}}'), lambda a, w: ({_rotated(eight, 27)} * {P1} & {MASK}) + {P4} & {MASK}, h0) as h8, substring(tail, n%32//8*16 + 1) as tail8 from {name}_merged),
 {name}_fours as (select *, list_reduce(regexp_extract_all(tail8, '^.{{8}}'), lambda a, w: ({_rotated(four, 23)} * {P2} & {MASK}) + {P3} & {MASK}, h8) as h4, substring(tail8, n%8//4*8 + 1) as tail4 from {name}_eights),
 {name}_ones as (select *, list_reduce(regexp_extract_all(tail4, '..'), lambda a, w: {_rotated(one, 11)} * {P1} & {MASK}, h4) as h1 from {name}_fours),
 {name}_mixed as (select *, xor(h2, h2 >> 29) * {P3} & {MASK} as h3 from (select *, xor(h1, h1 >> 33) * {P2} & {MASK} as h2 from {name}_ones)),
 {name} as materialized (select * exclude (h, n, hx, l, v0, v1, v2, v3, h0, tail, h8, tail8, h4, tail4, h1, h2, h3), (xor(h3, h3 >> 32) + 9223372036854775808::uhugeint) & {MASK} as h from {name}_mixed)"""


def _letters(script: str) -> str:
    return ALPHABETS.get(script) or "".join(map(chr, range(0xA0, 0x100)))


LETTERS = "".join(sorted({c for s in KEPT for c in _letters(s) if ord(c) >= 0x80}))
# Numbers that stand for the letters, so that an array holds the bytes of each.
NUMBERED = f"translate({{0}}, '{LETTERS}', '{''.join(chr(0x80 + i) for i in range(len(LETTERS)))}')"


def _bytes(char: str, page: str) -> str | None:
    try:
        return char.encode(CODEC_OF[page]).hex().upper()
    except UnicodeEncodeError:
        return None


def _coded(text: str, page: str) -> str:
    """A text of kept letters and ASCII as the page's bytes in hexadecimal."""
    codes = [_bytes(c, page) for c in [*map(chr, range(128)), *LETTERS]]
    array = "[" + ",".join("null" if c is None else f"'{c}'" for c in codes) + "]"
    return f"array_to_string(list_transform(string_split({NUMBERED.format(text)},''), lambda ch: {array}[unicode(ch)+1]),'')"


def _held(script: str, page: str) -> str | None:
    """Whether the page holds a text of the script; None if it holds none of its letters."""
    missing = "".join(c for c in _letters(script) if ord(c) >= 0x80 and _bytes(c, page) is None)
    if len(missing) == sum(ord(c) >= 0x80 for c in _letters(script)):
        return None
    return f"not regexp_matches(substring(text,1,{SAMPLE_BYTES}), '[{missing}]')" if missing else "true"


CRC = [0] * 256
for _i in range(256):
    CRC[_i] = _i
    for _ in range(8):
        CRC[_i] = CRC[_i] >> 1 ^ (0xEDB88320 if CRC[_i] & 1 else 0)
CRC32 = (f"xor(list_reduce(list_transform(string_split(doc_id::varchar,''), lambda ch: unicode(ch)::bigint), "
         f"lambda a, b: xor(({CRC}::bigint[])[(xor(a, b) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295::bigint)")


def _adjacent(hx: str, keys: str, source: str) -> str:
    """(keys, pair, n) of the adjacent bytes; a space stands before the first."""
    return (f"select {keys}, pair, count(*) as n from (select {keys}, unnest(regexp_extract_all('20'||{hx},'....')) as pair from {source} "
            f"union all select {keys}, unnest(regexp_extract_all({hx},'....')) from {source}) group by all")


def _learned() -> str:
    """CTEs up to ``held`` (page, script, lang, pages' share) and ``seen`` (page, script, lang, pair, n): the counts of ``count_pairs`` over the labelled sample."""
    scripts = " union all ".join(f"select lang, '{s}' as script, {scripted(s).replace('FLAG', ', chr(103)')} as text from chosen" for s in KEPT)
    combos = [(p, s, held) for p in PAGES for s in KEPT if (held := _held(s, p))]
    holds = " union all ".join(f"select '{p}' as page, script, lang, text from taught where script = '{s}' and {held}" for p, s, held in combos)
    codes = " ".join(f"when '{p}' then {_coded(f'substring(text,1,{SAMPLE_BYTES})', p)}" for p in PAGES)
    return f"""useful as (select distinct lang, text from documents where text is not null and lang is not null and {CRC32} % 5 <> 0),
 {hashed('useful', 'keyed')},
 chosen as materialized (select lang, text from keyed qualify row_number() over (partition by lang order by h) <= {ROWS}),
 taught as materialized (select distinct * from ({scripts}) where regexp_matches(text,'[^\\x00-\\x7F]')),
 holding as materialized ({holds}),
 held as materialized (select * from (select page, script, lang, count(*) as texts from holding group by all) join (select script, lang, count(*) as every from taught group by all) using (script, lang)
  where texts >= {SHARE}e0 * every),
 lessons as materialized (select page, script, lang, substring(case page {codes} end, 1, {2 * SAMPLE_BYTES}) as hx from holding semi join held using (page, script, lang)),
 seen as materialized ({_adjacent('hx', 'page, script, lang', 'lessons')})"""


def _singles() -> list[str]:
    return [p for p in PAGES if p not in MULTIPLE]


def _single_char(byte: int, page: str) -> str | None:
    try:
        return _decode(bytes([byte]), page, True)
    except UnicodeError:
        return None


def _shape(page: str) -> str:
    """A pattern of all bytes the page can decode, and of some it cannot: most texts of other pages fail it early."""
    ones = "|".join(f"{b:02X}" for b in range(0x80, 256) if _char(bytes([b]), page) != NONE) or "GG"
    leads = [b for b in range(0x80, 256) if _pending(bytes([b]), page)]
    trails = sorted({b for a in leads for b in range(256) if _char(bytes([a, b]), page) != NONE})
    long, rest = LONG.get(page, ("GG", "GG"))
    leads = "|".join(f"{b:02X}" for b in leads)
    return f"(?:[0-7].|{ones}|{long}|(?:{leads})(?:{'|'.join(f'{b:02X}' for b in trails)}))*(?:{leads}|{rest})?"


def learned_pages(planted_text: str, mark: str, ascii_only: str, utf8_text: str) -> str:
    """The planted documents through the cascade, the code page by the learned model; the fragments are those of detection in SQL.

    Planted texts hold no zero byte, so no rule for UTF-16 and UTF-32 without a mark can claim one.
    """
    models = [(i, j) for i, p in enumerate(PAGES) for j, s in enumerate(KEPT) if _held(s, p)]
    scripts = list(KEPT)
    planted = " ".join(f"when {i} then {_coded('text', p)}" for i, p in enumerate(PAGES))
    gaps = ", ".join(f"({PAGES.index(p)}, '{b:02X}')" for p in _singles() for b in range(256) if _single_char(b, p) is None)
    differ = ", ".join(f"({PAGES.index(p)}, {PAGES.index(q)}, '{b:02X}')" for p in _singles() for q in _singles() if PAGES.index(q) < PAGES.index(p)
                       for b in range(256) if _single_char(b, p) != _single_char(b, q))
    chars = ", ".join(f"({PAGES.index(p)}, '{b:02X}', {ord(_single_char(b, p))})" for p in _singles() for b in range(256) if _single_char(b, p))
    forms = {page: (legacy, form, rest) for legacy, page, form, rest in _forms() if page in MULTIPLE}
    shape = {page: f"select doc_id, s, {forms[page][0]} as priority, {PAGES.index(page)} as page, unnest(l) as t, unnest(range(len(l))) as pos from (select doc_id, s, "
                   f"regexp_extract_all(s, '{forms[page][1]}') as l from rest where regexp_full_match(s, '{_shape(page)}'))" for page in MULTIPLE}
    tokens = " union all ".join(f"select doc_id, priority, page, t, pos from ({shape[page]}) where not regexp_full_match(t, '{forms[page][2]}')" for page in MULTIPLE)
    value = "greatest(round({UNIT}e0 * log2((coalesce(n,0) + {PRIOR}e0 * ((coalesce(after,0) + 0.5e0) / (total + 128))) / (coalesce(before,0) + {PRIOR}e0))), -32768e0)".format(UNIT=UNIT, PRIOR=PRIOR)
    columns = ", ".join(f"max(v) filter (where page = '{PAGES[i]}' and script = '{scripts[j]}') as v{i}_{j}" for i, j in models)
    sums = ", ".join(f"sum(n * v{i}_{j}) as v{i}_{j}" for i, j in models)
    best = " union all ".join(
        f"select doc_id, {i} as page, max(greatest({', '.join(f'v{k}_{j}' for k, j in models if k == i)}, null::double)) as score from sums group by doc_id"
        for i in range(len(PAGES)) if any(k == i for k, _ in models))
    return f"""with {planted_text}, {_learned()}, {_tables()},
 planted as materialized (select doc_id, substring(case doc_id % 11 {planted} end, 1, {2 * SAMPLE_BYTES}) as s from scripted),
 marked as materialized (select doc_id, s, len(s)//2 as n, {mark} as mark, {ascii_only} as plain from planted where s <> ''),
 pairs as materialized ({_adjacent('s', 'doc_id', '(select * from marked where not plain)')}),
 hist as materialized (select doc_id, substring(pair,3,2) as b, sum(n) as c from pairs group by all),
 ent as (select doc_id, log2(sum(c)) - sum(c*log2(c))/sum(c) as entropy from hist group by all),
 d as materialized (select doc_id, s, mark, n >= 512 and coalesce(entropy,0) > 7.4 as bin, case when n >= 512 and coalesce(entropy,0) > 7.4 then '(Unknown)' when mark is not null then mark
  when plain then 'us-ascii' when {utf8_text} then 'utf-8' end as charset from marked left join ent using (doc_id)),
 rest as materialized (select doc_id, s, len(s)//2 as n from d where charset is null),
 tokens as materialized (select doc_id, priority, page, t, pos from ({tokens})),
 token_counts as (select doc_id, priority, page, t, count(*) as c, count(*) filter (where pos < 500) as head from tokens group by all),
 {_points('token_counts', 'signs')},
 wide as materialized (select doc_id, page, sum(head) as scalars, coalesce(sum(head) filter (where {CONTROL.format('cp')}),0) as controls,
  bool_or(head > 0 and (cp between 57344 and 63743 or cp >= 983040)) as private, coalesce(sum(c) filter (where len(t) = 2),0) as ones from signs group by all having not bool_or(cp is null)
  union all select doc_id, page, 0, 0, false, 0 from (select doc_id, {', '.join(f"regexp_full_match(s, '{forms[p][2]}') as r{PAGES.index(p)}" for p in MULTIPLE)} from rest where n <= 8)
   join (values {', '.join(f'({PAGES.index(p)})' for p in MULTIPLE)}) v(page) on case page {' '.join(f'when {PAGES.index(p)} then r{PAGES.index(p)}' for p in MULTIPLE)} end),
 gaps as (select * from (values {gaps}) v(page, b)),
 differ as (select * from (values {differ}) v(page, other, b)),
 chars as (select * from (values {chars}) v(page, t, cp)),
 alive as materialized (select doc_id, page from (select doc_id, page from rest cross join (values {', '.join(f'({PAGES.index(p)})' for p in _singles())}) v(page)
   where (doc_id, page) not in (select distinct doc_id, page from hist join gaps using (b))) union all select doc_id, page from wide),
 befores as (select page, script, lang, substring(pair,1,2) as a, sum(n) as before from seen group by all),
 afters as (select page, script, lang, substring(pair,3,2) as b, sum(n) as after from seen group by all),
 totals as (select page, script, lang, sum(n) as total from seen group by all),
 met as materialized (select pair, substring(pair,1,2) as a, substring(pair,3,2) as b from (select distinct pair from pairs)),
 likely as materialized (select page, script, lang, pair, {value} as v from met cross join totals left join befores using (page, script, lang, a) left join afters using (page, script, lang, b)
  left join seen using (page, script, lang, pair)),
 table_of as materialized (select lang, pair, {columns} from likely group by all),
 sums as materialized (select doc_id, lang, {sums} from pairs join table_of using (pair) where doc_id in (select doc_id from rest) group by all),
 scored as materialized (select doc_id, page, score from ({best}) join alive using (doc_id, page) where score is not null),
 leaders as materialized (select doc_id, page from scored qualify score = max(score) over (partition by doc_id)),
 earlier as materialized (select l.doc_id, l.page, s.page as other from leaders l join scored s on s.doc_id = l.doc_id and s.page < l.page),
 parted as (select distinct doc_id, e.page, e.other from earlier e join hist h using (doc_id) join differ f on f.page = e.page and f.other = e.other and f.b = h.b),
 narrow as materialized (select doc_id, page, other from earlier join wide using (doc_id, page) join rest using (doc_id) where other < {FIRST} and ones = n),
 clashing as (select distinct doc_id, e.page, e.other from narrow e join signs g using (doc_id, page) join chars f on f.page = e.other and f.t = g.t where f.cp <> g.cp),
 opening as materialized (select doc_id, page, pos, cp from (select * from tokens where pos < 100) join signs using (doc_id, page, t)),
 apart as (select distinct doc_id, e.page, e.other from earlier e join opening a using (doc_id, page) join opening b on b.doc_id = e.doc_id and b.page = e.other and b.pos = a.pos where e.other >= {FIRST} and a.cp <> b.cp),
 close as materialized (select * from (select * from earlier where other >= {FIRST}) anti join apart using (doc_id, page, other)),
 wanted as materialized (select distinct doc_id, unnest([page, other]) as page from close),
 spelt as materialized (select doc_id, page, string_agg(chr(cp::integer), '' order by pos) as decoded from (select * from tokens semi join wanted using (doc_id, page)) join signs using (doc_id, page, t) group by all),
 same as (select doc_id, other as page from (select * from earlier where page < {FIRST}) anti join parted using (doc_id, page, other)
  union all select doc_id, other from narrow anti join clashing using (doc_id, page, other)
  union all select e.doc_id, e.other from close e left join spelt a on a.doc_id = e.doc_id and a.page = e.page left join spelt b on b.doc_id = e.doc_id and b.page = e.other
   where coalesce(a.decoded,'') = coalesce(b.decoded,'')),
 winner as (select doc_id, min(page) as page from (select * from leaders union all select * from same) group by doc_id),
 heads as (select doc_id, page, unnest(regexp_extract_all(substring(s,1,1000),'..')) as t from winner join rest using (doc_id) where page < {FIRST}),
 tested as (select doc_id, page, count(*) as scalars, count(*) filter (where {CONTROL.format('cp')}) as controls, bool_or(cp between 57344 and 63743) as private
  from heads join chars using (page, t) group by all union all select doc_id, page, scalars, controls, private from winner join wide using (doc_id, page)),
 picked_page as (select doc_id, (['{"','".join(PAGES)}'])[page + 1] as name from tested where scalars > 0 and not private and (scalars-controls)/scalars >= 0.9)
 select doc_id, coalesce(charset, name, '(Unknown)') as charset, mark is not null and not coalesce(bin, false) as has_bom
 from scripted left join d using (doc_id) left join picked_page using (doc_id)"""
