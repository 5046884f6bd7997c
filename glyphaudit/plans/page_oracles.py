"""The choice of a code page (``operators.legacy``) and the text in it as plain SQL (DuckDB dialect), from the codecs' own tables."""

from __future__ import annotations

from functools import cache

from ..functions.arrow import _decode
from ..operators.legacy import LATIN, MULTI_BYTE, PRIOR, SINGLE_BYTE, WESTERN, _single_byte_tables

NONE = "￿"   # stands for bytes without a character
# Bytes of a character longer than two, and what may be left of one at the end, as hexadecimal patterns.
LONG = {"euc-jp": ("8F....", "8F(?:..)?"), "GB18030": ("[89A-F].3[0-9]....", "[89A-F].3[0-9](?:..)?"), "euc-kr": ("A4D4.{12}", "A4D4(?:..){0,5}")}
CHO = [0xA1, 0xA2, 0xA4, 0xA7, 0xA8, 0xA9, 0xB1, 0xB2, 0xB3, *range(0xB5, 0xBF)]
JONG = [0xD4, 0xA1, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, *range(0xA9, 0xB3), *range(0xB4, 0xB9), *range(0xBA, 0xBF)]


def _char(data: bytes, page: str) -> str:
    try:
        text = _decode(data, page, True)
    except UnicodeError:
        return NONE
    return text if len(text) == 1 else NONE


def _pending(data: bytes, page: str) -> bool:
    try:
        return _decode(data, page, False) == ""
    except UnicodeError:
        return False


def _string(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _plane(page: str, before: bytes = b"") -> str:
    """Rows (t, ch) of all pairs of bytes, after a fixed byte if given."""
    leads = [a for a in range(0x81, 0xFF) if any(_char(before + bytes([a, b]), page) != NONE for b in range(0x31, 0xFF))]
    chars = "".join(_char(before + bytes([a, b]), page) for a in leads for b in range(0x31, 0xFF))
    at = f"[{','.join(map(str, leads))}][1 + unnest(range({len(chars)})) // 206]"
    return (f"select printf('{before.hex().upper()}%02X%02X', {at}, 49 + unnest(range({len(chars)})) % 206) as t, "
            f"unnest(string_split({_string(chars)}, '')) as ch")


def _four_bytes() -> list[tuple[int, int, int]]:
    """GB18030: runs (first number, last number, first code point) of the four-byte characters in the basic plane, and the planes above."""
    runs: list[list[int]] = []
    for i in range(50400):
        data = bytes([0x81 + i // 12600, 0x30 + i // 1260 % 10, 0x81 + i // 10 % 126, 0x30 + i % 10])
        ch = _char(data, "GB18030")
        if ch == NONE:
            continue
        if runs and runs[-1][1] == i - 1 and runs[-1][2] + i - runs[-1][0] == ord(ch):
            runs[-1][1] = i
        else:
            runs.append([i, i, ord(ch)])
    return [tuple(r) for r in runs] + [(189000, 189000 + 0xFFFFF, 0x10000)]


@cache
def _forms() -> list[tuple[int, str, str, str]]:
    """(priority, page, pattern of a character's bytes, pattern of what is left of one at the end) of the multi-byte pages."""
    out = []
    for k, (page, _, _) in enumerate(MULTI_BYTE):
        singles = "|".join(f"{b:02X}" for b in range(0x80, 256) if _char(bytes([b]), page) != NONE) or "GG"
        leads = "|".join(f"{b:02X}" for b in range(0x80, 256) if _pending(bytes([b]), page)) or "GG"
        long, rest = LONG.get(page, ("GG", "GG"))
        out.append((len(SINGLE_BYTE) + k, page, f"[0-7].|{singles}|{long}|{rest}$|....|..", f"{leads}|{rest}"))
    return out


@cache
def _tables() -> str:
    weight, undefined, _, _ = _single_byte_tables()
    rows = []
    for i, (page, usual, block) in enumerate(SINGLE_BYTE):
        chars = "".join(NONE if undefined[b, i] else _char(bytes([b]), page) for b in range(0x80, 0x100))
        weights = ",".join(f"{weight[b, i]:.17e}" for b in range(0x80, 0x100))
        rows.append(f"({i}, '{page}', {str(block == LATIN).lower()}, {PRIOR * (block == LATIN and usual != WESTERN)}e0, [{weights}], {_string(chars)})")
    pages = f"single_pages as (select * from (values {', '.join(rows)}) v(priority, page, latin, prior, weights, chars))"
    parts, many = [], []
    for k, (page, _, (kana, hangul, common, rare)) in enumerate(MULTI_BYTE):
        p = len(SINGLE_BYTE) + k
        ones = [b for b in range(256) if _char(bytes([b]), page) != NONE]
        chars = "".join(_char(bytes([b]), page) for b in ones)
        parts.append(f"select {p} as priority, printf('%02X', unnest([{','.join(map(str, ones))}])) as t, unnest(string_split({_string(chars)}, '')) as ch")
        parts.append(f"select {p}, * from ({_plane(page)})")
        if page == "euc-jp":
            parts.append(f"select {p}, * from ({_plane(page, bytes([0x8F]))})")
        many.append(f"({p}, {kana}e0, {hangul}e0, {common}e0, {rare}e0)")
    usual = " or ".join(
        f"(priority = {len(SINGLE_BYTE) + k} and substring(t,1,2) between '{low:02X}' and '{high:02X}'{' and substring(t,3,2) >= $$A1$$' if page == 'GB18030' else ''})"
        for k, (page, (low, high), _) in enumerate(MULTI_BYTE))
    runs = ", ".join(map(str, _four_bytes()))
    return f"""{pages},
 single_chars as materialized (select priority, page, latin, prior, printf('%02X', 128 + unnest(range(128))) as t, unnest(weights) as w, unnest(string_split(chars, '')) as ch from single_pages),
 multi_chars as materialized (select priority, t, unicode(ch) as cp from ({' union all '.join(parts)}) where ch <> '{NONE}'),
 usual as materialized (select distinct priority, cp from multi_chars where len(t) = 4 and ({usual})),
 weights as (select * from (values {', '.join(many)}) v(priority, kana, hangul, common, rare)),
 runs as (select * from (values {runs}) v(low, high, cp))"""


def _hex(at: int) -> str:
    return f"('0x' || substring(t,{at},2))::integer"


def _points(source: str, name: str) -> str:
    """``source`` (priority, t, ...) with the code point of each token; NULL where it has none."""
    number = f"((({_hex(1)}-129)*10 + {_hex(3)}-48)*126 + {_hex(5)}-129)*10 + {_hex(7)}-48"
    cho, jong = (", ".join(f"'{b:02X}'" for b in bytes_) for bytes_ in (CHO, JONG))
    made = (f"case when substring(t,5,2)='A4' and substring(t,9,2)='A4' and substring(t,13,2)='A4' and substring(t,11,2) between 'BF' and 'D3' then "
            f"44032 + ((list_position([{cho}], substring(t,7,2))-1)*21 + {_hex(11)}-191)*28 + list_position([{jong}], substring(t,15,2))-1 end")
    return f"""{name}_long as (select priority, t, {number} as number from (select distinct priority, t from {source} where len(t) = 8)),
 {name}_points as (select priority, t, cp from multi_chars union all
  select l.priority, t, r.cp + l.number - r.low from {name}_long l join runs r on l.number between r.low and r.high where substring(t,5,2) between '81' and 'FE' and substring(t,7,2) between '30' and '39'
  union all select priority, t, {made} from (select distinct priority, t from {source} where len(t) = 16)),
 {name} as materialized (select s.*, p.cp from {source} s left join {name}_points p on s.priority = p.priority and s.t = p.t)"""


CONTROL = "({0} < 32 and {0} not in (9,10,13) or {0} between 127 and 159)"


def ranked(digits: int) -> str:
    """CTEs from ``rest`` (doc_id, s: the sample in hexadecimal, with a byte above 7F) to ``picked`` (doc_id, page, priority): the best page, if it passes for text."""
    tokens = " union all ".join(
        f"select doc_id, {p} as priority, '{page}' as page, t, pos from (select doc_id, unnest(l) as t, unnest(range(len(l))) as pos from "
        f"(select doc_id, regexp_extract_all(s, '{form}') as l from rest)) where not regexp_full_match(t, '{rest}')" for p, page, form, rest in _forms())
    return f"""{_tables()},
 bytes as materialized (select doc_id, unnest(l) as t, unnest(range(len(l))) as pos from (select doc_id, regexp_extract_all(s,'..') as l from rest)),
 about as (select doc_id, count(*) as n, count(*) filter (where high) as high, count(*) filter (where high and before) as pairs, count(*) filter (where pos < 500 and control) as controls
  from (select doc_id, pos, t >= '80' as high, {CONTROL.format("('0x'||t)::integer")} and t < '80' as control, lag(t) over (partition by doc_id order by pos) >= '80' as before from bytes) group by doc_id),
 counted as (select doc_id, t, count(*) as c, count(*) filter (where pos < 500) as head from bytes where t >= '80' group by all),
 one_byte as (select doc_id, priority, page, sum(c*w)/any_value(high)
   - 0.6e0*any_value(case when high = n then 0e0 when latin then pairs/high else 1-pairs/high end) - any_value(prior) as score,
  least(any_value(n),500) as scalars, any_value(controls) + coalesce(sum(head) filter (where unicode(ch) between 127 and 159),0) as controls,
  bool_or(head > 0 and unicode(ch) between 57344 and 63743) as private
  from counted join single_chars using (t) join about using (doc_id) group by doc_id, priority, page having not bool_or(ch = '{NONE}')),
 tokens as materialized (select doc_id, priority, page, t, count(*) as c, count(*) filter (where pos < 500) as head from ({tokens}) group by all),
 {_points('tokens', 'signs')},
 weighed as (select s.*, case when s.cp between 19968 and 40959 then case when u.cp is null then rare else common end
   when s.cp between 12353 and 12542 then kana when s.cp between 44032 and 55203 then hangul
   when s.cp between 12288 and 12320 or s.cp between 65281 and 65374 then 0.8e0 else -0.5e0 end as w
  from signs s join weights using (priority) left join usual u on u.priority = s.priority and u.cp = s.cp),
 more_bytes as (select doc_id, priority, page, coalesce(sum(c*w) filter (where cp >= 128)/sum(c) filter (where cp >= 128), -1e0) as score,
  sum(head) as scalars, coalesce(sum(head) filter (where {CONTROL.format('cp')}),0) as controls,
  bool_or(head > 0 and (cp between 57344 and 63743 or cp >= 983040)) as private from weighed group by doc_id, priority, page having not bool_or(cp is null)),
 picked as materialized (select doc_id, page, priority from (select *, row_number() over (partition by doc_id order by round(score,{digits}) desc, priority) as place
   from (select * from one_byte union all select * from more_bytes)) where place = 1 and scalars > 0 and not private and (scalars-controls)/scalars >= 0.9)"""


def decoded() -> str:
    """CTEs from ``chosen`` (doc_id, page, hx: the whole content in hexadecimal) to ``texts`` (doc_id, decoded; NULL where the content is not valid); needs those of ``ranked``."""
    whole = " union all ".join(
        f"select doc_id, {p} as priority, unnest(l) as t, unnest(range(len(l))) as pos from (select doc_id, regexp_extract_all(hx, '{form}') as l from chosen where page = '{page}')"
        for p, page, form, _ in _forms())
    return f"""whole as materialized ({whole}),
 {_points('whole', 'read_signs')},
 read_bytes as (select doc_id, unnest(l) as t, unnest(range(len(l))) as pos, page from (select doc_id, page, regexp_extract_all(hx, '..') as l from chosen where page in (select page from single_pages))),
 texts as (select doc_id, case when bool_and(cp is not null) then string_agg(chr(cp::integer), '' order by pos) end as decoded from (
  select doc_id, pos, cp from read_signs union all
  select b.doc_id, b.pos, case when b.t < '80' then ('0x'||b.t)::integer when ch <> '{NONE}' then unicode(ch) end from read_bytes b left join single_chars s on s.page = b.page and s.t = b.t) group by doc_id)"""
