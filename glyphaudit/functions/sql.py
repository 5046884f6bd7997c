"""Functions for SQL users.

They are SQL functions over the Arrow helpers, so their rules are optimized together with the calling query.
The rules are those of ``operators.detect`` and ``operators.convert``; tests hold the two forms equal.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import constants as k
from .arrow import FEATURES, HEADS, TRANSCODED, byte_features, strict_head, strict_heads, transcode_facts
from .charsets import BOM_OF
from .text import _NON_TEXT_CONTROLS, _TAIL_1, _TAIL_2, _TAIL_3

_DETECTED = "struct<charset string, has_bom boolean>"
_FEATURES, _HEADS, _FACTS = (t.simpleString() for t in (FEATURES, HEADS, TRANSCODED))


def _mark_cases(column: str) -> str:
    cases = " ".join(f"when startswith({column}, x'{mark}') then '{name}'" for name, mark in k.BOMS)
    return f"case {cases} end"


def _is_text(t: str) -> str:
    """The text test as SQL; SQL functions cannot be called inside lambdas, so it is spliced in."""
    head = f"substring({t}, 1, {k.TEXT_SCALARS})"
    return (
        f"coalesce(char_length({t}) > 0 and not {head} rlike r'\\p{{Co}}' and "
        f"(char_length({head}) - regexp_count({head}, r'{_NON_TEXT_CONTROLS}')) / char_length({head}) "
        f">= {k.TEXT_MIN_FRACTION}D, false)"
    )


def _statements(ranked: str) -> list[str]:
    is_text = f"glyph_is_text(t string) returns boolean return {_is_text('t')}"
    cut = f"""
        glyph_cut(tail string) returns int return case
          when tail rlike r'{_TAIL_1}' then 1 when tail rlike r'{_TAIL_2}' then 2
          when tail rlike r'{_TAIL_3}' then 3 else 0 end"""
    whole = """
        glyph_whole_utf8(s binary) returns string return cast(substring(s, 1, length(s) -
          glyph_cut(hex(case when length(s) > 3 then substring(s, -3, 3) else s end))) as string)"""
    utf8 = """
        glyph_is_utf8_text(t string) returns boolean return is_valid_utf8(t) and glyph_is_text(t)"""
    nul = """
        glyph_nul_order(be double, le double, be_chi2 double, le_chi2 double) returns string return case
          when le > {high} and be < {low} then 'utf-16' when be > {high} and le < {low} then 'utf-16BE'
          when be < {least} and le < {least} then null
          when le_chi2 >= {chi2} and le_chi2 > be_chi2 then 'utf-16'
          when be_chi2 >= {chi2} and be_chi2 > le_chi2 then 'utf-16BE' end""".format(
        high=f"{k.UTF16_NUL_HIGH}D", low=f"{k.UTF16_NUL_LOW}D", least=f"{k.UTF16_NUL_MIN}D", chi2=k.UTF16_CHI2_MIN
    )
    trials = f"""
        glyph_trials(f {_FEATURES}) returns array<string> return array_compact(array(
          case when f.size >= {k.UTF32_MIN_BYTES} and f.last_lane_clear then 'utf-32' end,
          case when f.size >= {k.UTF32_MIN_BYTES} and f.first_lane_clear then 'utf-32BE' end,
          case when f.size >= {k.UTF16_MIN_BYTES} then
            glyph_nul_order(f.even_nul / (f.size div 2), f.odd_nul / (f.size div 2), f.even_chi2, f.odd_chi2) end))"""
    early = f"""
        glyph_early(s binary, mark string, f {_FEATURES}, heads {_HEADS}) returns string return case
          when length(s) = 0 or (f.size >= {k.ENTROPY_MIN_BYTES} and f.entropy > {k.ENTROPY_LIMIT}D)
            then '{k.UNKNOWN}'
          when mark is not null then mark
          when size(filter(heads, h -> {_is_text('h.head')})) > 0
            then filter(heads, h -> {_is_text('h.head')})[0].charset
          when not cast(s as string) rlike r'[^\\t\\n\\r -~]' then 'us-ascii'
          when glyph_is_utf8_text(glyph_whole_utf8(s)) then 'utf-8' end"""
    best = f"""
        glyph_best(ranked {ranked}) returns string return case when
          size(ranked) > 0 then (case when coalesce(glyph_top(ranked).ok, false) then glyph_top(ranked).charset end)
          end"""
    top = f"""
        glyph_top(ranked {ranked}) returns struct<score double, o int, charset string, ok boolean> return
          array_max(transform(ranked, r -> struct(round(r.score, 9) as score, -r.priority as o, r.charset as charset,
            (r.head_scalars > 0 and not r.head_private and
             (r.head_scalars - r.head_controls) / r.head_scalars >= {k.TEXT_MIN_FRACTION}D) as ok)))"""
    late = f"""
        glyph_late(s binary, mark string, early string) returns {_DETECTED} return named_struct(
          'charset', coalesce(early, glyph_best(glyph_rank(case when early is null then s end)), '{k.UNKNOWN}'),
          'has_bom', mark is not null and early <> '{k.UNKNOWN}')"""
    mid = f"""
        glyph_mid(s binary, mark string, f {_FEATURES}) returns {_DETECTED} return
          glyph_late(s, mark, glyph_early(s, mark, f, glyph_heads(
            case when mark is null and size(glyph_trials(f)) > 0 then s end, glyph_trials(f))))"""
    first = f"""
        glyph_first(s binary) returns {_DETECTED} return glyph_mid(s, {_mark_cases('s')}, glyph_features(s))"""
    detect = f"""
        detect_charset(content binary) returns {_DETECTED} return glyph_first(substring(content, 1, {k.SAMPLE_BYTES}))"""
    valid = f"""
        is_valid_text(content binary, charset string) returns boolean return
          glyph_is_text(glyph_head(content, charset))"""
    marked = ", ".join(f"'{name}'" for name in BOM_OF)
    code = f"""
        glyph_code(target string, bom boolean, bad boolean, undecodable boolean, unencodable boolean, marked boolean,
            broken boolean, equal boolean) returns string return case
          when bom and target not in ({marked}) then 'BomMismatch'
          when bad then 'Unexpected' when undecodable then 'SourceDecodeError' when unencodable then 'TargetEncodeError'
          when target in ({marked}) and marked <> bom then 'BomMismatch'
          when broken then 'TargetDecodeError' when not equal then 'UnicodeMismatch' else 'None' end"""
    result = """
        glyph_result(code string, output binary, sha256 string, scalars bigint)
          returns struct<output binary, error_code string, sha256 string, scalars bigint> return named_struct(
            'output', case when code = 'None' then output end, 'error_code', code,
            'sha256', sha256, 'scalars', scalars)"""
    facts = """
        glyph_classify(t {facts}, target string, bom boolean)
          returns struct<output binary, error_code string, sha256 string, scalars bigint> return glyph_result(
            glyph_code(target, bom, t is null, t.decode_error_at is not null, t.encode_error_cp is not null,
              t.target_mark, t.target_decode_error_at is not null, t.sha256 = t.target_sha256),
            t.output, t.sha256, t.scalars)""".format(facts=_FACTS)
    transcode = """
        transcode(content binary, source string, target string, bom boolean)
          returns struct<output binary, error_code string, sha256 string, scalars bigint> return
            glyph_classify(glyph_transcode(content, source, target, bom), target, bom)"""
    ordered = [is_text, cut, whole, utf8, nul, trials, early, top, best, late, mid, first, detect, valid,
               code, result, facts, transcode]
    return [f"create or replace temporary function {body.strip()}" for body in ordered]


def register_functions(spark: SparkSession) -> None:
    """Register ``detect_charset(binary)``, ``transcode(binary, source, target, bom)`` and
    ``is_valid_text(binary, charset)``; charset names are canonical ones."""
    from ..operators.legacy import RANKED, rank_legacy

    for name, f in {
        "glyph_features": byte_features, "glyph_head": strict_head, "glyph_heads": strict_heads,
        "glyph_rank": rank_legacy, "glyph_transcode": transcode_facts,
    }.items():
        spark.udf.register(name, f)
    for statement in _statements(RANKED.simpleString()):
        spark.sql(statement)
