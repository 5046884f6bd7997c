"""One query per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as k
from ..functions.arrow import once, strict_heads
from ..functions.charsets import resolve_charsets, supported_labels
from ..functions.labels import format_label, label_base, label_has_bom, yes_no
from ..functions.sql import register_functions
from ..functions.text import (
    bom_charset, is_ascii_text, is_utf8, looks_like_text, printable_fraction, utf8_head,
)
from ..operators import profile as prof
from ..operators import report as rep
from ..operators.chunks import convert_chunks, placed, utf8_states
from ..operators.code_pages import CodePageModel, fit_code_pages
from ..operators.convert import convert, needs_conversion, transcode
from ..operators.detect import (
    accepted_unicode, detect, is_binary, sample_of, utf16_candidates, utf32_candidates, whole_units,
)
from ..operators.joins import corpus_of_report, merge_outcomes, only_selected
from ..operators.legacy import candidate_trials, pick_from_trials
from ..operators.paths import (
    candidate, in_excluded_directory, included, is_artefact, is_path, is_top_level, split_masks_column,
)
from ..operators.validate import accepted, rejected, report_detected, validate
from ..operators.verify import compare_runs, content_digest, flag_stale_sources, verify_stored
from ..sources.scratch import shared_folder
from ..sources.sinks import (
    read_csv_report, write_backup, write_converted, write_csv_report, write_tab_export, write_tree,
)
from ..sources.tree import (
    list_directories, list_tree, listed_files, listing_warnings, read_files, scan_binary_files, scan_files,
    scan_prefixes,
)
from ..streaming.incremental import deliver_report, running_counts, watch_tree
from ..streaming.ledger import count_changes, current_counts, deliver_changes, poll_tree, watch_ledger
from . import fixtures as fx
from .audit import audit, check_options, convert_corpus, mark_failed, with_source

ALLOWED = ["utf-8", "UTF-8-BOM", "utf-16be-bom", "utf-32", "(Unknown)"]
INCLUDE = ["*.cs", "src/*.txt", "?ther/*"]
EXCLUDE = ["*.designer.cs", "say*1?.*"]


def _c(name: str):
    return F.col(name)


def _sample() -> F.Column:
    return sample_of("content")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.arrow import byte_features

    return fx.enc(spark, sf).withColumn("sample", _sample()).withColumn("f", once(byte_features)(_c("sample")))


def _sha(c: F.Column) -> F.Column:
    return F.sha2(c, 256)


def _tree(spark: SparkSession, sf: str) -> str:
    """The documents as a file tree in the shared folder: ``paths`` names, ``enc`` bytes."""
    base = shared_folder(spark, "tree")
    docs = fx.enc(spark, sf, f"{fx.PATHS} as rel")
    write_tree(docs, base).write.format("noop").mode("overwrite").save()
    return base


# --- sources -------------------------------------------------------------------------------------

def src1_recursive_scan(spark, sf):
    return scan_files(spark, _tree(spark, sf)).select("rel", "length", _sha(_c("content")).alias("sha256"))


def src1_binary_file(spark, sf):
    base = _tree(spark, sf)
    df = scan_binary_files(spark, base)
    rel = F.expr("substring(path, instr(path, '/tree-') + 39)")
    return df.select(rel.alias("rel"), "length", _sha(_c("content")).alias("sha256"))


def src2_top_level(spark, sf):
    return scan_files(spark, _tree(spark, sf), recursive=False).select("rel", "length")


def src2_top_level_predicate(spark, sf):
    return fx.paths(spark, sf).select("doc_id", is_top_level(_c("rel")).alias("top_level"))


def src3_prefix_scan(spark, sf):
    df = scan_prefixes(spark, _tree(spark, sf), sample_bytes=4096)
    return df.select(
        "rel", "length", F.length("sample").cast("bigint").alias("sampled"), _sha(_c("sample")).alias("sha256")
    )


def src4_byte_column(spark, sf):
    pages = fx.table(spark, sf, "pages", ["page_id", "html"]).select(
        F.lit("pages").alias("source"), _c("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))
    docs = fx.enc(spark, sf).select(F.lit("documents").alias("source"), _c("doc_id").alias("id"), "content")
    return docs.unionByName(pages).select(
        "source", "id", F.length(_sample()).cast("bigint").alias("sampled"), _sha(_sample()).alias("sha256"))


def src5_empty_and_hidden(spark, sf):
    df = scan_prefixes(spark, _tree(spark, sf), exclude=["Doc*", "na*", "say*"])
    return audit(df).select("rel", "length", "result")


def src6_unreadable(spark, sf):
    base = _tree(spark, sf)
    files = listed_files(list_tree(spark, base))
    gone = files.withColumns({
        "rel": F.concat("rel", F.lit(".gone")), "path": F.concat("path", F.lit(".gone")),
    })
    df = audit(read_files(files.unionByName(gone), k.SAMPLE_BYTES))
    return df.select("rel", F.when(_c("result") == k.ERROR, _c("source_encoding")).alias("failed_as"), "result",
                     _c("diagnostic").isNotNull().alias("explained"))


def src7_unlistable_directory(spark, sf):
    base = _tree(spark, sf)
    rel = F.regexp_extract("rel", "^(.*?)/?[^/]*$", 1)
    dirs = fx.paths(spark, sf).select(F.explode(F.array(rel, F.concat(rel, F.lit("-gone")))).alias("rel")).distinct()
    listing = list_directories(dirs.select(F.concat(F.lit(base + "/"), "rel").alias("path"), "rel"))
    warned = listing.filter("kind = 'error'").select("rel", F.lit("warning").alias("kind"))
    return warned.unionByName(listing.filter("kind = 'file'").select("rel", "kind"))


def src8_prior_report(spark, sf):
    corpus = fx.enc(spark, sf, f"{fx.PATHS} as path").drop("doc_id")
    prior = fx.report(spark, sf).filter("result <> 'Invalid'")
    return corpus_of_report(prior, corpus).select(
        "doc_id", "path", "source_encoding", "source_has_bom", F.length("content").cast("bigint").alias("length"))


def src9_checked_options(spark, sf):
    for bad in ({"action": "convert"}, {"action": "convert", "target": "no-such-charset"},
                {"action": "validate", "accepted": []}, {"action": "detect", "parallelism": 0},
                {"action": "detect", "base": sf + "/no-such-directory"}):
        try:
            check_options(**bad)
        except ValueError:
            continue
        raise AssertionError(f"accepted {bad}")
    check_options("convert", base=sf, target="utf-8-bom")
    df = convert(fx.truth(spark, sf), "utf-8-bom", what_if=True)
    return df.select("doc_id", "target_encoding", "target_has_bom", "result")


# --- sinks ---------------------------------------------------------------------------------------

def snk1_csv_report(spark, sf):
    out = shared_folder(spark, "csv")
    write_csv_report(fx.report(spark, sf), out)
    lines = spark.read.text(out).filter("value <> 'File,Encoding,BOM,Target,BOM,Result'")
    return lines.select(_c("value").alias("csv_line"))


def snk1_csv_round_trip(spark, sf):
    out = shared_folder(spark, "csv")
    write_csv_report(fx.report(spark, sf), out)
    return read_csv_report(spark, out)


def snk2_csv_line(spark, sf):
    return fx.report(spark, sf).select("doc_id", rep.csv_line().alias("csv_line"))


def snk3_tab_export(spark, sf):
    out = shared_folder(spark, "tab")
    write_tab_export(fx.report(spark, sf).filter("result <> 'Skipped'"), out)
    return spark.read.text(out).select(_c("value").alias("line"))


def snk4_converted_corpus(spark, sf):
    out = shared_folder(spark, "converted")
    write_converted(convert(fx.enc_truth(spark, sf, f"{fx.PATHS} as path"), "utf-16-bom"), out)
    return spark.read.parquet(out).select(
        "path", "target_encoding", "target_has_bom", "source_bytes", "target_bytes", "scalars_verified",
        _c("sha256").alias("content_sha256"), _sha(_c("content")).alias("sha256"))


def snk5_backup(spark, sf):
    out = shared_folder(spark, "backup")
    corpus = fx.enc_truth(spark, sf, f"{fx.PATHS} as path")
    write_backup(convert(corpus, "utf-8", what_if=True), out)
    return spark.read.parquet(out).select("path", _sha(_c("content")).alias("sha256"))


def snk6_conversion_job(spark, sf):
    """Backup, outcome and converted bytes of one job."""
    folder = shared_folder(spark, "job")
    result = convert_corpus(fx.enc(spark, sf).withColumn("path", _c("doc_id").cast("string")), "utf-8-bom", folder)
    saved = spark.read.parquet(f"{folder}/backup").select("path", _sha(_c("content")).alias("backup_sha256"))
    return result.join(saved, "path", "left").select("doc_id", "target_encoding", "target_has_bom", "result",
                                                     _sha(_c("conversion.output")).alias("sha256"), "backup_sha256")


# --- path predicates -----------------------------------------------------------------------------

def prd1_include_masks(spark, sf):
    return fx.paths(spark, sf).filter(included(_c("rel"), INCLUDE))


def prd2_exclude_masks(spark, sf):
    return fx.paths(spark, sf).filter(included(_c("rel"), INCLUDE, EXCLUDE))


def prd3_mask_regex(spark, sf):
    masks = ["*", "*.cs", "src/*.cs", r"SRC\*.cs", "?oc*", "na,me*.txt", "src/nested/_*", "[D]oc*", "*.dot"]
    rel = _c("rel")
    return fx.paths(spark, sf).select("doc_id", *[included(rel, [m]).alias(f"m{i}") for i, m in enumerate(masks)])


def prd4_excluded_directories(spark, sf):
    return fx.paths(spark, sf).select("doc_id", in_excluded_directory(_c("rel")).alias("excluded"))


def prd5_artefacts(spark, sf):
    return fx.paths(spark, sf).select("doc_id", is_artefact(_c("rel")).alias("artefact"))


def prd6_one_path(spark, sf):
    p = fx.paths(spark, sf).withColumn("path", F.concat(F.lit("/Corpus/"), "rel"))
    return p.filter(~is_path(_c("path"), "/corpus/OTHER/doc203.cs")).select("doc_id", "path")


def prd7_mask_list(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.concat_ws("", F.lit(" *."), "lang", F.lit(" ,, "), "source", F.lit("*, ,"), F.lit("x y ,"))
    return docs.select("doc_id", F.array_join(split_masks_column(text), "|").alias("masks"))


def prd8_hide_passing(spark, sf):
    return rep.hide_passing(fx.report(spark, sf)).select("doc_id", "result")


def prd9_needs_conversion(spark, sf):
    t = fx.truth(spark, sf)
    src, bom = _c("source_encoding"), _c("source_has_bom")
    return t.select("doc_id", needs_conversion(src, bom, "UTF-8", False).alias("to_utf8"),
                    needs_conversion(src, bom, "utf8", False).alias("to_alias"),
                    needs_conversion(src, bom, "utf-16BE", True).alias("to_utf16be_bom"))


def prd10_display_columns(spark, sf):
    return rep.display_columns(fx.report(spark, sf)).select("doc_id", "label", "file_name", "extension", "directory")


def prd11_effective_label(spark, sf):
    return rep.with_effective_label(fx.report(spark, sf)).select("doc_id", "label")


def prd_candidates(spark, sf):
    return fx.paths(spark, sf).filter(candidate(_c("rel"), ["*.cs", "*.txt", "*.tmpx"], ["_under*"]))


# --- joins ---------------------------------------------------------------------------------------

def join1_merge_outcomes(spark, sf):
    r = fx.report(spark, sf)
    listed = r.filter("result <> 'Skipped'").select("doc_id", "path")
    outcomes = r.select(F.upper("path").alias("path"), "result")
    return merge_outcomes(listed, outcomes)


def join2_selected_rows(spark, sf):
    chosen = fx.paths(spark, sf).filter("rel like '%.cs'").select(_c("rel").alias("path"))
    return only_selected(fx.report(spark, sf), chosen).select("doc_id", "path", "result")


def join3_accepted(spark, sf):
    return accepted(fx.truth(spark, sf), ALLOWED)


def join4_rejected(spark, sf):
    return rejected(fx.truth(spark, sf), ALLOWED)


NAMES = """case doc_id % 11 when 0 then 'UTF8' when 1 then 'latin1' when 2 then 'unicode' when 3 then 'x-none'
 when 4 then 'SJIS' when 5 then 'cp949' when 6 then 'tis-620' when 7 then 'ASCII' when 8 then 'utf-7'
 when 9 then 'Windows-1252' else 'utf-32le' end"""


def join5_resolve_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", f"{NAMES} as name")
    return resolve_charsets(docs, "name").select(
        "doc_id", "name", "charset", _c("bom").isNotNull().alias("has_mark"),
        F.when(_c("charset").isNull(), k.ERROR).alias("result"))


def join6_stale_sources(spark, sf):
    base = "timestamp_seconds(1700000000 + doc_id)"
    done = fx.report(spark, sf).selectExpr("*", "doc_id * 10 as length", f"{base} as modificationTime")
    now = done.filter("doc_id % 23 <> 5").selectExpr(
        "path", "case when doc_id % 7 = 0 then length + 1 else length end as length",
        "case when doc_id % 11 = 0 then timestampadd(second, 1, modificationTime) else modificationTime end "
        "as modificationTime")
    return flag_stale_sources(done, now).select("doc_id", "result", "diagnostic")


def join7_compare_runs(spark, sf):
    left = fx.report(spark, sf)
    right = left.filter("doc_id % 29 <> 3").withColumn(
        "result", F.when(_c("doc_id") % 31 == 4, "Error").otherwise(_c("result")))
    return compare_runs(left.filter("doc_id % 37 <> 2"), right)


def join8_legacy_trials(spark, sf):
    f = _c("f")
    text = _features(spark, sf).filter(~is_binary(f["size"], f["entropy"]))
    found = detect(text.select("doc_id", "content"), legacy=False)
    rest = found.filter((_c("charset") == k.UNKNOWN) & (F.length("content") > 0))
    return candidate_trials(rest, _sample(), ["doc_id"])


# --- aggregations --------------------------------------------------------------------------------

def agg1_count_by_result(spark, sf):
    return rep.count_by_result(fx.report(spark, sf))


def agg2_totals(spark, sf):
    return rep.totals(fx.report(spark, sf).filter("result <> 'Invalid'"))


def agg3_files_processed(spark, sf):
    return rep.files_processed(fx.report(spark, sf))


def agg4_convert_summary(spark, sf):
    return rep.convert_summary(fx.report(spark, sf))


def agg5_gate(spark, sf):
    r = fx.report(spark, sf)
    calm = r.filter("result <> 'Error'")
    cases = [("all", r, "convert", True), ("convert", calm, "convert", True), ("validate", calm, "validate", True),
             ("detect", calm, "detect", True), ("lenient", calm, "convert", False),
             ("clean", calm.filter("result <> 'Invalid'"), "validate", True)]
    out = None
    for name, rows, action, fail in cases:
        one = rep.gate(rows, action, fail).select(F.lit(name).alias("gate"), "status")
        out = one if out is None else out.unionByName(one)
    return out


def agg6_byte_histogram(spark, sf):
    df = prof.with_byte_histogram(fx.enc(spark, sf), _sample())
    return prof.unfold_histogram(df, ["doc_id"]).select("doc_id", "byte", _c("n").cast("bigint").alias("n"))


def agg6_byte_histogram_relational(spark, sf):
    return prof.relational_histogram(fx.enc(spark, sf), _sample(), ["doc_id"])


def agg7_lane_histogram(spark, sf):
    df = prof.with_lane_histogram(fx.enc(spark, sf), _sample(), unit=2)
    return prof.unfold_lanes(df, ["doc_id"]).withColumn("n", _c("n").cast("bigint"))


def agg8_entropy(spark, sf):
    df = prof.with_byte_histogram(fx.enc(spark, sf), _sample())
    return df.select("doc_id", F.round(prof.entropy(_c("histogram")), 6).alias("entropy"))


def agg8_entropy_relational(spark, sf):
    h = prof.relational_histogram(fx.enc(spark, sf), _sample(), ["doc_id"])
    return prof.relational_entropy(h, ["doc_id"]).select("doc_id", F.round("entropy", 6).alias("entropy"))


def _channels(spark, sf):
    df = prof.with_lane_histogram(fx.enc(spark, sf), _sample(), unit=2)
    return df.select("doc_id", prof.channel(_c("lanes"), False).alias("even"), prof.channel(_c("lanes"), True).alias("odd"))


def agg9_nul_density(spark, sf):
    return _channels(spark, sf).select(
        "doc_id", F.round(prof.nul_density(_c("even")), 6).alias("even_nul"),
        F.round(prof.nul_density(_c("odd")), 6).alias("odd_nul"))


def agg10_chi_square(spark, sf):
    return _channels(spark, sf).select(
        "doc_id", F.round(prof.chi_square(_c("even")), 4).alias("even_chi2"),
        F.round(prof.chi_square(_c("odd")), 4).alias("odd_chi2"))


CONTROLS = "translate(text, 'aeiou', concat(char(1), char(9), char(10), char(127), char(27)))"


def agg11_printable_fraction(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"]).selectExpr("doc_id", "text", f"{CONTROLS} as noisy")
    return docs.select("doc_id", F.round(printable_fraction(_c("text")), 6).alias("plain"),
                       F.round(printable_fraction(_c("noisy")), 6).alias("noisy"))


def agg12_byte_totals(spark, sf):
    df = convert(fx.enc_truth(spark, sf), "utf-8")
    flat = df.select(F.length("content").alias("length"), "conversion.source_bytes", "conversion.target_bytes",
                     "conversion.scalars_verified")
    return rep.byte_totals(flat, _c("length")).withColumn("percent", F.round("percent", 6))


def agg13_not_correct(spark, sf):
    return rep.not_correct(validate(fx.truth(spark, sf), ALLOWED))


# --- order and caps ------------------------------------------------------------------------------

def sort1_report_order(spark, sf):
    r = fx.report(spark, sf).select("path")
    return rep.with_position(r, rep.report_order())


def _sort2(spark, sf, descending):
    r = rep.display_columns(fx.report(spark, sf)).select("label", "file_name", "extension", "directory")
    keys = rep.sort_rows(r, "label", r.columns, descending)
    return rep.with_position(r, keys)


def sort2_by_label(spark, sf):
    return _sort2(spark, sf, False)


def sort2_by_label_descending(spark, sf):
    return _sort2(spark, sf, True)


def sort3_caps(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select(
        "doc_id", F.char_length(F.substring("text", 1, k.TEXT_SCALARS)).alias("scalars"),
        F.length(sample_of(F.encode("text", "UTF-8"))).alias("bytes"),
        F.md5(F.substring("text", 1, k.TEXT_SCALARS)).alias("head"))


def set1_good_and_failed(spark, sf):
    r = fx.report(spark, sf)
    failed = r.filter("result = 'Error'").withColumns({
        "source_encoding": F.lit(k.FAILED), "target_encoding": F.lit(k.FAILED),
        "source_has_bom": F.lit(False), "target_has_bom": F.lit(False)})
    return rep.union_reports(r.filter("result <> 'Error'"), failed)


# --- labels --------------------------------------------------------------------------------------

LABELS = f"""case when doc_id % 4 = 0 then upper({fx.TRUTH_ENCODING}) else {fx.TRUTH_ENCODING} end
 || case when {fx.TRUTH_BOM} then case when doc_id % 3 = 0 then '-BOM' else '-bom' end else '' end"""


def _labels(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", f"{LABELS} as label")


def lbl1_parse_label(spark, sf):
    return _labels(spark, sf).select("doc_id", label_base(_c("label")).alias("base"),
                                     label_has_bom(_c("label")).alias("has_bom"))


def lbl2_format_label(spark, sf):
    return fx.truth(spark, sf).select(
        "doc_id", format_label(_c("source_encoding"), _c("source_has_bom")).alias("label"))


def lbl3_round_trip(spark, sf):
    label = format_label(label_base(_c("label")), label_has_bom(_c("label")))
    return _labels(spark, sf).select("doc_id", (label == _c("label")).alias("same"),
                                     (F.upper(label) == F.upper("label")).alias("same_ignoring_case"))


def lbl4_yes_no(spark, sf):
    return fx.truth(spark, sf).select("doc_id", yes_no(_c("source_has_bom")).alias("bom"))


def lbl5_supported_labels(spark, sf):
    t = fx.truth(spark, sf).select("doc_id", format_label(_c("source_encoding"), _c("source_has_bom")).alias("label"))
    s = supported_labels(spark).select("label", F.lit(True).alias("_listed"))
    return t.join(F.broadcast(s), "label", "left").select(
        "doc_id", "label", F.coalesce("_listed", F.lit(False)).alias("supported"))


# --- detection -----------------------------------------------------------------------------------

def det1_binary_gate(spark, sf):
    f = _c("f")
    return _features(spark, sf).select("doc_id", is_binary(f["size"], f["entropy"]).alias("binary"))


def det2_bom(spark, sf):
    return fx.enc(spark, sf).select("doc_id", bom_charset(_c("content")).alias("charset"))


def _tried(df: DataFrame, le: F.Column, be: F.Column, names: tuple[str, str]) -> DataFrame:
    trials = F.array_compact(F.array(F.when(le, names[0]), F.when(be, names[1])))
    df = df.withColumn("trials", trials)
    df = df.withColumn("heads", once(strict_heads)(whole_units(_c("sample"), F.lit(names[0])), _c("trials")))
    return df.select("doc_id", accepted_unicode(_c("heads")).alias("charset"))


def det3_utf32(spark, sf):
    le, be = utf32_candidates(_c("f"))
    return _tried(_features(spark, sf), le, be, ("utf-32", "utf-32BE"))


def det4_utf16(spark, sf):
    le, be = utf16_candidates(_c("f"))
    return _tried(_features(spark, sf), le, be & ~le, ("utf-16", "utf-16BE"))


def det5_ascii(spark, sf):
    return fx.enc(spark, sf).select("doc_id", is_ascii_text(_sample()).alias("ascii"))


def det6_utf8(spark, sf):
    return fx.enc(spark, sf).select("doc_id", looks_like_text(utf8_head(_sample())).alias("utf8"))


def det7_cascade(spark, sf):
    return detect(fx.enc(spark, sf), legacy=False).select("doc_id", "charset", "has_bom")


def det7_label_counts(spark, sf):
    """Documents per detected label, code pages included."""
    found = detect(fx.enc(spark, sf))
    return found.groupBy(format_label(_c("charset"), _c("has_bom")).alias("label")).agg(F.count("*").alias("documents"))


def det7_pages(spark, sf):
    pages = fx.table(spark, sf, "pages", ["page_id", "html"])
    return detect(pages.select("page_id", F.encode("html", "UTF-8").alias("content")), legacy=False).select(
        "page_id", "charset", "has_bom")


def _cut(spark, sf) -> DataFrame:
    """Documents as UTF-8, cut a few bytes before the end of the last non-ASCII character."""
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"])
    before = F.regexp_extract("text", r"(?s)^(.*)[^\x00-\x7F]", 1)
    end = F.octet_length(before) + 1
    return docs.select("doc_id", F.substring(F.encode("text", "UTF-8"), F.lit(1), end).alias("content"))


def txt1_strict_utf8(spark, sf):
    cut = _cut(spark, sf).select("doc_id", is_utf8(_c("content")).alias("cut_accepted"),
                                 is_utf8(_c("content"), cut_tail=False).alias("cut_whole"))
    forms = fx.enc(spark, sf).select("doc_id", is_utf8(_sample()).alias("valid"))
    return forms.join(cut, "doc_id")


def txt2_looks_like_text(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"]).selectExpr(
        "doc_id", "text", f"{CONTROLS} as noisy").withColumn(
        "private", F.replace("text", F.lit("z"), F.lit("\ue000")))
    return docs.select("doc_id", *[looks_like_text(_c(c)).alias(c) for c in ("text", "noisy", "private")])


def txt3_valid_text(spark, sf):
    forms = {"utf8": "utf-8", "utf16": "utf-16", "utf16be": "utf-16BE", "ascii": "us-ascii"}
    # one call for the four charsets: each call of its own is a Python worker more for every task
    df = fx.enc(spark, sf).withColumn("heads", once(strict_heads)(_sample(), F.array(*[F.lit(c) for c in forms.values()])))

    def head(charset: str) -> F.Column:
        return F.get(F.filter("heads", lambda h: h["charset"] == charset), F.lit(0))["head"]

    return df.select("doc_id", *[looks_like_text(head(c)).alias(n) for n, c in forms.items()])


def leg1_pick(spark, sf):
    """The documents left to the code pages and their pick; the score is our own and stays out of the comparison."""
    trials = join8_legacy_trials(spark, sf)
    return pick_from_trials(trials, ["doc_id"]).select("doc_id", "charset", "priority")


def _code_pages(spark, sf) -> CodePageModel:
    return fit_code_pages(fx.labelled(spark, sf), fx.PAGES)


def leg1_learned_pages(spark, sf):
    """Every document planted in one of eleven code pages and what the cascade with a learned model takes it for."""
    found = detect(fx.planted(spark, sf), legacy=_code_pages(spark, sf))
    return found.select("doc_id", "charset", "has_bom")


def join8_learned_trials(spark, sf):
    """The planted documents and every single-byte page they decode in; the scores are our own and stay out of the comparison."""
    planted = fx.planted(spark, sf).filter(~_c("content").isNull()).filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    trials = candidate_trials(planted, _sample(), ["doc_id"], _code_pages(spark, sf).ranker())
    return trials.filter(~_c("charset").isin("shift_jis", "euc-jp", "euc-kr")).select("doc_id", "charset", "priority")


# --- validation and conversion -------------------------------------------------------------------

def val1_validate(spark, sf):
    return validate(fx.truth(spark, sf), ALLOWED).select("doc_id", "target_encoding", "target_has_bom", "result")


def val2_detect(spark, sf):
    return report_detected(fx.truth(spark, sf)).select("doc_id", "target_encoding", "target_has_bom", "result")


def val2_detect_bytes(spark, sf):
    return audit(fx.enc(spark, sf)).groupBy("result").agg(F.count("*").alias("n"))


def _converted(df: DataFrame) -> DataFrame:
    c = _c("conversion")
    return df.select(
        "doc_id", "target_encoding", "target_has_bom", "result",
        F.split(_c("diagnostic"), ":")[0].alias("code"), c["source_bytes"].alias("source_bytes"),
        F.when(c["success"], c["target_bytes"]).alias("target_bytes"),
        F.when(c["success"], c["scalars_verified"]).alias("scalars"),
        F.when(c["success"], c["sha256"]).alias("content_sha256"), _sha(c["output"]).alias("sha256"))


def _to(label: str, **options) -> Callable:
    def query(spark, sf):
        return _converted(convert(fx.enc_truth(spark, sf), label, **options))

    return query


CHUNK = 1024


def _chunks(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Contents cut into rows (doc_id, no, content); an empty one is one empty chunk."""
    last = F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / size).cast("int")
    return df.withColumn("no", F.explode(F.sequence(F.lit(0), last))).withColumn("content", F.substring("content", _c("no") * size + 1, F.lit(size)))


def _whole(pieces: DataFrame) -> DataFrame:
    """The pieces of each document put together; documents are small."""
    parts = F.sort_array(F.collect_list(F.struct("no", "part", "output")))
    return pieces.groupBy("doc_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["output"])).alias("output"))


def _in_chunks(label: str) -> Callable:
    def query(spark, sf):
        pieces, outcomes = convert_chunks(placed(_chunks(fx.enc_truth(spark, sf)), "doc_id"), label, "doc_id")
        c = F.col("conversion")
        return _converted(outcomes.join(_whole(pieces), "doc_id", "left").withColumn("conversion", F.when(c.isNotNull(), c.withField("output", _c("output")))))

    return query


def txt1_whole_contents(spark, sf):
    """UTF-8 validity of whole contents in chunks of seven bytes: every byte form, and documents cut inside a character."""
    forms = utf8_states(_chunks(fx.enc(spark, sf)), "doc_id").select("doc_id", _c("accepted").alias("form_accepted"), _c("valid").alias("form_valid"))
    cut = utf8_states(_chunks(_cut(spark, sf), 7), "doc_id").select("doc_id", _c("accepted").alias("cut_accepted"), _c("valid").alias("cut_whole"))
    return forms.join(cut, "doc_id")


def cnv1_convert_detected(spark, sf):
    df = convert(with_source(fx.enc(spark, sf)), "utf-8-bom")
    return df.select("doc_id", "target_encoding", "target_has_bom", "result", _sha(_c("conversion.output")).alias("sha256"))


def cnv2_dry_run(spark, sf):
    return convert(fx.truth(spark, sf), "utf-8", what_if=True).select(
        "doc_id", "target_encoding", "target_has_bom", "result", "diagnostic")


def cnv3_bom_feasibility(spark, sf):
    df = convert(fx.enc_truth(spark, sf), "windows-1252-bom")
    return df.select("doc_id", "result", F.split("diagnostic", ":")[0].alias("code"))


def cnv5_idempotent(spark, sf):
    once_ = convert(fx.enc_truth(spark, sf), "utf-8-bom").filter("source_encoding <> '(Unknown)'")
    again = once_.select("doc_id", _c("result").alias("first"),
                         F.coalesce("conversion.output", "content").alias("content"))
    second = convert(with_source(again), "utf-8-bom")
    kept = F.coalesce(_c("conversion.output"), _c("content")) == _c("content")
    return second.select("doc_id", "first", _c("result").alias("second"), kept.alias("same_bytes"),
                         _sha(_c("content")).alias("sha256"))


PRIOR = f"""case when doc_id % 5 = 0 and doc_id % 13 < 2 then 'UTF8' when doc_id % 5 = 1 and doc_id % 13 <= 10 then 'bogus'
 else {fx.TRUTH_ENCODING} end"""


def cnv6_prior_rows(spark, sf):
    prior = fx.enc(spark, sf, f"{PRIOR} as source_encoding", f"{fx.TRUTH_BOM} as source_has_bom",
                   "'kept' as target_encoding", "true as target_has_bom")
    return _converted(convert(prior, "utf-8", rerun=True))


def ver1_digest(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"]).withColumn(
        "wide", F.concat("text", F.lit("\U0001f30d世")))
    for c in ("text", "wide"):
        docs = docs.withColumn(c, content_digest(_c(c)))
    return docs.select("doc_id", "text.sha256", "text.scalars", "text.units",
                       _c("wide.sha256").alias("wide_sha256"), _c("wide.scalars").alias("wide_scalars"),
                       _c("wide.units").alias("wide_units"))


def _stored(spark, sf) -> DataFrame:
    """UTF-16 outputs, some damaged: cut, unmarked, other text, wrong length on record."""
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"]).selectExpr(
        "doc_id", "text", "concat(x'FFFE', encode(text,'UTF-16LE')) as good")
    damaged = F.expr("""case doc_id % 6
      when 1 then substring(good, 1, length(good) - 1)
      when 2 then substring(good, 3)
      when 3 then concat(x'FFFE', encode(reverse(text),'UTF-16LE'))
      when 4 then concat(good, encode('+','UTF-16LE'))
      else good end""")
    expected = F.expr("case doc_id % 6 when 5 then length(good) + 2 else length(stored) end")
    df = docs.withColumn("stored", damaged).withColumn("expected_bytes", expected)
    df = df.withColumn("source", content_digest(_c("text")))
    return verify_stored(df, "utf-16-bom", "stored", "expected_bytes", "source")


def ver2_verify(spark, sf):
    return _stored(spark, sf).select("doc_id", "verification.success", "verification.error_code",
                                     "verification.scalars_verified")


def ver3_messages(spark, sf):
    return _stored(spark, sf).filter("verification.error_code = 'UnicodeMismatch'").select(
        "doc_id", "verification.error_message")


def err1_codes(spark, sf):
    df = fx.enc(spark, sf, "'utf-8' as source_encoding", "false as source_has_bom")
    for name, label in (("to_utf16", "utf-16"), ("to_ascii", "us-ascii")):
        base = label
        df = transcode(df, "content", _c("source_encoding"), base, False, into=name)
    return df.select("doc_id", _c("to_utf16.error_code").alias("to_utf16"), _c("to_ascii.error_code").alias("to_ascii"),
                     _c("to_utf16.source_bytes").alias("read_utf16"))


def err2_diagnostics(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"]).select(
        "doc_id", F.encode("text", "UTF-8").alias("content"),
        F.lit("utf-8").alias("source_encoding"), F.lit(False).alias("source_has_bom"))
    return convert(docs, "us-ascii").select("doc_id", "result", "diagnostic")


def err3_error_lines(spark, sf):
    return rep.error_lines(fx.report(spark, sf))


# --- streaming and SQL functions -----------------------------------------------------------------

def _stream_tree(spark, sf) -> str:
    base = shared_folder(spark, "tree")
    docs = fx.enc(spark, sf, "concat('d', doc_id % 10, '/', doc_id, '.txt') as rel")
    write_tree(docs, base).write.format("noop").mode("overwrite").save()
    return base


def str1_incremental_report(spark, sf):
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    deliver_report(watch_tree(spark, _stream_tree(spark, sf)), out, state).awaitTermination()
    doc = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint")
    return spark.read.parquet(out).select(doc.alias("doc_id"), "result")


def str2_running_counts(spark, sf):
    name = f"glyph_counts_{uuid.uuid4().hex}"
    stream = watch_tree(spark, _stream_tree(spark, sf))
    running_counts(stream, name, shared_folder(spark, "state"), action="validate", accepted=ALLOWED).awaitTermination()
    return spark.table(name)


def _changing_tree(spark, sf, ledger: str, deliver: Callable) -> None:
    """A tree with empty and hidden files, delivered; then every fourth file rewritten as marked UTF-16, delivered again by a restarted query."""
    base = shared_folder(spark, "tree")
    rel = "concat('d', doc_id % 10, '/', case doc_id % 5 when 2 then '_' when 4 then '.' else '' end, doc_id, '.txt') as rel"
    first = fx.enc(spark, sf, rel)
    docs = fx.table(spark, sf, "documents", ["doc_id", "text"]).where("doc_id % 4 = 1")
    second = docs.selectExpr("concat(x'FFFE', encode(text, 'UTF-16LE')) as content", rel)
    for files in (first, second):
        write_tree(files, base).write.format("noop").mode("overwrite").save()
        poll_tree(spark, base, ledger)
        deliver(watch_ledger(spark, ledger)).awaitTermination()


def str1_changed_files(spark, sf):
    """A report row for each version of each file: all of the first poll, the rewritten ones again after the second."""
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    _changing_tree(spark, sf, shared_folder(spark, "ledger"), lambda changes: deliver_changes(changes, out, state))
    doc = F.regexp_extract("path", r"/[_.]?(\d+)\.txt$", 1).cast("bigint")
    return spark.read.parquet(out).select(doc.alias("doc_id"), "version", "source_has_bom", "result")


def str2_counts_after_rewrites(spark, sf):
    """Counts by result, the old results of rewritten files taken off."""
    out, state = shared_folder(spark, "counts"), shared_folder(spark, "state")
    _changing_tree(spark, sf, shared_folder(spark, "ledger"), lambda changes: count_changes(
        changes, out, state, action="validate", accepted=ALLOWED))
    return current_counts(spark, out)


def _sql(statement: str) -> Callable:
    def query(spark, sf):
        register_functions(spark)
        return spark.sql(statement, enc=fx.enc(spark, sf))

    return query


udf1_detect_charset = _sql(
    "select doc_id, d.charset as charset, d.has_bom as has_bom "
    "from (select doc_id, detect_charset(content) as d from {enc})")
udf2_transcode = _sql(
    "select doc_id, t.error_code as error_code, sha2(t.output, 256) as sha256, t.scalars as scalars "
    "from (select doc_id, transcode(content, 'utf-8', 'utf-16', true) as t from {enc})")
udf3_is_valid_text = _sql(
    "select doc_id, is_valid_text(content, 'utf-8') as utf8, is_valid_text(content, 'us-ascii') as ascii from {enc}")

cnv4_to_utf8 = _to("utf-8")
cnv4_to_utf8_arrow = _to("utf-8", built_in=False)
cnv4_to_utf16le_bom = _to("utf-16-bom")
cnv4_to_utf16be = _to("utf-16BE")
cnv4_to_utf32le_bom = _to("utf-32-bom")
cnv4_to_utf32be = _to("utf-32BE")
cnv4_to_latin1 = _to("iso-8859-1")
cnv4_to_windows1252 = _to("windows-1252")
cnv4_to_ascii = _to("us-ascii")
cnv4_chunks = _in_chunks("utf-8")
cnv4_chunks_utf16le_bom = _in_chunks("utf-16-bom")
cnv4_chunks_ascii = _in_chunks("us-ascii")

QUERIES = (
    "src1_recursive_scan", "src1_binary_file", "src2_top_level", "src2_top_level_predicate", "src3_prefix_scan",
    "src4_byte_column", "src5_empty_and_hidden", "src6_unreadable", "src7_unlistable_directory", "src8_prior_report",
    "src9_checked_options", "snk1_csv_report", "snk1_csv_round_trip", "snk2_csv_line", "snk3_tab_export",
    "snk4_converted_corpus", "snk5_backup", "snk6_conversion_job", "prd1_include_masks", "prd2_exclude_masks", "prd3_mask_regex",
    "prd4_excluded_directories", "prd5_artefacts", "prd6_one_path", "prd7_mask_list", "prd8_hide_passing",
    "prd9_needs_conversion", "prd10_display_columns", "prd11_effective_label", "prd_candidates", "join1_merge_outcomes",
    "join2_selected_rows", "join3_accepted", "join4_rejected", "join5_resolve_names", "join6_stale_sources",
    "join7_compare_runs", "join8_legacy_trials", "agg1_count_by_result", "agg2_totals", "agg3_files_processed",
    "agg4_convert_summary", "agg5_gate", "agg6_byte_histogram", "agg6_byte_histogram_relational", "agg7_lane_histogram",
    "agg8_entropy", "agg8_entropy_relational", "agg9_nul_density", "agg10_chi_square", "agg11_printable_fraction",
    "agg12_byte_totals", "agg13_not_correct", "sort1_report_order", "sort2_by_label", "sort2_by_label_descending", "sort3_caps",
    "set1_good_and_failed", "lbl1_parse_label", "lbl2_format_label", "lbl3_round_trip", "lbl4_yes_no", "lbl5_supported_labels",
    "det1_binary_gate", "det2_bom", "det3_utf32", "det4_utf16", "det5_ascii", "det6_utf8", "det7_cascade", "det7_label_counts",
    "det7_pages", "txt1_strict_utf8", "txt2_looks_like_text", "txt3_valid_text", "leg1_pick", "leg1_learned_pages", "join8_learned_trials", "val1_validate", "val2_detect",
    "val2_detect_bytes", "cnv1_convert_detected", "cnv2_dry_run", "cnv3_bom_feasibility", "cnv5_idempotent", "cnv6_prior_rows",
    "ver1_digest", "ver2_verify", "ver3_messages", "err1_codes", "err2_diagnostics", "err3_error_lines", "str1_incremental_report",
    "str1_changed_files", "str2_running_counts", "str2_counts_after_rewrites", "udf1_detect_charset", "udf2_transcode", "udf3_is_valid_text", "cnv4_to_utf8", "cnv4_to_utf8_arrow",
    "cnv4_to_utf16le_bom", "cnv4_to_utf16be", "cnv4_to_utf32le_bom", "cnv4_to_utf32be", "cnv4_to_latin1", "cnv4_to_windows1252",
    "cnv4_to_ascii", "cnv4_chunks", "cnv4_chunks_utf16le_bom", "cnv4_chunks_ascii", "txt1_whole_contents",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in QUERIES}
