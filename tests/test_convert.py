import hashlib

import pytest
from pyspark.sql import functions as F

from glyphaudit.functions.charsets import BOM_OF, CODEC_OF, resolve
from glyphaudit.operators.convert import convert
from glyphaudit.plans.audit import audit, check_options, with_source
from test_detect import ASCII, MULTI, awkward


def run(spark, rows, target, **options):
    df = spark.createDataFrame(
        [(i, bytearray(c), e, b) for i, (c, e, b) in enumerate(rows)],
        "id int, content binary, source_encoding string, source_has_bom boolean")
    return convert(df, target, **options).orderBy("id").collect()


FORMS = [("us-ascii", False)] + [(name, mark) for name in ("utf-8", "utf-16", "utf-16BE", "utf-32", "utf-32BE") for mark in (False, True)]
# every form into every form; ASCII text is told from UTF-8 only by a mark
MATRIX = [(source, mark, target + "-bom" * to, ASCII if "us-ascii" in (source, target) else MULTI)
          for source, mark in FORMS for target, to in FORMS if not (target == "us-ascii" and source == "utf-8" and not mark)]


@pytest.mark.parametrize("target", sorted({m[2] for m in MATRIX}))
def test_matrix_of_sources_and_targets(spark, target):
    """Detected and converted, the exact bytes come out."""
    cases = [m for m in MATRIX if m[2] == target]
    sources = [(BOM_OF.get(s, b"") if b else b"") + t.encode(CODEC_OF[s]) for s, b, _, t in cases]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(sources)], "id int, content binary")
    rows = audit(df, action="convert", target=target).orderBy("id").collect()
    base, bom = (target[:-4], True) if target.endswith("-bom") else (target, False)
    for row, (source, marked, _, text), original in zip(rows, cases, sources):
        assert row.source_has_bom == marked and row.result in ("Converted", "Unchanged")
        want = (BOM_OF[base] if bom else b"") + text.encode(CODEC_OF[base])
        got = original if row.result == "Unchanged" else bytes(row.conversion.output)
        assert got == want
        if row.result == "Converted":
            assert row.conversion.scalars_verified == len(text) and row.conversion.verification_passed
            assert row.conversion.sha256 == hashlib.sha256(text.encode("utf-16-le")).hexdigest()
            assert row.conversion.target_bytes == len(want) and row.conversion.source_bytes == len(original)


@pytest.mark.parametrize("text,target,code", [
    ("世界", "windows-1252", "UnicodeMismatch"), ("مرحبا", "windows-1252", "UnicodeMismatch"),
    ("Привет", "windows-1252", "UnicodeMismatch"), ("世界", "us-ascii", "TargetEncodeError"),
    ("café", "windows-1252", "None"), ("世界", "iso-8859-1", "TargetEncodeError"), ("a\x81b\x9d", "windows-1252", "None"),
    ("世界", "GB18030", "None"), ("안녕", "ks_c_5601-1987", "None"), ("日本", "shift_jis", "None"),
])
def test_what_a_target_cannot_hold(spark, text, target, code):
    row = run(spark, [(text.encode(), "utf-8", False)], target)[0]
    assert row.conversion.error_code == code and row.conversion.success == (code == "None")
    assert (row.conversion.output is None) == (code != "None")
    if code == "TargetEncodeError":
        assert f"U+{ord(text[0]):04X}" in row.diagnostic and row.diagnostic.startswith("TargetEncodeError: ")


def test_wrong_source_cut_tail_and_second_mark(spark):
    mark = b"\xef\xbb\xbf"
    rows = run(spark, [
        (MULTI.encode("utf-16-le"), "utf-8", False),      # not UTF-8 at all
        ("abc é".encode()[:-1], "utf-8", False),          # detection tolerates this, conversion does not
        (mark + mark + b"x", "utf-8", True),              # a second U+FEFF would read as a mark
        (b"x" * 300000 + b"\xff" + b"y" * 300000, "utf-8", False),
    ], "utf-8-bom")
    assert [r.conversion.error_code for r in rows[:2]] == ["SourceDecodeError"] * 2
    assert rows[1].conversion.source_bytes == 5 and rows[1].conversion.target_bytes == 3 + 4
    assert rows[2].result == "Unchanged"
    c = rows[3].conversion
    assert "offset 37856 within" in c.error_message and c.source_bytes == 524288 and c.target_bytes == 3 + 262144
    row = run(spark, [(mark + mark + b"x", "utf-8", True)], "utf-8")[0]
    assert row.conversion.error_code == "BomMismatch" and row.conversion.output is None


def test_mark_for_a_charset_without_one(spark):
    row = run(spark, [(b"abc", "utf-8", False)], "us-ascii-bom")[0]
    assert (row.result, row.conversion.error_code) == ("Error", "BomMismatch")


def test_emoji_is_one_scalar(spark):
    row = run(spark, [("before \U0001f30d after".encode(), "utf-8", False)], "utf-8-bom")[0]
    assert row.conversion.scalars_verified == 14


def test_ascii_to_utf8_is_converted_every_time(spark):
    df = spark.createDataFrame([(bytearray(b"plain"),)], "content binary")
    for _ in range(2):
        row = convert(with_source(df), "utf-8").first()
        assert (row.source_encoding, row.result, bytes(row.conversion.output)) == ("us-ascii", "Converted", b"plain")


@pytest.mark.parametrize("target", ["utf-8", "utf-16-bom", "utf-32BE", "us-ascii", "iso-8859-1"])
def test_built_in_path_equals_arrow_path(buffers, target):
    base = buffers(awkward()[:400])
    for source in ("utf-8", "us-ascii", "iso-8859-1"):
        df = base.withColumns({"source_encoding": F.lit(source), "source_has_bom": F.lit(False)})
        fields = ["id", "result", "diagnostic", "conversion.*"]
        a = convert(df, target).select(*fields)
        b = convert(df, target, built_in=False).select(*fields)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_prior_rows(spark):
    df = spark.createDataFrame([
        (1, bytearray(b"abc"), "(Unknown)", False, "kept", True), (2, bytearray(b"abc"), "no-such", False, "kept", True),
        (3, bytearray(b"abc"), "utf8", False, "kept", True), (4, bytearray(b"abc"), "UTF-8", False, "kept", True)],
        "id int, content binary, source_encoding string, source_has_bom boolean, target_encoding string, target_has_bom boolean")
    rows = convert(df, "utf-8", rerun=True).orderBy("id").collect()
    assert [(r.result, r.target_encoding, r.diagnostic) for r in rows] == [
        ("Skipped", "kept", None), ("Error", "kept", None), ("Converted", "utf-8", None), ("Unchanged", "utf-8", None)]


def test_dry_run_never_touches_content(spark):
    df = spark.createDataFrame([(1, "utf-16", False), (2, "(Unknown)", False)], "id int, source_encoding string, source_has_bom boolean")
    assert [r.result for r in convert(df, "utf-8", what_if=True).orderBy("id").collect()] == ["Converted", "Skipped"]


@pytest.mark.parametrize("options", [
    {"action": "convert"}, {"action": "convert", "target": " "}, {"action": "convert", "target": "nope-bom"},
    {"action": "validate"}, {"action": "validate", "accepted": [" "]}, {"action": "explode"},
    {"action": "detect", "parallelism": 0}, {"action": "detect", "base": "/no/such/place"}, {"action": "detect", "base": " "},
])
def test_options_are_checked_first(options):
    with pytest.raises(ValueError):
        check_options(**options)


@pytest.mark.parametrize("name,charset", [
    ("UTF8", "utf-8"), ("utf-16le", "utf-16"), ("UTF-16BE", "utf-16BE"), ("tis-620", "windows-874"), ("iso-8859-11", "windows-874"),
    ("cp949", "ks_c_5601-1987"), ("ibm866", "cp866"), ("shift-jis", "shift_jis"), ("gb18030", "GB18030")])
def test_names(name, charset):
    assert resolve(name) == charset


def test_unsupported_names():
    for name in ("utf-7", "viscii", "euc-tw", "iso-8859-10", "X-ISO-10646-UCS-4-3412", ""):
        with pytest.raises(ValueError):
            resolve(name)
