"""Lossless conversion to one target charset, verified before a row counts as converted.

Rows whose source is ASCII, UTF-8 or ISO-8859-1 and decodes cleanly are converted and verified with
built-in expressions. Everything else - other charsets, and rows that will fail and need a diagnosis -
goes through one Arrow call. A row never fails the job: faults become ``error_code``/``error_message``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import once, transcode_facts
from ..functions.charsets import BOM_OF, canonical, resolve
from ..functions.constants import (
    CONVERT_CHUNK_BYTES, CONVERTED, ERROR, SKIPPED, UNCHANGED, UNKNOWN,
)
from ..functions.labels import split_label

# Charset names the built-in encode/decode functions take, by our charset name.
BUILT_IN = {
    "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "utf-8": "UTF-8",
    "utf-16": "UTF-16LE", "utf-16BE": "UTF-16BE", "utf-32BE": "UTF-32",
}

RESULT_FIELDS = [
    "success", "error_code", "error_message", "source_bytes", "target_bytes", "scalars_verified",
    "verification_passed", "bom_verified", "sha256", "output",
]


def needs_conversion(source: Column, source_bom: Column, target: str, want_bom: bool) -> Column:
    """Names are compared as given, ignoring case: an alias never equals its canonical name."""
    return ~((F.upper(source) == target.upper()) & (source_bom == F.lit(want_bom)))


def utf16_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-16LE"), 256)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("bigint")


def _fast_text(body: Column, source: Column) -> Column:
    """Decoded text for sources the JVM can decode safely; NULL otherwise."""
    s = body.cast("string")
    valid = F.is_valid_utf8(s)
    return (
        F.when((source == "utf-8") & valid, s)
        .when((source == "us-ascii") & valid & (F.char_length(s) == F.length(body)), s)
        .when(source == "iso-8859-1", F.decode(body, "ISO-8859-1"))
    )


def _fast_encodable(text: Column, target: str) -> Column:
    if target == "us-ascii":
        return F.char_length(text) == F.octet_length(text)
    if target == "iso-8859-1":
        return ~text.rlike(r"[^\u0000-\u00FF]")
    return F.lit(True)


def _fast_encode(text: Column, target: str) -> Column:
    return text.cast("binary") if target in ("utf-8", "us-ascii") else F.encode(text, BUILT_IN[target])


def _fast_decode(output: Column, target: str) -> Column:
    return output.cast("string") if target in ("utf-8", "us-ascii") else F.decode(output, BUILT_IN[target])


def transcode(
    df: DataFrame, content: str, source: Column, target: str, want_bom: bool, active: Column | None = None,
    into: str = "conversion", built_in: bool = True,
) -> DataFrame:
    """Add a result struct for rows where ``active`` holds (NULL elsewhere).

    ``source`` and ``target`` are canonical charset names; ``built_in=False`` sends every row through Arrow.
    """
    bom = BOM_OF.get(target, b"") if want_bom else b""
    if want_bom and not bom:
        return df.withColumn(into, F.when(active if active is not None else F.lit(True), _infeasible_bom(target)))
    go = F.coalesce(active if active is not None else F.lit(True), F.lit(False))
    body = F.when(
        (F.col("_source") == "utf-8") & F.startswith(F.col(content), F.lit(BOM_OF["utf-8"])),
        F.substring(content, 4, 2147483647),
    ).otherwise(F.col(content))
    staged = df.withColumn("_go", go).withColumn("_source", source)
    fast = built_in and target in BUILT_IN
    if fast:
        staged = staged.withColumn("_body", F.when(F.col("_go"), body))
        staged = staged.withColumn("_text", _fast_text(F.col("_body"), F.col("_source")))
        keep = _fast_encodable(F.col("_text"), target) & ~F.col("_text").startswith("\ufeff")
        staged = staged.withColumn("_text", F.when(keep, F.col("_text")))
        staged = staged.withColumn("_encoded", _fast_encode(F.col("_text"), target))
        text = F.col("_text")
    else:
        text = F.lit(None).cast("string")
    # staged as columns: each is referred to many times below
    staged = staged.withColumn("_slow", F.col("_go") & text.isNull())
    staged = staged.withColumn("_t", once(transcode_facts)(
        F.when(F.col("_slow"), F.col(content)), F.col("_source"), F.lit(target), F.lit(want_bom)
    ))
    staged = staged.withColumn("_code", F.when(
        F.col("_slow"), _code_of_facts(
            F.col("_t"), F.length(content), target, want_bom, F.col("_t.sha256") == F.col("_t.target_sha256"))
    ))
    result = F.when(F.col("_slow"), _from_facts(
        F.col("_t"), F.col("_code"), F.length(content), F.col("_source"), target, want_bom,
        F.length(F.col("_t.output")), F.col("_t.output")
    ))
    if fast:
        # read back and compare text with text, which implies equal digests
        staged = staged.withColumn("_same", _fast_decode(F.col("_encoded"), target) == text)
        result = F.when(text.isNotNull(), _from_text(text, F.col("_encoded"), F.col(content), bom)).otherwise(result)
    helper = ["_go", "_source", "_body", "_text", "_encoded", "_t", "_slow", "_code", "_same"]
    return staged.withColumn(into, result).drop(*helper)


def _struct(**fields: Column) -> Column:
    types = {
        "success": "boolean", "error_code": "string", "error_message": "string", "source_bytes": "bigint",
        "target_bytes": "bigint", "scalars_verified": "bigint", "verification_passed": "boolean",
        "bom_verified": "boolean", "sha256": "string", "output": "binary",
    }
    empty = {"source_bytes": F.lit(0), "target_bytes": F.lit(0), "scalars_verified": F.lit(0),
             "verification_passed": F.lit(False), "bom_verified": F.lit(False)}
    return F.struct(*[
        fields.get(name, empty.get(name, F.lit(None))).cast(types[name]).alias(name) for name in RESULT_FIELDS
    ])


def _infeasible_bom(target: str) -> Column:
    message = f"{target} has no byte-order mark, so none can be written"
    return _struct(success=F.lit(False), error_code=F.lit("BomMismatch"), error_message=F.lit(message))


def _from_text(text: Column, encoded: Column, content: Column, bom: bytes) -> Column:
    same = F.col("_same")
    return _struct(
        success=same,
        error_code=F.when(same, "None").otherwise("UnicodeMismatch"),
        error_message=F.when(~same, "decoded content differs from the source"),
        source_bytes=F.length(content),
        target_bytes=F.length(encoded) + len(bom),
        scalars_verified=F.char_length(text),
        verification_passed=same, bom_verified=F.lit(True), sha256=utf16_sha256(text),
        output=F.when(same, F.concat(F.lit(bom), encoded) if bom else encoded),
    )


def mismatch_message(scalars: Column, units: Column, target_scalars: Column, target_units: Column) -> Column:
    """Say whether the lengths differ or only the content does."""
    return F.when(
        units != target_units,
        F.format_string(
            "decoded length differs: source %d scalars (%d UTF-16 units), target %d scalars (%d UTF-16 units)",
            scalars, units, target_scalars, target_units,
        ),
    ).otherwise(F.format_string("decoded content differs: both have %d scalars", scalars))


def _code_of_facts(f: Column, size: Column, target: str, want_bom: bool, same: Column) -> Column:
    """Error code of a row that went through Arrow; the first fault in this order counts. ``same``: the target holds the source's text."""
    return (
        F.when(size.isNull(), "SourceReadError")
        .when(f.isNull(), "Unexpected")
        .when(f["decode_error_at"].isNotNull(), "SourceDecodeError")
        .when(f["encode_error_cp"].isNotNull(), "TargetEncodeError")
        .when(F.lit(target in BOM_OF) & (f["target_mark"] != F.lit(want_bom)), "BomMismatch")
        .when(f["target_decode_error_at"].isNotNull(), "TargetDecodeError")
        .when(~same, "UnicodeMismatch")
        .otherwise("None")
    )


def _from_facts(
    f: Column, code: Column, size: Column, source: Column, target: str, want_bom: bool, written: Column, output: Column,
) -> Column:
    """The result struct; ``size`` bytes were read, ``written`` is NULL where the output is incomplete."""
    body = size - f["source_mark"]
    at = f["decode_error_at"]
    # a sequence cut off by the end of the data is noticed by the empty read after the last chunk
    chunk_start = F.when(f["cut_tail"], body).otherwise(F.floor(at / CONVERT_CHUNK_BYTES) * CONVERT_CHUNK_BYTES)
    read = F.when(
        at.isNotNull(), f["source_mark"] + F.least(body, chunk_start + CONVERT_CHUNK_BYTES)
    ).otherwise(size)
    message = (
        F.when(code == "SourceReadError", "the content could not be read")
        .when(code == "Unexpected", F.format_string("no codec for %s", source))
        .when(code == "SourceDecodeError", F.format_string(
            "the source is not valid %s: invalid byte sequence (offset %d within the failing read chunk)",
            source, at - chunk_start))
        .when(code == "TargetEncodeError", F.format_string(
            f"character U+%04X cannot be represented by {target}", f["encode_error_cp"]))
        .when(code == "BomMismatch", F.lit(
            "the target lacks the expected byte-order mark" if want_bom
            else "the target unexpectedly starts with a byte-order mark"))
        .when(code == "TargetDecodeError", F.format_string(
            "the target could not be decoded again: invalid byte sequence (offset %d)", f["target_decode_error_at"]))
        .when(code == "UnicodeMismatch", mismatch_message(
            f["scalars"], f["units"], f["target_scalars"], f["target_units"]))
    )
    ok = code == "None"
    return _struct(
        success=ok, error_code=code, error_message=message,
        source_bytes=read,
        target_bytes=F.coalesce(written, f["partial_bytes"]),
        scalars_verified=F.when(ok, f["scalars"]).when(
            code == "UnicodeMismatch", F.least(f["scalars"], f["target_scalars"])).otherwise(0),
        verification_passed=ok,
        bom_verified=code.isin("None", "UnicodeMismatch", "TargetDecodeError"),
        sha256=f["sha256"],
        output=F.when(ok, output),
    )


def diagnostic(code: Column, message: Column) -> Column:
    return F.concat_ws(": ", code, message)


def convert(
    df: DataFrame, target_label: str, content: str = "content", what_if: bool = False, rerun: bool = False,
    built_in: bool = True,
) -> DataFrame:
    """Convert detected rows to ``target_label``.

    Needs ``source_encoding`` and ``source_has_bom``. Adds the target columns, ``result``, ``diagnostic`` and -
    except under ``what_if``, which plans without touching the content - the struct ``conversion`` whose
    ``output`` holds the converted bytes. With ``rerun`` the rows come from an earlier report: rows that cannot
    be tried keep the target columns they arrived with. A file's row (with ``length`` and ``modificationTime``) whose content is
    not as long as the file is an error.
    """
    base, want_bom = split_label(target_label)
    target = resolve(base)
    if not what_if:
        if content == "sample":
            raise ValueError("samples cannot be converted: read the whole files")
        if {"length", "modificationTime"} <= set(df.columns):  # a file's row: all of its bytes must be there
            df = df.withColumn(content, F.when(F.length(content) == F.col("length"), F.col(content)))
    unknown = F.col("source_encoding") == UNKNOWN
    charset = canonical(F.col("source_encoding"))
    needs = needs_conversion(F.col("source_encoding"), F.col("source_has_bom"), base, want_bom)
    kept_encoding, kept_bom = (
        ("target_encoding", "target_has_bom") if rerun else ("source_encoding", "source_has_bom")
    )
    staged = (
        df.withColumn("_charset", charset)
        .withColumn("_untried", F.coalesce(unknown | F.col("_charset").isNull(), F.lit(True)))
        .withColumn("_needs", F.coalesce(~F.col("_untried") & needs, F.lit(False)))
        .withColumn("target_encoding", F.when(F.col("_untried"), F.col(kept_encoding)).otherwise(F.lit(base)))
        .withColumn("target_has_bom", F.when(F.col("_untried"), F.col(kept_bom)).otherwise(F.lit(want_bom)))
    )
    if what_if:
        done, detail = F.lit(CONVERTED), F.lit(None).cast("string")
    else:
        staged = transcode(
            staged, content, F.col("_charset"), target, want_bom, F.col("_needs"), built_in=built_in
        )
        c = F.col("conversion")
        done = F.when(c["success"], CONVERTED).otherwise(ERROR)
        detail = F.when(~c["success"], diagnostic(c["error_code"], c["error_message"]))
    return (
        staged
        .withColumn(
            "result",
            F.when(unknown, SKIPPED).when(F.col("_untried"), ERROR)
            .when(F.col("_needs"), done).otherwise(UNCHANGED),
        )
        .withColumn("diagnostic", F.when(F.col("_needs"), detail))
        .drop("_needs", "_untried", "_charset")
    )
