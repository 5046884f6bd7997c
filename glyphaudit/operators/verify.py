"""Digests, verification of stored output, stale-source check and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import once, transcode_facts
from ..functions.charsets import BOM_OF, resolve
from ..functions.labels import split_label
from .convert import mismatch_message, utf16_sha256, utf16_units

OUTCOME = ["source_encoding", "source_has_bom", "target_encoding", "target_has_bom", "result"]


def content_digest(text: Column) -> Column:
    """SHA-256 over UTF-16LE code units without normalisation, plus scalar and unit counts."""
    return F.struct(
        utf16_sha256(text).alias("sha256"),
        F.char_length(text).cast("bigint").alias("scalars"),
        utf16_units(text).alias("units"),
    )


def verify_stored(
    df: DataFrame, target_label: str, output: str, expected_bytes: str, expected: str, into: str = "verification"
) -> DataFrame:
    """Check stored bytes against what conversion reported: length, mark, decodability, digest - in that order.

    ``expected`` names a ``content_digest`` struct column of the source.
    """
    base, want_bom = split_label(target_label)
    target = resolve(base)
    staged = df.withColumn(
        "_d", once(transcode_facts)(F.col(output), F.lit(target), F.lit("utf-8"), F.lit(False))
    )
    d, e = F.col("_d"), F.col(expected)
    code = (
        F.when(F.length(output) != F.col(expected_bytes), "VerificationFailed")
        .when(F.lit(target in BOM_OF) & ((d["source_mark"] > 0) != F.lit(want_bom)), "BomMismatch")
        .when(d["decode_error_at"].isNotNull(), "TargetDecodeError")
        .when(d["sha256"] != e["sha256"], "UnicodeMismatch")
        .otherwise("None")
    )
    message = (
        F.when(code == "VerificationFailed", F.format_string(
            "stored %d bytes, expected %d", F.length(output), F.col(expected_bytes)))
        .when(code == "UnicodeMismatch", mismatch_message(
            e["scalars"], e["units"], d["scalars"], d["units"]))
    )
    result = F.struct(
        (code == "None").alias("success"), code.alias("error_code"), message.alias("error_message"),
        F.when(code == "None", e["scalars"]).when(
            code == "UnicodeMismatch", F.least(e["scalars"], d["scalars"])
        ).otherwise(F.lit(0)).cast("bigint").alias("scalars_verified"),
    )
    return staged.withColumn(into, result).drop("_d")


def stale_paths(read: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Paths whose file is gone or has another size or time than when it was read."""
    now = listing.select(
        F.col(path), F.col("length").alias("_length"), F.col("modificationTime").alias("_time"),
        F.lit(True).alias("_present"),
    )
    joined = read.select(path, "length", "modificationTime").join(now, path, "left")
    same = F.col("_present") & F.col("length").eqNullSafe(F.col("_length")) & F.col("modificationTime").eqNullSafe(
        F.col("_time")
    )
    return joined.filter(~F.coalesce(same, F.lit(False))).select(path)


def flag_stale_sources(converted: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Turn converted rows whose file changed since it was read into errors.

    ``listing`` is a fresh (path, length, modificationTime) listing. Only these narrow columns are joined to find
    the stale paths; the converted bytes are not shuffled unless very many files changed.
    """
    stale = stale_paths(converted, listing, path).withColumn("_stale", F.lit(True))
    hit = F.col("_stale").isNotNull() & (F.col("result") == "Converted")
    message = "SourceChangedDuringConversion: the source changed while it was being converted"
    return (
        converted.join(stale, path, "left")
        .withColumn("diagnostic", F.when(hit, message).otherwise(F.col("diagnostic")))
        .withColumn("result", F.when(hit, "Error").otherwise(F.col("result")))
        .drop("_stale")
    )


def compare_runs(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Rows present in only one run, or with a different outcome; empty when the runs agree."""
    a = left.select(path, *[F.col(c).alias(f"left_{c}") for c in OUTCOME], F.lit(True).alias("in_left"))
    b = right.select(path, *[F.col(c).alias(f"right_{c}") for c in OUTCOME], F.lit(True).alias("in_right"))
    same = F.lit(True)
    for c in OUTCOME:
        same = same & F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    joined = a.join(b, path, "full_outer")
    both = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return joined.filter(~(both & same)).select(
        path, F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
        *[F.col(f"{side}_{c}") for c in OUTCOME for side in ("left", "right")],
    )
