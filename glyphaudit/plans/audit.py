"""Whole jobs: corpus in, report out."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.charsets import resolve
from ..functions.constants import ERROR, FAILED, SAMPLE_BYTES
from ..functions.labels import split_label
from ..operators.code_pages import CodePageModel
from ..operators.convert import convert
from ..operators.detect import detect
from ..operators.report import as_report
from ..operators.validate import report_detected, validate
from ..sources.sinks import write_backup
from .session import tune

ACTIONS = ["detect", "validate", "convert"]


def check_options(
    action: str, base: str | None = None, target: str | None = None, accepted: Iterable[str] | None = None,
    parallelism: int | None = None,
) -> None:
    """Refuse impossible options before any row is read; a dry run is checked the same way."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action '{action}'")
    if base is not None:
        if not base.strip():
            raise ValueError("the base directory is empty")
        if "://" not in base and not os.path.isdir(base):
            raise ValueError(f"base directory '{base}' does not exist")
        if "://" not in base and os.path.islink(base):
            raise ValueError(f"base directory '{base}' is a symbolic link")
    if parallelism is not None and parallelism < 1:
        raise ValueError("parallelism must be at least 1")
    if action == "convert":
        if target is None or not target.strip():
            raise ValueError("convert needs a target charset")
        resolve(split_label(target)[0])
    if action == "validate" and not isinstance(accepted, DataFrame) and not [a for a in accepted or [] if a.strip()]:
        raise ValueError("validate needs at least one accepted charset")


def with_source(
    df: DataFrame, content: str = "content", sample_bytes: int = SAMPLE_BYTES, legacy: bool | CodePageModel = True,
) -> DataFrame:
    """Detected encoding as the report's source columns."""
    return detect(df, content, sample_bytes, legacy).withColumnsRenamed(
        {"charset": "source_encoding", "has_bom": "source_has_bom"}
    )


def audit(
    corpus: DataFrame, action: str = "detect", target: str | None = None,
    accepted: Iterable[str] | DataFrame | None = None, what_if: bool = False, content: str | None = None,
    legacy: bool | CodePageModel = True,
) -> DataFrame:
    """Detect every row of ``corpus`` and apply the action; all columns are kept.

    The bytes are in ``content``, or in ``sample`` where only prefixes were read; samples are detected, validated and planned
    for, never converted. ``legacy`` says how code pages are ranked (``operators.detect``). A row with a ``read_error`` becomes an error row instead of failing the job.
    """
    check_options(action, target=target, accepted=accepted)
    if content is None:
        content = "content" if "content" in corpus.columns or "sample" not in corpus.columns else "sample"
    if content == "sample" and action == "convert" and not what_if:
        raise ValueError("a corpus of samples cannot be converted: read the whole files")
    tune(corpus.sparkSession)
    readable = corpus
    errors = "read_error" in corpus.columns
    if errors:
        readable = corpus.withColumn(content, F.when(F.col("read_error").isNull(), F.col(content)))
    found = with_source(readable, content, legacy=legacy)
    if action == "validate":
        done = validate(found, accepted)
    elif action == "convert":
        done = convert(found, target, content, what_if)
    else:
        done = report_detected(found)
    if "diagnostic" not in done.columns:
        done = done.withColumn("diagnostic", F.lit(None).cast("string"))
    return mark_failed(done) if errors else done


def convert_corpus(corpus: DataFrame, target: str, folder: str) -> DataFrame:
    """One conversion job: the originals to ``folder``/backup, then every row's outcome with its bytes to ``folder``/result.

    The stored result is returned. Report (``as_report``), gate and corpus (``write_converted``) are read from it, so they agree with
    each other and the source is read once per stage; rows that failed stay in it.
    """
    write_backup(audit(corpus, "convert", target, what_if=True), f"{folder}/backup")
    audit(corpus, "convert", target).drop("content").write.mode("overwrite").parquet(f"{folder}/result")
    return corpus.sparkSession.read.parquet(f"{folder}/result")


def mark_failed(df: DataFrame) -> DataFrame:
    """Report columns of rows that could not be read."""
    bad = F.col("read_error").isNotNull()
    return df.withColumns({
        "source_encoding": F.when(bad, FAILED).otherwise(F.col("source_encoding")),
        "target_encoding": F.when(bad, FAILED).otherwise(F.col("target_encoding")),
        "source_has_bom": F.when(bad, False).otherwise(F.col("source_has_bom")),
        "target_has_bom": F.when(bad, False).otherwise(F.col("target_has_bom")),
        "result": F.when(bad, ERROR).otherwise(F.col("result")),
        "diagnostic": F.when(bad, F.col("read_error")).otherwise(F.col("diagnostic")),
    })


def audit_report(corpus: DataFrame, **options) -> DataFrame:
    return as_report(audit(corpus, **options))
