"""Outcome of a scan without conversion: plain detection, or a check against an allow-list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import INVALID, SKIPPED, UNCHANGED, UNKNOWN
from ..functions.labels import format_label


MOST_LABELS = 10_000
KEY = "_label_key"


def allow_list(labels: Iterable[str] | DataFrame) -> list[str] | DataFrame:
    """Distinct upper-cased labels: a list up to ``MOST_LABELS``, a table of one column ``KEY`` beyond it."""
    if isinstance(labels, DataFrame):
        table = labels.select(F.upper(labels.columns[0]).alias(KEY)).where(f"{KEY} is not null").distinct()
        rows = table.limit(MOST_LABELS + 1).collect()
        return table if len(rows) > MOST_LABELS else sorted(r[KEY] for r in rows)
    names = sorted({label.upper() for label in labels})
    if not names:
        raise ValueError("the list of accepted charsets is empty")
    return names


def with_acceptance(df: DataFrame, labels: Iterable[str] | DataFrame, into: str) -> DataFrame:
    """Add whether each row's label is on the list; never for unknown rows.

    A short list is a filter expression, so no row is shuffled. A longer one is first met by the distinct labels of the rows, which are few, and what
    they have in common is met by the rows.
    """
    key = F.upper(format_label(F.col("source_encoding"), F.col("source_has_bom")))
    known = F.col("source_encoding") != UNKNOWN
    names = allow_list(labels)
    if isinstance(names, list):
        return df.withColumn(into, F.coalesce(key.isin(names) & known, F.lit(False)))
    keyed = df.withColumn(KEY, key)
    common = keyed.select(KEY).distinct().join(names, KEY, "left_semi").withColumn("_listed", F.lit(True))
    return keyed.join(common, KEY, "left").withColumn(into, F.coalesce(F.col("_listed") & known, F.lit(False))).drop(KEY, "_listed")


def accepted(df: DataFrame, labels: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose label is on the list."""
    return with_acceptance(df, labels, "_accepted").filter("_accepted").drop("_accepted")


def rejected(df: DataFrame, labels: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose label is not on the list; unknown rows are always rejected."""
    return with_acceptance(df, labels, "_accepted").filter("not _accepted").drop("_accepted")


def validate(df: DataFrame, labels: Iterable[str] | DataFrame) -> DataFrame:
    """Unchanged or Invalid per row; the target columns mirror the source."""
    return _mirror(with_acceptance(df, labels, "_accepted")).withColumn(
        "result", F.when(F.col("_accepted"), UNCHANGED).otherwise(INVALID)).drop("_accepted")


def report_detected(df: DataFrame) -> DataFrame:
    """Unchanged, or Skipped for rows of unknown encoding; the target columns mirror the source."""
    return _mirror(df).withColumn(
        "result", F.when(F.col("source_encoding") == UNKNOWN, SKIPPED).otherwise(UNCHANGED)
    )


def _mirror(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "target_encoding": F.col("source_encoding"), "target_has_bom": F.col("source_has_bom"),
    })
