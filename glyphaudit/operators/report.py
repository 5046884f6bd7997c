"""Report rows: CSV lines, counts, gate, ordering, error listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import CONVERTED, ERROR, INVALID, RESULTS, UNCHANGED
from ..functions.labels import effective_label, format_label, yes_no
from ..sources.scratch import checkpoint_folder
from .paths import directory, extension, file_name

REPORT_COLUMNS = [
    "path", "source_encoding", "source_has_bom", "target_encoding", "target_has_bom", "result", "diagnostic",
]


def as_report(df: DataFrame, *also: str) -> DataFrame:
    """The report schema, whatever else the rows carry; ``also`` names columns to keep behind it."""
    if "diagnostic" not in df.columns:
        df = df.withColumn("diagnostic", F.lit(None).cast("string"))
    return df.select(*REPORT_COLUMNS, *also)


def union_reports(good: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows that went through and rows that failed, one per input."""
    return as_report(good).unionByName(as_report(failed))


def csv_field(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike('[,"\r\n]'), quoted).otherwise(v)


def csv_columns() -> list[Column]:
    """Report columns as they are written: flags as Yes/No, no diagnostic."""
    return [
        F.col("path"), F.col("source_encoding"), yes_no(F.col("source_has_bom")),
        F.col("target_encoding"), yes_no(F.col("target_has_bom")), F.col("result"),
    ]


def csv_line() -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in csv_columns()])


def count_by_result(report: DataFrame) -> DataFrame:
    return report.groupBy("result").agg(F.count("*").alias("n"))


def totals(report: DataFrame) -> DataFrame:
    """One row; absent results count 0."""
    return report.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("result") == r).alias(r.lower()) for r in RESULTS],
    )


def files_processed(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("files"))


def convert_summary(report: DataFrame) -> DataFrame:
    """Converted and failed rows; all others, skipped ones included, count as unchanged."""
    converted, failed = F.col("result") == CONVERTED, F.col("result") == ERROR
    return report.agg(
        F.count_if(converted).alias("converted"),
        F.count_if(~(converted | failed)).alias("unchanged"),
        F.count_if(failed).alias("failed"),
    )


def not_correct(report: DataFrame) -> DataFrame:
    """Rows that lack the correct encoding, errors included."""
    return report.agg(F.count_if(F.col("result") != UNCHANGED).alias("not_correct"))


def hide_passing(report: DataFrame) -> DataFrame:
    return report.filter(F.col("result") != UNCHANGED)


def gate(report: DataFrame, action: str, fail_on_changes: bool) -> DataFrame:
    """Status 3 on any error, 2 on a change the caller wants to fail on, else 0."""
    failed = F.coalesce(F.bool_or(F.col("result") == ERROR), F.lit(False))
    watched = {"validate": INVALID, "convert": CONVERTED}.get(action)
    changed = F.lit(False)
    if fail_on_changes and watched:
        changed = F.coalesce(F.bool_or(F.col("result") == watched), F.lit(False))
    return report.agg(F.when(failed, 3).when(changed, 2).otherwise(0).alias("status"))


def byte_totals(converted: DataFrame, total_bytes: Column) -> DataFrame:
    """Bytes read and written, scalars verified, percent of ``total_bytes`` done."""
    done, total = F.sum("source_bytes"), F.sum(total_bytes)
    return converted.agg(
        F.coalesce(done, F.lit(0)).alias("source_bytes"),
        F.coalesce(F.sum("target_bytes"), F.lit(0)).alias("target_bytes"),
        F.coalesce(F.sum("scalars_verified"), F.lit(0)).alias("scalars_verified"),
        F.when(total > 0, F.least(F.lit(100.0), done / total * 100.0)).otherwise(100.0).alias("percent"),
    )


def error_lines(report: DataFrame) -> DataFrame:
    shown = report.filter((F.col("result") == ERROR) & (F.col("diagnostic") != ""))
    return shown.select("path", F.concat(F.lit("Error: "), "path", F.lit(": "), "diagnostic").alias("line"))


def display_columns(report: DataFrame) -> DataFrame:
    return report.select(
        "*",
        format_label(F.col("source_encoding"), F.col("source_has_bom")).alias("label"),
        file_name(F.col("path")).alias("file_name"),
        extension(F.col("path")).alias("extension"),
        directory(F.col("path")).alias("directory"),
    )


def with_effective_label(report: DataFrame) -> DataFrame:
    return report.withColumn("label", effective_label(
        F.col("result"), F.col("source_encoding"), F.col("source_has_bom"),
        F.col("target_encoding"), F.col("target_has_bom"),
    ))


def tab_line() -> Column:
    """Label, tab, path with backslashes between directory and name."""
    path = F.concat(directory(F.col("path")), F.lit("\\"), file_name(F.col("path")))
    return F.concat(format_label(F.col("source_encoding"), F.col("source_has_bom")), F.lit("\t"), path)


def report_order() -> list[Column]:
    """Path, ignoring case by upper-casing (so ``_`` sorts after letters)."""
    return [F.upper("path"), F.col("path")]


def sort_rows(df: DataFrame, by: str, columns: list[str], descending: bool = False) -> list[Column]:
    """Sort keys: one column ignoring case, ties by the other columns in order; descending turns all."""
    keys = [F.collate(by, "UNICODE_CI")] + [F.col(c) for c in columns if c != by]
    return [k.desc() if descending else k.asc() for k in keys]


def with_position(df: DataFrame, keys: list[Column], into: str = "position") -> DataFrame:
    """Global 1-based position in sort order without bringing the rows into one task.

    The range-sorted rows are checkpointed, which pins their partitions; each partition then only needs the
    number of rows before it - one small row per partition.
    """
    checkpoint_folder(df.sparkSession)
    base = df.orderBy(*keys).withColumn("_slot", F.monotonically_increasing_id()).checkpoint()
    # monotonically_increasing_id puts the partition above bit 33 and counts from 0 below it
    part, inner = F.shiftright("_slot", 33), F.col("_slot").bitwiseAND((1 << 33) - 1)
    sizes = base.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    joined = base.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(into, F.col("_before") + inner + 1).drop("_part", "_slot", "_before")
