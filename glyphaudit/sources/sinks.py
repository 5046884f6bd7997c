"""Outputs: CSV report, tab-separated export, converted corpus, backup, and a plain file tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from ..functions.constants import CSV_HEADER
from ..operators.report import csv_columns, report_order, tab_line
from .tree import _child, _open


def write_csv_report(report: DataFrame, path: str, ordered: bool = True) -> None:
    """CSV files with the report header, in path order across and within files."""
    rows = report.orderBy(*report_order()) if ordered else report
    # two of the six header names are equal, which select and the CSV writer allow
    shaped = rows.select(*[c.alias(name) for c, name in zip(csv_columns(), CSV_HEADER)])
    (
        shaped.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
        .option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_csv_report(spark, path: str) -> DataFrame:
    """A written CSV report as report rows."""
    names = "path string, source_encoding string, source_bom string, target_encoding string, target_bom string, result string"
    raw = (
        spark.read.schema(names).option("header", True).option("escape", '"').option("multiLine", True)
        .option("enforceSchema", True).option("emptyValue", "").csv(path)
    )
    # an unquoted empty field is read as NULL
    return raw.select(
        F.coalesce("path", F.lit("")).alias("path"), "source_encoding", (F.col("source_bom") == "Yes").alias("source_has_bom"),
        "target_encoding", (F.col("target_bom") == "Yes").alias("target_has_bom"), "result",
    )


def write_tab_export(report: DataFrame, path: str) -> None:
    report.select(tab_line().alias("value")).write.mode("overwrite").text(path)


def write_converted(converted: DataFrame, path: str) -> None:
    """Converted bytes and their report columns; the commit of the write publishes all or nothing."""
    c = F.col("conversion")
    converted.filter("result = 'Converted'").select(
        "path", "source_encoding", "source_has_bom", "target_encoding", "target_has_bom", "result",
        c["source_bytes"].alias("source_bytes"), c["target_bytes"].alias("target_bytes"),
        c["scalars_verified"].alias("scalars_verified"), c["sha256"].alias("sha256"),
        c["output"].alias("content"),
    ).write.mode("overwrite").parquet(path)


def write_backup(planned: DataFrame, path: str) -> None:
    """Originals of the rows a dry run would convert, kept whatever becomes of the conversion.

    A plan still carries its contents, so this is a filter and never joins the corpus with itself. Samples are refused, and
    contents shorter or longer than their file stop the write.
    """
    if "content" not in planned.columns:
        raise ValueError("a backup needs whole contents, not samples")
    chosen = planned.filter("result = 'Converted'")
    if {"length", "modificationTime"} <= set(planned.columns):
        whole = F.length("content") == F.col("length")
        broken = F.raise_error(F.concat(F.lit("the content is not the whole file: "), "path")).cast("binary")
        chosen = chosen.withColumn("content", F.when(whole, F.col("content")).otherwise(broken))
    chosen.select("path", "content").write.mode("overwrite").parquet(path)


def _file_writer(base: str):
    def write_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = _open(base)
        made: set[str] = set()
        for batch in batches:
            out = []
            for rel, content in zip(batch.column("rel"), batch.column("content")):
                target = _child(root, rel.as_py())
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                # a retried or speculative task may write the same file: move a finished one into place
                part = f"{parent}/.{uuid.uuid4().hex}.glyphaudit.tmp"
                data = content.as_buffer() or b""
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, target)
                out.append({"rel": rel.as_py(), "length": len(data)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("rel", pa.string()), ("length", pa.int64())]))

    return write_many


def write_tree(df: DataFrame, base: str, rel: str = "rel", content: str = "content") -> DataFrame:
    """Write each row's bytes to ``base``/``rel``; lazily - the files appear when the result is consumed."""
    return df.select(F.col(rel).alias("rel"), F.col(content).alias("content")).mapInArrow(
        _file_writer(base), "rel string, length bigint"
    )
