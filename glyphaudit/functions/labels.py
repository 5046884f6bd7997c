"""Charset labels: a base name with an optional "-bom" suffix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def label_has_bom(label: Column) -> Column:
    return F.lower(label).endswith("-bom")


def label_base(label: Column) -> Column:
    bare = F.substring(label, F.lit(1), F.char_length(label) - 4)
    return F.when(label_has_bom(label), bare).otherwise(label)


def format_label(base: Column, has_bom: Column) -> Column:
    return F.when(has_bom, F.concat(base, F.lit("-bom"))).otherwise(base)


def split_label(label: str) -> tuple[str, bool]:
    """Driver-side form for one literal label."""
    bom = label.lower().endswith("-bom")
    return (label[:-4] if bom else label), bom


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def effective_label(result: Column, source: Column, source_bom: Column, target: Column, target_bom: Column) -> Column:
    """What a row is encoded in after the run."""
    return F.when(result == "Converted", format_label(target, target_bom)).otherwise(
        format_label(source, source_bom)
    )
