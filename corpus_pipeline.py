"""The corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next stage's documents. All but the last
return the columns of ``documents``. SQL cannot express the stages, so tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphaudit.llm.common import stored, table
from glyphaudit.llm.language_id import identified
from glyphaudit.llm.near_dup import FROM_80, without_near_duplicates
from glyphaudit.llm.packing import packed_stage
from glyphaudit.llm.repeats import without_repeats
from glyphaudit.llm.toxicity import without_toxic


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; linked are texts of likeness 0.8 or more."""
    return without_near_duplicates(spark, docs, sf_dir, FROM_80)


STAGES = [
    ("language_id", identified),
    ("toxicity", without_toxic),
    ("near_dup", near_dup),
    ("suffix_dedup", without_repeats),
    ("packing", packed_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
