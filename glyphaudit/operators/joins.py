"""Joins of report rows with selections, results and earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _outcomes(df: DataFrame, path: str) -> DataFrame:
    return df.select(F.col(path).alias("_path"), F.upper(path).alias("_key"),
                     *[F.col(c).alias(f"outcome_{c}") for c in df.columns if c != path])


def merge_outcomes(listed: DataFrame, outcomes: DataFrame, path: str = "path") -> DataFrame:
    """Outcome columns for listed rows; unmatched outcomes are dropped.

    Equal paths match. What is left on both sides matches ignoring case, but only where the folded path is unique on either
    side: paths that differ by case alone are never mixed up.
    """
    found = _outcomes(outcomes, path)
    exact = listed.join(found.drop("_key"), F.col(path) == F.col("_path")).drop("_path")
    once = lambda df: df.groupBy("_key").count().where("count = 1").select("_key")
    loose = listed.join(found.select("_path"), F.col(path) == F.col("_path"), "left_anti").withColumn("_key", F.upper(path))
    free = found.join(listed.select(F.col(path).alias("_path")), "_path", "left_anti").drop("_path")
    folded = loose.join(once(loose), "_key", "left_semi").join(free.join(once(free), "_key", "left_semi"), "_key").drop("_key")
    return exact.unionByName(folded)


def only_selected(df: DataFrame, selection: DataFrame, path: str = "path") -> DataFrame:
    return df.join(selection.select(path), path, "left_semi")


def corpus_of_report(report: DataFrame, corpus: DataFrame, path: str = "path") -> DataFrame:
    """Contents for the rows of an earlier report. The join is left to the optimizer, which knows the report's bytes."""
    return corpus.select(path, "content").join(report, path)
