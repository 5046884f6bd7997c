"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Batches sent to Python are cut by bytes, so rows of any length keep a worker's memory flat.
DEFAULTS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Detection and conversion chain several helpers: each is a worker beside every task, with a batch and its results in memory.
CHAINED = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def tune(spark: SparkSession, **first: str) -> SparkSession:
    """Set what the session leaves open; settings already made are kept. ``first`` go before the defaults."""
    for key, value in (first | {k: v for k, v in DEFAULTS.items() if k not in first}).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark
