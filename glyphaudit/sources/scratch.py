"""Shared scratch folder: the cluster's checkpoint folder, or a temporary one in local mode."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's own checkpoint folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="glyphaudit-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
