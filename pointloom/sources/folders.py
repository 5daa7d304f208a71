"""Folders for tables between steps: the cluster's shared one, or a temporary one on a local master without it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="pointloom-"))
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/pointloom-scans/{name}-{uuid.uuid4().hex}"
