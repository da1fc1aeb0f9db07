"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.abspath(tempfile.gettempdir())}/marktide-shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
