"""Where queries keep what they write: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below a local one if driver and executors are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{base.rstrip('/')}/corvane/{tag}-{uuid.uuid4().hex}"
