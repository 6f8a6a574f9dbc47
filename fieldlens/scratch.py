"""Folders for what a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``. Unset:
    a temporary folder where all runs in one JVM, as in tests; an error on a cluster."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="fieldlens-"))
        top = _own[0]
    return f"{top.rstrip('/')}/fieldlens/{name}-{uuid.uuid4().hex}"
