"""Where a plan is cut: what is behind it is worked out once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The table, worked out once: as a checkpoint in the shared folder that the session
    names in ``spark.checkpoint.dir``, which survives lost executors; persisted where it
    names none, as in tests. Two readers of it see the same rows in the same tasks."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()
