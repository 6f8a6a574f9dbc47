"""Queries that replay a table as a stream, in several micro-batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..streaming import lifecycle
from .queries import EVENTS, _sql, events_sem, query

BATCHES = 4


def replayed(spark, table, order):
    """The table as a streaming one of ``BATCHES`` micro-batches by ranges of ``order``."""
    path, last = scratch_path(spark, "replay"), table.agg(F.max(order)).first()[0] or 0
    for i in range(BATCHES):  # one after another: a stream takes files in the order of their writing
        table.where(F.floor(F.col(order) * BATCHES / (last + 1)) == i).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(_sql["stream_lifecycle"])
def stream_lifecycle_replayed(spark, d):
    lifecycle.use_state_store(spark)
    stream = replayed(spark, events_sem(spark, d).select("event_id", "user_id", "kind").coalesce(1), "event_id")
    out = scratch_path(spark, "verdicts")
    lifecycle.write_once(lifecycle.verdicts(stream, "user_id", ["event_id"]), out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select(F.col("stream").alias("user_id"), F.col("index").cast("int").alias("index"), "rule", "pointer")


@query(f"SELECT CAST(event_id AS VARCHAR) AS event, CASE kind WHEN 'result' THEN 'primary' ELSE 'diagnostic' END AS sink FROM {EVENTS}")
def stream_emit_replayed(spark, d):
    stream = replayed(spark, events_sem(spark, d).select("event_id", F.col("event_id").cast("string").alias("event"), "kind").coalesce(1), "event_id")
    out = scratch_path(spark, "emitted")
    lifecycle.emit(stream, out, scratch_path(spark, "progress")).awaitTermination()
    read = lambda sink: spark.read.schema("value string").text(f"{out}/{sink}/batch=*").select(F.col("value").alias("event"), F.lit(sink).alias("sink"))
    return read("primary").union(read("diagnostic"))
