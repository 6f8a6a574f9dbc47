"""The life cycle of event streams as events arrive: (log or progress)*, then one result
or error.

Each stream has two values of state, how many events it had and whether it ended, so
state stays a few bytes a stream however long it is. Events of one micro-batch are
taken in their order; a later batch must hold later events, as for any log that is read
as it grows. Sinks write each micro-batch under its number, so a batch that is run
again after a failure replaces what it wrote.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.events import KINDS, route

# The runner of stateful functions has the interpreter's own path only: it gets them as a whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("ended", T.BooleanType())])
#: The state store that state of this kind needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """Verdicts of a stream's events; with ``idle_ms``, also of streams that stay silent
    so long without having ended."""

    def __init__(self, order: list[str], idle_ms: int | None):
        self.order, self.idle_ms = order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("life", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, ended = self.state.get() if self.state.exists() else (0, False)
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        found = []
        for kind in events["what"]:
            terminal = kind in KINDS[2:]
            if ended and kind in KINDS:
                rule = "stream_duplicate_terminal" if terminal else "stream_non_terminal_after_terminal"
                found.append((*key, n, rule, f"/{n}"))
            ended, n = ended or terminal, n + 1
        self.state.update((n, ended))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(found, columns=["stream", "index", "rule", "pointer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, ended = self.state.get() if self.state.exists() else (0, False)
        rows = [] if ended else [(*key, n, "stream_missing_terminal", "")]
        yield pd.DataFrame(rows, columns=["stream", "index", "rule", "pointer"])

    def close(self) -> None:
        pass


def verdicts(events: DataFrame, stream: str, order: list[str], kind: str = "kind", idle_ms: int | None = None) -> DataFrame:
    """(stream, index, rule, pointer) for each event of a streaming table that breaks its
    stream's life cycle: the same rows as ``events.lifecycle`` gives of the whole table."""
    key = events.schema[stream].dataType
    out = T.StructType([T.StructField("stream", key), T.StructField("index", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("pointer", T.StringType())])
    narrow = events.select(F.col(stream), *[F.col(c) for c in order if c != stream], F.col(kind).alias("what"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    return narrow.groupBy(stream).transformWithStateInPandas(Lifecycle(order, idle_ms), out, "Append", mode)


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that :func:`verdicts` needs, if the session has another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def write_once(table: DataFrame, path: str, checkpoint: str, form: str = "parquet", **trigger) -> StreamingQuery:
    """A sink for a streaming table: each micro-batch is a folder of its own, which the
    same batch replaces if it is run again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.format(form).mode("overwrite").save(f"{path}/batch={number}")

    return table.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def emit(events: DataFrame, path: str, checkpoint: str, event: str = "event", kind: str = "kind", **trigger) -> StreamingQuery:
    """Route a streaming table's event texts: results to ``primary``, all else to
    ``diagnostic``, below ``path``, as lines of text by micro-batch."""

    def put(batch: DataFrame, number: int) -> None:
        routed = batch.select(F.col(event).alias("value"), route(F.col(kind)).alias("sink"))
        for sink in ("primary", "diagnostic"):
            routed.where(F.col("sink") == sink).select("value").write.mode("overwrite").text(f"{path}/{sink}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
