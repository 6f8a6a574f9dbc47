"""Log events with the fields of the spans around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import cut

LEVELS = {"TRACE": "debug", "DEBUG": "debug", "INFO": "info", "WARN": "warn", "ERROR": "error"}


def overlaid(under: Column, over: Column) -> Column:
    """Two maps as one; where both have a key, ``over`` wins."""
    kept = F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.when(under.isNull(), over).when(over.isNull(), under).otherwise(F.map_concat(kept, over))


def inherit(spans: DataFrame, span: str = "span", parent: str = "parent", fields: str = "fields") -> DataFrame:
    """(span, fields): each span's fields with those of all spans around it, inner ones
    first. A round joins each span with the one that it has reached and doubles the
    way, so a depth of d takes log2(d) rounds. Spans whose parent isn't there are roots;
    a circle of parents is an error, and so is a span id that two rows have."""
    twice = spans.groupBy(span).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(span).head(5)
    if twice:
        raise ValueError(f"spans that repeat: {[r[0] for r in twice]}")
    own = spans.select(F.col(span).alias("_s"), F.col(parent).alias("_up"), F.col(fields).alias("_f"))
    for _ in range(64):
        own = cut(own)
        if own.where("_up is not null").isEmpty():
            return own.select(F.col("_s").alias(span), F.col("_f").alias(fields))
        above = own.select(F.col("_s").alias("_up"), F.col("_up").alias("_next"), F.col("_f").alias("_g"))
        own = own.join(above, "_up", "left").select("_s", F.col("_next").alias("_up"), overlaid(F.col("_g"), F.col("_f")).alias("_f"))
    raise ValueError("spans are their own parents")


def with_spans(events: DataFrame, spans: DataFrame, span: str = "span", fields: str = "fields") -> DataFrame:
    """Events, their fields over those of their spans."""
    around = spans.select(F.col(span), F.col(fields).alias("_around"))
    return events.join(around, span, "left").withColumn(fields, overlaid(F.col("_around"), F.col(fields))).drop("_around")


def log_record(fields: Column, level: Column, message: Column, at_ms: Column) -> Column:
    """A map of text: level, message and time win over fields with their names."""
    name = F.upper(level)
    shown = F.when(name.isin(*LEVELS), F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), name)).otherwise("info")
    said = F.when(F.length(message) > 0, message).otherwise("(no message)")
    own = F.create_map(F.lit("level"), shown, F.lit("message"), said, F.lit("timestamp_epoch_ms"), at_ms.cast("string"))
    return overlaid(fields, own)
