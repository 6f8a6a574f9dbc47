"""Event envelopes and the lifecycle of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json import whole_json
from ..functions.urls import let
from ..sources.text import read_json_or_lines
from .cuts import cut

# The kinds of events, terminal ones last.
KINDS = ("log", "progress", "result", "error")
# End of the fixed values.


def is_terminal(kind: Column) -> Column:
    return kind.isin(*KINDS[2:])


def _ended(events: DataFrame, stream: str, order: list[str], kind: str) -> DataFrame:
    """With _first, the place of the stream's first terminal event (null: none): an
    aggregate joined back, so no stream is gathered in one task."""
    place = F.struct(*[F.col(c) for c in order])
    first = events.where(is_terminal(F.col(kind))).groupBy(F.col(stream).alias("_stream")).agg(F.min(place).alias("_first"))
    return events.withColumn("_place", place).join(first, F.col(stream).eqNullSafe(F.col("_stream")), "left").drop("_stream")


def lifecycle(events: DataFrame, stream: str, order: list[str], kind: str = "kind") -> DataFrame:
    """A row for each event that breaks (log or progress)* then one result or error:
    stream, index (from 0), rule, pointer. ``order`` must tell the events of a stream
    apart. The index is a running count over range-partitioned events, so a stream
    with a third of all events spreads over a third of the tasks."""
    placed = numbered(_ended(events.select(stream, *order, F.col(kind).alias("_kind")), stream, order, "_kind"), stream, order, "index")
    late = placed.where((F.col("_place") > F.col("_first")) & F.col("_kind").isin(*KINDS))
    rule = F.when(is_terminal(F.col("_kind")), "stream_duplicate_terminal").otherwise("stream_non_terminal_after_terminal")
    return late.select(stream, F.col("index").cast("int").alias("index"), rule.alias("rule"), F.concat(F.lit("/"), F.col("index").cast("string")).alias("pointer"))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """With ``name``: how many rows of the same ``group`` come before, by ``order``.

    Rows are range-partitioned; a window numbers a group's rows of one partition, and
    what earlier partitions hold of it, at most one row for each group and partition,
    is added. Both read one table that is worked out once: the borders of the ranges
    come from a sample, and another run of it may have others.
    """
    ranged = cut(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1)
    counts = ranged.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before > 0").drop("_c")
    joined = ranged.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumn(name, F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_g", "_p", "_before")


def missing_terminal(events: DataFrame, stream: str, kind: str = "kind", streams: DataFrame | None = None) -> DataFrame:
    """Streams that never end; ``streams``: also those without any event."""
    ended = events.groupBy(stream).agg(F.max(is_terminal(F.col(kind)).cast("int")).alias("_ended"))
    if streams is not None:
        every = streams.select(stream).union(ended.select(stream)).distinct()
        ended = every.join(ended, stream, "left")
    return ended.where(F.coalesce("_ended", F.lit(0)) == 0).select(stream, F.lit("stream_missing_terminal").alias("rule"), F.lit("").alias("pointer"))


def route(kind: Column) -> Column:
    """Results go to the primary sink, all else to the diagnostic one."""
    return F.when(kind == "result", "primary").otherwise("diagnostic")


def log_filter(event: Column, filters: list[str]) -> Column:
    """Whether an event's name starts with one of the filters; ``all`` is every
    event, no filter is none."""
    wanted = sorted({f.strip().lower() for f in filters} - {""})
    if "all" in wanted:
        return F.lit(True)
    out = F.lit(False)
    for f in wanted:
        out = out | F.lower(event).startswith(f)
    return out


def _escaped(name: Column) -> Column:
    return F.concat(F.lit("/"), name)


def read_event(event: Column) -> Column:
    """A struct of what the rules look at, from an event's JSON text; parse it once,
    as a column of its own, before :func:`violation_of`."""
    return let(whole_json(event), _read)


def _read(v: Column) -> Column:
    kind_of = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.try_variant_get(v, path, "string")
    return F.struct(
        v.alias("v"),
        F.when(F.schema_of_variant(v).startswith("OBJECT"), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).alias("keys"),
        F.when(kind_of("$.kind") == "STRING", text("$.kind")).alias("kind"),
        kind_of("$.trace").startswith("OBJECT").alias("trace"),
        kind_of("$.error").startswith("OBJECT").alias("error"),
        F.when(kind_of("$.error.code") == "STRING", text("$.error.code")).alias("code"),
        F.when(kind_of("$.error.message") == "STRING", text("$.error.message")).alias("message"),
        kind_of("$.error.hint").alias("hint"),
        (kind_of("$.error.retryable") == "BOOLEAN").alias("retryable"),
    )


def violation_of(e: Column, strict: bool = False) -> Column:
    """The first rule that a read event breaks, as (rule, pointer), else null."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    kind, keys = e["kind"], e["keys"]
    is_error = kind == "error"
    extra = F.array_min(F.array_except(keys, F.array(F.lit("kind"), F.lit("trace"), kind)))
    has_trace = F.array_contains(keys, "trace")
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    rules = [
        (keys.isNull(), "event_not_object", F.lit("")),
        (kind.isNull(), "kind_invalid", F.lit("/kind")),
        (~kind.isin(*KINDS), "kind_unsupported", F.lit("/kind")),
        (~F.array_contains(keys, kind), "payload_missing", _escaped(kind)),
        (extra.isNotNull(), "unexpected_field", _escaped(extra)),
        (has_trace & ~yes(e["trace"]), "trace_not_object", F.lit("/trace")),
        (is_error & ~yes(e["error"]), "error_not_object", F.lit("/error")),
        (is_error & empty(e["code"]), "error_code_invalid", F.lit("/error/code")),
        (is_error & empty(e["message"]), "error_message_invalid", F.lit("/error/message")),
        (is_error & e["hint"].isNotNull() & (e["hint"] != "STRING"), "error_hint_invalid", F.lit("/error/hint")),
    ]
    if strict:
        rules += [(~yes(e["trace"]), "trace_required", F.lit("/trace")), (is_error & ~yes(e["retryable"]), "error_retryable_invalid", F.lit("/error/retryable"))]
    out = None
    for test, name, pointer in rules:
        found = F.struct(F.lit(name).alias("rule"), pointer.alias("pointer"))
        out = F.when(test, found) if out is None else out.when(test, found)
    return out


def violation(event: Column, strict: bool = False) -> Column:
    """The same of JSON text."""
    return let(read_event(event), lambda e: violation_of(e, strict))


def with_violation(df: DataFrame, event: str = "event", strict: bool = False, name: str = "violation") -> DataFrame:
    """The table with each event's first violation; a text is parsed once."""
    return _events(df, event).withColumn(name, violation_of(F.col("_event"), strict)).drop("_event")


def _events(df: DataFrame, event: str) -> DataFrame:
    return df.withColumn("_event", read_event(F.col(event)))


def validate_stream(df: DataFrame, stream: str, order: list[str], event: str = "event", strict: bool = False, streams: DataFrame | None = None) -> DataFrame:
    """(stream, rule, pointer): every violation of events and of their stream's life
    cycle. ``streams``: also those without any event, which lack a terminal one."""
    read = _events(df.select(stream, *order, event), event).select(stream, *order, F.col("_event.kind").alias("_kind"), violation_of(F.col("_event"), strict).alias("_broken"))
    read = cut(read)  # four readers below; a text is parsed once
    placed = numbered(_ended(read, stream, order, "_kind"), stream, order, "_index")
    late = F.when((F.col("_place") > F.col("_first")) & is_terminal(F.col("_kind")), "stream_duplicate_terminal").when((F.col("_place") > F.col("_first")) & F.col("_kind").isin(*KINDS[:2]), "stream_non_terminal_after_terminal")
    at = F.concat(F.lit("/"), F.col("_index").cast("string"))
    found = F.array(
        F.when(F.col("_broken").isNotNull(), F.struct(F.col("_broken.rule").alias("rule"), F.concat(at, F.col("_broken.pointer")).alias("pointer"))),
        F.when(late.isNotNull(), F.struct(late.alias("rule"), at.alias("pointer"))),
    )
    each = placed.select(stream, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")).select(stream, "_f.rule", "_f.pointer")
    return each.union(missing_terminal(read, stream, "_kind", streams))


def checked(event: Column) -> Column:
    """The event; a job with one that isn't strict fails."""
    return let(violation(event, strict=True), lambda v: F.when(v.isNull(), event).otherwise(F.raise_error(F.concat_ws(" ", v["rule"], v["pointer"]))))


def validate_texts(df: DataFrame, id_col: str, text_col: str, strict: bool = False, per_event: bool = False) -> DataFrame:
    """(id, rule, pointer): violations of texts. Lines, the elements of one array, or a
    lone log or progress event are a stream; any other value is one event alone. What
    can't be parsed is a row with the parser's code. ``per_event``: no life cycle."""
    read = read_json_or_lines(df, id_col, text_col).select(id_col, "line", "value", "error")
    is_array = F.schema_of_variant("value").startswith("ARRAY")
    several = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v, i: F.struct(i.cast("int").alias("seq"), v.alias("v")))
    one = F.array(F.struct(F.coalesce("line", F.lit(0)).alias("seq"), F.col("value").alias("v")))
    parts = F.explode(F.when(F.col("line").isNull() & is_array, several).otherwise(one)).alias("_p")
    lone = F.col("line").isNull() & ~F.coalesce(is_array, F.lit(False))
    events = read.where("error is null").select(id_col, lone.alias("_lone"), parts).select(id_col, "_lone", F.col("_p.seq").alias("_seq"), F.to_json("_p.v").alias("event"))
    kind = F.get_json_object("event", "$.kind")
    in_stream = ~F.col("_lone") | F.coalesce(kind.isin(*KINDS[:2]), F.lit(False))
    alone = with_violation(events.where(~in_stream if not per_event else F.lit(True)), strict=strict)
    # A lone event has no index; one of several keeps its own.
    at = F.when(F.col("_lone"), "").otherwise(F.concat(F.lit("/"), F.col("_seq").cast("string")))
    out = alone.where("violation is not null").select(id_col, F.col("violation.rule").alias("rule"), F.concat(at, F.col("violation.pointer")).alias("pointer"))
    bad = read.where("error is not null").select(id_col, F.col("error").alias("rule"), F.coalesce(F.concat(F.lit("/"), F.col("line").cast("string")), F.lit("")).alias("pointer"))
    out = out.union(bad)
    return out if per_event else out.union(validate_stream(events.where(in_stream), id_col, ["_seq"], strict=strict))


def decode(df: DataFrame, event: str = "event") -> DataFrame:
    """With ``decoded``: kind, payload and trace (variants), and of errors code, message,
    retryable, hint and the other fields; and ``error_code``: ``invalid_json`` or
    ``invalid_event`` where the text isn't one strict event."""
    read = df.withColumn("_event", read_event(F.col(event))).withColumn("_broken", violation_of(F.col("_event"), strict=True))
    v, kind = F.col("_event.v"), F.col("_event.kind")
    fields = F.map_filter(F.try_variant_get(v, "$.error", "map<string,variant>"), lambda k, _: ~k.isin("code", "message", "retryable", "hint"))
    at = lambda path, t: F.try_variant_get(v, path, t)
    payload = None
    for k in KINDS:
        payload = F.when(kind == k, at(f"$.{k}", "variant")) if payload is None else payload.when(kind == k, at(f"$.{k}", "variant"))
    is_error = kind == "error"
    decoded = F.struct(kind.alias("kind"), payload.alias("payload"), at("$.trace", "variant").alias("trace"), *[F.when(is_error, at(f"$.error.{k}", t)).alias(k) for k, t in (("code", "string"), ("message", "string"), ("retryable", "boolean"), ("hint", "string"))], F.when(is_error, fields).alias("fields"))
    bad = F.when(v.isNull(), "invalid_json").when(F.col("_broken").isNotNull(), "invalid_event")
    return read.withColumn("decoded", F.when(bad.isNull(), decoded)).withColumn("error_code", bad).drop("_event", "_broken")


_RESERVED = ("code", "message", "hint", "retryable")


def build_event(kind: str, payload: Column, trace: Column | None = None) -> Column:
    """JSON text of a result, progress or log event; ``trace``: a struct or map."""
    if kind not in KINDS[:3]:
        raise ValueError(f"no such kind of event: {kind}")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.to_json(F.struct(F.lit(kind).alias("kind"), payload.alias(kind), (none if trace is None else trace).alias("trace")), {"ignoreNullFields": "false"})


def build_error(code: Column, message: Column, retryable: Column | bool = False, hint: Column | None = None, fields: dict[str, Column] | None = None, trace: Column | None = None) -> Column:
    """JSON text of an error event, null where code or message is null or empty. An
    empty or null hint is left out; ``fields`` may not take the names of the others."""
    taken = set(fields or ()) & set(_RESERVED)
    if taken:
        raise ValueError(f"reserved fields: {sorted(taken)}")
    said = F.struct(code.alias("code"), message.alias("message"), (retryable if isinstance(retryable, Column) else F.lit(retryable)).alias("retryable"), F.when(F.length(F.lit(None).cast("string") if hint is None else hint) > 0, hint).alias("hint"))
    own = F.to_json(said)
    if fields:
        more = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
        own = F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substr(more, F.lit(2)))
    traced = F.lit("{}") if trace is None else F.to_json(trace, {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"kind":"error","error":'), own, F.lit(',"trace":'), traced, F.lit("}"))
    return F.when((F.length(code) > 0) & (F.length(message) > 0), text)


def build_cli_error(message: Column, hint: Column | None = None) -> Column:
    """An error event with the code ``cli_error``; never null: an empty message is named."""
    said = F.when(F.length(message) > 0, message).otherwise("unknown error")
    return build_error(F.lit("cli_error"), said, hint=hint)


def findings_event(findings: DataFrame, by: list[str], groups: DataFrame | None = None, with_findings: bool = False) -> DataFrame:
    """For each group of findings (severity, rule_id, pointer): ``kind`` error if any is
    an error, else result; ``ok``, which is true only without findings; and the counts of
    errors and warnings. ``groups``: also those without findings. ``with_findings``: the
    findings themselves, for groups as small as a document's."""
    is_error = (F.col("severity") == "error").cast("long")
    listed = [F.array_sort(F.collect_list(F.struct("pointer", "rule_id", "severity"))).alias("findings")] if with_findings else []
    rolled = findings.groupBy(*by).agg(F.sum(is_error).alias("errors"), F.sum(1 - is_error).alias("warnings"), *listed)
    if groups is not None:
        empty = F.array().cast("array<struct<pointer:string,rule_id:string,severity:string>>")
        rolled = groups.select(*by).distinct().join(rolled, by, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("errors", "warnings")} | ({"findings": F.coalesce("findings", empty)} if with_findings else {}))
    return rolled.withColumn("kind", F.when(F.col("errors") > 0, "error").otherwise("result")).withColumn("ok", F.col("errors") + F.col("warnings") == 0)


def catalog_lookup(events: DataFrame, catalog: DataFrame, code: str = "code") -> DataFrame:
    """Events with their code's catalogue entry; ``known`` tells whether there is one.
    A catalogue that has a code twice, or an empty one, is an error."""
    bad = catalog.groupBy(code).agg(F.count(F.lit(1)).alias("_c")).where((F.col("_c") > 1) | F.col(code).isNull() | (F.col(code) == "")).select(code).head(5)
    if bad:
        raise ValueError(f"codes that are empty or repeat in the catalogue: {[r[0] for r in bad]}")
    return events.join(catalog.withColumn("known", F.lit(True)), code, "left").withColumn("known", F.coalesce("known", F.lit(False)))
