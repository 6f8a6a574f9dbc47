"""Queries over the shared tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats, urls, validators
from ..operators import events as ev
from ..operators import frames
from ..sources.ini import read_ini


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores: a table of few bytes is read by a few tasks, and then
    long expressions over its rows would run in as few. By number, for partitions of few
    bytes would be put together again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, F.col(df.columns[0]))


def orders_sem(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("total_usd_cents"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ordered_epoch_ms"), F.concat(F.lit("sk-"), F.col("o_custkey").cast("string")).alias("customer_secret"))


def lineitem_sem(spark: SparkSession, d: str) -> DataFrame:
    line = _table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100).cast("long").alias("discount_percent"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("extended_usd_cents"), (F.col("l_quantity").cast("long") * F.col("l_partkey")).alias("payload_bytes"))


def events_sem(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    who, which = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "error").otherwise("log")
    url = F.concat(F.lit("https://u"), who, F.lit(":pw"), which, F.lit("@h/cb?k=1&token_secret="), which, F.lit("#a=1&b%5Fsecret=x"))
    return e.select("event_id", "user_id", "ts", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("created_epoch_ms"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"), url.alias("callback_url"), kind.alias("kind"))


ORDERS = "(SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, epoch_ms(o_orderdate) AS ms, o_custkey FROM orders)"
LINES = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * l_partkey AS b, CAST(round(l_discount * 100) AS BIGINT) AS p FROM lineitem)"
EVENTS = "(SELECT *, CAST(round(value * 10) AS BIGINT) AS ms, CASE event_type WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' ELSE 'log' END AS kind FROM events)"
CENTS = "CASE WHEN c < 0 THEN '-' ELSE '' END || {mark} || CAST(abs(c) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0')"
STAMP = "strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
BYTES = "CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1fMiB', b / 1048576.0) ELSE printf('%.1fGiB', b / 1073741824.0) END"
SECONDS = "regexp_replace(regexp_replace(CAST(CAST(ms / 1000.0 AS DECIMAL(18, 3)) AS VARCHAR), '0+$', ''), '\\.$', '.0') || 's'"
MS = f"CASE WHEN abs(ms) < 1000 THEN ms || 'ms' ELSE {SECONDS} END"

LONG = T.LongType()
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def _formatted(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.select(*keys, value.alias("text"))


@query(f"SELECT o_orderkey, {CENTS.format(mark=chr(39) + '$' + chr(39))} AS text FROM {ORDERS}")
def fmt_usd_cents(spark, d):
    return _formatted(orders_sem(spark, d), ["o_orderkey"], formats.readable(F.col("total_usd_cents"), LONG, "usd_cents", None))


@query(f"SELECT o_orderkey, {CENTS.format(mark=chr(39) + '€' + chr(39))} AS text FROM (SELECT o_orderkey, -c AS c FROM {ORDERS})")
def fmt_eur_cents(spark, d):
    return _formatted(orders_sem(spark, d), ["o_orderkey"], formats.readable(-F.col("total_usd_cents"), LONG, "eur_cents", None))


@query(f"SELECT o_orderkey, {CENTS.format(mark=chr(39) * 2)} || ' THB' AS text FROM {ORDERS}")
def fmt_code_cents(spark, d):
    return _formatted(orders_sem(spark, d), ["o_orderkey"], formats.readable(F.col("total_usd_cents"), LONG, "cents", "THB"))


@query(f"SELECT o_orderkey, CAST(c // 1000000 AS VARCHAR) || '.' || lpad(CAST(c % 1000000 AS VARCHAR), 6, '0') || ' USD' AS text FROM {ORDERS}")
def fmt_micro(spark, d):
    return _formatted(orders_sem(spark, d), ["o_orderkey"], formats.readable(F.col("total_usd_cents"), LONG, "micro", "USD"))


@query(f"SELECT o_orderkey, '-¥' || format('{{:,}}', c) AS text FROM {ORDERS}")
def fmt_jpy(spark, d):
    return _formatted(orders_sem(spark, d), ["o_orderkey"], formats.readable(-F.col("total_usd_cents"), LONG, "jpy", None))


@query(f"SELECT l_orderkey, l_linenumber, {BYTES} AS text FROM {LINES}")
def fmt_bytes(spark, d):
    return _formatted(lineitem_sem(spark, d), ["l_orderkey", "l_linenumber"], formats.readable(F.col("payload_bytes"), LONG, "bytes", None))


@query(f"SELECT event_id, {MS} AS text FROM {EVENTS}")
def fmt_ms(spark, d):
    return _formatted(events_sem(spark, d), ["event_id"], formats.readable(F.col("latency_ms"), LONG, "ms", None))


@query(f"SELECT event_id, ms || 'ns' AS ns, ms || 'μs' AS us, ms || 's' AS s, ms || ' minutes' AS minutes, ms || ' hours' AS hours, ms || ' days' AS days, ms || '%' AS percent, ms || 'msats' AS msats, ms || 'sats' AS sats FROM {EVENTS}")
def fmt_units(spark, d):
    kinds = ("ns", "us", "s", "minutes", "hours", "days", "percent", "msats", "sats")
    return events_sem(spark, d).select("event_id", *[formats.readable(F.col("latency_ms"), LONG, k, None).alias(k) for k in kinds])


@query(f"SELECT event_id, {STAMP.format(ms='(epoch_us(ts) // 1000)')} AS ms, {STAMP.format(ms='(epoch_us(ts) // 1000000 * 1000)')} AS s, {STAMP.format(ms='(epoch_us(ts) // 1000)')} AS ns FROM events")
def fmt_epoch(spark, d):
    at = F.col("created_epoch_ms")
    ns = F.concat(at.cast("string"), F.lit("000123"))
    return events_sem(spark, d).select("event_id", formats.readable(at, LONG, "epoch_ms", None).alias("ms"), formats.readable(F.floor(at / 1000), LONG, "epoch_s", None).alias("s"), formats.readable(ns, T.StringType(), "epoch_ns", None).alias("ns"))


@query("SELECT o_orderkey, regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(s AS DATE) IS NOT NULL AS ok FROM (SELECT o_orderkey, '2023-02-' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') AS s FROM orders)")
def valid_rfc3339_date(spark, d):
    text = F.concat(F.lit("2023-02-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"))
    return _table(spark, d, "orders").select("o_orderkey", validators.is_rfc3339_date(text).alias("ok"))


@query("SELECT o_orderkey, o_orderkey % 30 < 24 AND o_orderkey % 70 < 60 AS ok FROM orders")
def valid_rfc3339_time(spark, d):
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    return _table(spark, d, "orders").select("o_orderkey", validators.is_rfc3339_time(F.concat(two(30), F.lit(":"), two(70), F.lit(":00.5"))).alias("ok"))


@query("SELECT doc_id, regexp_matches(lang || '-' || source, '^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$') AS ok FROM documents")
def valid_bcp47(spark, d):
    return _table(spark, d, "documents").select("doc_id", validators.is_bcp47(F.concat_ws("-", "lang", "source")).alias("ok"))


@query("SELECT o_orderkey, CASE WHEN h > 23 THEN NULL WHEN h = 0 THEN 'UTC' ELSE '-' || lpad(CAST(h AS VARCHAR), 2, '0') || ':00' END AS text FROM (SELECT o_orderkey, o_orderkey % 30 AS h FROM orders)")
def norm_utc_offset(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", validators.normalize_utc_offset(F.concat(F.lit(" -"), (F.col("o_orderkey") % 30).cast("string"), F.lit(":00"))).alias("text"))


@query(f"SELECT o_orderkey, c AS total_usd_cents, ms AS ordered_epoch_ms, '***' AS customer_secret FROM {ORDERS}")
def redact_secret_columns(spark, d):
    return frames.redact(orders_sem(spark, d))


@query(f"SELECT o_orderkey, c AS total_usd_cents, ms AS ordered_epoch_ms, 'sk-' || o_custkey AS customer_secret FROM {ORDERS}")
def redact_off(spark, d):
    return frames.redact(orders_sem(spark, d), "off")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '***' END AS customer_secret FROM {ORDERS}")
def redact_null_secret(spark, d):
    odd = F.substring("customer_secret", 4, 99).cast("long") % 2 == 1
    return frames.redact(orders_sem(spark, d).withColumn("customer_secret", F.when(~odd, F.col("customer_secret")))).select("o_orderkey", "customer_secret")


@query("SELECT event_id, 'https://u' || user_id || ':***@h/cb?k=1&token_secret=***#a=1&b%5Fsecret=***' AS callback_url FROM events")
def redact_url_columns(spark, d):
    return frames.redact(events_sem(spark, d).select("event_id", "callback_url"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '***' WHEN 1 THEN '/cb?page=2' ELSE 'http://h/' END AS value_url FROM events")
def redact_url_field(spark, d):
    n = F.col("event_id") % 3
    value = F.when(n == 0, "user:pw@host").when(n == 1, "/cb?page=2").otherwise(" http://h/ ")
    return frames.redact(_table(spark, d, "events").select("event_id", value.alias("value_url")))


@query("SELECT conv_id, turn, text || ' see (https://u:***@h/p?a_secret=***), ok' AS text FROM conversations")
def redact_urls_in_text(spark, d):
    text = F.concat("text", F.lit(" see (https://u:pw@h/p?a_secret=1), ok"))
    return _table(spark, d, "conversations").select("conv_id", "turn", urls.redact_urls_in_text(text).alias("text"))


@query("SELECT event_id, '--api-key-secret *** --n 1 --x_secret=*** --y-secret --z' AS line FROM events")
def redact_argv(spark, d):
    which = F.col("event_id").cast("string")
    args = F.array(F.lit("--api-key-secret"), which, F.lit("--n"), F.lit("1"), F.concat(F.lit("--x_secret="), which), F.lit("--y-secret"), F.lit("--z"))
    return _table(spark, d, "events").select("event_id", F.array_join(urls.redact_argv(args), " ").alias("line"))


@query(f"SELECT o_orderkey, 'customer=*** o_orderkey=' || o_orderkey || ' ordered=' || {STAMP.format(ms='ms')} || ' total=' || {CENTS.format(mark=chr(39) + '$' + chr(39))} AS rendered FROM {ORDERS}")
def render_plain_orders(spark, d):
    return frames.render(orders_sem(spark, d), keep=["o_orderkey"])


@query(f"SELECT o_orderkey, 'customer_secret=*** o_orderkey=' || o_orderkey || ' ordered_epoch_ms=' || ms || ' total_usd_cents=' || c AS rendered FROM {ORDERS}")
def render_plain_raw(spark, d):
    return frames.render(orders_sem(spark, d), raw=True, keep=["o_orderkey"])


@query(f"""SELECT o_orderkey, '{{"o_orderkey":' || o_orderkey || ',"total_usd_cents":' || c || ',"ordered_epoch_ms":' || ms || ',"customer_secret":"***"}}' AS rendered FROM {ORDERS}""")
def render_json_orders(spark, d):
    return frames.render(orders_sem(spark, d), "json", keep=["o_orderkey"])


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'event_id=' || event_id || ' response_bytes=7 response_ms=' || ms ELSE 'event_id=' || event_id || ' response=' || ({MS}) || ' response_bytes=-5' END AS rendered FROM {EVENTS}")
def render_plain_collision(spark, d):
    size = F.when(F.col("event_id") % 2 == 0, F.lit(7)).otherwise(F.lit(-5)).cast("long")
    return frames.render(events_sem(spark, d).select("event_id", F.col("latency_ms").alias("response_ms"), size.alias("response_bytes")), keep=["event_id"])


@query("SELECT 'suffix_type_mismatch' AS rule_id, 'error' AS severity, '/total_usd_cents' AS pointer, 'total_usd_cents can''t be double' AS message, count(o_totalprice) AS rows FROM orders")
def lint_schema_findings(spark, d):
    odd = orders_sem(spark, d).withColumn("total_usd_cents", F.col("total_usd_cents").cast("double"))
    return frames.lint_columns(odd)


LIFECYCLE = f"""WITH e AS (SELECT user_id, kind, row_number() OVER w - 1 AS index,
  coalesce(max(CASE WHEN kind IN ('result', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(index AS INTEGER) AS index, CASE WHEN kind IN ('result', 'error') THEN 'stream_duplicate_terminal' ELSE 'stream_non_terminal_after_terminal' END AS rule, '/' || index AS pointer FROM e WHERE ended = 1"""


@query(LIFECYCLE)
def stream_lifecycle(spark, d):
    return ev.lifecycle(events_sem(spark, d), "user_id", ["ts", "event_id"])


@query(f"SELECT user_id, 'stream_missing_terminal' AS rule, '' AS pointer FROM {EVENTS} GROUP BY user_id HAVING max(CASE WHEN kind IN ('result', 'error') THEN 1 ELSE 0 END) = 0")
def stream_missing_terminal(spark, d):
    return ev.missing_terminal(events_sem(spark, d), "user_id")


@query(f"SELECT event_id, CASE WHEN kind = 'result' THEN 'primary' ELSE 'diagnostic' END AS sink FROM {EVENTS}")
def event_route(spark, d):
    return events_sem(spark, d).select("event_id", ev.route(F.col("kind")).alias("sink"))


@query("SELECT event_id FROM events WHERE starts_with(event_type, 'c') OR starts_with(event_type, 'pur')")
def log_filter(spark, d):
    return _table(spark, d, "events").where(ev.log_filter(F.col("event_type"), [" C", "pur", ""])).select("event_id")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'kind_unsupported' WHEN 2 THEN 'payload_missing' WHEN 3 THEN 'unexpected_field' ELSE 'error_code_invalid' END AS rule,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '/kind' WHEN 2 THEN '/log' WHEN 3 THEN '/more' ELSE '/error/code' END AS pointer FROM events""")
def event_validate_base(spark, d):
    texts = ['{"kind":"log","log":{},"trace":{}}', '{"kind":"other"}', '{"kind":"log"}', '{"kind":"log","log":1,"more":2}', '{"kind":"error","error":{"code":"","message":"m"}}']
    n = F.col("event_id") % 5
    text = F.when(n == 0, texts[0]).when(n == 1, texts[1]).when(n == 2, texts[2]).when(n == 3, texts[3]).otherwise(texts[4])
    found = ev.with_violation(_table(spark, d, "events").select("event_id", text.alias("event")), name="v")
    return found.select("event_id", "v.rule", "v.pointer")


CATALOG = [("error", "retry later"), ("view", "shown"), ("unused", "never")]


@query("SELECT event_id, code, meaning, meaning IS NOT NULL AS known FROM (SELECT event_id, event_type AS code FROM events) LEFT JOIN (VALUES ('error', 'retry later'), ('view', 'shown'), ('unused', 'never')) c(code, meaning) USING (code)")
def catalog_lookup(spark, d):
    known = spark.createDataFrame(CATALOG, "code string, meaning string")
    return ev.catalog_lookup(_table(spark, d, "events").select("event_id", F.col("event_type").alias("code")), known).select("event_id", "code", "meaning", "known")


@query("""SELECT c_custkey, CAST(line AS INTEGER) AS line, section, key, value FROM (
  SELECT c_custkey, 1 AS line, '' AS section, 'name' AS key, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 4, 'account', 'segment', c_mktsegment || ' = x' FROM customer
  UNION ALL SELECT c_custkey, 5, 'account', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)""")
def read_ini_entries(spark, d):
    text = F.concat(F.lit("name = "), F.col("c_name"), F.lit("\n; remark = none\n[ account ]\nsegment= "), F.col("c_mktsegment"), F.lit(" = x\r\n  nation ="), F.col("c_nationkey").cast("string"), F.lit("\n\n"))
    return read_ini(_table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text").drop("error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import command_queries, document_queries, more_queries, stream_queries  # noqa: F401  add their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import command_queries, document_queries, more_queries, stream_queries  # noqa: F401

    return dict(_sql)
