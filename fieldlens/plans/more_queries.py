"""Queries for documents, lint, events, sources, spans and commands, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dynamic, formats, urls
from ..operators import commands, frames, lint, paths, sections, spans
from ..operators import events as ev
from ..sources import text as src
from ..sources.ini import read_ini
from .queries import EVENTS, ORDERS, _spread, _table, events_sem, orders_sem, query

DOUBLE = T.DoubleType()

# Formats and redaction


@query("SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS text FROM events")
def fmt_number_double(spark, d):
    return _table(spark, d, "events").select("event_id", formats.number(F.col("value"), DOUBLE).alias("text"))


@query("""SELECT event_id, CASE WHEN abs(ms) < 1000 THEN CASE WHEN ms = floor(ms) THEN CAST(CAST(ms AS BIGINT) AS VARCHAR) ELSE CAST(ms AS VARCHAR) END || 'ms'
  ELSE regexp_replace(regexp_replace(printf('%.3f', ms / 1000.0), '0+$', ''), '\\.$', '.0') || 's' END AS text FROM (SELECT event_id, value * 100.0 + event_id / 16.0 AS ms FROM events)""")
def fmt_ms_double(spark, d):
    ms = F.col("value") * 100.0 + F.col("event_id") / 16.0
    return _table(spark, d, "events").select("event_id", formats.readable(ms, DOUBLE, "ms", None).alias("text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id || 'sats' WHEN 1 THEN '-' || user_id || 'sats' END AS text FROM events")
def fmt_sats_text(spark, d):
    n = F.col("user_id").cast("string")
    value = F.when(F.col("event_id") % 3 == 0, n).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), n)).otherwise(F.concat(n, F.lit(".5")))
    return _table(spark, d, "events").select("event_id", formats.readable(value, T.StringType(), "sats", None).alias("text"))


@query("""SELECT event_id, '{"api_secret":"***","cb_url":"http://h/?a_secret=***","user":"' || user_id || '"}' AS text FROM events""")
def redact_map(spark, d):
    e = _table(spark, d, "events")
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("api_secret"), F.col("event_id").cast("string"), F.lit("cb_url"), F.concat(F.lit("http://h/?a_secret="), F.col("event_id").cast("string")))
    safe = frames.redact(e.select("event_id", m.alias("m")))
    return safe.select("event_id", frames.canonical_json(F.col("m"), safe.schema["m"].dataType).alias("text"))


@query("""SELECT event_id, '{"a":[{"b_url":"http://u:***@h/?t_secret=***"}],"big":1.10,"n":null,"x_secret":"***"}' AS text FROM events""")
def redact_json(spark, d):
    which = F.col("event_id").cast("string")
    text = F.concat(F.lit('{"x_secret": {"k": '), which, F.lit('}, "a": [{"b_url": "http://u:'), which, F.lit("@h/?t_secret="), which, F.lit('"}], "n": null, "big": 1.10}'))
    return _table(spark, d, "events").select("event_id", dynamic.redact_json_text(text).alias("text"))


@query("SELECT event_id, 'https://u@x:***@h/?a%zz%5Fsecret=***&b=' || event_id AS url FROM events")
def redact_url_leaks(spark, d):
    which = F.col("event_id").cast("string")
    url = F.concat(F.lit("https://u@x:p@w"), which, F.lit("@h/?a%zz%5Fsecret="), which, F.lit("&b="), which)
    return _table(spark, d, "events").select("event_id", urls.redact_url(url).alias("url"))


@query("SELECT o_orderkey, 'sk-' || o_custkey AS customer_secret, '***' AS traced FROM orders")
def redact_trace_only(spark, d):
    df = orders_sem(spark, d).select("o_orderkey", "customer_secret", F.struct(F.col("customer_secret").alias("k_secret")).alias("trace"))
    return frames.redact(df, "trace_only").select("o_orderkey", "customer_secret", F.col("trace.k_secret").alias("traced"))


@query("SELECT event_id, starts_with(props, '{\"k\": 1') AS leak FROM events")
def redaction_canary(spark, d):
    hidden = F.concat(F.lit("x%73k-"), F.substring("props", 7, 1))
    return _table(spark, d, "events").select("event_id", lint.leaks(hidden, "sk-1").alias("leak"))


@query(f"""SELECT o_orderkey, '---' || chr(10) || 'customer_secret: "***"' || chr(10) || 'o_orderkey: ' || o_orderkey || chr(10) || 'ordered_epoch_ms: ' || ms || chr(10) || 'total_usd_cents: ' || c AS rendered FROM {ORDERS}""")
def render_yaml_orders(spark, d):
    return frames.render(orders_sem(spark, d), "yaml", keep=["o_orderkey"])


@query("""SELECT o_orderkey, 'items="{\\"a\\":' || o_orderkey || ',\\"b\\":\\"x\\"}" meta.size=1.0KiB meta.x=' || o_custkey AS rendered FROM orders""")
def render_plain_nested(spark, d):
    o = _table(spark, d, "orders")
    items = F.array(F.struct(F.lit("x").alias("b"), F.col("o_orderkey").alias("a")))
    meta = F.create_map(F.lit("x"), F.col("o_custkey").cast("string"), F.lit("size"), F.lit("1.0KiB"))
    return frames.render(o.select(items.alias("items"), meta.alias("meta"), "o_orderkey"), keep=["o_orderkey"]).select("o_orderkey", F.expr("replace(rendered, concat(' o_orderkey=', o_orderkey), '')").alias("rendered"))


# Lint


@query("""SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['/n_bytes'] WHEN 1 THEN ['/c_usd_cents', '/s/d_rfc3339_date'] WHEN 2 THEN ['/a_url'] ELSE ['/list/0/x_sats'] END) AS pointer FROM events""")
def lint_suffix_type(spark, d):
    k = F.col("event_id") % 4
    day = F.when(k == 1, "2023-02-30").otherwise("2023-02-28")
    df = _table(spark, d, "events").select("event_id", F.when(k == 0, -1).otherwise(1).cast("long").alias("n_bytes"), F.when(k == 1, 1.5).otherwise(2.0).alias("c_usd_cents"), F.struct(day.alias("d_rfc3339_date")).alias("s"), F.when(k == 2, "u:p@h").otherwise("/x").alias("a_url"), F.array(F.struct(F.when(k == 3, "1.5").otherwise("15").alias("x_sats"))).alias("list"))
    return lint.lint_values(df, ["event_id"], "error").where("rule_id = 'suffix_type_mismatch'").select("event_id", "pointer")


@query("SELECT event_id, unnest(['/price', '/user_password']) AS pointer, 'warning' AS severity FROM events WHERE event_id % 2 = 0")
def lint_missing_suffix(spark, d):
    even = F.col("event_id") % 2 == 0
    df = _table(spark, d, "events").select("event_id", F.when(even, F.col("value")).alias("price"), F.when(even, "x").alias("user_password"), F.lit("x").alias("api_key_secret"), F.lit("x").alias("amount"))
    return lint.lint_values(df, ["event_id"]).where("rule_id = 'missing_suffix'").select("event_id", "pointer", "severity")


@query("SELECT event_id, '/n' AS pointer FROM events WHERE event_id * 1000000000000 > 9007199254740991")
def lint_unsafe_integer(spark, d):
    df = _table(spark, d, "events").select("event_id", (F.col("event_id") * 1_000_000_000_000).alias("n"))
    return lint.lint_values(df, ["event_id"]).where("rule_id = 'unsafe_integer'").select("event_id", "pointer")


@query("SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def lint_exact_integer(spark, d):
    which = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(which, F.lit(".50e2"))).when(F.col("event_id") % 3 == 1, F.concat(which, F.lit("1e-1"))).otherwise(F.concat(which, F.lit("x")))
    return _table(spark, d, "events").select("event_id", lint.exact_integer(text).alias("ok"))


# Events

EVENT_TEXT = """CASE event_id % 6 WHEN 0 THEN '{"kind":"log","log":{"n":' || event_id || '},"trace":{}}' WHEN 1 THEN '{"kind":"result","result":' || user_id || ',"trace":{}}'
  WHEN 2 THEN '{"kind":"error","error":{"code":"c' || user_id || '","message":"m","retryable":true,"at":' || event_id || '},"trace":{}}'
  WHEN 3 THEN '{"kind":"progress","progress":null}' WHEN 4 THEN '{"kind":"error","error":{"code":"c","message":"m","hint":3}}' ELSE '{"kind":"log","log":1} ' || event_id END"""


def _texts(spark, d):
    return _spread(_table(spark, d, "events").select("event_id", "user_id", "ts")).select("event_id", "user_id", "ts", F.expr(EVENT_TEXT).alias("event"))


@query("SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'trace_required' WHEN 4 THEN 'error_hint_invalid' WHEN 5 THEN 'event_not_object' END AS rule, CASE event_id % 6 WHEN 3 THEN '/trace' WHEN 4 THEN '/error/hint' WHEN 5 THEN '' END AS pointer FROM events")
def event_validate_strict(spark, d):
    return ev.with_violation(_texts(spark, d), strict=True, name="v").select("event_id", "v.rule", "v.pointer")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"n":' || event_id || '}' WHEN 1 THEN CAST(user_id AS VARCHAR) END AS payload, CASE event_id % 6 WHEN 2 THEN 'c' || user_id END AS code,
  CASE event_id % 6 WHEN 2 THEN '{"at":' || event_id || '}' END AS fields, CASE event_id % 6 WHEN 5 THEN 'invalid_json' WHEN 3 THEN 'invalid_event' WHEN 4 THEN 'invalid_event' END AS error_code FROM events""")
def event_decode(spark, d):
    e = ev.decode(_texts(spark, d))
    payload = F.when(F.col("decoded.kind") != "error", F.to_json("decoded.payload"))
    return e.select("event_id", payload.alias("payload"), "decoded.code", F.to_json("decoded.fields").alias("fields"), "error_code")


@query("""SELECT event_id, '{"kind":"progress","progress":{"n":' || event_id || '},"trace":{}}' AS progress,
  CASE WHEN event_id % 2 = 0 THEN '{"kind":"error","error":{"code":"' || event_type || '","message":"m","retryable":true,"hint":"h","user":' || user_id || '},"trace":{}}' END AS error FROM events""")
def event_build(spark, d):
    message = F.when(F.col("event_id") % 2 == 0, "m").otherwise("")
    e = _table(spark, d, "events")
    return e.select("event_id", ev.build_event("progress", F.struct(F.col("event_id").alias("n"))).alias("progress"), ev.build_error(F.col("event_type"), message, True, F.lit("h"), {"user": F.col("user_id")}).alias("error"))


STREAM = f"""WITH t AS (SELECT event_id, user_id, ts, CASE event_id % 6 WHEN 0 THEN 'log' WHEN 1 THEN 'result' WHEN 2 THEN 'error' WHEN 3 THEN 'progress' WHEN 4 THEN 'error' END AS kind FROM events),
n AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(max(CASE WHEN kind IN ('result', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CASE event_id % 6 WHEN 4 THEN 'error_hint_invalid' ELSE 'event_not_object' END AS rule, '/' || i || CASE event_id % 6 WHEN 4 THEN '/error/hint' ELSE '' END AS pointer FROM n WHERE event_id % 6 > 3
UNION ALL SELECT user_id, CASE WHEN kind IN ('result', 'error') THEN 'stream_duplicate_terminal' ELSE 'stream_non_terminal_after_terminal' END, '/' || i FROM n WHERE ended = 1 AND kind IS NOT NULL
UNION ALL SELECT user_id, 'stream_missing_terminal', '' FROM n GROUP BY user_id HAVING max(CASE WHEN kind IN ('result', 'error') THEN 1 ELSE 0 END) = 0"""


@query(STREAM)
def stream_verdict(spark, d):
    return ev.validate_stream(_texts(spark, d), "user_id", ["ts", "event_id"])


@query(f"SELECT user_id, 'stream_missing_terminal' AS rule, '' AS pointer FROM {EVENTS} WHERE event_type <> 'purchase' AND kind <> 'error' GROUP BY user_id")
def stream_without_terminal(spark, d):
    return ev.missing_terminal(events_sem(spark, d).where("event_type <> 'purchase' and kind <> 'error'"), "user_id")


@query("SELECT event_type AS code, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view', 'unused') GROUP BY event_type")
def catalog_unknown(spark, d):
    known = spark.createDataFrame([("error", "retry later"), ("view", "shown"), ("unused", "never")], "code string, meaning string")
    found = ev.catalog_lookup(_table(spark, d, "events").select("event_id", F.col("event_type").alias("code")), known)
    return found.where("not known").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'result' ELSE 'error' END AS kind, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END)::BIGINT AS errors, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS warnings, false AS ok FROM events GROUP BY event_type")
def findings_rollup(spark, d):
    severity = F.when(F.col("event_type") == "click", "warning").otherwise("error")
    return ev.findings_event(_table(spark, d, "events").select("event_type", severity.alias("severity")), ["event_type"]).select("event_type", "kind", "errors", "warnings", "ok")


# Documents


def _order_documents(spark, d):
    """A JSON document for each order: its lines as a list with slugs."""
    line = F.struct(F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("slug"), F.col("l_partkey").alias("part"))
    lines = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.select("l_orderkey", F.to_variant_object(F.struct("lines", F.lit("k").alias("api.secret"), F.struct(F.lit("s").alias("a_secret")).alias("x"))).alias("doc"))


LISTED = "(SELECT l_orderkey, list(struct_pack(slug := 'l' || l_linenumber, part := l_partkey) ORDER BY 'l' || l_linenumber, l_partkey) AS v FROM lineitem GROUP BY l_orderkey)"


@query("SELECT event_id, json_extract_string(props, '$.k') AS value, CAST(NULL AS VARCHAR) AS error, 'document_path_not_found' AS missing, 'document_type_mismatch' AS through FROM events")
def path_value(spark, d):
    v = _table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    k = paths.scalar(F.col("v"), "k")
    return v.select("event_id", k["value"].alias("value"), k["error"].alias("error"), paths.get(F.col("v"), "z.y")["error"].alias("missing"), paths.get(F.col("v"), "k.y")["error"].alias("through"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, 'document_type_mismatch' AS error FROM events")
def path_typed(spark, d):
    v = _table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", paths.typed(F.col("v"), "k", "bigint")["value"].alias("n"), paths.typed(F.col("v"), "k", "array<int>")["error"].alias("error"))


@query(f"SELECT l_orderkey, 'lines.' || i || '.part' AS path, CAST(v[i + 1].part AS VARCHAR) AS value FROM (SELECT l_orderkey, v, unnest(range(0, len(v))) AS i FROM {LISTED})")
def path_values_wildcard(spark, d):
    return paths.values(_order_documents(spark, d), "doc", "lines.*.part", ["l_orderkey"]).select("l_orderkey", "path", F.to_json("value").alias("value"))


@query(f"""SELECT l_orderkey, 0 AS number, 'lines.' || i || '.part' AS path, CAST(v[i + 1].part AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM (SELECT l_orderkey, v, unnest(range(0, len(v))) AS i FROM {LISTED})
UNION ALL SELECT l_orderkey, 1, 'lines.1.slug', v[2].slug, CASE WHEN len(v) < 2 THEN 'document_path_not_found' END FROM {LISTED}
UNION ALL SELECT l_orderkey, 2, 'api\\.secret', 'k', NULL FROM {LISTED} UNION ALL SELECT l_orderkey, 3, 'x.a_secret', NULL, 'document_secret_redacted' FROM {LISTED}
UNION ALL SELECT l_orderkey, 4, 'lines', NULL, 'document_not_scalar' FROM {LISTED}""")
def path_values_many(spark, d):
    patterns = ["lines.*.part", "lines.1.slug", "api\\.secret", "x.a_secret", "lines"]
    return paths.scalars(_order_documents(spark, d), "doc", patterns, ["l_orderkey"])


@query("SELECT DISTINCT l_orderkey, unnest(['api.secret', 'lines', 'x']) AS name, unnest(['api\\.secret', 'lines', 'x']) AS path, CAST(NULL AS VARCHAR) AS error FROM lineitem")
def path_children(spark, d):
    return paths.children(_order_documents(spark, d), "doc", ["l_orderkey"])


@query(f"SELECT l_orderkey, CASE WHEN n = 1 THEN CAST(part AS VARCHAR) END AS part, CASE WHEN n = 0 THEN 'document_slug_not_found' WHEN n > 1 THEN 'document_ambiguous_match' END AS error FROM (SELECT l_orderkey, len(list_filter(v, lambda x: x.slug = 'l2')) AS n, list_filter(v, lambda x: x.slug = 'l2')[1].part AS part FROM {LISTED})")
def keyed_lookup(spark, d):
    got = paths.scalar(F.col("doc"), "lines.l2.part", {"lines": "slug"})
    # A column of its own is worked out once; two fields of an expression are two look-ups.
    return _order_documents(spark, d).select("l_orderkey", got.alias("g")).select("l_orderkey", F.col("g.value").alias("part"), "g.error")


@query(f"SELECT l_orderkey, CASE WHEN len(v) = 1 THEN v[1].slug END AS slug, len(v) > 1 AS ambiguous FROM {LISTED}")
def keyed_ambiguous(spark, d):
    at = paths.matches(F.col("lines"), "slug", "L", contains=True)
    lines = _order_documents(spark, d).select("l_orderkey", F.try_variant_get("doc", "$.lines", "variant").alias("lines"))
    return lines.select("l_orderkey", F.when(F.size(at) == 1, F.try_variant_get("lines", "$[0].slug", "string")).alias("slug"), (F.size(at) > 1).alias("ambiguous"))


@query(f"SELECT l_orderkey, CASE WHEN i > 0 THEN 'lines.' || (i - 1) || '.part' END AS path FROM (SELECT l_orderkey, coalesce(list_position(list_transform(v, lambda x: x.slug), 'l2'), 0) AS i, len(list_filter(v, lambda x: x.slug = 'l2')) AS n FROM {LISTED}) WHERE n < 2")
def path_resolve(spark, d):
    got = paths.resolve(F.col("doc"), "lines.l2.part", {"lines": "slug"})
    # A filter would be pushed below the look-up and take it twice; an empty list gives no row.
    kept = urls.let(got, lambda g: F.when(~g["error"].eqNullSafe(F.lit(paths.AMBIGUOUS)), F.array(g)))
    return _order_documents(spark, d).select("l_orderkey", F.explode(kept).alias("g")).select("l_orderkey", F.col("g.value").alias("path"))


@query("SELECT DISTINCT l_orderkey, '\"***\"' AS shown, 'document_secret_redacted' AS refused, 's' AS revealed FROM lineitem")
def path_secret(spark, d):
    at = "x.a_secret"
    v = F.col("doc")
    return _order_documents(spark, d).select("l_orderkey", paths.shown(v, at)["value"].alias("shown"), paths.scalar(v, at)["error"].alias("refused"), paths.scalar(v, at, reveal=True)["value"].alias("revealed"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS as_bool, CASE event_id % 4 WHEN 2 THEN '15' END AS as_number, event_id % 4 = 3 AS may FROM events")
def coerce_values(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "YES").when(k == 1, "off").when(k == 2, "15").otherwise("007")
    old = F.when(k == 3, F.parse_json(F.lit('"s"'))).otherwise(F.parse_json(F.lit("1")))
    return _table(spark, d, "events").select("event_id", F.to_json(paths.coerce(text, "bool")["value"]).alias("as_bool"), F.to_json(paths.coerce(text, "number")["value"]).alias("as_number"), paths.may_overwrite(old).alias("may"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"a":{"b":' || o_custkey || '}}' AS text FROM orders""")
def doc_edit(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    edited = paths.unset_field(paths.set_field(paths.set_field(o, "a.b", F.col("o_custkey")), "a.c.d", F.lit(1)), "a.c").drop("o_custkey")
    return edited.select("o_orderkey", F.to_json(F.struct("*")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 3 END AS n_added, CASE WHEN o_orderkey % 2 = 0 THEN 'document_slug_exists' END AS add_error, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS n_left, CASE WHEN o_orderkey % 2 = 1 THEN 'document_slug_not_found' END AS remove_error FROM orders")
def doc_edit_keyed(spark, d):
    element = lambda slug: F.struct(slug.alias("slug"), F.col("o_custkey").alias("v"))
    slug = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("c")
    o = _table(spark, d, "orders").withColumn("l", F.array(element(F.lit("a")), element(F.lit("b"))))
    added, removed = paths.add_keyed(F.col("l"), "slug", slug, element(F.lit(""))), paths.remove_keyed(F.col("l"), "slug", slug)
    size = lambda x: F.when(x.isNotNull(), F.size(x))
    return o.select("o_orderkey", size(added["value"]).alias("n_added"), added["error"].alias("add_error"), size(removed["value"]).alias("n_left"), removed["error"].alias("remove_error"))


# Sources


@query("""SELECT c_custkey, CAST(1 AS INTEGER) AS line, '{"n":' || c_custkey || '}' AS value, CAST(NULL AS VARCHAR) AS error FROM customer
  UNION ALL SELECT c_custkey, 3, '"' || c_name || '"', NULL FROM customer UNION ALL SELECT c_custkey, 4, NULL, 'jsonl_parse_failed' FROM customer""")
def read_jsonl(spark, d):
    text = F.concat(F.lit('{"n": '), F.col("c_custkey").cast("string"), F.lit('}\n \n"'), F.col("c_name"), F.lit('"\n{"broken\n'))
    return src.read_json_or_lines(_spread(_table(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", text.alias("text")), "c_custkey", "text").select("c_custkey", "line", F.to_json("value").alias("value"), "error")


@query("""SELECT c_custkey, unnest(['NAME', 'SEGMENT', 'NATION']) AS key, unnest([c_name || chr(10) || 'x', c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer""")
def read_dotenv(spark, d):
    text = F.concat(F.lit('# it isn\'t\nexport NAME="'), F.col("c_name"), F.lit('\\nx" # c\nSEGMENT=\''), F.col("c_mktsegment"), F.lit("'\nNATION="), F.col("c_nationkey").cast("string"), F.lit(" # n\n"))
    return src.read_dotenv(_table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text").select("c_custkey", "key", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'name: ' || c_name || chr(10) END AS front, CASE WHEN c_custkey % 2 = 0 THEN 'body' END AS body, CASE WHEN c_custkey % 2 = 1 THEN 'frontmatter_unterminated' END AS error FROM customer")
def read_frontmatter(spark, d):
    end = F.when(F.col("c_custkey") % 2 == 0, "--- \nbody").otherwise(" ---\nbody")
    text = F.concat(F.lit("---\nname: "), F.col("c_name"), F.lit("\n"), end)
    return _table(spark, d, "customer").select("c_custkey", src.split_frontmatter(text, "---").alias("f")).select("c_custkey", "f.front", "f.body", "f.error")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'duplicate_section' WHEN 1 THEN 'missing_value' WHEN 2 THEN 'duplicate_key' ELSE 'section_is_root_key' END AS error, CAST(CASE c_custkey % 4 WHEN 1 THEN 1 ELSE 3 END AS INTEGER) AS line FROM customer")
def read_ini_errors(spark, d):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("[a]\nx="), F.col("c_name"), F.lit("\n[a]"))).when(k == 1, F.col("c_name")).when(k == 2, "[a]\nx=1\nx=2").otherwise("a=1\n\n[a]")
    return read_ini(_table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text").select("c_custkey", "error", "line")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'dotenv' END AS format, CASE p_partkey % 4 WHEN 0 THEN 'file+json' WHEN 1 THEN 'env' END AS source FROM part")
def detect_formats(spark, d):
    k = F.col("p_partkey") % 4
    name = F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.when(k == 0, ".JSON").when(k == 1, ".yml").when(k == 2, "/.env.local").otherwise(".md"))
    value = F.when(k == 0, F.concat(F.lit("file+json:"), name)).when(k == 1, "env:HOME").otherwise("fd:2")
    return _table(spark, d, "part").select("p_partkey", src.detect_format(name).alias("format"), src.classify_source(value)["kind"].alias("source"))


# Spans, sections, commands


@query("""SELECT c_custkey, r_name AS region, n_name AS nation, c_name AS name, 'info' AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def span_inherit(spark, d):
    region, nation, customer = (_table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    around = (
        region.select(key("r", "r_regionkey").alias("span"), none.alias("parent"), F.create_map(F.lit("region"), F.col("r_name"), F.lit("name"), F.col("r_name")).alias("fields"))
        .union(nation.select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.create_map(F.lit("nation"), F.col("n_name"), F.lit("name"), F.col("n_name"))))
    )
    logs = customer.select("c_custkey", key("n", "c_nationkey").alias("span"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("level"), F.lit("x")).alias("fields"))
    full = spans.with_spans(logs, spans.inherit(around)).select("c_custkey", spans.log_record(F.col("fields"), F.lit("INFO"), F.lit("m"), F.lit(1)).alias("f"))
    return full.select("c_custkey", *[F.col("f")[k].alias(k) for k in ("region", "nation", "name", "level")])


@query("""WITH b AS (SELECT n_regionkey AS doc, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS i FROM nation)
SELECT doc, i AS block_idx, CASE WHEN i % 3 = 1 THEN CASE WHEN i > 1 THEN 1 END ELSE CASE WHEN i % 3 = 2 THEN i - 1 ELSE i - 1 END END AS parent,
  CAST(CASE WHEN i = 1 THEN (SELECT max(i) FROM b x WHERE x.doc = b.doc) WHEN i % 3 = 0 THEN NULL WHEN i % 3 = 1 THEN least(i + 2, (SELECT max(i) FROM b x WHERE x.doc = b.doc)) ELSE least(i + 1, (SELECT max(i) FROM b x WHERE x.doc = b.doc)) END AS BIGINT) AS section_end FROM b""")
def section_tree(spark, d):
    # h1, then over and over: h3 (or, first, under the h1), text, h2.
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    blocks = _table(spark, d, "nation").select(F.col("n_regionkey").alias("doc"), at.alias("block_idx"))
    level = F.when(F.col("block_idx") == 1, 1).when(F.col("block_idx") % 3 == 1, 2).when(F.col("block_idx") % 3 == 2, 3)
    placed = sections.fold(blocks.withColumn("level", level).withColumn("source_end_line", F.col("block_idx").cast("long")), "doc")
    return placed.select("doc", "block_idx", "parent", "section_end")


@query("SELECT event_id AS call, CASE event_id % 3 WHEN 0 THEN 'set item' WHEN 1 THEN 'set' END AS command, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'x ' || event_type ELSE 'put item ' || event_type END AS rest FROM events")
def cli_select_command(spark, d):
    k = F.col("event_id") % 3
    argv = F.when(k == 0, F.array(F.lit("set"), F.lit("item"), F.col("event_type"))).when(k == 1, F.array(F.lit("set"), F.lit("x"), F.col("event_type"))).otherwise(F.array(F.lit("put"), F.lit("item"), F.col("event_type")))
    known = spark.createDataFrame([("get",), ("set",), ("set item",)], "command string")
    found = commands.select_command(_table(spark, d, "events").select(F.col("event_id").alias("call"), argv.alias("argv")), known)
    return found.select("call", "command", F.array_join("rest", " ").alias("rest"))
