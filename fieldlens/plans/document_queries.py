"""Queries for VARIANT columns, JSON text kept byte for byte, and edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_text
from ..operators import frames, lint, sections
from ..sources import documents, ini
from ..sources import text as src
from .queries import _spread, _table, query

# An event as a document: its own properties, and secrets, URLs and units at some depth.


def _documents(spark, d):
    e = _spread(_table(spark, d, "events").select("event_id", "user_id", "event_type", "props"))
    who, which, n = F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_id") * 1000
    text = F.concat(
        F.lit('{"props":'), F.col("props"), F.lit(',"meta":{"api_secret":"sk-'), who, F.lit('","hops":[{"callback_url":"https://u:pw@h'), which, F.lit('/?token_secret=t'), who, F.lit('","took_ms":'), which,
        F.lit('}],"size_bytes":'), n.cast("string"), F.lit(',"price_usd_cents":'), who, F.lit('},"latency":'), who, F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'),
    )
    return e.select("event_id", "user_id", "event_type", F.parse_json(text).alias("doc"))


K = "CAST(json_extract(props, '$.k') AS VARCHAR)"
SAFE_META = """'{"api_secret":"***","hops":[{"callback_url":"https://u:***@h' || event_id || '/?token_secret=***","took_ms":' || event_id || '}],"price_usd_cents":' || user_id || ',"size_bytes":' || event_id * 1000 || '}'"""


@query(f"""SELECT event_id, '{{"kind":"' || event_type || '","latency":' || user_id || ',"meta":' || {SAFE_META} || ',"props":{{"k":' || {K} || '}}}}' AS doc FROM events""")
def redact_variant(spark, d):
    return frames.redact(_documents(spark, d).select("event_id", "doc")).select("event_id", F.to_json("doc").alias("doc"))


SIZE = "CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1fMiB', b / 1048576.0) ELSE printf('%.1fGiB', b / 1073741824.0) END"


@query(f"""SELECT event_id, 'doc.kind=' || event_type || ' doc.latency=' || user_id || ' doc.meta.api=*** doc.meta.hops="{{\\"callback_url\\":\\"https://u:***@h' || event_id || '/?token_secret=***\\",\\"took_ms\\":' || event_id
  || '}}" doc.meta.price=$' || user_id // 100 || '.' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || ' doc.meta.size=' || {SIZE} || ' doc.props.k=' || {K} AS line FROM (SELECT *, event_id * 1000 AS b FROM events)""")
def render_plain_variant(spark, d):
    docs = _documents(spark, d)
    return frames.render(docs.select("doc", "event_id"), "plain", keep=["event_id"]).select("event_id", F.regexp_replace("rendered", r" event_id=\d+\z", "").alias("line"))


@query(f"""SELECT event_id, '---' || chr(10) || 'doc:' || chr(10) || '  kind: "' || event_type || '"' || chr(10) || '  latency: ' || user_id || chr(10) || '  meta:' || chr(10) || '    api_secret: "***"' || chr(10) || '    hops:' || chr(10) || '      -' || chr(10)
  || '        callback_url: "https://u:***@h' || event_id || '/?token_secret=***"' || chr(10) || '        took_ms: ' || event_id || chr(10) || '    price_usd_cents: ' || user_id || chr(10) || '    size_bytes: ' || event_id * 1000 || chr(10)
  || '  props:' || chr(10) || '    k: ' || {K} || chr(10) || 'event_id: ' || event_id AS doc FROM events""")
def render_yaml_variant(spark, d):
    return frames.render(_documents(spark, d).select("doc", "event_id"), "yaml", keep=["event_id"]).select("event_id", F.col("rendered").alias("doc"))


@query("SELECT event_id, 'missing_suffix' AS rule_id, '/doc/latency' AS pointer FROM events")
def lint_variant(spark, d):
    return lint.lint_values(_documents(spark, d).select("event_id", "doc"), ["event_id"]).select("event_id", "rule_id", "pointer")


# Text kept byte for byte. ``props`` gets a number whose digits a parser would change.


def _texts(spark, d):
    e = _spread(_table(spark, d, "events").select("event_id", "user_id", "event_type", "props"))
    which = F.col("event_id").cast("string")
    text = F.concat(F.lit('{\n  "n": '), which, F.lit('.10,\n  "big": 1e400, "props": '), F.col("props"), F.lit(',\n  "list": [ 1,  1'), which, F.lit(" ]\n}\n"))
    return e.select("event_id", "user_id", "event_type", text.alias("text"))


TEXT = """'{' || chr(10) || '  "n": ' || event_id || '.10,' || chr(10) || '  "big": 1e400, "props": ' || props || ',' || chr(10) || '  "list": [ 1,  1' || event_id || ' ]' || chr(10) || '}' || chr(10)"""


@query(f"SELECT event_id, event_id || '.10' AS n, '1e400' AS big, {K} AS k, '1' || event_id AS last, 'document_path_not_found' AS error FROM events")
def json_literals(spark, d):
    found = _texts(spark, d).select("event_id", *[json_text.scalar(F.col("text"), p).alias(n) for n, p in (("n", "n"), ("big", "big"), ("k", "props.k"), ("last", "list.1"), ("none", "list.2"))])
    return found.select("event_id", F.col("n.value").alias("_n"), F.col("big.value").alias("_b"), F.col("k.value").alias("_k"), F.col("last.value").alias("_l"), F.col("none.error").alias("error")).select("event_id", F.col("_n").alias("n"), F.col("_b").alias("big"), F.col("_k").alias("k"), F.col("_l").alias("last"), "error")


@query(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id || '.10' WHEN 1 THEN {K} END AS value, CASE WHEN event_id % 3 = 2 THEN 'document_type_mismatch' END AS error FROM events")
def json_paths_by_row(spark, d):
    path = F.when(F.col("event_id") % 3 == 0, "n").when(F.col("event_id") % 3 == 1, "props.k").otherwise("n.x")
    return _texts(spark, d).select("event_id", json_text.get_by(F.col("text"), path).alias("g")).select("event_id", "g.value", "g.error")


@query(f"""SELECT event_id, replace(text, '"props": ' || props, '"props": ' || replace(props, '"k": ' || {K}, '"k": ' || user_id || '.50')) AS changed,
  replace(text, '  "n": ' || event_id || '.10,' || chr(10), '') AS shorter,
  replace(text, ' ]' || chr(10), ' ],' || chr(10) || '  "more": {{' || chr(10) || '    "who": "' || event_type || '"' || chr(10) || '  }}' || chr(10)) AS longer
FROM (SELECT *, {TEXT} AS text FROM events)""")
def json_edits(spark, d):
    t = F.col("text")
    kind = json_text.coerce(F.col("event_type"), "string")["value"]
    changed = json_text.set_value(t, "props.k", F.concat(F.col("user_id").cast("string"), F.lit(".50")))
    return _texts(spark, d).select("event_id", changed["value"].alias("changed"), json_text.unset(t, "n")["value"].alias("shorter"), json_text.set_value(t, "more.who", kind)["value"].alias("longer"))


INI = "'name = ' || c_name || chr(10) || '; kept' || chr(10) || '[ account ]' || chr(10) || 'segment= ' || c_mktsegment || chr(13) || chr(10) || chr(10) || '[other]' || chr(10) || 'x=1' || chr(10)"


@query(f"""SELECT c_custkey, replace(t, 'segment= ' || c_mktsegment, 'segment= s' || c_nationkey) AS changed, replace(t, c_mktsegment || chr(13) || chr(10), c_mktsegment || chr(13) || chr(10) || 'nation=' || c_nationkey || chr(13) || chr(10)) AS longer,
  replace(t, 'name = ' || c_name || chr(10), '') AS shorter FROM (SELECT *, {INI} AS t FROM customer)""")
def ini_edits(spark, d):
    text = F.concat(F.lit("name = "), F.col("c_name"), F.lit("\n; kept\n[ account ]\nsegment= "), F.col("c_mktsegment"), F.lit("\r\n\n[other]\nx=1\n"))
    nation, t = F.col("c_nationkey").cast("string"), F.col("t")
    docs = _spread(_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")).select("c_custkey", "c_nationkey", text.alias("t"))
    return docs.select("c_custkey", ini.set_ini(t, "account.segment", F.concat(F.lit("s"), nation))["value"].alias("changed"), ini.set_ini(t, "account.nation", nation)["value"].alias("longer"), ini.unset_ini(t, "name")["value"].alias("shorter"))


@query("""SELECT c_custkey, 'export NAME="' || c_name || ' x" # kept' || chr(10) || 'N=' || c_nationkey || chr(10) AS changed, 'export NAME=a # kept' || chr(10) || 'N=' || c_nationkey || chr(10) || 'S=' || c_mktsegment || chr(10) AS longer,
  'export NAME=a # kept' || chr(10) AS shorter FROM customer""")
def dotenv_edits(spark, d):
    t = F.col("t")
    docs = _table(spark, d, "customer").select("*", F.concat(F.lit("export NAME=a # kept\nN="), F.col("c_nationkey").cast("string"), F.lit("\n")).alias("t"))
    return docs.select("c_custkey", src.set_dotenv(t, "NAME", F.concat("c_name", F.lit(" x")))["value"].alias("changed"), src.set_dotenv(t, "S", F.col("c_mktsegment"))["value"].alias("longer"), src.unset_dotenv(t, "N")["value"].alias("shorter"))


@query("""SELECT c_custkey, ['json', 'ini', 'dotenv', 'toml', NULL, 'json'][k + 1] AS format,
  CASE k WHEN 0 THEN '{"n":"' || c_name || '"}' WHEN 1 THEN '{"a":"1","empty":{},"s":{"name":"' || c_name || '"}}' WHEN 2 THEN '{"N":"' || c_name || '"}' END AS value,
  CASE k WHEN 3 THEN 'document_format_unsupported' WHEN 4 THEN 'document_format_unknown' WHEN 5 THEN 'json_parse_failed' END AS error FROM (SELECT *, CAST(c_custkey % 6 AS INTEGER) AS k FROM customer)""")
def load_by_format(spark, d):
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    endings, texts = [".json", ".INI", "/.env.local", ".toml", ".txt", ".json"], [F.concat(F.lit('{"n":"'), name, F.lit('"}')), F.concat(F.lit("a=1\n[s]\nname="), name, F.lit("\n[empty]\n")), F.concat(F.lit("export N='"), name, F.lit("'\n")), F.lit("a = 1"), F.lit("x"), F.lit("{")]
    pick = lambda xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k + 1).cast("int"))
    docs = _table(spark, d, "customer").select("c_custkey", F.concat(name, pick(endings)).alias("file"), pick(texts).alias("text"))
    return documents.load_texts(docs, "file", "text", ["c_custkey"]).select("c_custkey", "format", F.to_json("value").alias("value"), "error")


@query("""WITH b AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END AS level FROM events),
w AS (SELECT *, lag(event_id) OVER u AS before, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
    max(CASE WHEN level = 1 THEN event_id END) OVER p AS m1, max(CASE WHEN level = 2 THEN event_id END) OVER p AS m2, max(CASE WHEN level = 3 THEN event_id END) OVER p AS m3,
    min(CASE WHEN level <= 1 THEN event_id END) OVER f AS f1, min(CASE WHEN level <= 2 THEN event_id END) OVER f AS f2, min(CASE WHEN level <= 3 THEN event_id END) OVER f AS f3
  FROM b WINDOW u AS (PARTITION BY user_id ORDER BY event_id), p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, [f1, f2, f3][level] AS stop, greatest(CASE WHEN coalesce(level, 9) > 1 THEN m1 END, CASE WHEN coalesce(level, 9) > 2 THEN m2 END, CASE WHEN coalesce(level, 9) > 3 THEN m3 END) AS parent FROM w)
SELECT s.user_id, s.event_id, s.parent, CASE WHEN s.level IS NOT NULL THEN coalesce(n.before, s.final) END AS section_end,
  CASE WHEN s.level IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY s.user_id, s.parent, s.level ORDER BY s.event_id) - 1 AS INTEGER) END AS ordinal
FROM s LEFT JOIN w n ON n.user_id = s.user_id AND n.event_id = s.stop""")
def section_tree_events(spark, d):
    level = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 3)
    blocks = _table(spark, d, "events").select("user_id", "event_id", level.alias("level"), F.col("event_id").alias("line"))
    return sections.fold(blocks, "user_id", "event_id", end="line").select("user_id", "event_id", "parent", "section_end", "ordinal")


@query("""SELECT s_suppkey, rule_id, pointer FROM (
  SELECT s_suppkey, 'suffix_type_mismatch' AS rule_id, '/properties/size_bytes/type' AS pointer FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT s_suppkey, 'suffix_type_mismatch', '/$defs/d/properties/in/properties/at_rfc3339/type' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT s_suppkey, 'secret_schema_value_exposed', unnest(['/properties/api_secret/default', '/properties/api_secret/examples/1']) FROM supplier
  UNION ALL SELECT s_suppkey, 'suffix_type_mismatch', '/properties/took_ms/type' FROM supplier WHERE s_suppkey % 5 = 0)""")
def lint_json_schemas(spark, d):
    k = F.col("s_suppkey")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    text = F.concat(
        F.lit('{"properties":{"size_bytes":{"type":'), pick(2, '"string"', '["null","integer"]'), F.lit('},"api_secret":{"type":"string","default":"sk-'), k.cast("string"), F.lit('","example":"***","examples":[null,"x","***"]},"took_ms":{'),
        pick(5, '"allOf":[{"type":"number"},{"anyOf":[{"type":"string"}]}]', '"oneOf":[{"type":"string"},{"allOf":[{"type":"integer"},{}]}]'), F.lit('},"plain":{"type":"array"},"flag_ms":true},"$defs":{"d":{"properties":{"in":{"properties":{"at_rfc3339":{"type":'),
        pick(3, '"integer"', '"string"'), F.lit("}}}}}}}"),
    )
    found = lint.lint_json_schema(F.parse_json(text))
    return _table(spark, d, "supplier").select("s_suppkey", F.explode(found).alias("f")).select("s_suppkey", "f.rule_id", "f.pointer")
