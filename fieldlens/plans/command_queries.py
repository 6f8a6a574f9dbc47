"""Queries for registries of commands, made of suppliers, and calls, made of their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands
from ..operators.cuts import cut
from .queries import _table, query

NAME = "'run s' || s_suppkey"
#: Of each supplier's command: argument, long, position, type, values, least, most, default, repeatable.
ARGUMENTS = [
    ("mode", "--mode", None, "enum", ["cli", "pipe"], None, None, "cli", False),
    ("limit", "--limit", None, "i64", None, 1, 1000, None, False),
    ("path", None, 0, "string", None, None, None, None, False),
    ("force", "--force", None, "flag", None, None, None, None, False),
    ("tag", "--tag", None, "string", None, None, None, None, True),
]


def _suppliers(spark, d):
    return _table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("run s"), F.col("s_suppkey").cast("string")).alias("command"))


def _lit(x):
    return F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)


def _arguments(spark, d):
    each = F.array(*[F.struct(*[_lit(x).alias(n) for n, x in zip(commands._FIELDS, row, strict=True)]).cast(commands.ARGUMENT) for row in ARGUMENTS])
    return _suppliers(spark, d).select("command", F.explode(each).alias("a")).select("command", "a.*")


def _combinations(spark, d):
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    fixed = F.create_map(F.lit("mode"), F.when(F.col("s_suppkey") % 2 == 0, texts("pipe")).otherwise(texts("cli", "pipe")))
    one = lambda name, optional, fixed: F.struct(F.lit(name).alias("combination"), texts("path").alias("required"), texts(*optional).alias("optional"), fixed.cast(commands.NO_FIXED).alias("fixed"))
    return _suppliers(spark, d).select("s_suppkey", "command", F.explode(F.array(one("absent", ["limit", "tag"], F.create_map()), one("fixed", ["force"], fixed))).alias("c")).select("s_suppkey", "command", "c.*")


def _calls(spark, d):
    line = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").cast("long").cast("string").alias("q"))
    w = lambda *x: F.array(*[F.lit(y) if isinstance(y, str) else y for y in x]).cast("array<string>")
    argv = [w("p", "--mode", "pipe"), w("--mode=cli", "p"), w("p", "--limit", F.col("q")), w("p", "--limit=2000"), w("--limit"), w("--nope"), w("p", "q"), w("p", "--force", "--force"), w("--", "-x"), w("-x"), w("p", "--tag", "a", "--tag=b"), w("p", "--limit", "-5")]
    k, rest = (F.col("l_orderkey") + F.col("l_linenumber")) % len(argv), None
    for i, words in enumerate(argv):
        rest = F.when(k == i, words) if rest is None else rest.when(k == i, words)
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), F.concat(F.lit("run s"), F.col("l_suppkey").cast("string")).alias("command"), rest.alias("rest"))


CALLS = """(SELECT l_orderkey * 10 + l_linenumber AS call, 'run s' || l_suppkey AS command, l_suppkey % 2 AS odd, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST((l_orderkey + l_linenumber) % 12 AS INTEGER) AS k
  FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"""
ERRORS = "[NULL, NULL, NULL, 'cli_invalid_argument_value', 'cli_missing_argument_value', 'cli_unknown_argument', 'cli_unexpected_positional', 'cli_duplicate_argument', NULL, 'cli_unknown_argument', NULL, 'cli_invalid_argument_value'][k + 1]"
SUBJECTS = "[NULL, NULL, NULL, '--limit', '--limit', '--nope', 'q', '--force', NULL, '-x', NULL, '--limit'][k + 1]"
COMBINATION = "CASE WHEN k = 0 OR (k = 1 AND odd = 1) THEN 'fixed' WHEN k IN (2, 10) OR (k = 8 AND odd = 0) THEN 'absent' END"


@query(f"""SELECT call, {ERRORS} AS error, {SUBJECTS} AS subject,
  CASE k WHEN 0 THEN '{{"path":["p"],"mode":["pipe"]}}' WHEN 1 THEN '{{"mode":["cli"],"path":["p"]}}' WHEN 2 THEN '{{"path":["p"],"limit":["' || q || '"]}}' WHEN 8 THEN '{{"path":["-x"]}}' WHEN 10 THEN '{{"path":["p"],"tag":["a","b"]}}' END AS given
FROM {CALLS}""")
def cli_parse(spark, d):
    return commands.tokenize(_calls(spark, d), _arguments(spark, d)).select("call", "error", "subject", F.to_json("given").alias("given"))


@query(f"SELECT call, {COMBINATION} AS combination, coalesce({ERRORS}, CASE WHEN {COMBINATION} IS NULL THEN CASE WHEN k = 8 THEN 'cli_ambiguous_combination' ELSE 'cli_unregistered_combination' END END) AS error FROM {CALLS}")
def cli_match(spark, d):
    parsed = commands.tokenize(_calls(spark, d), _arguments(spark, d))
    return commands.match(parsed, _combinations(spark, d), _arguments(spark, d)).select("call", "combination", "error")


@query(f"""WITH m AS (SELECT *, {COMBINATION} AS combination FROM {CALLS})
SELECT call, 'path' AS argument, CASE WHEN k = 8 THEN '-x' ELSE 'p' END AS value FROM m WHERE combination IS NOT NULL
UNION ALL SELECT call, 'force', 'false' FROM m WHERE combination = 'fixed'
UNION ALL SELECT call, 'mode', CASE k WHEN 0 THEN 'pipe' ELSE 'cli' END FROM m WHERE combination = 'fixed'
UNION ALL SELECT call, 'limit', q FROM m WHERE k = 2 UNION ALL SELECT call, 'tag', 'a,b' FROM m WHERE k = 10""")
def cli_project(spark, d):
    parsed = cut(commands.tokenize(_calls(spark, d), _arguments(spark, d)))  # read twice below, worked out once
    fitted = commands.match(parsed, _combinations(spark, d), _arguments(spark, d)).where("error is null").select("call", "combination")
    found = commands.project(parsed.join(fitted, "call"), _arguments(spark, d), _combinations(spark, d))
    return found.select("call", "argument", F.array_join("values", ",").alias("value"))


@query(f"SELECT {NAME} AS command, 'absent' AS combination, 'fixed' AS other FROM supplier WHERE s_suppkey % 2 = 1")
def cli_overlap(spark, d):
    return commands.overlaps(_combinations(spark, d), _arguments(spark, d))


@query(f"""SELECT {NAME} AS command, 'absent' AS combination, CAST(0 AS BIGINT) AS variant, 'run s' || s_suppkey || ' value' AS argv FROM supplier
UNION ALL SELECT {NAME}, 'fixed', 0, 'run s' || s_suppkey || ' --mode ' || CASE s_suppkey % 2 WHEN 0 THEN 'pipe' ELSE 'cli' END || ' value' FROM supplier
UNION ALL SELECT {NAME}, 'fixed', 1, 'run s' || s_suppkey || ' --mode pipe value' FROM supplier WHERE s_suppkey % 2 = 1""")
def cli_synthetic(spark, d):
    made = commands.synthetic_calls(_combinations(spark, d), _arguments(spark, d))
    return made.select("command", "combination", "variant", F.array_join("argv", " ").alias("argv"))


@query(f"""SELECT 'overlapping_combinations' AS rule, {NAME} AS command, 'absent,fixed' AS subject FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 5 <> 4
UNION ALL SELECT 'invalid_default', {NAME}, 'limit' FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'unknown_combination_argument', {NAME}, 'absent.zzz' FROM supplier WHERE s_suppkey % 5 = 1
UNION ALL SELECT unnest(['invalid_argument_id', 'invalid_long_argument', 'uncovered_argument']), {NAME}, 'Bad' FROM supplier WHERE s_suppkey % 5 = 2
UNION ALL SELECT 'duplicate_command_path', {NAME}, 'run s' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 3
UNION ALL SELECT unnest(['invalid_fixed_value', 'positional_not_prefix']), {NAME}, unnest(['fixed.mode', 'absent']) FROM supplier WHERE s_suppkey % 5 = 4""")
def cli_registry_check(spark, d):
    number = F.substring("command", 6, 20).cast("long") % 5
    known = _suppliers(spark, d)
    known = known.union(known.where("s_suppkey % 5 = 3")).select("command")
    own = _arguments(spark, d).withColumn("default", F.when((number == 0) & (F.col("argument") == "limit"), "2000").otherwise(F.col("default")))
    bad = F.struct(F.lit("Bad").alias("argument"), F.lit("--bad").alias("long"), F.lit(None).alias("position"), F.lit("string").alias("type")).cast("struct<argument:string,long:string,position:int,type:string>")
    more = _suppliers(spark, d).where("s_suppkey % 5 = 2").select("command", bad.alias("a")).select("command", "a.*")
    # A second positional argument that only the first combination takes, in place of the first.
    second = _suppliers(spark, d).where("s_suppkey % 5 = 4").select("command", F.lit("other").alias("argument"), F.lit(1).alias("position"), F.lit("string").alias("type"))
    arguments = own.unionByName(more, allowMissingColumns=True).unionByName(second, allowMissingColumns=True)
    four = F.substring("command", 6, 20).cast("long") % 5 == 4
    first = F.col("combination") == "absent"
    combos = _combinations(spark, d).withColumn("optional", F.when((number == 1) & first, F.array_append("optional", F.lit("zzz"))).otherwise(F.col("optional")))
    combos = combos.withColumn("required", F.when(four & first, F.array(F.lit("other"))).otherwise(F.col("required")))
    combos = combos.withColumn("fixed", F.when(four & ~first, F.transform_values("fixed", lambda _, v: F.array_append(v, F.lit("nope")))).otherwise(F.col("fixed")))
    return commands.violations(known, arguments, combos.drop("s_suppkey"))


@query(f"""SELECT {NAME} AS command, 'fixed' AS combination, 'action_missing' AS error FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT {NAME}, 'gone', 'action_unknown' FROM supplier WHERE s_suppkey % 3 = 1""")
def cli_actions(spark, d):
    names = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("absent"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("absent"), F.lit("fixed"), F.lit("gone"))).otherwise(F.array(F.lit("absent"), F.lit("fixed")))
    actions = _suppliers(spark, d).select("command", F.explode(names).alias("combination"))
    return commands.unbound(_combinations(spark, d), actions)
