"""Registries of commands, calls, synthetic calls, documents by format, sections, streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import commands, events, lint, paths, sections, spans
from fieldlens.scratch import scratch_path
from fieldlens.sources import documents
from fieldlens.streaming import lifecycle

ARGUMENT = "command string, argument string, long string, position int, type string, values array<string>, least long, most long, `default` string, repeatable boolean"
COMBINATION = "command string, combination string, required array<string>, optional array<string>, fixed map<string,array<string>>"


def argument(name, long=None, position=None, type_="string", values=None, least=None, most=None, default=None, repeatable=False, command="c"):
    return (command, name, long, position, type_, values, least, most, default, repeatable)


ARGUMENTS = [
    argument("mode", "--mode", type_="enum", values=["a", "b"], default="a"),
    argument("n", "--n", type_="i64", least=-5, most=5),
    argument("x", "--x", type_="f64"),
    argument("id", "--id", type_="uuid"),
    argument("j", "--j", type_="json"),
    argument("f", "--f", type_="flag"),
    argument("p", None, 0),
    argument("q", None, 1, "i64", repeatable=True),
]


@pytest.mark.parametrize(
    ("argv", "given", "error"),
    [
        (["v"], {"p": ["v"]}, None),
        (["--mode", "b", "v", "1", "-2"], {"mode": ["b"], "p": ["v"], "q": ["1", "-2"]}, None),
        (["--n=-3", "--f", "v"], {"n": ["-3"], "f": ["true"], "p": ["v"]}, None),
        (["--n", "-3"], {"n": ["-3"]}, None),
        (["--x", "-1e3", "--j", "-1.10"], {"x": ["-1e3"], "j": ["-1.10"]}, None),
        (["--", "--mode"], {"p": ["--mode"]}, None),
        (["-"], {"p": ["-"]}, None),
        (["--help", "--output", "yaml"], {"--help": ["true"], "--output": ["yaml"]}, None),
        ([], {}, None),
        (["--mode=c"], None, (commands.INVALID, "--mode")),
        (["--n", "9"], None, (commands.INVALID, "--n")),
        (["--x", "inf"], None, (commands.INVALID, "--x")),
        (["--id", "1"], None, (commands.INVALID, "--id")),
        (["--f=1"], None, (commands.INVALID, "--f")),
        (["--j", "{"], None, (commands.INVALID, "--j")),
        (["--n"], None, (commands.MISSING, "--n")),
        (["--n="], None, (commands.MISSING, "--n")),
        (["--mode", "--f"], None, (commands.MISSING, "--mode")),
        (["--n", "1", "--n", "2"], None, (commands.TWICE, "--n")),
        (["--help", "--help"], None, (commands.TWICE, "--help")),
        (["--z=1"], None, (commands.UNKNOWN, "--z")),
        (["-z"], None, (commands.UNKNOWN, "-z")),
        (["v", "w"], None, (commands.INVALID, "q")),
    ],
)
def test_words_of_calls(spark, argv, given, error):
    calls = spark.createDataFrame([(1, "c", argv)], "call int, command string, rest array<string>")
    r = commands.tokenize(calls, spark.createDataFrame(ARGUMENTS, ARGUMENT)).first()
    assert r.given == given
    assert (r.error, r.subject) == (error or (None, None))


def test_a_default_may_stand_for_a_fixed_value(spark):
    arguments = spark.createDataFrame([argument("mode", "--mode", type_="enum", values=["cli", "pipe"], default="cli")], ARGUMENT)
    for value, overlap in (("cli", 1), ("pipe", 0)):
        registry = spark.createDataFrame([("c", "fixed", [], [], {"mode": [value]}), ("c", "absent", [], [], {})], COMBINATION)
        assert commands.overlaps(registry, arguments).count() == overlap
        calls = spark.createDataFrame([(1, "c", {}), (2, "c", {"mode": ["pipe"]}), (3, "c", {"mode": ["cli"]})], "call int, command string, given map<string,array<string>>")
        got = {r.call: r.combination or r.error for r in commands.match(calls, registry, arguments).collect()}
        unfit = commands.UNREGISTERED
        assert got == ({1: commands.AMBIGUOUS, 2: unfit, 3: "fixed"} if overlap else {1: "absent", 2: "fixed", 3: unfit})


def test_only_allowed_arguments_are_projected(spark):
    registry = spark.createDataFrame([("c", "one", ["p"], ["f"], {"mode": ["a"]})], COMBINATION)
    calls = spark.createDataFrame([(1, "c", "one", {"p": ["v"]})], "call int, command string, combination string, given map<string,array<string>>")
    got = {r.argument: r["values"] for r in commands.project(calls, spark.createDataFrame(ARGUMENTS, ARGUMENT), registry).collect()}
    assert got == {"p": ["v"], "f": ["false"], "mode": ["a"]}


def test_synthetic_calls_fit_their_combinations(spark):
    arguments = spark.createDataFrame(ARGUMENTS, ARGUMENT)
    registry = spark.createDataFrame([("c", "one", ["p", "q", "x"], ["f"], {"mode": ["a", "b"]}), ("c", "two", ["j", "id", "n", "f"], [], {})], COMBINATION)
    made = commands.synthetic_calls(registry, arguments)
    assert made.count() == 3
    calls = made.select(F.monotonically_increasing_id().alias("call"), "command", F.col("combination").alias("meant"), F.slice("argv", 2, 100).alias("rest"))
    fitted = commands.match(commands.tokenize(calls, arguments), registry, arguments).join(calls, "call")
    assert [r for r in fitted.collect() if r.combination != r.meant] == []


def test_documents_by_name_and_size(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n":1}')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.ini").write_text("[s]\nk=v\n[e]\n")
    (tmp_path / ".env").write_text("A='x'\n")
    (tmp_path / "big.json").write_text("[" + "1," * 500 + "1]")
    (tmp_path / "c.toml").write_text("a=1")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.j, r.error) for r in documents.load_documents(spark, str(tmp_path), most=100).select("path", "format", F.to_json("value").alias("j"), "error").collect()}
    assert got["a.json"] == ("json", '{"n":1}', None)
    assert got["b.ini"] == ("ini", '{"e":{},"s":{"k":"v"}}', None)
    assert got["big.json"] == ("json", None, documents.TOO_LARGE)
    assert got["c.toml"] == ("toml", None, documents.UNSUPPORTED)
    only = documents.load_documents(spark, str(tmp_path), ["json"], most=100)
    assert {r.path.rsplit("/", 1)[1] for r in only.collect()} == {"a.json", "big.json"}
    assert "LessThanOrEqual(length,100)" in only._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="unsupported"):
        documents.load_documents(spark, str(tmp_path), ["toml"])


def test_sections_of_any_order_of_levels(spark):
    rnd = random.Random(1)
    rows = [(i % 3, i, rnd.choice([None, None, 1, 2, 3, 4]), rnd.randint(0, 99)) for i in range(240)]
    got = {(r.doc, r.block_idx): (r.parent, r.ordinal, r.section_end) for r in sections.fold(spark.createDataFrame(rows, "doc int, block_idx int, level int, source_end_line long").repartition(3), "doc").collect()}
    for doc in range(3):
        own, stack, seen = [r for r in rows if r[0] == doc], [], {}
        for i, (_, at, level, line) in enumerate(own):
            while level is not None and stack and stack[-1][1] >= level:
                stack.pop()
            parent, ordinal, end = (stack[-1][0] if stack else None), None, None
            if level is not None:
                ordinal = seen[parent, level] = seen.get((parent, level), -1) + 1
                end = line
                for _, _, other, more in own[i + 1 :]:
                    if other is not None and other <= level:
                        break
                    end = max(end, more)
                stack.append((at, level))
            assert got[doc, at] == (parent, ordinal, end)


def test_many_patterns_at_once(spark):
    doc = '{"l":[{"v":1,"n":"x"},{"v":"two\\nlines"}],"o":{"a.b":null,"k_secret":"s"},"s":"t"}'
    df = spark.createDataFrame([(1, doc), (2, None)], "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    patterns = ["l.*.v", "l.*.n", "o.*", "s", "s.x", "q.r", "l.0.v", "*.0.v"]
    got = {(r.number, r.path, r.value, r.error) for r in paths.scalars(df.where("i = 1"), "v", patterns, []).collect()}
    assert got == {
        (0, "l.0.v", "1", None), (0, "l.1.v", None, paths.MULTILINE), (1, "l.0.n", "x", None), (1, "l.1.n", None, paths.NOT_FOUND), (2, "o.a\\.b", None, paths.IS_NULL),
        (2, "o.k_secret", None, paths.IS_SECRET), (3, "s", "t", None), (4, "s.x", None, paths.WRONG_TYPE), (5, "q.r", None, paths.NOT_FOUND), (6, "l.0.v", "1", None),
        (7, "l.0.v", "1", None), (7, "o.0.v", None, paths.NOT_FOUND), (7, "s.0.v", None, paths.WRONG_TYPE),
    }
    assert {r.error for r in paths.scalars(df.where("i = 2"), "v", patterns, []).collect()} == {paths.NOT_FOUND}


def test_the_only_field_of_a_struct_goes_with_it(spark):
    df = spark.createDataFrame([((1,), 2)], "a struct<b:int>, c int")
    out = paths.unset_field(df, "a.b")
    assert out.columns == ["a", "c"] and tuple(out.first()) == (None, 2)


def test_keys_with_both_quotes(spark):
    df = spark.createDataFrame([("""{"a'\\"b":{"c":1}}""",)], "t string").select(F.parse_json("t").alias("v"))
    assert df.select(paths.scalar(F.col("v"), "a'\"b.c")["value"]).first()[0] == "1"


def test_span_ids_that_repeat(spark):
    rows = [("a", None, {"x": "1"}), ("a", None, {"x": "2"})]
    with pytest.raises(ValueError, match="repeat"):
        spans.inherit(spark.createDataFrame(rows, "span string, parent string, fields map<string,string>"))


def test_findings_as_events(spark):
    found = spark.createDataFrame([(1, "error", "r", "/a"), (1, "warning", "s", "/b"), (2, "warning", "s", "/c")], "doc int, severity string, rule_id string, pointer string")
    every = spark.createDataFrame([(1,), (2,), (3,)], "doc int")
    got = {r.doc: (r.kind, r.ok, r.errors, r.warnings, len(r.findings)) for r in events.findings_event(found, ["doc"], every, with_findings=True).collect()}
    assert got == {1: ("error", False, 1, 1, 2), 2: ("result", False, 0, 1, 1), 3: ("result", True, 0, 0, 0)}


def test_streams_in_batches(spark):
    lifecycle.use_state_store(spark)
    rows = [(1, 1, "log"), (1, 2, "result"), (2, 3, "log"), (1, 4, "progress"), (2, 5, "error"), (2, 6, "error"), (3, 7, "log"), (3, 8, "other")]
    table = spark.createDataFrame(rows, "s int, n int, kind string")
    source, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    for low, high in ((1, 3), (4, 5), (6, 8)):
        table.where(F.col("n").between(low, high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    lifecycle.write_once(lifecycle.verdicts(stream, "s", ["n"]), out, state).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select("stream", "index", "rule", "pointer").collect()))
    want = sorted((r.s, r["index"], r.rule, r.pointer) for r in events.lifecycle(table, "s", ["n"]).collect())
    assert got == want and len(got) == 2


def test_streams_that_fall_silent(spark):
    lifecycle.use_state_store(spark)
    table = spark.createDataFrame([(1, 1, "log"), (2, 2, "result")], "s int, n int, kind string")
    source, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    table.coalesce(1).write.parquet(source)
    query = lifecycle.write_once(lifecycle.verdicts(spark.readStream.schema(table.schema).parquet(source), "s", ["n"], idle_ms=500), out, state, processingTime="1 second")
    found, until = [], time.time() + 60
    while not found and time.time() < until:
        time.sleep(1)
        try:
            found = [tuple(r) for r in spark.read.parquet(out).select("stream", "index", "rule", "pointer").collect()]
        except Exception:  # no batch is written yet
            continue
    query.stop()
    assert found == [(1, 1, "stream_missing_terminal", "")]


def test_schemas_in_schemas(spark):
    schema = '{"properties":{"size_bytes":{"anyOf":[{"type":"string"},{"type":"null"}]},"ok_ms":{},"t_secret":{"default":"***"},"x":{"properties":{"u_url":{"type":"array"}}}}}'
    df = spark.createDataFrame([(schema,)], "t string").select(F.explode(lint.lint_json_schema(F.parse_json("t"))).alias("f")).select("f.*")
    assert {(r.rule_id, r.pointer) for r in df.collect()} == {("suffix_type_mismatch", "/properties/size_bytes/type"), ("suffix_type_mismatch", "/properties/x/properties/u_url/type")}


def test_calls_of_cli_project_are_read_once(spark, monkeypatch):
    from fieldlens.plans import command_queries

    cuts, cut = [], command_queries.cut
    monkeypatch.setattr(command_queries, "cut", lambda df: cuts.append(df.columns) or cut(df))
    command_queries.cli_project(spark, "/root/testdata/sf0.001")
    assert len(cuts) == 1 and {"call", "given", "error"} <= set(cuts[0])
