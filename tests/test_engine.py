"""Operators outside the training-data subpackage on small cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.functions import dynamic, formats, urls, validators
from fieldlens.functions.json import whole_json
from fieldlens.operators import commands, frames, lint, paths, spans
from fieldlens.operators import events as ev
from fieldlens.sources import text as src
from fieldlens.sources.ini import read_ini


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


URLS = {
    "https://u@x:pw@h/": "https://u@x:***@h/",
    "https://u:p:q@h": "https://u:***@h",
    "https://u@h:80/": "https://u@h:80/",
    "http://h/?a%zz%5Fsecret=1": "http://h/?a%zz%5Fsecret=***",
    "http://h/?%73_secret=1&%=2": "http://h/?%73_secret=***&%=2",
    "http://h/?a+secret=1&b_secret==": "http://h/?a+secret=1&b_secret=***",
    "http://h/?x=1?k_secret=2": "http://h/?x=1?k_secret=2",
    "http://h#k_secret=1?b_secret=2": "http://h#k_secret=***",
    "http://?k_secret=1": "http://?k_secret=***",
    "1http://u:p@h": "1http://u:p@h",
    "http://u:p@h/a b": "http://u:p@h/a b",
    "http://h/?api_Secret=1": "http://h/?api_Secret=1",
    "": "",
}


def test_urls(spark):
    assert values(spark, URLS, urls.redact_url) == list(URLS.values())


def test_names_of_secrets_may_be_given(spark):
    assert values(spark, ["http://h/?token=1&b=2"], lambda c: urls.redact_url(c, ["token"])) == ["http://h/?token=***&b=2"]


def test_urls_in_prose(spark):
    cases = {
        "a http://u:p@h, b": "a http://u:***@h, b",
        "12.http://u:p@h": "12.http://u:***@h",
        "x" * 300 + "://u:p@h": "x" * 300 + "://u:***@h",
        "ftp://?k_secret=1\u2003http://h?k_secret=2\u3000z": "ftp://?k_secret=***\u2003http://h?k_secret=***\u3000z",
        "http:// http://u:p@h": "http:// http://u:***@h",
        "<http://u:p@h>'http://u:p@h'": "<http://u:***@h>'http://u:***@h'",
        "mail a@b.c k_secret=1": "mail a@b.c k_secret=1",
    }
    assert values(spark, cases, urls.redact_urls_in_text) == list(cases.values())


def test_url_fields(spark):
    cases = {"user:pw@h": "***", " http://u:p@h ": "http://u:***@h", "a b": "***", "/x?y=1": "/x?y=1", "http://h/ x": "***", "\u3000http://u:p@h": "http://u:***@h"}
    assert values(spark, cases, urls.redact_url_field) == list(cases.values())


def test_maps_are_redacted(spark):
    df = spark.createDataFrame([({"api_secret": "s", "x": "y"}, [{"k_SECRET": 3, "n": 4}], {"a_secret": None})], "m map<string,string>, l array<map<string,int>>, o map<string,string>")
    got = frames.redact(df).select("m", F.to_json("l").alias("l"), "o").first()
    assert got.m == {"api_secret": "***", "x": "y"} and got.l in ('[{"k_SECRET":"***","n":4}]', '[{"n":4,"k_SECRET":"***"}]') and got.o == {"a_secret": None}


def test_json_text(spark):
    cases = {
        '{"b":1.10,"a":{"k_secret":[1],"n_secret":null,"u_url":[" http://u:p@h ","a b"]}}': '{"a":{"k_secret":"***","n_secret":null,"u_url":["http://u:***@h","***"]},"b":1.10}',
        "123456789012345678901234567890123456789012": "123456789012345678901234567890123456789012",
        '{"a":1,"a":2}': None,
        '{"a":1} x': None,
        "NaN": None,
        '{"\U00010000":1,"\uffff":2}': '{"\U00010000":1,"\uffff":2}',
        None: None,
    }
    assert values(spark, cases, dynamic.redact_json_text) == list(cases.values())
    assert values(spark, ['{"trace":{"a_secret":1},"b_secret":2}'], lambda c: dynamic.redact_json_text(c, policy="trace_only")) == ['{"b_secret":2,"trace":{"a_secret":"***"}}']
    for text, want in URLS.items():
        assert (dynamic._redact_url(text, frozenset()) or text) == want


def test_no_secret_survives_any_form(spark):
    df = spark.createDataFrame([(("canary-1", ["canary-2"]), {"x_secret": "canary-3"}, [("canary-4",)], "http://u:canary-5@h/?a_secret=canary-6")], "n struct<a_secret: string, b_secret: array<string>>, m map<string,string>, l array<struct<c_secret: string>>, d_url string")
    for form in ("plain", "yaml", "json"):
        assert "canary" not in frames.render(df, form).first()[0]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0.1234567890123456, 1e-7, 1e15, 1e20, 123456789012345680000.0, 1e21, 3.0, -2.5, 12345678.25, 1.5e-9)], "x double")
    assert [r[0] for r in df.select(formats.number(F.col("x"), T.DoubleType())).collect()] == ["0.1234567890123456", "1e-7", "1000000000000000", "100000000000000000000", "123456789012345683968", "1e21", "3", "-2.5", "12345678.25", "1.5e-9"]


def test_milliseconds_round_the_binary_value(spark):
    xs = [1000.5, 2000.5, 1062.5, 999.5, -1500.25, 1e9 + 0.5, 999999.9999]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    want = ["999.5ms" if abs(x) < 1000 else (lambda t: t + ("0s" if t.endswith(".") else "s"))(f"{x / 1000.0:.3f}".rstrip("0")) for x in xs]
    assert [r[0] for r in df.select(formats.milliseconds(F.col("x"), T.DoubleType())).collect()] == want


def test_strings_of_integers(spark):
    show = lambda kind: lambda c: formats.readable(c, T.StringType(), kind, None)
    assert values(spark, ["100", "-5", "1.5", " 1", None], show("msats")) == ["100msats", "-5msats", None, None, None]
    assert values(spark, ["-1", "12.7", " 12 ", "1e9"], show("epoch_ns")) == ["1969-12-31T23:59:59.999Z", None, None, None]


def test_validators(spark):
    assert values(spark, ["x-a", "X-a", "en-US", "chinese", "en_US"], validators.is_bcp47) == [True, False, True, False, False]
    assert values(spark, ["\t+5\n", "+00:00", "+5:7"], validators.normalize_utc_offset) == ["+05:00", "UTC", None]


def test_plain(spark):
    df = spark.createDataFrame([([(1, "x")], {"b": "2", "a": "1"}, "a\u2003b", [], {}, 7, 1500)], "l array<struct<z: int, a: string>>, m map<string,string>, t string, e array<int>, n map<string,int>, r_bytes long, r_ms long")
    assert frames.render(df).first()[0] == 'e=[] l="{\\"a\\":\\"x\\",\\"z\\":1}" m.a=1 m.b=2 n={} r_bytes=7 r_ms=1500 t="a\u2003b"'


def test_keys_of_maps_are_formatted(spark):
    df = spark.createDataFrame([({"a_ms": "x", "b_rfc3339": "2024", "c_secret": "s"},)], "m map<string,string>")
    assert frames.render(df).first()[0] == "m.a_ms=x m.b=2024 m.c=***"


def test_yaml(spark):
    df = spark.createDataFrame([(1, [("a", [1.0, None])], "q\"\n", {"true": "x", "k": None}, None)], "`1e5` int, l array<struct<k: string, n: array<double>>>, t string, m map<string,string>, s struct<a: int>")
    assert frames.render(df, "yaml").first()[0] == '---\n"1e5": 1\nl:\n  -\n    k: "a"\n    n:\n      - 1\n      - null\nm:\n  k: null\n  "true": "x"\ns: null\nt: "q\\"\\n"'


def test_whole_json(spark):
    cases = {'{"a":1}': '{"a":1}', "1 ": "1", '{"a":1} x': None, "1,2": None, "1} {": None, '1,"z":"end of the text"} {': None, '1,"y":2': None, "": None, None: None, '{"a":1,"a":2}': None}
    assert values(spark, cases, lambda c: F.to_json(whole_json(c))) == list(cases.values())


def test_paths():
    for path in ("a.b", "a\\.b.c", "p.", ".", "\\*", "a\\\\.b"):
        assert paths.join_path(paths.parse_path(path)) == path
    assert paths.parse_pattern("a.*.b") == ["a", paths.EACH, "b"]
    for path, code in (("", paths.BAD_ARGUMENT), ("a.*", paths.BAD_PATH), ("a\\x", paths.BAD_PATH), ("a\\", paths.BAD_PATH)):
        with pytest.raises(paths.PathError) as e:
            paths.parse_path(path)
        assert e.value.code == code


DOC = '{"a":{"0":"k","b":[10,{"c":null}]},"l":[{"s":"p","v":1},{"s":"q"},{"s":"q"}],"x.y":true}'


def test_get(spark):
    df = spark.createDataFrame([(DOC,)], "t string").select(F.try_parse_json("t").alias("v"))
    cases = {"a.0": ("k", None), "a.b.0": ("10", None), "a.b.7": (None, paths.NOT_FOUND), "a.b.1.c": (None, paths.IS_NULL), "a.b": (None, paths.NO_SCALAR), "a.0.z": (None, paths.WRONG_TYPE), "l.p.v": ("1", None), "l.q": (None, paths.AMBIGUOUS), "l.z.v": (None, paths.NO_SLUG), "a.b.p": (None, paths.NOT_FOUND), "x\\.y": ("true", None), "l.p.v_secret": (None, paths.IS_SECRET)}
    for path, want in cases.items():
        assert tuple(df.select(paths.scalar(F.col("v"), path, {"l": "s"}).alias("r")).select("r.*").first()) == want, path
    with_default = lambda p: tuple(df.select(paths.scalar(F.col("v"), p, {"l": "s"}, default="d").alias("r")).select("r.*").first())
    assert with_default("zz") == ("d", None) and with_default("a.b.1.c") == ("d", None) and with_default("l.q") == (None, paths.AMBIGUOUS)


def test_children_and_values(spark):
    df = spark.createDataFrame([(1, DOC), (2, '"s"'), (3, '{"":1}')], "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    got = {tuple(r) for r in paths.children(df, "v", ["i"]).collect()}
    assert got == {(1, "a", "a", None), (1, "l", "l", None), (1, "x.y", "x\\.y", None), (2, None, None, paths.NO_CONTAINER), (3, "", None, "document_unaddressable_key")}
    assert [tuple(r) for r in paths.values(df, "v", "l.*.v", ["i"]).select("path", F.to_json("value")).collect()] == [("l.0.v", "1")]


def test_typed_edits(spark):
    df = spark.createDataFrame([((1, 2), 3)], "a struct<b: int, c: int>, d int")
    assert paths.set_field(df, "a.e.f", F.lit(9)).select(F.to_json("a")).first()[0] == '{"b":1,"c":2,"e":{"f":9}}'
    assert paths.set_field(df, "a.b", F.lit(9)).select(F.to_json("a")).first()[0] == '{"b":9,"c":2}'
    assert paths.unset_field(df, "a.b").select(F.to_json("a")).first()[0] == '{"c":2}'
    with pytest.raises(paths.PathError):
        paths.set_field(df, "d.x", F.lit(1))
    with pytest.raises(paths.PathError):
        paths.unset_field(df, "a.z")


def test_lint_reaches_nested_values(spark):
    df = spark.createDataFrame([(1, [(1.5, "2023-02-30", None)], "x y", 2**53, "tok"), (2, None, None, None, None)], "id int, l array<struct<n_bytes: double, d_rfc3339_date: string, z_ms: double>>, a_url string, `b/~c` long, token string")
    got = {(r.id, r.rule_id, r.severity, r.pointer) for r in lint.lint_values(df, ["id"]).collect()}
    assert got == {(1, "suffix_type_mismatch", "error", "/l/0/n_bytes"), (1, "suffix_type_mismatch", "error", "/l/0/d_rfc3339_date"), (1, "suffix_type_mismatch", "error", "/a_url"), (1, "unsafe_integer", "error", "/b~1~0c"), (1, "missing_suffix", "warning", "/token")}
    assert {r.severity for r in lint.lint_values(df, ["id"], "error").collect()} == {"error"}


def test_lint_of_a_schema(spark):
    schema = T.StructType([T.StructField("a_sats", T.DoubleType()), T.StructField("b_url", T.LongType()), T.StructField("c_url", T.ArrayType(T.StringType())), T.StructField("k_secret", T.StringType(), True, {"CURRENT_DEFAULT": "'x'"})])
    assert [(r.rule_id, r.pointer) for r in frames.lint_schema(spark, schema).collect()] == [("suffix_type_mismatch", "/a_sats"), ("suffix_type_mismatch", "/b_url"), ("secret_schema_value_exposed", "/k_secret")]


EVENTS = {
    '{"kind":"error","error":{"code":" ","message":"m"}}': None,
    '{"kind":"error","error":{"code":"","message":"m"}}': "error_code_invalid",
    '{"kind":"error","error":{"code":"c","message":"m","hint":3}}': "error_hint_invalid",
    '{"kind":"log","log":1,"a/b":2}': "unexpected_field",
    '{"kind":"log","log":1,"trace":[]}': "trace_not_object",
    '{"kind":"log","log":1} {}': "event_not_object",
    '{"kind":3}': "kind_invalid",
    "[1]": "event_not_object",
    "null": "event_not_object",
}


def test_rules_of_events(spark):
    assert values(spark, EVENTS, lambda c: ev.violation(c)["rule"]) == list(EVENTS.values())
    assert values(spark, ['{"kind":"log","log":1,"a/b":2}'], lambda c: ev.violation(c)["pointer"]) == ["/a/b"]


def test_what_is_built_is_valid(spark):
    df = spark.range(1).select(ev.build_event("result", F.lit(1)).alias("a"), ev.build_error(F.lit("c"), F.lit("m"), hint=F.lit(""), fields={"n": F.lit(1)}).alias("b"), ev.build_cli_error(F.lit("")).alias("c"))
    for name in "abc":
        assert df.select(ev.violation(F.col(name), strict=True)).first()[0] is None
    with pytest.raises(ValueError):
        ev.build_error(F.lit("c"), F.lit("m"), fields={"hint": F.lit(1)})


def test_a_catalogue_has_a_code_once(spark):
    catalog = spark.createDataFrame([("a", 1), ("a", 2)], "code string, n int")
    with pytest.raises(ValueError):
        ev.catalog_lookup(spark.createDataFrame([("a",)], "code string"), catalog)


def test_streams(spark):
    rows = [("a", i, f'{{"kind":"{k}","{k}":1}}') for i, k in enumerate(["log", "result", "log", "result"])] + [("b", 0, "x")]
    got = ev.validate_stream(spark.createDataFrame(rows, "s string, n int, event string").repartition(3), "s", ["n"], streams=spark.createDataFrame([("c",)], "s string")).collect()
    assert {tuple(r) for r in got} == {("a", "stream_non_terminal_after_terminal", "/2"), ("a", "stream_duplicate_terminal", "/3"), ("b", "event_not_object", "/0"), ("b", "stream_missing_terminal", ""), ("c", "stream_missing_terminal", "")}


def test_texts_of_events(spark):
    log, end = '{"kind":"log","log":1}', '{"kind":"result","result":1}'
    texts = {1: f"{log}\n{end}", 2: f"[{log},{end},{log}]", 3: log, 4: end, 5: '{"kind":"x"}', 6: f"{log}\nbad", 7: ""}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {tuple(r) for r in ev.validate_texts(df, "id", "t").collect()}
    assert got == {(2, "stream_non_terminal_after_terminal", "/2"), (3, "stream_missing_terminal", ""), (5, "kind_unsupported", "/kind"), (6, "jsonl_parse_failed", "/2"), (6, "stream_missing_terminal", ""), (7, "json_parse_failed", "")}
    assert {tuple(r) for r in ev.validate_texts(df, "id", "t", per_event=True).collect()} == {(5, "kind_unsupported", "/kind"), (6, "jsonl_parse_failed", "/2"), (7, "json_parse_failed", "")}


def test_assertions(spark):
    lint.assert_clean(spark.range(3))
    with pytest.raises(AssertionError):
        lint.assert_clean(spark.range(3).withColumn("price", F.lit(1)))
    assert spark.range(1).select(ev.checked(ev.build_event("log", F.lit(1)))).count() == 1
    with pytest.raises(Exception, match="trace_required"):
        spark.range(1).select(ev.checked(F.lit('{"kind":"log","log":1}'))).collect()


def test_ini(spark):
    cases = {"a = 1\n[s]\n\tk\t= v=2\r\n;c": [(1, "", "a", "1", None), (3, "s", "k", "v=2", None)], "junk": [(1, None, None, None, "missing_value")], "[broken": [(1, None, None, None, "invalid_section_header")], "[a]\n[a]": [(2, None, None, None, "duplicate_section")], "[]": [(1, None, None, None, "invalid_section_name")], "=1": [(1, None, None, None, "invalid_key")], "a=1\n[a]": [(2, None, None, None, "section_is_root_key")], "[a]\nx=1\nx=2": [(3, None, None, None, "duplicate_key")], "": []}
    df = spark.createDataFrame([(1, t) for t in cases], "id int, t string")
    got = sorted(map(str, (tuple(r)[1:] for r in read_ini(df, "id", "t").collect())))
    assert got == sorted(str(x) for rows in cases.values() for x in rows)


def test_dotenv():
    text = "# it isn't\nexport A=1 # c\nB=\"x\\ny\n z\" # d\nC='it\\'s'\nD=a\\#b #e\nE=\nF=a#b"
    assert [(k, v) for _, k, v, _ in src.parse_dotenv(text)] == [("A", "1"), ("B", "x\ny\n z"), ("C", "it's"), ("D", "a#b"), ("E", ""), ("F", "a#b")]
    assert [e[3] for t in ("A=1\nA=2", "1x=2", 'A="u', "nothing", "A='x' y") for e in src.parse_dotenv(t)] == ["duplicate_key", "invalid_key", "invalid_quoted_value", "missing_value", "invalid_quoted_value"]


def test_frontmatter(spark):
    got = values(spark, ["+++\na\n+++ \nb\n+++", "+++\na\n +++", "x", "+++\n+++"], lambda c: F.to_json(src.split_frontmatter(c, "+++")))
    assert got == ['{"front":"a\\n","body":"b\\n+++"}', '{"error":"frontmatter_unterminated"}', '{"error":"frontmatter_missing"}', '{"front":"","body":""}']


def test_files_beyond_a_size_are_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.ini").write_text("x" * 50)
    got = {(r.format, r.content, r.error) for r in src.read_files(spark, str(tmp_path), most=10).collect()}
    assert got == {("json", "{}", None), ("ini", None, "document_too_large")}


def test_spans(spark):
    rows = [("r", None, {"a": "1", "b": "1"}), ("m", "r", {"b": "2"}), ("l", "m", {"c": "3"}), ("x", "gone", {"z": "9"})]
    got = {r.span: r.fields for r in spans.inherit(spark.createDataFrame(rows, "span string, parent string, fields map<string,string>")).collect()}
    assert got == {"r": {"a": "1", "b": "1"}, "m": {"a": "1", "b": "2"}, "l": {"a": "1", "b": "2", "c": "3"}, "x": {"z": "9"}}


def test_calls_fit_one_combination(spark):
    registry = spark.createDataFrame([("c", "x", ["a"], ["b"], {"b": ["1"]}), ("c", "y", ["d"], [], {})], "command string, combination string, required array<string>, optional array<string>, fixed map<string,array<string>>")
    calls = spark.createDataFrame([(1, "c", {"a": "", "b": "1"}), (2, "c", {"a": "", "b": "2"}), (3, "c", {"d": ""}), (4, "z", {})], "call int, command string, given map<string,string>")
    got = {(r.call, r.combination, r.error) for r in commands.match(calls, registry).collect()}
    assert got == {(1, "x", None), (2, None, "cli_unregistered_combination"), (3, "y", None), (4, None, "cli_unregistered_combination")}
    assert commands.overlaps(registry).count() == 0


def test_a_step_looks_at_the_kind_only_where_nothing_is_found(spark):
    """Kinds read all of a value: one place in the plan for each step, and names of
    elements, missing ones and those that several have, give the same as before."""
    rows = [(0, '{"l":[{"s":"p","v":1},{"s":"q","v":[2]},{"s":"q"}]}'), (1, '{"l":{"q":{"v":2}}}'), (2, '{"l":[]}'), (3, '{"l":3}'), (4, "null"), (5, '{"l":[null,{"s":"q","v":null}]}')]
    df = spark.createDataFrame(rows, "id int, t string").select("id", F.parse_json("t").alias("v"))
    got = paths.get(F.col("v"), "l.q.v", {"l": "s"})
    where = paths.resolve(F.col("v"), "l.q.v", {"l": "s"})
    plan = df.select(got.alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant") <= 3
    found = df.select("id", F.to_json(got["value"]), got["error"], where["value"]).orderBy("id").collect()
    ambiguous, wrong = "document_ambiguous_match", "document_type_mismatch"
    assert [tuple(r)[1:] for r in found] == [(None, ambiguous, None), ("2", None, "l.q.v"), (None, "document_slug_not_found", None), (None, wrong, None), (None, wrong, None), ("null", None, "l.1.v")]


def test_lines_and_events_are_parsed_once(spark, monkeypatch):
    from fieldlens.plans.queries import _spread

    docs = spark.createDataFrame([(0, '{"a":1}\n\n[2'), (1, "\n"), (2, None), (3, "{"), (4, " 7 "), (5, "\n{\n")], "id int, text string")
    read = src.read_json_or_lines(docs, "id", "text")
    assert read._jdf.queryExecution().analyzed().toString().count("parse_json") <= 2
    got = sorted((r.id, r.line, r.value, r.error) for r in read.select("id", "line", F.to_json("value").alias("value"), "error").collect())
    bad = "json_parse_failed"
    assert got == [(0, 1, '{"a":1}', None), (0, 3, None, "jsonl_parse_failed"), (1, None, None, bad), (2, None, None, bad), (3, None, None, bad), (4, None, "7", None), (5, None, None, bad)]
    cuts, cut = [], ev.cut
    monkeypatch.setattr(ev, "cut", lambda df: cuts.append(df.columns) or cut(df))
    events = spark.createDataFrame([("s", 0, '{"kind":"log","log":1}'), ("s", 1, "x")], "s string, i int, event string")
    found = sorted(map(tuple, ev.validate_stream(events, "s", ["i"]).collect()))
    assert found == [("s", "event_not_object", "/1"), ("s", "stream_missing_terminal", "")]
    assert cuts[0] == ["s", "i", "_kind", "_broken"]
    assert _spread(docs.coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_no_size_has_no_text(spark):
    df = spark.createDataFrame([(1.5, None), (None, -1), (2.0**60, 1536)], "a_bytes double, b_bytes long").coalesce(1)
    assert [r[0] for r in frames.render(df).collect()] == ["a_bytes=1.5 b_bytes=", "a_bytes= b_bytes=-1", "a=1048576.0TiB b=1.5KiB"]
