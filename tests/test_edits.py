"""Edits of INI and dotenv text that keep all other bytes; VARIANT columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.functions import formats, names, plain
from fieldlens.operators import frames, lint, paths
from fieldlens.sources import ini, text

INI = "a=1\n[s]\nb = 2\n; x\n\n[t]\nc=3"
CRLF = "[s]\r\nk =  v\r\n\r\n[t]\r\nq=1\r\n"
ENV = "A=1\n# c\nexport B = 'x\ny' # r\nC=z #k\r\nD="


def edited(spark, source, make):
    r = spark.createDataFrame([(source,)], "t string").select(make(F.col("t")).alias("r")).select("r.*").first()
    return r.value if r.error is None else r.error


@pytest.mark.parametrize(
    ("source", "path", "value", "want"),
    [
        (INI, "s.b", "Z", INI.replace("b = 2", "b = Z")),
        (INI, "s.new", "1", INI.replace("; x\n", "; x\nnew=1\n")),
        (INI, "t.new", "1", INI + "\nnew=1\n"),
        (INI, "z.k", "1", INI + "\n\n[z]\nk=1\n"),
        (INI, "root", "r", INI.replace("a=1\n", "a=1\nroot=r\n")),
        (INI, "a", "$1 \\x", INI.replace("a=1", "a=$1 \\x")),
        (INI, "s", "x", ini.UNSUPPORTED),
        (INI, "a.k", "x", ini.UNSUPPORTED),
        (CRLF, "s.k", "new", CRLF.replace("  v", "  new")),
        (CRLF, "s.m", "n", CRLF.replace("  v\r\n", "  v\r\nm=n\r\n")),
        ("", "s.k", "1", "[s]\nk=1\n"),
        ("[s]\na=1\n[s]\n", "s.a", "1", paths.PARSE_FAILED),
        (None, "a", "1", paths.PARSE_FAILED),
        (INI, "a", "two\nlines", paths.BAD_ARGUMENT),
    ],
)
def test_set_ini(spark, source, path, value, want):
    assert edited(spark, source, lambda t: ini.set_ini(t, path, F.lit(value))) == want


@pytest.mark.parametrize(("path", "want"), [("s.b", INI.replace("b = 2\n", "")), ("a", INI[4:]), ("t.c", INI[:-3]), ("s.c", paths.NOT_FOUND), ("z.c", paths.NOT_FOUND)])
def test_unset_ini(spark, path, want):
    assert edited(spark, INI, lambda t: ini.unset_ini(t, path)) == want


def test_paths_that_ini_cannot_hold(spark):
    for path in ("a.b.c", "a.b=c", "[a]", " a"):
        with pytest.raises(paths.PathError):
            ini.set_ini(F.col("t"), path, F.lit("x"))


@pytest.mark.parametrize(
    ("source", "key", "value", "want"),
    [
        (ENV, "A", "2", ENV.replace("A=1", "A=2")),
        (ENV, "B", "n w", ENV.replace(" 'x\ny'", '"n w"')),
        (ENV, "C", 'q"\\', ENV.replace("C=z", 'C="q\\"\\\\"')),
        (ENV, "D", "", ENV + '""'),
        (ENV, "E", "1", ENV + "\nE=1\n"),
        ("", "E", "1", "E=1\n"),
        ("A", "E", "1", "document_parse_failed"),
    ],
)
def test_set_dotenv(spark, source, key, value, want):
    assert edited(spark, source, lambda t: text.set_dotenv(t, key, F.lit(value))) == want


@pytest.mark.parametrize(("key", "want"), [("A", ENV[4:]), ("B", ENV.replace("export B = 'x\ny' # r\n", "")), ("D", ENV[:-2]), ("E", "document_path_not_found")])
def test_unset_dotenv(spark, key, want):
    assert edited(spark, ENV, lambda t: text.unset_dotenv(t, key)) == want


# VARIANT columns

CANARY = "CANARY"
SECRETS = '{"api_secret":"CANARY","b":{"c_secret":[1,"CANARY"],"d_url":{"e":["https://u:CANARY@h/?x_secret=CANARY",5,null]}},"n":null,"k_secret":null,"z":[[{"q_secret":"CANARY"}],{}]}'


@pytest.fixture(scope="module")
def variants(spark):
    docs = [SECRETS, '[1,{"a_secret":"CANARY"}]', '"x"', "null", "{}", None, '{"a":' * 12 + '"CANARY"' + "}" * 12]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string").select("id", F.parse_json("t").alias("v"))
    nested = df.select("id", "v", F.create_map(F.lit("in_url"), F.col("v"), F.lit("x_secret"), F.parse_json(F.lit('"CANARY"'))).alias("m"), F.array("v").alias("a"), F.struct(F.col("v").alias("inner")).alias("s"))
    return nested


@pytest.mark.parametrize("form", ["json", "plain", "yaml"])
def test_no_secret_survives_in_variants(variants, form):
    out = frames.render(variants, form).withColumn("leak", lint.leaks(F.col("rendered"), CANARY)).collect()
    assert not any(r.leak for r in out)
    assert all(r.rendered for r in out)


def test_redacted_variants_keep_all_else(spark, variants):
    out = [r[0] for r in frames.redact(variants.select("v")).select(F.to_json("v")).collect()]
    assert out[0] == '{"api_secret":"***","b":{"c_secret":"***","d_url":{"e":["https://u:***@h/?x_secret=***",5,null]}},"k_secret":null,"n":null,"z":[[{"q_secret":"***"}],{}]}'
    assert out[1:6] == ['[1,{"a_secret":"***"}]', '"x"', "null", "{}", None]


def test_variants_as_text(spark):
    doc = '{"took_ms":1500,"took":2,"in":{"size_bytes":2048,"size":{"x":1},"price_usd_cents":999},"f":10000000.5e3,"h":1e-7,"w s":"a b","l":[1,"x"],"e":{}}'
    df = spark.createDataFrame([(doc,)], "t string").select(F.parse_json("t").alias("v"))
    assert frames.render(df, "plain").first()[0] == 'v.e={} v.f=10000000500.0 v.h=1e-7 v.in.price=$9.99 v.in.size.x=1 v.in.size_bytes=2048 v.l=1,x v.took=2 v.took_ms=1500 "v.w s"="a b"'
    assert frames.render(df, "json").first()[0] == '{"v":{"e":{},"f":10000000500.0,"h":1e-7,"in":{"price_usd_cents":999,"size":{"x":1},"size_bytes":2048},"l":[1,"x"],"took":2,"took_ms":1500,"w s":"a b"}}'
    assert frames.render(df, "yaml").first()[0] == '---\nv:\n  e: {}\n  f: 10000000500.0\n  h: 1e-7\n  in:\n    price_usd_cents: 999\n    size:\n      x: 1\n    size_bytes: 2048\n  l:\n    - 1\n    - "x"\n  took: 2\n  took_ms: 1500\n  "w s": "a b"'


def test_json_numbers(spark):
    rows = [(1e7, "10000000.0"), (1e-7, "1e-7"), (1.5e16, "1.5e16"), (1e15, "1000000000000000.0"), (-1.25e-5, "-0.0000125"), (0.001, "0.001"), (2.5, "2.5"), (1.2345e8, "123450000.0"), (1.23456789012e9, "1234567890.12")]
    df = spark.createDataFrame([(x,) for x, _ in rows], "x double").coalesce(1)
    assert [r[0] for r in frames.render(df, "json").collect()] == [f'{{"x":{t}}}' for _, t in rows]


def test_lint_of_variants(spark):
    doc = '{"latency":5,"size_bytes":-1,"x_rfc3339":"no","created_at":"x","big":9007199254740993,"a/b_url":["https://a b"],"password":"x","n_ms":"1","in":[{"e_epoch_ns":5}],"ok_url":[null,"http://h"],"u_sats":"12","t_secret":"x","token":null}'
    df = spark.createDataFrame([(1, doc)], "id int, t string").select("id", F.parse_json("t").alias("v"))
    found = {(r.rule_id, r.pointer) for r in lint.lint_values(df, ["id"]).collect()}
    wrong = {"/v/size_bytes", "/v/x_rfc3339", "/v/a~1b_url", "/v/n_ms", "/v/in/0/e_epoch_ns"}
    assert found == {("suffix_type_mismatch", p) for p in wrong} | {("missing_suffix", f"/v/{k}") for k in ("latency", "created_at", "password")} | {("unsafe_integer", "/v/big")}


def test_planted_secrets_behind_escapes(spark):
    texts = ["xsk-1", "x\\u0073k-1", '\\"s\\k-1', "%73k-1", "%5Cu0073k-1", "\\ud83d\\ude00sk\\x2d1", "\\\\u0073k-1"]
    df = spark.createDataFrame([(t,) for t in [*texts, "clean", "100%", "\\"]], "t string").coalesce(1)
    assert [r[0] for r in df.select(lint.leaks(F.col("t"), "sk-1")).collect()] == [True] * 7 + [False] * 3
    with pytest.raises(ValueError, match="empty"):
        lint.leaks(F.col("t"), "")


def test_plain_text_of_variants_runs_no_lambdas(spark):
    """Names that are known per row were told by lambdas, which run unoptimized: 2 ms a row."""
    df = spark.createDataFrame([(1, '{"a_ms":5}')], "id int, t string").select("id", F.parse_json("t").alias("v"))
    out = frames.render(df, "plain")
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first()[0] == "id=1 v.a=5ms"
    # Other columns may stand among the pairs of a value.
    mixed = df.select("v", F.lit(7).alias("v.a-b"), F.struct("v", F.lit(2).alias("n_ms")).alias("s"), F.lit(None).cast("struct<x:variant>").alias("z"))
    assert frames.render(mixed, "plain").first()[0] == "s.n=2ms s.v.a=5ms v.a=5ms v.a-b=7 z="


def test_formats_of_variants_are_those_of_columns(spark):
    """Both ways to a readable value give the same text for each kind."""
    kinds = [s[1:] for s in (*names.TIMESTAMPS, *names.CURRENCIES, *names.NAMED, *names.UNITS, *names.SHORT)] + ["cents", "micro"]
    longs = [0, 1, -1, 99, -100, 999, 1000, -1500, 1023, 1024, 1075, 1126, 123456, 2**20 - 1, 2**30, 2**40, 1700000000123, 10**15, 2**53 + 1, 2**62, -(2**62)]
    doubles = [0.0, -0.5, 1.25, 2.0, 999.5, 999.9999, 1000.5, -1500.25, 1062.5, 1e7, 12345678.25, 1e15, 1.5e16, 1e17, 1e-7, 1.5e-9, 1e-5]
    texts = ["", "12", "-5", "1.5", " 12", "1\n", "***", "2024-01-01", "1700000000000000000", "-1", "9" * 38, "9" * 45]
    for data, typed, values in ((T.LongType(), "long", longs), (T.DoubleType(), "double", doubles), (T.StringType(), "string", texts)):
        df = spark.createDataFrame([(x,) for x in values], f"x {typed}").coalesce(1)
        want = df.select(*[formats.readable(F.col("x"), data, k, "THB").alias(k) for k in kinds]).collect()
        as_json = lambda x: plain._float(repr(x)) if typed == "double" else x
        assert [[plain._readable(as_json(x), k, "THB") for k in kinds] for x in values] == [list(r) for r in want], typed
