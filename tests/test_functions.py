from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.functions import formats, names, urls, validators
from fieldlens.operators import frames


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_names():
    assert names.is_secret("api_secret") and names.is_secret("API_SECRET") and not names.is_secret("api_Secret")
    assert names.meaning("price_thb_cents") == ("price", "cents", "THB")
    assert names.meaning("total_amount_cents") is None and names.meaning("_thb_cents") is None
    assert names.meaning("day_rfc3339_date") is None and names.meaning("x_epoch_ms")[1] == "epoch_ms"


def test_urls(spark):
    cases = {
        "https://u:p@h/x": "https://u:***@h/x",
        "https://u:p@q@h": "https://u:***@h",
        "http://h/?a_secret=1&b=2#c_secret=3": "http://h/?a_secret=***&b=2#c_secret=***",
        "http://h/?x%5Fsecret=1": "http://h/?x%5Fsecret=***",
        "http://h/?flag_secret": "http://h/?flag_secret",
        "http://h:99999/?a_SECRET=": "http://h:99999/?a_SECRET=***",
        "no url a_secret=1": "no url a_secret=1",
        None: None,
    }
    assert values(spark, cases, urls.redact_url) == list(cases.values())


def test_urls_in_text(spark):
    cases = {
        "see (http://u:p@h/a_b), and http://x/?k_secret=1.": "see (http://u:***@h/a_b), and http://x/?k_secret=***.",
        "x http://u:p@h/  http://u:p@h，http://u:p@h》": "x http://u:***@h/  http://u:***@h，http://u:***@h》",
        "12http://u:p@h": "12http://u:***@h",
        "nothing": "nothing",
    }
    assert values(spark, cases, urls.redact_urls_in_text) == list(cases.values())


def test_formats(spark):
    df = spark.createDataFrame([(1280, -1, 1500, -499)], "a long, b long, c long, d long")
    show = lambda c, kind, code=None: formats.readable(F.col(c), T.LongType(), kind, code)
    got = df.select(show("a", "bytes"), show("b", "bytes"), show("a", "ms"), show("c", "jpy"), show("d", "usd_cents"), show("b", "epoch_ms"), show("c", "micro", "USD")).first()
    assert tuple(got) == ("1.2KiB", None, "1.28s", "¥1,500", "-$4.99", "1969-12-31T23:59:59.999Z", "0.001500 USD")


def test_validators(spark):
    assert values(spark, ["2024-02-29", "2023-02-29", "2024-2-1", None, "2024-02-29\n"], validators.is_rfc3339_date) == [True, False, False, False, False]
    assert values(spark, ["2024-02-29T10:00:00Z", "2024-02-29t10:00:00.5+01:00", "2024-02-29T10:00:60Z", "2024-02-29 10:00:00Z"], validators.is_rfc3339) == [True, True, False, False]
    assert values(spark, ["utc", "+5", "+0530", "-9:30", "+24", "+00:00", "5"], validators.normalize_utc_offset) == ["UTC", "+05:00", "+05:30", "-09:30", None, "UTC", None]


def test_nested_redaction_and_rendering(spark):
    df = spark.createDataFrame([((1, "s"), ["a b", "c"], None)], "n struct<size_bytes: long, k_secret: string>, tags array<string>, x_secret string")
    assert frames.render(df).first()[0] == 'n.k=*** n.size=1B tags="a b,c" x_secret='
