import hashlib
import re

from pyspark.sql import functions as F

from fieldlens.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, bench, n=10):
    low = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, items = low(text), set(), set()
    for item, body in bench:
        w = low(body)
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1) if w else ():
            if tuple(own[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                items |= {item} - {None}
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


ITEM = "One two, three four five six seven eight nine ten eleven twelve."
BENCH = [(1, ITEM), (1, ITEM), (10, "short item"), (2, None), (3, "..."), (None, "nameless words here"), (9, ITEM + " short item"), (4, "Über straße")]
TEXTS = [None, "", "!!", "x " + ITEM.upper() + " y", "one two three four five six seven eight nine", "a short-item b", "nameless words here", "über\nSTRAßE", "Über straße ok", "w " * 3000 + ITEM + " w" * 3000, ITEM]


def test_report_is_brute_force(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [*enumerate(TEXTS), (None, ITEM), (3, "again")]
    table = docs(rows).withColumn("n_words", F.lit("clash")).withColumn("item_id", F.lit(1))
    want = sorted(str((i, *brute(t, BENCH))) for i, t in rows)
    for block_bytes in (1 << 20, 64):
        got = decontaminate.report(table, bench, block_bytes=block_bytes).collect()
        assert sorted(map(str, map(tuple, got))) == want


def test_removal(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    table = docs(list(enumerate(TEXTS)))
    clean = decontaminate.remove_documents(table, bench)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(TEXTS) if not brute(t, BENCH)[4]]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(table, bench).collect()}
    assert len(cut) == len(TEXTS) and cut[3] == "x . y" and cut[5] == "a  b" and cut[4] == TEXTS[4]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs([(1, ITEM)]), none).first().contaminated is False
    assert decontaminate.report(docs([]), none).count() == 0
