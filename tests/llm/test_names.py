"""Stages keep extra columns whatever their names, also those that stages use themselves."""

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity

NAMES = [
    "_id", "_key", "_text_key", "_odd_id", "_odd_key", "_odd_stays", "_row", "_rows", "_stays", "_root", "_c", "_node", "_digest", "_n", "_sketch", "_bits", "_v", "_text", "_words", "_hit",
    "_mask", "_items", "k0", "k1", "_g", "_doc", "_tokens", "_epoch", "_perm", "_last", "_copy", "_times", "_block", "_rep", "_a", "_b", "score", "predicted", "_score", "hits",
]
LONG = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, LONG), (2, LONG + " more"), (3, "quite another text of a few more words than ten in all"), (4, None), (5, ""), (5, "")]
    named = ", ".join(f"`{n}` string" for n in NAMES)
    data = [(i, t, "en", "s", len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {named}").repartition(2)


def stages(spark):
    bench = spark.createDataFrame([("b", "another text of a few more words than ten in")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    return {
        "near": near_dedup.drop_near_duplicates,
        "exact": exact_dedup.drop_exact_duplicates,
        "documents": lambda d: decontaminate.remove_documents(d, bench),
        "spans": lambda d: decontaminate.remove_spans(d, bench),
        "mixing": mixing.mixed_documents,
        "toxicity": lambda d: toxicity.keep_clean(d, labels),
    }


@pytest.mark.parametrize("name", ["near", "exact", "documents", "spans", "mixing", "toxicity"])
def test_columns_stay(spark, wide, name):
    out = stages(spark)[name](wide)
    assert out.columns == wide.columns
    rows = out.collect()
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n}-{r.doc_id}" for n in NAMES]
    ids = sorted(r.doc_id for r in rows)
    if name == "near":
        assert ids == [1, 3, 4, 5, 5]  # wordless texts are linked with nothing
    if name == "exact":
        assert len(ids) == 4
    if name == "documents":
        assert 3 not in ids
    if name == "spans":
        assert next(r.text for r in rows if r.doc_id == 3).split() == ["quite", "all"]


def test_marks_of_a_table_with_their_names(spark, wide):
    bench = spark.createDataFrame([("b", "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10")], "item_id string, text string")
    got = {r.doc_id: (r._words, r.hits.words, r.hits.hit, r.hits["items"]) for r in decontaminate.mark_hits(wide.drop("hits"), bench, ["doc_id", "_words"]).where(F.col("doc_id") < 4).collect()}
    assert got[1] == ("_words-1", 60, 10, ["b"]) and got[3][2] == 0
