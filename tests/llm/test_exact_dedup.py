"""Exact dedup against dictionaries, on one level and on many."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from fieldlens.llm.exact_dedup import ContentTable, drop_exact_duplicates, exact_duplicates


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i, text))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))
        out += [(m[2], keep[2], len(members), hashlib.sha256(content.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["ab", "é", "\U0001f600", "c d", "　", "x" * 50]
    return [(i, None if rnd.random() < 0.05 else rnd.choice(["", " ", "\n\t"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"own_bytes": 20, "bucket_bytes": 100, "most_bytes": 200}, {"own_bytes": 0, "bucket_bytes": 1, "most_bytes": 1}])
def test_same_as_dictionaries(docs, sizes):
    rows = texts(300, 1) + [(1000 + i, "the same text") for i in range(200)] + [(None, "the sametext"), (2000, "y" * 5000), (2001, "y " * 5000)]
    got = exact_duplicates(docs(rows, 7), **sizes).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for group in by.values():
        assert [r.doc_id for r in group if r.kept] == [group[0].keep_id]


def test_repeated_rows_and_empty_table(docs):
    got = exact_duplicates(docs([(5, "a b"), (5, "a b"), (5, "ab"), (7, None), (8, " \n")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(5, 5, 3)] * 3 + [(7, 8, 2), (8, 8, 2)]
    assert sum(r.kept for r in got) == 2
    assert exact_duplicates(docs([])).collect() == []
    assert drop_exact_duplicates(docs([])).collect() == []


def test_rows_that_stay_keep_columns_with_internal_names(spark):
    names = ["_id", "_key", "_row", "_record", "_points", "_sha", "_hash", "_size", "_content", "_bucket", "_piece", "_leader", "_now", "_n", "_best", "_stays", "_keep", "_odd_id", "_odd_key", "_odd_stays", "_text_key"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b", "ab", "c", None, "c"])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]
    assert exact_duplicates(df).count() == 5


def test_equal_hashes_are_told_apart_by_content():
    table = ContentTable(slots=4)
    assert [table.place(7, bytes([i % 50]), i) for i in range(200)] == [i % 50 for i in range(200)]


def test_scratch_tables_can_be_deleted(spark, docs):
    from fieldlens.llm import _common

    assert exact_duplicates(docs([(1, "a"), (2, "a")])).count() == 2
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_common.scratch_dir(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    _common.cleanup(spark)
    assert not files.exists(path)
