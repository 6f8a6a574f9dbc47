"""The operators against brute force on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlens.llm import chat, lm_score, mixing, near_dedup, toxicity, vector_topk


def shingles(text, n=5):
    w = near_dedup.words(text)
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), None if doc is None else least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_duplicates(docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(rng, base, rng.randrange(6)) for _ in range(60)]
    texts += [" ".join(base), " ".join(base).upper(), "  ".join(base), "a b", "A  b", "a b c d e", None, "", " \n", "x " * 500]
    texts += [edited(rng, [f"p{i}" for i in range(40)] + [f"q{k}{i}" for i in range(60)], 0) for k in range(8)]
    rows = [*((100 - i, t) for i, t in enumerate(texts)), (None, " ".join(base)), (50, "a b"), (50, "a b")]
    got = near_dedup.near_duplicates(docs(rows).withColumn("kept", F.lit(3))).collect()
    want = brute_components(rows)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, want))
    assert all(r.kept == (None if r.doc_id is None else r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_an_empty_table(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_top_k(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * spread).astype(float).tolist()) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 6), (402, [None] * 6), (None, [1.0] * 6), (403, []), (404, [0.5, 0.5]), (405, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = vector_topk.top_k(df, F.col("vec_id") % 50 == 0, rows_per_shard=40).collect()
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-sum(map(int.__mul__, q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -score) for k, (score, j) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_chat_collapse(spark):
    def turns(conv, texts):
        return [(conv, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)]

    rows = turns(1, ["a", "b", "c"]) + turns(2, ["a", "b"]) + turns(3, ["a", "b", "c"]) + turns(4, ["a", "x"]) + turns(5, ["a"]) + turns(6, [None]) + turns(7, [""]) + [(None, 0, "user", "lost")] + turns(8, ["long"] * 3000)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).repartition(5)
    got = {}
    for r in chat.collapse(df, part_chars=4000).orderBy("conv_id", "part").collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert set(got) == {1, 4, 6, 7, 8}
    assert got[1] == "<|assistant|>\na\n<|user|>\nb\n<|assistant|>\nc\n" and got[8].count("long") == 3000
    assert chat.collapse(df.where("false")).count() == 0


def test_lm_scores(spark, docs):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(60)] + [(100, None), (101, ""), (102, "Zebra é"), (None, "word1"), (7, "again")]
    df = docs(rows).withColumn("score", F.lit("clash"))
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in [*lm_score.words(t), None])
    n, v = sum(counts.values()), len(counts)
    for max_words in (1000, 5):
        got = lm_score.lm_scores(df, max_words=max_words).collect()
        assert len(got) == len(rows)
        by = {(r.doc_id, r.n_tokens): r for r in got}
        for i, t in rows:
            w = [*lm_score.words(t), None]
            r = by[i, len(w)]
            assert r.train_tokens == n and r.n_known == sum(counts[x] > 0 for x in w)
            assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            assert r.score < 0
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and all(r.score > -150 for r in held)  # about 200 bytes each; 480 without a model


@pytest.mark.parametrize("max_nodes", [10**6, 12])
def test_byte_probabilities_sum_to_one(spark, docs, max_nodes):
    table = docs([(i, t) for i, t in enumerate(["abracadabra abra", "banana band", "cab", "b"])])
    counts = lm_score.count_training(table.select("text"), 3)
    trie = lm_score.Trie(lm_score.contexts(counts.where("kind = 0").select("key", "n"), 3, max_nodes))
    for context in (b"abr", b"zzz", b"zab", b"ana", bytes([lm_score.PAD] * 3)):
        grams = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256) if s != lm_score.PAD], dtype=np.uint64)
        assert math.isclose((10 ** trie.costs(grams)).sum(), 1, rel_tol=1e-9)


def test_lm_scores_of_empty_tables(docs):
    assert lm_score.lm_scores(docs([])).count() == 0
    assert lm_score.lm_scores(docs([(1, None)])).first().n_tokens == 1


def toxic_rows():
    rng = random.Random(2)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choices(words, k=40) + (["vile", "nastyness"] if bad else []))))
        if i % 5 < 2:
            labels.append((i, int(bad)))
    return rows + [(2000, None), (2001, ""), (None, "plain1")], labels


def test_toxicity(spark, docs):
    rows, labels = toxic_rows()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs(rows).withColumn("score", F.lit(9)), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.doc_id is not None and r.doc_id < 900 and r.doc_id % 6 == 0)
    clean = toxicity.keep_clean(docs(rows), table)
    assert clean.columns == docs(rows).columns and clean.count() == len(rows) - 150
    assert {r.predicted for r in toxicity.toxicity_scores(docs(rows), table.where("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity_scores(docs([]), table).count() == 0


def test_mixing(spark, docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 20), "big" if i < 300 else "mid" if i < 360 else None if i < 380 else "small") for i in range(400)] + [(500, None, "big")]
    table = docs(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += max(1, len((t or "").split()))
    drawn = mixing.mix(table, max_repeats=3.0, blocks=8).collect()
    got, times = Counter(), Counter(r.doc_id for r in drawn)
    for r in drawn:
        got[r.source] += r.n_tokens
    ratio = {s: got[s] / size[s] for s in size}
    assert math.isclose(ratio["big"], 1, abs_tol=0.02) and all(0.98 <= x <= 3.3 for x in ratio.values()) and max(ratio.values()) > 2.5
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 4
    assert {r.block for r in drawn if r.source == "big"} == set(range(8))
    whole = mixing.mixed_documents(table, max_repeats=3.0)
    assert whole.columns == table.columns and Counter(r.doc_id for r in whole.collect()) == times
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed_documents(docs([])).count() == 0


def test_exponent(spark):
    shares = spark.createDataFrame([(x,) for x in (0.7, 0.2, 0.1)], "_share double")
    a = mixing.find_exponent(shares, None, entropy=1.0)
    p = np.array([0.7, 0.2, 0.1]) ** a
    p /= p.sum()
    assert math.isclose(-(p * np.log(p)).sum(), 1.0, abs_tol=1e-6)


def test_pipeline(spark, docs, tmp_path):
    rows, labels = toxic_rows()
    docs(rows[:300]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(300) if i % 6 and i != 1}
