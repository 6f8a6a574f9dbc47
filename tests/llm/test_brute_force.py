"""Operators without SQL against plain Python on small tables, and bounds that must hold."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlens.llm import chat, decontaminate, lm_score, mixing, near_dedup, toxicity, vector_topk


class PlainPpm:
    """Method C with symbol exclusion, in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            for context, symbol in self.positions(t):
                for o in range(order + 1):
                    self.counts[context[len(context) - o :]][symbol] += 1

    def positions(self, text):
        stream = bytes([lm_score.PAD]) * self.order + b" ".join(lm_score.words(text)) + bytes([lm_score.END])
        return [(stream[i - self.order : i], stream[i]) for i in range(self.order, len(stream))]

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for o in range(self.order, -1, -1):
            seen = self.counts.get(context[len(context) - o :])
            if not seen:
                continue
            total = sum(n for s, n in seen.items() if s not in excluded)
            new = max(len(set(seen) - excluded), 1)
            if symbol in seen:
                return p * seen[symbol] / (total + new)
            p *= new / (total + new)
            excluded = set(seen)
        return p / max(1, lm_score.SYMBOLS - len(self.counts.get(b"", {})))

    def score(self, text):
        return sum(math.log10(self.probability(*x)) for x in self.positions(text))


@pytest.mark.parametrize("max_nodes", [10**6, 40])
def test_scores_of_texts(docs, max_nodes):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(rng.randrange(12)))) for i in range(50)]
    rows += [(90, "Zebra é"), (91, None), (92, "ab ab ab"), (92, "ab ab ab")]
    plain = PlainPpm([t for i, t in rows if zlib.crc32(str(i).encode()) % 10], 3)
    got = lm_score.lm_scores(docs(rows), order=3, max_nodes=max_nodes).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((i, round(plain.score(t), 6)) for i, t in rows)


@pytest.mark.parametrize("bias", [1.0, -4.0])
def test_gradient_of_the_risk(bias):
    rng = np.random.default_rng(1)
    rows = [rng.choice(6, size=rng.integers(1, 4), replace=False).tolist() for _ in range(30)]
    positive, prior, ridge = np.arange(30) < 10, 0.2, 0.01
    w = np.append(rng.normal(size=6), bias)

    def risk(w):
        g = [sum(w[f] for f in r) + w[-1] for r in rows]
        p = [1 / (1 + math.exp(-x)) for x in g]
        first = prior * sum(1 - x for x in p[:10]) / 10
        rest = sum(p[10:]) / 20 - prior * sum(p[:10]) / 10
        return (first + rest if rest >= 0 else -rest) + ridge / 2 * sum(x * x for x in w[:-1])

    flat, row_of = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(30), [len(r) for r in rows])
    got = toxicity.gradient(w, flat, row_of, positive, prior, ridge)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        assert math.isclose(got[i], (risk(w + step) - risk(w - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-7)


def test_bound_of_training_rows(spark, docs, monkeypatch):
    seen = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, *a, **k: seen.append(len(rows)) or real(rows, *a, steps=5))
    rows = [(1, "vile words here")] * 500 + [(1, f"vile {i}") for i in range(200)] + [(i, f"plain text {i}") for i in range(10, 200)]
    labels = spark.createDataFrame([(1, 1), (10, 0)] + [(1, 1)] * 50, "doc_id long, toxic int")
    toxicity.fit(docs(rows), labels, max_positive=20, max_unlabelled=30)
    assert seen and seen[0] < 120


def test_every_document_labelled(spark, docs):
    rows = [(i, f"plain{i % 7} text words " + ("vile nasty" if i % 4 == 0 else "good kind")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs(rows), labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)


@pytest.mark.parametrize("budget", [700, 1500, None])
def test_drawn_documents(spark, docs, budget):
    rng = random.Random(6)
    rows = [(0, "w " * 5, "one")] * 40 + [(i, "w " * rng.randrange(1, 9), "big" if i % 3 else "mid") for i in range(1, 150)]
    table = docs(rows)
    size, unit = Counter(), {}
    for i, t, s in rows:
        size[s] += len(t.split())
        unit[i, s] = len(t.split())
    total = sum(size.values())
    share = {s: n / total for s, n in size.items()}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        ratios = [share[s] ** a / share[s] for s in share]
        low, high = (low, a) if max(ratios) / min(ratios) <= 2 else (a, high)
    weight = {s: share[s] ** high / sum(x**high for x in share.values()) for s in share}
    least = min(weight[s] / share[s] for s in share)
    wanted = {s: round(weight[s] * (budget or total / least)) for s in share}
    # The order of each pass is Spark's hash; what is drawn is counted here.
    hashed = table.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h")).distinct()
    copies = Counter((i, s) for i, _, s in rows)
    want = Counter()
    for s in size:
        before = 0
        for epoch in range(99):
            for r in hashed.where(F.col("source") == s).orderBy(F.xxhash64(F.lit(mixing.SEED), F.lit(epoch), "h"), "h").collect() if before < wanted[s] else []:
                if before < wanted[s]:
                    n = min(copies[r.doc_id, s], -(-(wanted[s] - before) // unit[r.doc_id, s]))
                    want[r.doc_id] += n
                    before += copies[r.doc_id, s] * unit[r.doc_id, s]
    drawn = mixing.mix(table, budget=budget).collect()
    assert Counter(r.doc_id for r in drawn) == want
    assert Counter(r.doc_id for r in mixing.mixed_documents(table, budget=budget).collect()) == want


def planted(rng, n, low, high):
    out = []
    while len(out) < n:
        base = [f"k{len(out)}x{rng.randrange(10**9)}" for _ in range(rng.randrange(40, 160))]
        other = [w if rng.random() > 0.03 else f"y{rng.randrange(10**9)}" for w in base]
        a, b = near_dedup.shingles(b" ".join(w.encode() for w in base).split()), near_dedup.shingles(b" ".join(w.encode() for w in other).split())
        inter = len(np.intersect1d(a, b))
        if low <= inter / (len(a) + len(b) - inter) < high:
            out.append((" ".join(base), " ".join(other)))
    return out


def test_recall_of_links_near_the_threshold(docs):
    pairs = planted(random.Random(9), 300, 0.85, 0.9)
    # Passages that many share fill inverted lists with texts that are no partners.
    common = [f"c{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)] + [(1000 + i, " ".join([*common, *(f"own{i}z{j}" for j in range(70))])) for i in range(150)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) == 300
    assert all(got[i] == i for i in range(1000, 1150))


def test_a_large_group_below_and_above_the_threshold(docs):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(100)]

    def edited(n):
        out = list(base)
        for i in rng.sample(range(100), n):
            out[i] = f"e{rng.randrange(10**9)}"
        return " ".join(out)

    rows = [(i, edited(rng.choice([0, 1, 2, 3, 5]))) for i in range(160)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(160))
    for i in range(160):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert [got[i] for i in range(160)] == root


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(i, [1e14, 1e14]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vector_topk.top_k(df, F.col("vec_id") == 0)


def test_turns_that_tie(spark):
    rows = [(1, 0, "user", x) for x in "dbca"] + [("2", 0, None, "x")][:0] + [(2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.collapse(df.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))).collect()
    assert [(r.conv_id, r.text.replace("<|user|>", "").split()) for r in got] == [("c1", list("abcd"))]


def test_repeated_benchmark_rows(spark, docs):
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, text)] * 500 + [(8, "short one"), (9, text), (None, text), (10, None), (11, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    table = docs([(1, "x " + text + " y"), (2, "a short one here"), (3, "nothing"), (4, None)])
    blocks = decontaminate._blocks(bench, "item_id", "text", 200)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == 6
    for block_bytes in (1 << 20, 200):
        got = {r.doc_id: r for r in decontaminate.report(table, bench, block_bytes=block_bytes).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[2].n_hit, got[3].n_hit, got[4].n_words) == (32, 30, 2, 2, 0, 0)
        assert {r.doc_id for r in decontaminate.remove_documents(table, bench, block_bytes=block_bytes).collect()} == {3, 4}


def test_pipeline_of_copies_nulls_and_empty_tables(spark, docs, tmp_path):
    rng = random.Random(21)
    vocabulary = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(120)]
    copies = [(1000 + i, rows[3][1]) for i in range(80)] + [rows[5]] * 4
    rows += [*copies, (None, "no id at all"), (200, None), (201, "")]
    d = str(tmp_path / "a")
    docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
    assert set(got) == {i for i in range(120) if i != 7} | {None, 200, 201} and got[5] == 1
    e = str(tmp_path / "b")
    docs([]).write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{e}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{e}/benchmark.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0
