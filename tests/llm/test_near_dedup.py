"""The stage that drops near copies."""

import random

import pytest

import corpus_pipeline
from fieldlens.llm import near_dedup


def shingles(text, n=5):
    w = near_dedup.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def planted(low, high, n):
    """``n`` pairs of texts, each like its partner alone, with a similarity from ``low`` to below ``high``."""
    rng, pairs = random.Random(8), []
    while len(pairs) < n:
        base = [f"k{len(pairs)}x{rng.randrange(10**9)}" for _ in range(rng.randrange(60, 200))]
        other = [w if rng.random() > 0.03 else f"y{rng.randrange(10**9)}" for w in base]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if low <= len(a & b) / len(a | b) < high:
            pairs.append((" ".join(base), " ".join(other)))
    return pairs


def test_the_stage_drops_copies_from_080_up(spark, docs):
    near, apart = planted(0.8, 0.85, 40), planted(0.7, 0.8, 20)
    texts = [t for pair in near + apart for t in pair]
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(list(enumerate(texts))), "").collect()}
    assert got == {i for i in range(len(texts)) if i >= 2 * len(near) or i % 2 == 0}


@pytest.mark.parametrize(("similarity", "least"), [((100, 85), 14), ((100, 80), 11), ((100, 50), 2), ((100, 100), 32)])
def test_least_number_of_shared_values(similarity, least):
    assert near_dedup.least_shared(similarity) == least


def test_a_group_of_near_copies_makes_no_row_for_each_list_in_joins_of_nodes(spark, docs, monkeypatch):
    """What a node's set and sketch are joined with has one row a node, however many of
    its lists are open; and no join is broadcast by the size of the files it reads."""
    seen, thresholds = [], []
    with_sets, able = near_dedup._with_sets, near_dedup._able

    def spy_sets(nodes, *rest):
        seen.append((nodes.count(), nodes.select("_node").distinct().count()))
        return with_sets(nodes, *rest)

    def spy_able(*args):
        thresholds.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        return able(*args)

    monkeypatch.setattr(near_dedup, "_with_sets", spy_sets)
    monkeypatch.setattr(near_dedup, "_able", spy_able)
    monkeypatch.setattr(near_dedup, "HUBS", (1, 2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(150), 4):
            words[j] = f"x{i}y{j}"
        texts.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(texts)).collect()}

    sets = [shingles(t) for _, t in texts]
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(sets))}
    assert seen and all(rows == nodes for rows, nodes in seen)
    assert thresholds and set(thresholds) == {"-1"}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
