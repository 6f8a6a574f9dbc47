"""A model that is too large to broadcast gives the same scores."""

import math
import random

import numpy as np
import pytest

from fieldlens.llm import lm_score


@pytest.mark.parametrize("max_nodes", [1, 60, 900])
def test_scores_do_not_depend_on_what_is_broadcast(spark, docs, max_nodes):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(12))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Zebra 42 \u4e2d"), (None, "abc"), (7, "again"), (7, "again")]
    score = lambda most: sorted((r.n_tokens, r.doc_id or -1, r.score) for r in lm_score.lm_scores(docs(rows), max_nodes=most).collect())
    whole, joined = score(10**6), score(max_nodes)
    assert len(whole) == len(joined) == len(rows)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(whole, joined, strict=True))


def test_joined_costs_are_those_of_the_trie(spark, docs):
    table = docs([(i, t) for i, t in enumerate(["abracadabra abra", "banana band", "cab", "b"])])
    grams = lm_score.count_training(table.select("text"), 3).where("kind = 0").select("key", "n")
    trie = lm_score.Trie(lm_score.contexts(grams, 3, 10**6))
    keys = np.array([int.from_bytes(c + bytes([s]), "big") for c in (b"abr", b"zzz", b"zab", b"ana", bytes([lm_score.PAD] * 3)) for s in range(256) if s != lm_score.PAD], dtype=np.uint64)
    asked = spark.createDataFrame([(int(np.int64(k)),) for k in keys.astype(np.int64)], "key long")
    got = {r.key: r.cost for r in lm_score.gram_costs(grams, asked, 3).collect()}
    want = trie.costs(keys)
    assert len(got) == len(keys) and all(math.isclose(got[int(k)], c, rel_tol=1e-9) for k, c in zip(keys, want, strict=True))
