"""The classifier from labels to scores against plain loops."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from fieldlens.llm import toxicity

STEPS = 40


def plain_words(text):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    return set(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def plain_features(text):
    return {h >> 1 for w in plain_words(text) for h in [xxhash.xxh3_64_intdigest(w), *(xxhash.xxh3_64_intdigest(w[:n], seed=n) for n in (4, 5, 6, 7) if len(w) > n)]}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def sigmoid(x, most):
    return 1 / (1 + math.exp(-max(-most, min(most, x))))


def plain_scores(rows, labels):
    usable = [(i, y) for i, y in labels if i is not None and y is not None and not held(i)]
    prior = min(0.9, sum(y for _, y in usable) / len(usable))
    toxic = {i for i, y in usable if y == 1}
    sample = [(i in toxic, plain_features(t)) for i, t in dict.fromkeys((i, t) for i, t in rows if i is not None and not held(i))]
    n_p = sum(p for p, _ in sample)
    n_u = len(sample) - n_p
    p, u = (Counter(f for own, x in sample if own == side for f in x) for side in (True, False))
    z = {}
    for f in p.keys() | u.keys():
        mean = (p[f] + u[f]) / (n_p + n_u)
        z[f] = (p[f] / n_p - u[f] / n_u) / math.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)
    good = [f for f in z if p[f] >= max(4, n_p / 1000) and z[f] > 4 and prior * p[f] / n_p >= 0.5 * (u[f] + 1) / n_u]
    bad = [f for f in z if u[f] >= max(4, n_u / 1000) and z[f] < -4]
    chosen = [*good, *bad]
    w, bias = dict.fromkeys(chosen, 0.0), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    keys = [*chosen, None]
    m, v = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    data = [(own, [f for f in chosen if f in x]) for own, x in sample]
    for step in range(1, STEPS + 1):
        prob = [sigmoid(sum(w[f] for f in x) + bias, 30) for _, x in data]
        rest = sum(q for q, (own, _) in zip(prob, data) if not own) / n_u - prior * sum(q for q, (own, _) in zip(prob, data) if own) / n_p
        d = dict.fromkeys(keys, 0.0)
        for q, (own, x) in zip(prob, data):
            slope = q * (1 - q)
            of_rest = -prior * slope / n_p if own else slope / n_u
            each = (-prior * slope / n_p if own else 0) + of_rest if rest >= 0 else -of_rest
            for f in [*x, None]:
                d[f] += each
        for f in keys:
            slope = d[f] + (1e-5 * w[f] if f is not None else 0)
            m[f], v[f] = 0.9 * m[f] + 0.1 * slope, 0.999 * v[f] + 0.001 * slope * slope
            change = 0.05 * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
            if f is None:
                bias -= change
            else:
                w[f] -= change
    assert good and bad
    return [sigmoid(sum(w[f] for f in chosen if f in plain_features(t)) + bias, 500) for _, t in rows]


def test_scores_of_plain_loops(spark, docs, monkeypatch):
    rnd = random.Random(3)
    common, rude, kind = ([f"{stem}{i}" for i in range(12)] for stem in ("plain", "insulting", "thankful"))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        own = rnd.choices(common, k=6) + (rnd.choices(rude, k=3) if toxic else rnd.choices(kind, k=2))
        rows.append((i, " ".join(own)))
        if i < 200:
            labels.append((i, int(toxic)))
    rows += [(None, "insulting1 insulting2"), (300, None), (301, ""), (4, rows[4][1]), (5, "ANOTHER Text Of insulting3")]
    labels += [(None, 1), (400, None)]
    monkeypatch.setattr(toxicity, "train", functools.partial(toxicity.train, steps=STEPS))
    got = toxicity.toxicity_scores(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((i, s) for (i, _), s in zip(rows, plain_scores(rows, labels))), key=key)
    found = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-9)
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
