"""Codebooks and codes against a plain Lloyd in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from fieldlens.llm.vector_codes import build, compress, filtered


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label)."""
    good = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1])
    good = [r for r in good if len(r[1]) == width]
    ends = np.cumsum([0, *map(len, np.array_split(range(width), parts))]).tolist()
    spans = list(zip(ends, ends[1:]))
    books = [[r[1][a:b] for r in good[:entries]] for a, b in spans]
    gap = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p, (a, b) in enumerate(spans):
            held = [[] for _ in books[p]]
            for r in good:
                held[nearest(r[1][a:b], books[p])].append(r[1][a:b])
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out = []
    for i, v, lab in good:
        codes = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(spans)]
        out.append((i, "".join(f"{c:02x}" for c in codes), sum(gap(v[a:b], books[p][c]) for p, ((a, b), c) in enumerate(zip(spans, codes))), lab))
    total = lambda lab: sum(r[2] for r in out if r[3] == lab)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total(lab), digest) for i, c, e, lab in out), key=str)


def vectors(n, d, seed, step=None):
    rnd = random.Random(seed)
    value = lambda: rnd.gauss(0, 1) if step is None else step * rnd.randint(-2, 2)
    return [(i, [value() for _ in range(d)], rnd.choice([None, 0, 1, 2])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(
    ("rows", "block"),
    [
        (vectors(300, 16, 1), 4096),
        (vectors(300, 16, 2, step=0.25), 50),  # many ties
        (vectors(40, 11, 3), 7),
        (vectors(9, 8, 4), 4096),  # fewer rows than entries
        (vectors(60, 16, 5) + [(100, None, 1), (101, [1.0, None] * 8, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 0), (104, [], 0), (105, [0.5] * 8, 0), (3, [0.1] * 16, 2), (None, [0.2] * 16, None)], 20),
        ([(i, [0.5] * 16, None) for i in range(200)], 64),  # one vector, repeated
    ],
)
def test_same_as_plain_lloyd(spark, rows, block):
    got = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = vectors(50, 16, 6)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", _id int, _v int, code int")
    assert sorted(map(tuple, compress(df).collect()), key=str) == plain(rows)


def test_large_components_are_an_error(spark):
    with pytest.raises(ValueError, match="64 bits"):
        compress(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))


def test_whole_subtrees_are_assigned_at_once():
    """Points in tight clusters need few looks at single points."""
    rng = np.random.default_rng(1)
    centres = np.arange(16)[:, None] * np.full((1, 8), 100_000)
    points = (centres[rng.integers(0, 16, 4096)] + rng.integers(-50, 50, (4096, 8))).astype(np.int64)
    order, levels = build(points)
    codes = np.full(4096, -1)
    sums, counts = filtered(levels, points[order], centres.astype(np.int64), codes=codes)
    want = ((points[order][:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == want).all()
    assert (counts == np.bincount(want, minlength=16)).all()
    assert (sums == np.stack([points[order][want == e].sum(axis=0) for e in range(16)])).all()
