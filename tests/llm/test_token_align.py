"""Alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldlens.llm import token_align
from fieldlens.llm.token_align import Aligner, align_tokenizers

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
A.encode_special_tokens = True
NAME_A = {i: t for t, i in A.get_vocab().items()}
ODD = ["a", "b", " ", "  ", "\n", "\t", "\u00e9", "\U0001f600", "\u2581", "<s>", "<|endoftext|>", "12", "'s", "\u6f22\u5b57", "\x1c", "\u3000", "the", "ing", "<0x41>", "\x00", "\u0085", "\u200b", "e\u0301"]


def bytes_of_characters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def groups_of(text):
    """[(A ids, B ids)] of a text; None: no tokens."""
    if not text:
        return None
    raw, of = (" " + text).encode(), bytes_of_characters()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    as_bytes = [[bytes(of[c] for c in NAME_A[i]) for i in a], [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("\u2581", " ").encode() for i in b]]
    if any(b"".join(x) != raw for x in as_bytes):
        return None
    at, by_end = 0, [{}, {}]
    for side, ids in enumerate((a, b)):
        at = 0
        for n, i in enumerate(ids):
            at += len(as_bytes[side][n])
            by_end[side][at] = i
    out, now = [], ([], [])
    for end in sorted(by_end[0].keys() | by_end[1].keys()):
        for side in (0, 1):
            if end in by_end[side]:
                now[side].append(by_end[side][end])
        if end in by_end[0] and end in by_end[1]:
            out.append(now)
            now = ([], [])
    return out


def expected(rows):
    each = [(i, groups_of(t)) for i, t in rows]
    links = [Counter((p, q) for x, y in g or () for p in x for q in y) for _, g in each]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), own in zip(each, links):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in own.items() if count[p] == most[p[0]])
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), own.total(), best, sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [token_align.CHUNK, 40])
def test_links_of_texts(monkeypatch, chunk):
    monkeypatch.setattr(token_align, "CHUNK", chunk)
    own, texts = Aligner(PATH_A, PATH_B, most=50), odd_texts(1200, 1)
    for i in range(0, len(texts), 40):
        for text, got in zip(texts[i : i + 40], own.align(texts[i : i + 40])):
            want = groups_of(text)
            assert (want is None) == (got is None)
            if got:
                links = Counter((p, q) for x, y in want for p in x for q in y)
                assert got[:4] == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want), len(want), links.total())
                assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(got[5], got[6])} == dict(links)


@pytest.mark.parametrize("most_known", [token_align.MOST_KNOWN, 60, 0])
def test_same_as_plain_loops(docs, spark, most_known):
    rows = [(i, t) for i, t in enumerate(odd_texts(150, 2))]
    words = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    rows += [(1000 + i, t[:2000]) for i, t in enumerate(words)] + [(5, "again"), (5, "again"), (None, "no id"), (7, None), (8, ""), (9, "long " * 3000), (10, "x" * 20000)]
    got = align_tokenizers(docs(rows), most_known=most_known)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_empty_table_and_clashing_names(spark, docs):
    assert align_tokenizers(docs([])).collect() == []
    rows = [(1, "one two"), (2, None)]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], "doc_id long, text string, _id int, _row int, _pairs int, n_a int")
    assert sorted(map(tuple, align_tokenizers(df).collect()), key=str) == expected(rows)
