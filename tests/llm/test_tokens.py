import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlens.llm import token_counts, token_ids
from fieldlens.llm._common import scratch_path, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a  b ", "a\n\n b\t c", "x<|endoftext|>y <|endoftext|> z", "é é ́x", "  a　 b", "it's we'll 's", "1 22 333", "a" * 5000, "word " * 4000, "\x1c \x1f", "🙂 🙂🙂", "end ", "\n"]


load = lru_cache(Tokenizer.from_file)


def tokens(path, text):
    return load(path).encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(spark, docs):
    rows = [*enumerate(ODD), (None, "null id"), (3, "repeated id"), (3, "repeated id")]
    got = token_counts.token_counts(docs(rows).withColumn("n_tokens", F.lit("clash"))).collect()
    want = [(i, len((t or "").encode()), n := len(tokens(WORD, t)), n > 2048) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_counts_of_an_empty_table(docs):
    assert token_counts.token_counts(docs([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sé1.<|> ́Σ"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_pieces_change_nothing(texts):
    assert token_counts.count_batch(texts, WORD) == [len(tokens(WORD, t)) for t in texts]
    assert token_ids.encode_batch(texts, BYTE) == [np.array(tokens(BYTE, t), dtype="<u4").tobytes() for t in texts]


def test_small_cache_changes_nothing():
    texts = [" ".join(f"w{i}" for i in range(k, k + 50)) for k in range(20)]
    assert token_counts.count_batch(texts, WORD, cache_pieces=10) == [len(tokens(WORD, t)) for t in texts]
    assert token_ids.encode_batch(texts, BYTE, cache_pieces=10) == [np.array(tokens(BYTE, t), dtype="<u4").tobytes() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\tabZ'sßŸſƀªé×19.,<|>_%\x1f\x85\xa0\u3000"), st.sampled_from("ab ")), max_size=80), max_size=5))
def test_units_change_nothing(texts):
    assert token_ids.encode_batch(texts, BYTE, cache_pieces=30) == [np.array(tokens(BYTE, t), dtype="<u4").tobytes() for t in texts]


def test_a_word_is_encoded_once_whatever_stands_beside_it(monkeypatch):
    seen = []

    class Heard:
        def __init__(self, path):
            self.tok = load(path)

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, strings, **how):
            seen.extend(strings)
            return self.tok.encode_batch_fast(strings, **how)

    monkeypatch.setattr(token_ids, "_tokenizer", Heard)
    texts = ["The harbour, harbour. harbour!\nHarbour harbour;\nHarbour (harbour)", "A harbour.\n\nHarbour, harbour: harbour 12 harbour"]
    for t in [*texts, texts[0]]:
        assert token_ids.encode_batch([t], BYTE, cache_pieces=12345) == [np.array(tokens(BYTE, t), dtype="<u4").tobytes()]
    assert "".join(seen).count(" harbour") == "".join(seen).count("Harbour") == 1


def test_small_batches_are_looked_up_together():
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i]), "text": pa.array(["x" * n])}) for i, n in enumerate([30, 40, 0, 90, 600, 10])]
    got = [(k.to_pylist(), sum(map(len, t.to_pylist()))) for k, t in token_ids._gathered(iter(batches), 100)]
    assert [i for k, _ in got for i in k] == list(range(6)) and sum(n for _, n in got) == 770
    assert [k for k, _ in got][0] == [0, 1, 2, 3]


def test_a_tokenizer_of_another_pattern(tmp_path):
    form = json.loads(load(BYTE).to_str())
    form["pre_tokenizer"]["use_regex"] = False
    path = str(tmp_path / "other.json")
    Tokenizer.from_str(json.dumps(form)).save(path)
    texts = ["it is. It was  ", "", "a b"]
    assert token_ids.encode_batch(texts, path) == [np.array(tokens(path, t), dtype="<u4").tobytes() for t in texts]


def test_files_round_trip(spark, docs):
    rows = [*enumerate(ODD), (None, "null id"), (40, "later"), (40, "later"), (40, "another")]
    table = docs(rows).withColumn("ids", F.lit("clash"))
    got = token_ids.token_id_files(table).collect()
    coded = [(i, np.array([*tokens(BYTE, t), 0], dtype="<u4")) for i, t in rows]
    assert sorted((str(i), len(c), zlib.crc32(c.tobytes())) for i, c in coded) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_reading_some_ids(spark, docs):
    path = scratch_path(spark, "test-ids")
    token_ids.write_token_ids(docs([(i, f"text number {i}") for i in range(300)]), path)
    got = {r.doc_id: (r.start, list(r.ids)) for r in token_ids.read_token_ids(spark, path, only=[7, 250]).collect()}
    everything = {r.doc_id: (r.start, list(r.ids)) for r in token_ids.read_token_ids(spark, path).collect()}
    assert got == {i: everything[i] for i in (7, 250)}
    assert everything[7][1] == [*tokens(BYTE, "text number 7"), 0]


def test_files_of_an_empty_table(docs):
    assert token_ids.token_id_files(docs([])).count() == 0
