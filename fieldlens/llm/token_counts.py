"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries (a space or a line feed, which no token of a
tokenizer that drops white space ever crosses), so that a very long text is
never encoded in one piece. Each batch of about ``batch_bytes`` encodes its new
pieces in one call of the library; lengths of pieces seen before come from a
table of at most ``cache_pieces`` entries that each worker keeps.

Defined results: null text counts as empty (0 bytes, 0 tokens); null ids are
returned as they are; repeated rows give repeated results; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, slices_by_bytes, tokenizer_path, worker_cache

BATCH_BYTES = 4 << 20
CACHE_PIECES = 300_000


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Known:
    """A tokenizer and the lengths of pieces that it has counted."""

    def __init__(self, path: str):
        self.tok, self.lengths = _tokenizer(path), {}


def pieces(text: str) -> list[str]:
    """The parts of a text between spaces and line feeds; empty ones change nothing."""
    return text.replace("\n", " ").split(" ")


def count_batch(texts: list[str], path: str, cache_pieces: int = CACHE_PIECES) -> list[int]:
    """Tokens of each text."""
    own = worker_cache("token counts " + path, lambda: Known(path))
    known = own.lengths
    split = [pieces(t) for t in texts]
    new = list(set(chain.from_iterable(split)) - known.keys())
    if new:
        if len(known) + len(new) > cache_pieces:
            known.clear()
            new = list(set(chain.from_iterable(split)))
        for e, piece in zip(own.tok.encode_batch_fast(new, add_special_tokens=False), new, strict=True):
            known[piece] = len(e)
    get = known.__getitem__
    return [sum(map(get, s)) for s in split]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, tokenizer: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer``: path of a tokenizers file whose pre-tokenizer drops white space.
    """
    bound_batches(df.sparkSession)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    narrow = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for i, j in slices_by_bytes(texts, batch_bytes):
                part = texts.slice(i, j - i)
                n = np.array(count_batch(part.to_pylist(), path), dtype=np.int64)
                size = pc.binary_length(part).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, schema)
