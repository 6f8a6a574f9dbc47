"""Benchmark decontamination by a broadcast hash set of test n-grams.

The benchmark's words get numbers; each window of ``n`` consecutive words (or a
shorter item's whole text) is stored under a 64-bit hash. Tasks turn a document
into word numbers, hash all its windows at once with numpy, look the hashes up
and verify each hit on the words themselves.

The set is broadcast in blocks of distinct benchmark items of at most
``block_bytes`` of text each, and one item more, cut by running sums of bytes. A
byte of text takes about 5 bytes in the arrays of hashes, places and word numbers,
and each distinct word about 120 in the table of numbers, so a block of ``BLOCK_BYTES``
stays below 200 MB. A benchmark of several blocks is scanned block by block, with
the words hit so far kept as a bit mask in a scratch table.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.

Defined results: null or wordless texts have no words and no hits; items without
words are ignored; an item with a null id marks words but is not named; repeated
item ids count once; an empty benchmark marks nothing; repeated documents give
repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialize, running_sums

N = 10
BLOCK_BYTES = 8 << 20
#: Bytes that end a word become spaces, A-Z become a-z.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for j in range(n):
        h = (h ^ ids[j : j + len(h)]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


class NgramSet:
    """The windows of some benchmark items, as arrays over their words."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = N):
        self.number: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        streams = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], dtype=np.uint32) for _, text in items]
        self.stream = np.concatenate([*streams, np.empty(0, np.uint32)])
        begin = np.cumsum([0, *map(len, streams)])
        #: Window length -> (sorted hashes, where in the stream each window begins, its item).
        self.tables = {}
        for k in sorted({min(n, len(x)) for x in streams} - {0}):
            own = [i for i, x in enumerate(streams) if min(n, len(x)) == k]
            count = np.array([len(streams[i]) - k + 1 for i in own])
            item = np.repeat(np.array(own, dtype=np.int32), count)
            place = np.concatenate([np.arange(begin[i], begin[i] + c, dtype=np.int64) for i, c in zip(own, count, strict=True)])
            hashes = _window_hashes(self.stream.astype(np.uint64), k)[place]
            # A window that an item repeats is kept once.
            order = np.lexsort((item, hashes))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (item[order][1:] == item[order][:-1])
            same = again.copy()
            for at in np.flatnonzero(again):
                a, b = place[order[at]], place[order[at - 1]]
                same[at] = np.array_equal(self.stream[a : a + k], self.stream[b : b + k])
            order = order[~same]
            self.tables[k] = (hashes[order], place[order], item[order])

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words, the mask of words hit, items with occurring windows."""
        found = words(text)
        hit, items = np.zeros(len(found), dtype=bool), set()
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in found), dtype=np.uint32, count=len(found))
        # Only windows without a foreign word can occur.
        foreign = np.concatenate([[0], np.cumsum(ids == 0)])
        for k, (hashes, place, item) in self.tables.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(foreign[k:] == foreign[:-k])
            if not len(at):
                continue
            h = _window_hashes(ids.astype(np.uint64), k)[at]
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                # Verified on the words: numbers stand for exactly one word.
                spans = self.stream[place[a:b, None] + np.arange(k)]
                own = item[a:b][(spans == ids[i : i + k]).all(axis=1)]
                if len(own):
                    hit[i : i + k] = True
                    items.update(own.tolist())
        return len(found), hit, {self.names[i] for i in items}


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    rows = bench.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    sized = rows.withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)
    if (sized.agg(F.sum("_size")).first()[0] or 0) <= block_bytes:
        return [rows]
    placed = running_sums(sized.withColumn("_all", F.lit(0)).withColumn("_hash", F.xxhash64("item", "text")), "_all", ["_hash"], ["_size"], "benchmark")
    numbered, _ = materialize(placed.select("item", "text", F.floor(F.col("_size_before") / block_bytes).alias("_block")), "benchmark")
    last = numbered.agg(F.max("_block")).first()[0]
    return [numbered.where(F.col("_block") == i) for i in range(last + 1)]


def _marked(docs: DataFrame, bench: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of each document as k0, k1 and so on, so that no name can
    clash, then ``_text`` if the text is not among them, and ``_words`` (count), ``_hit``
    (count), ``_mask`` (bits of the words hit, little-endian) and ``_items`` (ids as strings)."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = [] if text_col in keep else [F.col(text_col).alias("_text")]
    marks = [F.lit(0).cast("long").alias("_words"), F.lit(0).cast("long").alias("_hit"), F.lit(None).cast("binary").alias("_mask"), F.array().cast("array<string>").alias("_items")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *text, *marks)
    at, first = (len(keep) if text else keep.index(text_col)), len(keep) + len(text)
    blocks = _blocks(bench, item_col, item_text_col, block_bytes)
    for number, block in enumerate(blocks):
        items = [(r["item"], r["text"]) for r in block.collect()]  # at most block_bytes of text and one item
        sent = spark.sparkContext.broadcast(NgramSet(items, n))

        def run(batches, sent=sent):
            grams = sent.value
            for b in batches:
                count, hits, masks, found = [], [], [], []
                for body, mask, named in zip(b.column(at), b.column(first + 2), b.column(first + 3), strict=True):
                    m, hit, new = grams.scan(body.as_py())
                    if mask.is_valid:
                        hit |= np.unpackbits(np.frombuffer(mask.as_py(), dtype=np.uint8), count=m, bitorder="little").astype(bool)
                    count.append(m)
                    hits.append(int(hit.sum()))
                    masks.append(np.packbits(hit, bitorder="little").tobytes())
                    found.append(list({*named.as_py(), *(str(i) for i in new if i is not None)}))
                yield pa.RecordBatch.from_arrays([*b.columns[:first], pa.array(count, pa.int64()), pa.array(hits, pa.int64()), pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=b.schema.names)

        own = own.mapInArrow(run, own.schema)
        if number + 1 < len(blocks):
            own, _ = materialize(own, "decontaminate")
    return own


def mark_hits(docs: DataFrame, bench: DataFrame, keep: list[str], **options) -> DataFrame:
    """The columns ``keep`` of each document and ``hits``: a struct of words, hit (counts),
    mask (bits of the words hit, little-endian) and items (ids as strings)."""
    marks = F.struct(*[F.col(f"_{c}").alias(c) for c in ("words", "hit", "mask", "items")]).alias("hits")
    return _marked(docs, bench, keep, **options).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], marks)


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _marked(docs, bench, [id_col], **options).select(
        F.col("k0").alias(id_col),
        F.col("_words").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.col("_hit") > 0).alias("contaminated"),
    )


def _clean(sent):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not sent.value.scan(t)[1].any() for t in texts.to_pylist()], pa.bool_())

    return clean


def remove_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, columns as they were. Only texts go to Python."""
    spark, kept = docs.sparkSession, docs
    bound_batches(spark)
    blocks = _blocks(bench, item_col, item_text_col, block_bytes)
    for number, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(NgramSet([(r["item"], r["text"]) for r in block.collect()], n))
        kept = kept.where(_clean(sent)(F.col(text_col)))
        if number + 1 < len(blocks):
            kept, _ = materialize(kept, "decontaminate")
    return kept


def cut(text: str, mask: bytes) -> str:
    """The text without its runs of words that are hit."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
    hit = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(spans), bitorder="little").astype(bool)
    out, at, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            out.append(raw[at : spans[i][0]])
            while i + 1 < len(spans) and hit[i + 1]:
                i += 1
            at = spans[i][1]
        i += 1
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, the words that are hit cut from their texts."""
    marked = _marked(docs, bench, docs.columns, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            rows = zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
            new = [t if t is None or not any(m) else cut(t, m) for t, m in rows]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.column(at).type) if i == at else b.column(i) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])

    names = [f"k{i}" for i in range(len(docs.columns))]
    cut_ = marked.select(*names, "_mask").mapInArrow(run, marked.select(*names).schema)
    return cut_.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
