"""Token ids as ORC: one row per document, ids as an integer array.

Documents are range-partitioned by id (then by a hash of the text and the place in
the input, so that one id with a third of the rows still spreads; the input should
be a table, which a lost task reads again in the same order), sorted, encoded in
Arrow batches and written by Spark. ORC run-length-encodes the integers, keeps row
indexes and puts Bloom filters on the document id, so a reader takes stripes in
parallel and skips those that can't hold the ids it wants.

Texts are encoded in pieces that begin at a single space between two characters
that are no white space; a byte-level tokenizer with the usual splitting pattern
always ends a token there. The pieces of some megabytes of text are looked up at
once, in Arrow, among those seen lately, of which a worker keeps ``CACHE_PIECES``.
New ones are cut further where they consist of plain letters, digits, ASCII marks
and line feeds (each run is a unit of that pattern), and only units that weren't
seen lately go to the library, many to a string, told apart by the tokens that
begin with a space or line feed. With a tokenizer of another pattern the library
encodes whole texts.

Defined results: null text is an empty text (the end id alone); null ids sort
first; repeated ids are separate documents, ordered by text hash and text; other
columns are not read; an empty table gives files without rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bound_batches, scratch_path, slices_by_bytes, tokenizer_path, worker_cache

#: Text that is looked up at once, and text of the rows that are handed on at once.
GATHER_BYTES, BATCH_BYTES = 4 << 20, 1 << 19
CACHE_PIECES = 400_000
#: Units that share a string, and strings that go to the library at once.
TOGETHER, STRINGS = 200, 50
#: Bytes of a piece; longer ones hardly come again.
LONGEST_KEPT = 64
END_ID = 0
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: What ``\s`` is in Python, as a class for Arrow.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that can't be cut at each space.
_ODD_TEXT = f"{_WHITE} | {_WHITE}| $"
#: Pieces that can't share a string.
_ODD_PIECE = f"^{_WHITE}|{_WHITE}$|^$| "
#: Letters of all versions of Unicode; marks but for the apostrophe, which begins units like 's.
_LETTERS, _MARKS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}", r"!-&(-/:-@\[-`{-~"
_PLAIN = rf"^(?:\n?\n?[{_LETTERS}0-9{_MARKS}]+)+$"
_UNIT = rf"( ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n)"
_CUT = "\x1f"


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _begins_with(vocabulary: dict[str, int], letter: str) -> np.ndarray:
    """Of each id, whether its token begins with a letter of the byte alphabet."""
    begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    begins[[i for t, i in vocabulary.items() if t.startswith(letter)]] = True
    return begins


def _is_usual(tok) -> bool:
    """Whether texts are cut by the usual pattern alone, and special strings as they stand."""
    from tokenizers.pre_tokenizers import ByteLevel

    cuts, specials = tok.pre_tokenizer, tok.get_added_tokens_decoder().values()
    own = isinstance(cuts, ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
    return own and tok.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in specials)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, type=pa.int32()))


class Known:
    """Ids of strings seen lately; ``make`` gives those of new ones."""

    def __init__(self, make, most: int):
        self.make, self.most, self.now = make, most, 0
        self.names, self.ids = pa.array([], type=pa.string()), _lists(np.empty(0, dtype=np.int32), np.empty(0))
        self.seen = np.empty(0, dtype=np.int32)

    def places(self, strings: pa.Array) -> np.ndarray:
        """Each string's place in ``ids``."""
        n = len(self.names)
        found = pa.concat_arrays([self.names, strings]).dictionary_encode()
        if len(found.dictionary) > n:
            self.ids = pa.concat_arrays([self.ids, self.make(found.dictionary.slice(n))])
            self.names = found.dictionary
        self.now += 1
        places = found.indices.to_numpy()[n:]
        self.seen = np.concatenate([self.seen, np.zeros(len(self.names) - n, dtype=np.int32)])
        self.seen[places] = self.now
        return places

    def forget(self) -> None:
        """Drop long strings, and all but those seen last if they are too many."""
        keep = pc.binary_length(self.names).to_numpy() <= LONGEST_KEPT
        if keep.sum() > self.most:
            keep[np.argsort(np.where(keep, self.seen, -1), kind="stable")[: -self.most // 2]] = False
        if not keep.all():
            self.names, self.ids, self.seen = self.names.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.seen[keep]


class Pieces:
    """Ids of texts. Heads begin a text, the other pieces follow a space."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        self.tok = _tokenizer(path)
        self.usual = _is_usual(self.tok)
        vocabulary = self.tok.get_vocab()
        self.space, self.feed = _begins_with(vocabulary, "\u0120"), _begins_with(vocabulary, "\u010a")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.heads = Known(self._alone, max(1, most // 10))
        self.pieces = Known(self._pieces, most)
        self.units = Known(self._units, most)

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _alone(self, strings: pa.Array) -> pa.ListArray:
        each = self._encode(strings.to_pylist())
        return _lists(np.concatenate([np.empty(0, dtype=np.int32), *each]), np.cumsum([len(e) for e in each]))

    def _together(self, units: pa.Array, begins: np.ndarray, drop: int = 0) -> pa.ListArray:
        """Encode units that all begin with a token of ``begins`` and hold no other;
        ``drop``: so many of their tokens stay away."""
        _, at, data = units.buffers()
        at = np.frombuffer(at, dtype=np.int32)[units.offset : units.offset + len(units) + 1]
        cuts = [*at[:-1:TOGETHER].tolist(), int(at[-1])]
        strings = [data[i:j].to_pybytes().decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate([np.empty(0, dtype=np.int32), *(e for i in range(0, len(strings), STRINGS) for e in self._encode(strings[i : i + STRINGS]))])
        starts = np.flatnonzero(begins[ids])
        if len(starts) != len(units):
            raise ValueError("the tokenizer doesn't cut texts at each space and line feed")
        sizes = np.diff(np.append(starts, len(ids))) - drop
        return _lists(np.delete(ids, starts) if drop else ids, np.cumsum(sizes))

    def _split(self, mask: pa.Array, strings: pa.Array, yes, no) -> pa.ListArray:
        """The ids that ``yes`` gives for the strings of ``mask`` and ``no`` for the others."""
        flags = mask.to_numpy(zero_copy_only=False)
        if flags.all() or not flags.any():
            return (yes if flags.all() else no)(strings)
        both = pa.concat_arrays([yes(strings.filter(mask)), no(strings.filter(pc.invert(mask)))])
        return both.take(pa.array(np.argsort(np.argsort(~flags, kind="stable"))))

    def _units(self, new: pa.Array) -> pa.ListArray:
        """Units of plain pieces, with the space before them or without one."""

        def bare(units):
            return self._split(pc.equal(units, "\n"), units, self._alone, lambda u: self._together(pc.binary_join_element_wise("\n", u, ""), self.feed, 1))

        return self._split(pc.starts_with(new, " "), new, lambda u: self._together(u, self.space), bare)

    def _plain(self, new: pa.Array) -> pa.ListArray:
        cut = pc.replace_substring_regex(pc.binary_join_element_wise(" ", new, ""), _UNIT, rf"\1{_CUT}")
        units = pc.split_pattern(pc.utf8_rtrim(cut, _CUT), _CUT)
        places = self.units.places(units.flatten())
        ids = self.units.ids.take(pa.array(places))
        return _lists(ids.values.to_numpy(), ids.offsets.to_numpy()[units.offsets.to_numpy()[1:]])

    def _pieces(self, new: pa.Array) -> pa.ListArray:
        special = pa.array(np.zeros(len(new), dtype=bool))
        for s in self.special:  # the library cuts those out first
            special = pc.or_(special, pc.match_substring(new, s))
        odd = pc.or_(special, pc.match_substring_regex(new, _ODD_PIECE))
        plain = pc.and_not(pc.match_substring_regex(new, _PLAIN), odd)

        def spaced(pieces):
            return pc.binary_join_element_wise(" ", pieces, "")

        def others(pieces):
            return self._split(odd.filter(pc.invert(plain)), pieces, lambda p: self._alone(spaced(p)), lambda p: self._together(spaced(p), self.space))

        return self._split(plain, new, self._plain, others)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text."""
        split = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, _ODD_TEXT).to_numpy(zero_copy_only=False)
        if not odd.any():
            return split
        again = pa.array([_SAFE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], type=split.type)
        return pa.concat_arrays([again, split.filter(pa.array(~odd))]).take(pa.array(np.argsort(np.argsort(~odd, kind="stable"))))

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.ListArray:
        """Each text's ids, and ``end`` after them."""
        last = [] if end is None else [end]
        if not self.usual:
            each = [np.append(e, last).astype(np.int32) for e in self._encode(texts.to_pylist())]
            return _lists(np.concatenate([np.empty(0, dtype=np.int32), *each]), np.cumsum([len(e) for e in each]))
        cut = self._cut(texts.cast(pa.string()))
        flat, at = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        first = np.zeros(len(flat), dtype=bool)
        first[at[:-1]] = True
        starts, rest = flat.filter(pa.array(first)), flat.filter(pa.array(~first))
        del cut, flat
        places = np.empty(len(first), dtype=np.int32)
        places[first] = self.heads.places(starts)
        places[~first] = self.pieces.places(rest)
        places[~first] += len(self.heads.ids)
        del starts, rest
        ids = pa.concat_arrays([self.heads.ids, self.pieces.ids, pa.array([last], type=self.pieces.ids.type)])
        places = np.insert(places, at[1:], len(ids) - 1)
        found = ids.take(pa.array(places))
        del ids, places
        for known in (self.heads, self.pieces, self.units):
            known.forget()
        return _lists(found.values.to_numpy(), found.offsets.to_numpy()[at[1:] + np.arange(1, len(texts) + 1)])


def _pieces_of(path: str, cache_pieces: int = CACHE_PIECES) -> Pieces:
    return worker_cache(f"token ids {cache_pieces} {path}", lambda: Pieces(path, cache_pieces))


def encode_batch(texts: list[str], path: str, cache_pieces: int = CACHE_PIECES) -> list[bytes]:
    """Each text's ids as little-endian 32-bit integers."""
    ids = _pieces_of(path, cache_pieces).encode(pa.array(texts, type=pa.string()))
    values, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
    return [values[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


def _gathered(batches, most: int):
    """(ids, texts) of ``most`` bytes of text to twice that: small batches are put together, large ones cut."""
    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
        if held and (b is None or sum(h.column(1).nbytes for h in held) >= most):
            keys, texts = (pa.concat_arrays([h.column(c) for h in held]) for c in (0, 1))
            held = []
            for i, j in slices_by_bytes(texts, 2 * most):
                yield keys.slice(i, j - i), texts.slice(i, j - i)


def write_token_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, stripe_bytes: int = 32 << 20, bloom_fpp: float = 0.01) -> None:
    """Write (id, part, part_start, n_tokens, ids) in ascending id order.

    Files follow each other by ``part``; ``part_start`` counts the ids before
    the document in its file.
    """
    vocabulary = tokenizer or tokenizer_path("byte_bpe_50k.json")
    narrow = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, part long, part_start long, n_tokens long, ids array<int>"

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for keys, texts in _gathered(batches, GATHER_BYTES):
            ids = _pieces_of(vocabulary).encode(texts, end_id)
            ends = ids.offsets.to_numpy().astype(np.int64)
            n = np.diff(ends)
            rows = pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(at + ends[:-1]), pa.array(n), ids], names=[id_col, "part", "part_start", "n_tokens", "ids"])
            del ids
            pa.default_memory_pool().release_unused()
            for i, j in slices_by_bytes(texts, BATCH_BYTES):
                yield rows.slice(i, j - i)
            at += int(ends[-1])

    bound_batches(df.sparkSession)
    keys = [F.col(id_col), F.xxhash64("text")]
    ordered = narrow.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys, "text")
    (
        ordered.mapInArrow(run, schema)
        .write.option("compression", "lz4")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, only: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The files' rows with their global ``start``; ``only``: some ids, whose
    predicate reaches the ORC reader (stripe statistics, row index, Bloom filter)."""
    rows = spark.read.orc(path)
    # One row a file: the total of ids in it.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if only is not None:
        rows = rows.where(F.col(id_col).isin(only))
    return rows.join(before, F.col("part") == F.col("_p"), "left").select(id_col, (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def summarize(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    kind = rows.schema[id_col].dataType.simpleString()

    def check(batches):
        for b in batches:
            ids = b.column(3)
            at = ids.offsets.to_numpy()
            values = ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, type=pa.int64())], names=[id_col, "part", "part_start", "n_tokens", "ids_crc32"])

    checked = rows.select(id_col, "part", "part_start", "ids").mapInArrow(check, f"`{id_col}` {kind}, part long, part_start long, n_tokens long, ids_crc32 long")
    return checked.join(before, F.col("part") == F.col("_p"), "left").select(id_col, (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_id_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the files to a folder of their own in the shared scratch folder and
    return what :func:`summarize` reads from them."""
    path = scratch_path(df.sparkSession, "token-ids")
    write_token_ids(df, path, id_col, text_col, tokenizer)
    return summarize(df.sparkSession, path, id_col)
