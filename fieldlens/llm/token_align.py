"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Byte offsets at which a token of A (byte-level BPE, over a space and the text) and
one of B (byte-fallback BPE, which adds that space itself) both end cut a text
into groups; every A token of a group is linked with every B token of it.

1. Texts are cut at single spaces between two characters that are no white space.
   Both tokenizers end a token there, so a piece has the same tokens and groups in any
   text. New pieces of a batch are encoded and aligned together: sums of token lengths
   are ends, ``intersect1d`` gives common cuts, ``searchsorted`` the groups, ``repeat``
   the links. Pieces seen before come from a table that a worker keeps, of two
   generations of at most ``CACHE_PIECES`` entries.
2. A document's row holds its distinct id pairs and how often they are linked. These
   rows are written once, to the shared folder.
3. Documents are counted by pair in two shuffles: by pair and a salt, then by pair.
4. Counts of the most frequent pairs, ``MOST_KNOWN`` at most, are broadcast and looked
   up where the documents are; pairs beyond those are joined, with the same result.

Defined results: texts that are null or empty, or whose tokens don't give back
exactly a space and the text, have no tokens: zeros and an empty groups_sha256; null
and repeated ids are documents of their own; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialize, slices_by_bytes, tokenizer_path, worker_cache

BATCH_BYTES = 1 << 19
CACHE_PIECES = 200_000
#: Pieces that share a string of A's.
TOGETHER = 200
#: Longer pieces hardly come again.
LONGEST_KEPT = 64
#: Links that are expanded at once.
CHUNK = 1 << 21
#: Pairs whose counts are broadcast (17 bytes each), and salts of the first shuffle.
MOST_KNOWN, SALTS = 1 << 20, 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level entry: printable characters of one byte stand for
    themselves, other bytes for the characters from U+0100 on, in order."""
    return bytes(_BYTE_OF[c] for c in token)


_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _clean(piece: str) -> bool:
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The links of A's tokens from ``start`` to ``stop`` as a << 32 | b."""
    count_b = np.bincount(group_b)
    first_b = np.cumsum(count_b) - count_b
    mine = group_a[start:stop]
    times = count_b[mine]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(a[start:stop], times) << 32 | b[np.repeat(first_b[mine], times) + within]


class Aligner:
    """Entries of pieces: n_a, n_b, n_groups, n_links, groups as text, links as bytes, and
    (links, how often) in place of these for pieces with very many. False: a piece whose
    tokens don't give it back."""

    def __init__(self, path_a: str, path_b: str, most: int = CACHE_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.most = Tokenizer.from_file(path_a), most
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        entries = {i: special[i].encode() if i in special else byte_level(t) for t, i in self.a.get_vocab().items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of B crosses the beginning of a word: texts can't be cut at spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.young: dict[str, tuple | bool] = {}
        self.old: dict[str, tuple | bool] = {}

    def _ids_a(self, pieces: list[str]) -> list[list[int]]:
        """A's tokens of pieces, each after a space. Clean pieces share strings: A ends a
        token before each of their spaces."""
        shared = [p for p in pieces if _clean(p)]
        out = {p: e.ids for p, e in zip(odd, self.a.encode_batch_fast([" " + p for p in odd], add_special_tokens=False), strict=True)} if (odd := [p for p in pieces if not _clean(p)]) else {}
        for i in range(0, len(shared), TOGETHER):
            own = shared[i : i + TOGETHER]
            ids = self.a.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.size_a[ids])
            last = np.cumsum([len(p.encode()) + 1 for p in own])
            stops = (np.searchsorted(ends, last) + 1).tolist()
            if not np.isin(last, ends).all():
                raise ValueError("A doesn't end a token before a single space: texts can't be cut there")
            out.update((p, ids[j:k]) for p, j, k in zip(own, [0, *stops[:-1]], stops, strict=True))
        return [out[p] for p in pieces]

    def _new(self, pieces: list[str]) -> dict[str, tuple | bool]:
        """Entries of pieces, each after a space."""
        if not pieces:
            return {}
        a, b = self._ids_a(pieces), self.b.encode(pieces, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        whole = (" " + " ".join(pieces)).encode()
        if b"".join(map(of_a, chain.from_iterable(a))) == whole == b"".join(map(of_b, chain.from_iterable(b))) and all(map(_clean, pieces)):
            return dict(zip(pieces, self._aligned(a, b), strict=True))
        out: dict[str, tuple | bool] = dict.fromkeys(pieces, False)
        good = [i for i, p in enumerate(pieces) if b"".join(map(of_a, a[i])) == (raw := (" " + p).encode()) and b"".join(map(of_b, b[i])) == raw]
        if good:
            out.update(zip([pieces[i] for i in good], self._aligned([a[i] for i in good], [b[i] for i in good]), strict=True))
        return out

    def _aligned(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        n_a, n_b = (np.array([len(x) for x in y]) for y in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(y), dtype=np.int64) for y in (a, b))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        # Of each piece: where its tokens, groups and links end.
        last_a = np.cumsum(n_a)
        groups = group_a[last_a - 1] + 1
        many = np.cumsum(count_b[group_a])[last_a - 1]
        text_a, text_b = (list(map(self.names.__getitem__, chain.from_iterable(x))) for x in (a, b))
        stop_a, stop_b = np.cumsum(count_a).tolist(), np.cumsum(count_b).tolist()
        texts = [
            text_a[i] + "|" + text_b[k] if j - i == m - k == 1 else ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m])
            for i, j, k, m in zip([0, *stop_a[:-1]], stop_a, [0, *stop_b[:-1]], stop_b, strict=True)
        ]
        whole = links(flat_a, flat_b, group_a, group_b, 0, len(flat_a)).tobytes() if many[-1] <= CHUNK else None
        spans = [list(zip([0, *x.tolist()[:-1]], x.tolist(), strict=True)) for x in (groups, many, last_a, np.cumsum(n_b))]
        out = []
        for (g, h), (x, y), (s, t), (u, v) in zip(*spans, strict=True):
            raw, counted = b"", None
            if whole is not None:
                raw = whole[8 * x : 8 * y]
            else:
                own = flat_a[s:t], flat_b[u:v], group_a[s:t] - g, group_b[u:v] - g
                if y - x <= CHUNK:
                    raw = links(*own, 0, t - s).tobytes()
                else:
                    counted = _counted(*own)
            out.append((t - s, v - u, h - g, y - x, ";".join(texts[g:h]), raw, counted))
        return out

    def align(self, texts: list[str]) -> list[tuple | None]:
        """Of each text n_a, n_b, n_groups, n_links, the digest, distinct links and how often
        they occur; None: no tokens."""
        rows, new = [], {}
        for t in texts:
            if not t:
                rows.append(None)
                continue
            pieces = t.split(" ")
            found = list(map(self.young.get, pieces))
            missing = {p for p, x in zip(pieces, found, strict=True) if x is None} if None in found else ()
            if not all(map(_clean, missing)):
                pieces = _SAFE.split(t)
                found = list(map(self.young.get, pieces))
                missing = {p for p, x in zip(pieces, found, strict=True) if x is None}
            new.update(dict.fromkeys(missing))
            rows.append((pieces, found))
        again = {p: self.old[p] for p in new if p in self.old}
        fresh = again | self._new([p for p in new if p not in again])
        out = []
        for row in rows:
            found = row and [fresh[p] if x is None else x for p, x in zip(*row, strict=True)]
            if not found or False in found:
                out.append(None)
                continue
            n_a, n_b, n_groups, n_links, groups, raw, counted = zip(*found, strict=True)
            distinct = np.unique(np.frombuffer(b"".join(raw), dtype=np.int64), return_counts=True)
            large = [c for c in counted if c is not None]
            out.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(";".join(groups).encode()).hexdigest(), *(_summed([distinct, *large]) if large else distinct)))
        self.young.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST_KEPT and _clean(p))
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out


def _counted(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links and how often they occur, expanded a chunk at a time."""
    so_far = np.cumsum(np.bincount(group_b)[group_a])
    edges = [0, *(1 + np.flatnonzero(np.diff(so_far // CHUNK))).tolist(), len(a)]
    return _summed([np.unique(links(a, b, group_a, group_b, i, j), return_counts=True) for i, j in zip(edges[:-1], edges[1:], strict=True) if i < j])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    each, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(each), dtype=np.int64)
    np.add.at(total, back, np.concatenate([p[1] for p in parts]))
    return each, total


def _rows(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, cache_pieces: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    none = (0, 0, 0, 0, "", np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j in slices_by_bytes(b.column(1), BATCH_BYTES):
                own = worker_cache(f"alignment {cache_pieces} {path_a} {path_b}", lambda: Aligner(path_a, path_b, cache_pieces))
                found = [x or none for x in own.align(b.column(1).slice(i, j - i).to_pylist())]
                n = [pa.array([x[c] for x in found], pa.int64()) for c in range(4)]
                ends = pa.array(np.cumsum([0, *(len(x[5]) for x in found)]), pa.int32())
                pairs, times = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[c] for x in found]))) for c in (5, 6))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.arange(at, at + j - i)), *n, pa.array([x[4] for x in found], pa.string()), pairs, times], names=["_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_times"])
                at += j - i

    schema = f"_id {kind}, _row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<long>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pair_counts(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(_pair, _n, _best): how many documents hold a pair, and whether no other pair
    with its A id is in more."""
    each = rows.select(F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"), F.explode("_pairs").alias("_pair"))
    salted = each.groupBy("_pair", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts, _ = materialize(salted.groupBy("_pair").agg(F.sum("_n").alias("_n")).withColumn("_a", F.shiftright("_pair", 32)), "pairs")
    most = counts.groupBy("_a").agg(F.max("_n").alias("_most"))
    return counts.join(most, "_a").select("_pair", "_n", (F.col("_n") == F.col("_most")).alias("_best"))


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent pairs, ``most`` at most, and whether these are all."""
    bins = counts.groupBy(F.floor(F.log2("_n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_n").alias("least"))
    total, floor, whole = 0, None, True
    for r in sorted(bins.collect(), key=lambda r: -r.bin):  # at most 8 x 63 rows
        if total + r.c > most:
            whole = False
            break
        total, floor = total + r.c, r.least
    return counts.where(F.col("_n") >= floor if floor is not None else F.lit(False)), whole


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str | None = None, tokenizer_b: str | None = None, cache_pieces: int = CACHE_PIECES, most_known: int = MOST_KNOWN) -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many
    documents as any with its A id), count_sum (documents of each link's pair, summed),
    groups_sha256."""
    spark = docs.sparkSession
    bound_batches(spark)
    path_a, path_b = tokenizer_a or tokenizer_path("byte_bpe_50k.json"), tokenizer_b or tokenizer_path("piece_bpe_32k.model")
    rows, _ = materialize(_rows(docs, id_col, text_col, path_a, path_b, cache_pieces), "aligned")
    counts, _ = materialize(pair_counts(rows), "counts")
    frequent, whole = _frequent(counts, most_known)
    table = frequent.toArrow().sort_by("_pair")
    arrays = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_pair", "_n", "_best")]
    known = spark.sparkContext.broadcast(arrays)
    kept = ["_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        pair, n, best = known.value
        for b in batches:
            lists, times = b.column(7), b.column(8).flatten().to_numpy()
            pairs, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            there = pair[at] == pairs if len(pair) else np.zeros(len(pairs), dtype=bool)
            at = np.where(there, at, 0)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            sums = total(np.where(there, n[at] * times, 0)) if len(pair) else total(0 * times)
            bests = total(np.where(there & best[at], times, 0)) if len(pair) else total(0 * times)
            left = pa.array(np.concatenate([[0], np.cumsum(~there)])[ends].astype(np.int32))
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~there])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), *rest], names=[*kept, "_bests", "_sums", "_pairs", "_times"])

    own = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    looked_up = rows.mapInArrow(run, ", ".join([*own, "_bests long, _sums long, _pairs array<long>, _times array<long>"]))
    best, total = F.col("_bests"), F.col("_sums")
    if not whole:
        looked_up, _ = materialize(looked_up, "looked-up")
        each = looked_up.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("_p")).select("_row", "_p._pairs", "_p._times")
        found = each.join(counts, F.col("_pairs") == F.col("_pair")).groupBy("_row").agg(F.sum(F.when(F.col("_best"), F.col("_times")).otherwise(0)).alias("_rest_best"), F.sum(F.col("_n") * F.col("_times")).alias("_rest_sum"))
        looked_up = looked_up.join(found, "_row", "left")
        best, total = best + F.coalesce("_rest_best", F.lit(0)), total + F.coalesce("_rest_sum", F.lit(0))
    return looked_up.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", best.cast("long").alias("n_best"), total.cast("long").alias("count_sum"), "groups_sha256")
