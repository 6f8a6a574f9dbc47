"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Tasks hash each document's distinct word shingles (64 bits) and keep the
   ``SKETCH`` smallest: a bottom-k sketch. Documents with the same words are
   one representative from then on; the others only follow it.
2. Inverted lists of retained values generate candidates. Of two sets with a
   ``similarity`` or more, the sketches share at least ``_least(s, similarity)`` of
   s values but for a chance of about 1e-8, so the lists hold only values that occur
   twice or more, and of a document's only so many of the rarest that any such
   partner must be met in one of them.
3. Lists are not paired out. First each document meets one other alone, the member
   it shares most lists with of those that come first in a list; that joins most of
   a large group. Lists whose members are joined by then are done. In the others the
   first few members (hubs) meet those that they aren't joined with yet, then the
   next few, and at last the members that are left. Between these steps what was
   joined is told from labels, which a few pointer jumps give; they only spare
   meetings, so they need not be complete. Members of a long list are dealt to
   blocks, to each of which its hubs are sent, so no key of a join is hot.
4. Set sizes, the number of shingles that a member of an open list shares with
   other labels, and the union sketch's estimate filter candidates; what is left is
   verified on the full sets. Components of all links come from large-star and
   small-star steps, all of them joins and aggregates.

Words are runs of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer
than ``WORDS`` words is one shingle.

Defined results: a null, empty or wordless text has no shingles and is linked
with nothing; a null id is linked with nothing, its component and kept are null;
rows that repeat an id are judged each by its own text; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bound_batches, drop_path, joins_by_true_size, materialize, rows_that_stay, worker_cache

WORDS = 5
SKETCH = 32
#: Link where PER_UNION * intersection >= PER_SHARED * union.
SIMILARITY = (100, 85)
#: The same where whole documents are dropped.
DROP_SIMILARITY = (100, 80)
#: A pair that is similar enough shares fewer sketch values than asked for with this chance at most.
MISSED = 1.1e-8
#: Places in a list up to which its members are hubs, step by step; then come all others.
HUBS = (4, 64)
#: Members of a list that meet its hubs in one block.
BLOCK = 1000
#: Bytes of an intermediate table to a file.
_FILE_BYTES = 64 << 20
#: 64-bit words of a sketch's bit set.
BIT_WORDS = 4
#: Sets up to this size are compared as a whole in the last step, by 32 bits of each shingle.
WHOLE = 256
#: Words of the filter that spares texts a shuffle (2 MB).
BLOOM_BLOCKS = 1 << 18
_CACHE_WORDS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(found: list[bytes], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words."""
    if not found:
        return np.empty(0, dtype=np.uint64)
    known = worker_cache("near_dedup", _WordHashes)
    ids = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(n, len(ids))
    h = np.full(len(ids) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + len(h)]) * _MULTIPLIER
        h ^= h >> np.uint64(32)
    return np.unique(h)


def least_shared(similarity: tuple[int, int], size: int = SKETCH) -> int:
    """How many of ``size`` sketch values a pair at ``similarity`` shares but for a
    chance of ``MISSED``: 14 of 32 at 0.85, 11 at 0.8. One at least, which fails more
    often where the similarity is below about 0.45."""
    p, below, m = similarity[1] / similarity[0], 0.0, 0
    while m < size:
        below += math.comb(size, m) * p**m * (1 - p) ** (size - m)
        if below > MISSED:
            break
        m += 1
    return max(1, m)


def _least(size: Column, similarity: tuple[int, int]) -> Column:
    """How many of a sketch's values a partner's sketch shares at least."""
    return F.greatest(F.lit(1), F.ceil(size * (least_shared(similarity) / SKETCH)).cast("int"))


def sketches(docs: DataFrame, id_col: str, text_col: str, words_each: int = WORDS, size: int = SKETCH) -> DataFrame:
    """Per row: _id, _key (hash of the text), _n (set size), _digest (of the
    words), _sketch and _bits, the sketch as a bit set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, same, kept = [], [], []
            for text in b.column(1):
                found = words(text.as_py())
                full = shingles(found, words_each)
                n.append(len(full))
                same.append(xxhash.xxh3_128_digest(b" ".join(found)) if found else None)
                kept.append(full[:size].astype(np.int64))
            lengths = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)
            at = values & (64 * BIT_WORDS - 1)
            bit = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            # A zero at the end, and none where a list is empty.
            words_of = [np.bitwise_or.reduceat(np.append(np.where(at >> 6 == j, bit, 0), 0), lengths[:-1]) if len(kept) else values for j in range(BIT_WORDS)]
            bits = [pa.array(np.where(np.diff(lengths) > 0, w, 0)) for w in words_of]
            sketch = pa.ListArray.from_arrays(pa.array(lengths), pa.array(values, pa.int64()))
            bit_set = pa.StructArray.from_arrays(bits, names=[f"b{j}" for j in range(BIT_WORDS)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(same, pa.binary()), sketch, bit_set], names=["_id", "_key", "_n", "_digest", "_sketch", "_bits"])

    bits_type = ", ".join(f"b{j}: long" for j in range(BIT_WORDS))
    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col))).mapInArrow(run, f"_id {kind}, _key long, _n long, _digest binary, _sketch array<long>, _bits struct<{bits_type}>")


def _inverted(reps: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(_v, _node, _n): each representative in the lists of its rarest shared values."""
    entries = reps.select("_node", "_n", F.size("_sketch").alias("_s"), F.explode("_sketch").alias("_v"))
    often = entries.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    shared = entries.join(often, "_v").groupBy("_node", "_n", "_s").agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_shared"))
    # At most SKETCH values a document. Those that occur once are the rarest and meet nobody.
    ahead = F.size("_shared") - _least(F.col("_s"), similarity) + 1
    return shared.where(ahead >= 1).select("_node", "_n", F.explode(F.slice("_shared", F.lit(1), ahead)).alias("_e")).select(F.col("_e._v").alias("_v"), "_node", "_n")


def _files(spark, size: int) -> int:
    """How many files hold ``size`` bytes; two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // _FILE_BYTES))


def components(links: DataFrame, name: str = "links", files: int | None = None) -> tuple[DataFrame, str]:
    """(_node, _root) of every node of ``links`` (a, b) but the roots themselves, by
    alternating large-star and small-star steps until nothing changes."""
    spark = links.sparkSession
    edges, path = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), None
    while True:
        # Large star: each node's larger neighbours go to its smallest one.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: a node and its smaller neighbours go to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = materialize(small, name, files)
        if path:
            drop_path(spark, path)
        edges, path = new, new_path
        # Done when all are stars: nobody has two centres, no centre has one.
        ends = edges.select("u", F.lit(1).alias("c"), F.lit(0).alias("d")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("c").alias("c"), F.max("d").alias("d")).where("c > 1 or (c > 0 and d > 0)").isEmpty():
            return edges.select(F.col("u").alias("_node"), F.col("v").alias("_root")), path


def verified(pairs: DataFrame, texts: DataFrame, words_each: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Each row
    carries both texts; no group of pairs is gathered in one place."""
    of = lambda side: texts.select(F.col("_node").alias(side), F.col("_text").alias(f"_{side}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "_a", "_b")
    per_union, per_shared = similarity

    def run(batches):
        last: dict[str, np.ndarray] = {}
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                sets = []
                for t in (x, y):
                    if t not in last:
                        if len(last) >= 64:
                            last.clear()
                        last[t] = shingles(words(t), words_each)
                    sets.append(last[t])
                inter = len(np.intersect1d(*sets, assume_unique=True))
                good.append(inter > 0 and per_union * inter >= per_shared * (len(sets[0]) + len(sets[1]) - inter))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def _estimate_passes(x: Column, y: Column, similarity: tuple[int, int]) -> Column:
    """The union sketch: of the smallest values of both, how many are in both."""
    size = F.least(F.lit(SKETCH), F.greatest(F.size(x), F.size(y)))
    union = F.slice(F.sort_array(F.array_union(x, y)), F.lit(1), size)
    return F.size(F.array_intersect(F.array_intersect(x, y), union)) >= _least(F.size(union), similarity) - 1


def _whole_passes(similarity: tuple[int, int]) -> Column:
    """What two whole sets share; 32 bits may make it look more, never less. Larger
    sets pass."""
    per_union, per_shared = similarity
    inter = F.size(F.array_intersect("_all", "_hub_all"))
    return F.coalesce(inter * per_union >= (F.col("_n") + F.col("_hub_n") - inter) * per_shared, F.lit(True))


def _with_sets(nodes: DataFrame, texts: DataFrame, words_each: int) -> DataFrame:
    """``nodes``, a row each, with _all, the node's set; null beyond ``WHOLE``."""

    def run(batches):
        for b in batches:
            sets = [shingles(words(t.as_py()), words_each) for t in b.column(1)]
            # Equal values must stay as many as they are: bits that clash in a set would lose one.
            low = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in sets]
            kept = [x.tolist() if len(x) <= WHOLE and len(np.unique(x)) == len(x) else None for x in low]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int32()))], names=["_node", "_all"])

    return nodes.join(texts.join(nodes.select("_node"), "_node").select("_node", "_text").mapInArrow(run, "_node long, _all array<int>"), "_node")


def _may_pass(x: str, y: str, similarity: tuple[int, int]) -> Column:
    """What :func:`_estimate_passes` asks for at least, from the bit sets. Two sketches
    share no more values than bits, but for the values that share a bit in one of them."""
    size = lambda a: F.size(f"{a}_sketch")
    words_of = range(BIT_WORDS)
    total = lambda parts: sum(parts[1:], parts[0])
    common = total([F.bit_count(F.col(f"{x}_bits")[f"b{j}"].bitwiseAND(F.col(f"{y}_bits")[f"b{j}"])) for j in words_of])
    double = lambda a: size(a) - total([F.bit_count(F.col(f"{a}_bits")[f"b{j}"]) for j in words_of])
    return common + F.least(double(x), double(y)) >= _least(F.least(F.lit(SKETCH), F.greatest(size(x), size(y))), similarity) - 1


def _listed_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_node, _text) of the representatives ``wanted`` (_rep, _node, _digest). A blocked Bloom
    filter of their ids, of at most ``BLOOM_BLOCKS`` words, spares most texts the
    shuffle; the join and the digest make the result exact."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOOM_BLOCKS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.lit(1)), F.lit(63)).cast("int"))
    blocks = wanted.groupBy(block(F.col("_rep")).alias("_block")).agg(F.bit_or(bit(F.col("_rep"))).alias("_bits"))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    possible = own.withColumn("_block", block(F.col("_id"))).join(F.broadcast(blocks), "_block").where(F.col("_bits").bitwiseAND(bit(F.col("_id"))) != 0)
    paired = possible.join(wanted, F.col("_id") == F.col("_rep")).select("_node", "_text", "_digest")

    def run(batches):
        for b in batches:
            same = [xxhash.xxh3_128_digest(b" ".join(words(t.as_py()))) == d.as_py() for t, d in zip(b.column(1), b.column(2), strict=True)]
            yield b.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return paired.mapInArrow(run, "_node long, _text string").dropDuplicates(["_node"])


def _one_of_each(lists: DataFrame) -> DataFrame:
    """The lists without those whose members are the same as another's."""
    digest = lambda seed: F.sum(F.xxhash64("_node", F.lit(seed)).cast("decimal(38,0)"))
    each = lists.groupBy("_v").agg(F.count(F.lit(1)).alias("c"), digest(1).alias("x"), digest(2).alias("y"))
    return lists.join(each.groupBy("c", "x", "y").agg(F.min("_v").alias("_v")).select("_v"), "_v", "left_semi")


def _able(current: DataFrame, texts: DataFrame, words_each: int, similarity: tuple[int, int]) -> DataFrame:
    """(_node, _m) of the nodes of ``current`` that may still be linked with another
    label: _m of their shingles occur in a node with another label as well."""
    kind = "_node long, _root long, _h long"

    def run(batches):
        for b in batches:
            sets = [shingles(words(t.as_py()), words_each).astype(np.int64) for t in b.column(2)]
            which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            if len(which):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), b.column(1).take(pa.array(which)), pa.array(np.concatenate(sets))], names=["_node", "_root", "_h"])

    nodes = current.select("_node", "_root", "_n").distinct()
    own = texts.join(nodes, "_node").select("_node", "_root", "_text").mapInArrow(run, kind)
    crossing = own.groupBy("_h").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo <> _hi").select("_h")
    shared = own.select("_node", "_h").join(crossing, "_h").groupBy("_node").agg(F.count(F.lit(1)).alias("_m"))
    per_union, per_shared = similarity
    return shared.join(nodes, "_node").where(F.col("_m") * per_union >= F.col("_n") * per_shared).select("_node", "_m")


def _open(lists: DataFrame) -> DataFrame:
    """(_v, _blocks): lists whose members have two labels or more."""
    each = lists.groupBy("_v").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count(F.lit(1)).alias("_c"))
    return each.where("_lo <> _hi").select("_v", F.ceil(F.col("_c") / BLOCK).cast("int").alias("_blocks"))


def _ranked(lists: DataFrame) -> DataFrame:
    """With _k, the place in the list by node; null beyond the last of ``HUBS``. A
    task passes on no more than that many rows of a list."""
    first = lists.select("_v", "_node", F.row_number().over(Window.partitionBy("_v").orderBy("_node")).alias("_k")).where(F.col("_k") <= HUBS[-1])
    return lists.join(first, ["_v", "_node"], "left")


def _labels(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(_from, _to): of the ends of ``links`` (a, b), a smaller node that each larger
    one reaches; not always the smallest."""
    up = links.groupBy(F.greatest("a", "b").alias("_from")).agg(F.min(F.least("a", "b")).alias("_to"))
    for _ in range(jumps):
        next_up = up.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        up = up.join(next_up, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to"))
    return up


def _meetings(current: DataFrame, after: int, upto: int | None, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): hubs at the places ``after`` + 1 to ``upto`` of each open list with the
    members that come later and have another label, if sizes and sketches allow it.
    Two members meet in one list only, and in the last step as whole sets."""
    per_union, per_shared = similarity
    is_hub = F.col("_k").isNull() | (F.col("_k") > after)
    is_hub = is_hub if upto is None else is_hub & (F.col("_k") <= upto)
    hubs = current.where(is_hub).select(
        "_v", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), *[F.col(c).alias(f"_hub{c}") for c in ("_node", "_n", "_m", "_sketch", "_bits", "_root", "_vs", "_all") if c in current.columns]
    )
    members = current.withColumn("_block", F.pmod(F.hash("_node"), F.col("_blocks")))
    most = F.least("_m", "_hub_m")  # an intersection has at most
    fits = most * per_union >= (F.col("_n") + F.col("_hub_n") - most) * per_shared
    apart = (F.col("_node") > F.col("_hub_node")) & (F.col("_root") != F.col("_hub_root"))
    # The join itself looks at the sketches: what they rule out is not shuffled.
    near = _estimate_passes(F.col("_sketch"), F.col("_hub_sketch"), similarity)
    near = near & (F.array_min(F.array_intersect("_vs", "_hub_vs")) == members["_v"])
    if upto is None:
        near = near & _whole_passes(similarity)
    met = members.join(hubs, (members["_v"] == hubs["_v"]) & (members["_block"] == hubs["_block"]) & apart & fits & _may_pass("", "_hub", similarity) & near)
    return met.select(F.col("_hub_node").alias("a"), F.col("_node").alias("b")).distinct()


def _stars(lists: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): each node b with one node a, of the smallest nodes of its lists the
    one that it shares most lists with. A pair a node, whatever the lists."""
    per_union, per_shared = similarity
    least = lists.groupBy("_v").agg(F.min(F.struct("_node", "_n")).alias("_least"))
    near = lists.join(least, "_v").where(F.col("_node") > F.col("_least._node")).groupBy("_node", "_n", F.col("_least._node").alias("_hub"), F.col("_least._n").alias("_hub_n")).agg(F.count(F.lit(1)).alias("_c"))
    small, large = F.least("_n", "_hub_n"), F.greatest("_n", "_hub_n")
    best = near.where(small * per_union >= large * per_shared).groupBy("_node").agg(F.max_by("_hub", F.struct("_c", "_hub")).alias("a"))
    return best.select("a", F.col("_node").alias("b"))


def _components(docs: DataFrame, id_col: str, text_col: str, words_each: int, similarity: tuple[int, int]) -> tuple[DataFrame, list[str]]:
    """Per row: _id, _key, _n, _node, _root (of the component; null without words) and
    _c, the component's smallest id; and the scratch tables that this is read from."""
    bound_batches(docs.sparkSession)
    # Numbers of nodes are stored in a few bits each: a small file may be a large hash table.
    with joins_by_true_size(docs.sparkSession):
        return _linked_components(docs, id_col, text_col, words_each, similarity)


def _linked_components(docs: DataFrame, id_col: str, text_col: str, words_each: int, similarity: tuple[int, int]) -> tuple[DataFrame, list[str]]:
    spark = docs.sparkSession
    rows, rows_path = materialize(sketches(docs, id_col, text_col, words_each), "sketches")
    linked = rows.where("_id is not null and _digest is not null")
    n = rows.count()
    narrow, wide = _files(spark, 48 * n), _files(spark, (48 + 8 * SKETCH) * n)
    # Same words: one node, whose representative is the smallest id. Nodes are numbered in
    # the table that is written, so what is shuffled carries a number, not a digest.
    same = linked.groupBy("_digest").agg(F.min("_id").alias("_rep"), *[F.first(c).alias(c) for c in ("_n", "_sketch", "_bits")])
    reps, reps_path = materialize(same.withColumn("_node", F.monotonically_increasing_id()), "nodes", wide)
    lists, lists_path = materialize(_one_of_each(_inverted(reps, similarity)), "lists", wide)
    own, own_path = materialize(reps.join(lists.select("_node").distinct(), "_node"), "listed", wide)
    texts, texts_path = materialize(_listed_texts(docs, own.select("_rep", "_node", "_digest"), id_col, text_col), "texts")
    scratch, links = [lists_path, own_path, texts_path], []

    def linked_of(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough: links."""
        found, path = materialize(verified(pairs, texts, words_each, similarity), "found", narrow)
        scratch.append(path)
        links.append(found)
        return found

    sketch = lambda side: own.select(F.col("_node").alias(side), F.col("_sketch").alias(f"_{side}"))
    met_alone = _stars(lists, similarity).join(sketch("a"), "a").join(sketch("b"), "b").where(_estimate_passes(F.col("_a"), F.col("_b"), similarity)).select("a", "b")
    labels = _labels(linked_of(met_alone)).select(F.col("_from").alias("_node"), F.col("_to").alias("_root"))
    labelled, path = materialize(lists.join(labels, "_node", "left").withColumn("_root", F.coalesce("_root", "_node")), "labelled", wide)
    scratch.append(path)
    still, path = materialize(labelled.join(_open(labelled), "_v"), "open", wide)
    scratch.append(path)
    steps = list(zip((0, *HUBS), (*HUBS, None), strict=True))
    for number, (after, upto) in enumerate(steps):
        if still.isEmpty():
            break
        if number in (0, len(steps) - 1):
            # Who can't be linked with any of those that are left takes no more part.
            able = _able(still, texts, words_each, similarity).join(own.select("_node", "_sketch", "_bits"), "_node")
            # A node with all of its lists, at most SKETCH, is one row until what is known of it is there.
            nodes = still.groupBy("_node", "_n", "_root").agg(F.collect_list(F.struct("_v", "_blocks")).alias("_in")).join(able, "_node")
            nodes = _with_sets(nodes, texts, words_each) if number else nodes
            still = nodes.withColumn("_vs", F.transform("_in", lambda e: e["_v"])).select("*", F.explode("_in").alias("_e")).select("_e.*", *[c for c in nodes.columns if c != "_in"], "_vs")
            still, path = materialize(still.withColumn("_k", F.lit(None).cast("int")) if number else _ranked(still), "open-lists", wide)
            scratch.append(path)
        found = linked_of(_meetings(still, after, upto, similarity))
        if upto is None:
            break
        ends = [still.select(F.col("_node").alias(x), F.col("_root").alias(f"_{x}")).distinct() for x in "ab"]
        moved = _labels(found.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        # Hubs have met everybody in their lists.
        now = still.drop("_blocks").where(F.col("_k").isNull() | (F.col("_k") > upto)).join(moved, F.col("_root") == F.col("_from"), "left").withColumn("_root", F.coalesce("_to", "_root")).drop("_from", "_to")
        now, path = materialize(now, "labelled", wide)
        scratch.append(path)
        still, path = materialize(now.join(_open(now), "_v"), "open", wide)
        scratch.append(path)
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    root, root_path = (None, None) if every.isEmpty() else components(every, files=narrow)
    for p in scratch:
        drop_path(spark, p)

    named = reps.select("_digest", "_node", "_rep", F.col("_node").alias("_root"))
    if root is not None:
        # Worked out by the caller, with the session's own settings.
        labelled = named.drop("_root").join(root.hint("merge"), "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
        least = labelled.groupBy("_root").agg(F.min("_rep").alias("_c"))
        named = labelled.join(least, "_root").select("_digest", "_node", F.col("_c").alias("_rep"), "_root")
    joined = rows.select("_id", "_key", "_n", "_digest").join(named, "_digest", "left").drop("_digest")
    kept = [p for p in (rows_path, reps_path, root_path) if p]
    return joined.withColumn("_c", F.when(F.col("_id").isNotNull(), F.coalesce("_rep", "_id"))).drop("_rep"), kept


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row: the id, n_shingles, component_id and kept (the id is the smallest
    of its component)."""
    found, _ = _components(docs, id_col, text_col, words_each, similarity)
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_c").alias("component_id"), (F.col("_id") == F.col("_c")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS, similarity: tuple[int, int] = DROP_SIMILARITY) -> DataFrame:
    """One row of each component, columns as they were: of its rows with the smallest
    id, one whose text has the smallest hash. Rows with a null id or without words stay."""
    rows, scratch = _components(docs, id_col, text_col, words_each, similarity)
    found, _ = materialize(rows.where("_id is not null and _root is not null").select("_id", "_key", "_root", "_c"), "components")
    for p in scratch:
        drop_path(docs.sparkSession, p)
    keepers = found.where("_id = _c").groupBy("_root").agg(F.min(F.struct("_id", "_key")).alias("_kept"))
    judged = found.join(keepers, "_root").withColumn("_stays", (F.col("_id") == F.col("_kept._id")) & (F.col("_key") == F.col("_kept._key")))
    return rows_that_stay(docs, id_col, text_col, judged)
