"""Language-model scores: prediction by partial matching over byte contexts.

Training counts every byte after its ``ORDER`` preceding bytes, over all training
documents: tasks merge counts of their own, a shuffle adds them up, and shorter
contexts are sums of longer ones. Escape follows method C, and symbols seen in a
longer context are excluded from the shorter one. A code length is the sum over a
text's bytes, looked up for all positions of a batch at once.

The model is never pruned. Up to ``MAX_NODES`` (context, byte) entries of the
longest order, which has the most, a trie of all of them is broadcast. Beyond that
the tables stay in Spark: the costs of the most frequent entries are broadcast, at
most ``MAX_NODES``, and the positions of all others are joined with costs from the
tables, for each distinct gram that is asked for once.

Text model: lower-cased words joined by one space, then an end symbol, so the
probability is of the same word sequence as the unigram base's.

The base needs each word's count. Words that occur often are broadcast: at most
``MAX_WORDS``, found from the table of counts; the others' occurrences are joined
with the table.

Defined results: null text is empty (one end token); null ids are never held out;
an empty training set gives every byte the same probability, and a base of
log10(0.1 / 0.1) for each token; repeated rows give repeated results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, materialize, worker_cache

ORDER = 5
MAX_NODES = 2_000_000
MAX_WORDS = 500_000
END, PAD = 0xFF, 0xFE  # bytes that UTF-8 never has
SYMBOLS = 255  # every byte but PAD
END_WORD = 0  # the end token's hash
_BATCH, _SCORE_BATCH = 2 << 20, 1 << 19
_CACHE_WORDS = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, mod 10, is 0."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hash(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) >> 1) or 1


def codes(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, its context and itself as one integer; and how many each text has."""
    pad = bytes([PAD]) * order
    streams = [pad + b" ".join(t) + bytes([END]) for t in texts]
    s = np.frombuffer(b"".join(streams), dtype=np.uint8)
    n = np.array([len(x) - order for x in streams], dtype=np.int64)
    out = np.zeros(max(0, len(s) - order), dtype=np.uint64)
    for j in range(order + 1):
        out = (out << np.uint64(8)) | s[j : len(s) - order + j]
    return out[s[order:] != PAD], n


def _groups(column: pa.Array, most: int = _BATCH):
    """Lists of the words of texts, about ``most`` bytes each."""
    group, size = [], 0
    for t in column:
        group.append(words(t.as_py()))
        size += sum(map(len, group[-1])) + len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)


def count_training(train: DataFrame, order: int) -> DataFrame:
    """(kind, key, count): byte grams (kind 0) and word hashes (kind 1) of all texts."""

    def run(batches):
        held = {0: ([], []), 1: ([], [])}
        size = {0: 0, 1: 0}

        def flush(kind):
            k, c = _merged(*held[kind])
            held[kind][0].clear()
            held[kind][1].clear()
            size[kind] = 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(c)], names=["kind", "key", "n"])

        known = worker_cache("lm_score", _Hashes)
        for b in batches:
            for group in _groups(b.column(0)):
                grams, _ = codes(group, order)
                own = np.fromiter((h for t in group for h in [*map(known.__getitem__, t), END_WORD]), dtype=np.int64)
                for kind, values in ((0, grams), (1, own)):
                    k, c = np.unique(values, return_counts=True)
                    held[kind][0].append(k)
                    held[kind][1].append(c)
                    size[kind] += len(k)
                    if size[kind] > 4_000_000:
                        yield flush(kind)
        for kind in (0, 1):
            if size[kind]:
                yield flush(kind)

    return train.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = word_hash(word)
        return h


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count c for which at most ``most`` rows have n >= c."""
    c = 1
    while counts.where(F.col("n") >= c).count() > most:
        # Steps of an eighth, found in one pass.
        steps = [max(c + 1, int(c * 1.125**i) + 1) for i in range(1, 60)]
        above = counts.agg(*[F.sum((F.col("n") >= s).cast("long")) for s in steps]).first()
        c = next((s for s, a in zip(steps, above, strict=True) if (a or 0) <= most), steps[-1])
    return c


def contexts(grams: DataFrame, order: int, max_nodes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order 0..order: sorted (context and byte) codes, their counts, and
    sorted contexts with their total counts, pruned ones included."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(order)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (8 * (F.col("o") + 1)).cast("int")) - 1
    each, _ = materialize(grams.select("key", "n", steps.alias("o")).groupBy("o", F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")), "grams")
    out = []
    for o in range(order + 1):
        own = each.where(F.col("o") == o)
        c = _least_count(own, max_nodes)
        by_context = own.groupBy(F.shiftright("key", 8).alias("context"))
        kept = by_context.agg(F.sum("n").alias("total"), F.collect_list(F.when(F.col("n") >= c, F.struct("key", "n"))).alias("kept")).where(F.size("kept") > 0)
        rows = kept.select("context", "total", F.explode("kept").alias("e")).select("context", "total", "e.key", "e.n").toArrow()
        key, n, ctx, total = (rows.column(x).to_numpy() for x in ("key", "n", "context", "total"))
        at = np.argsort(key)
        cu, first = np.unique(ctx, return_index=True)
        out.append((key[at].astype(np.uint64), n[at], cu.astype(np.uint64), total[first]))
    return out


def _bits(order: int) -> int:
    """The mask of an order's context and byte."""
    return (1 << 8 * (order + 1)) - 1


def gram_costs(grams: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(key, cost): log10 of the probability of each gram of ``asked`` (key, distinct),
    by joins with the counts ``grams`` (key, n) of the longest order. From the shortest
    order up, each distinct suffix of a gram is costed once, so no key of a join has
    more than 256 rows."""
    asked, _ = materialize(asked.select("key"), "asked-grams")
    shift = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(_bits(o)).alias("mask")) for o in range(order + 1)])).alias("s")
    each = grams.select("key", "n", shift).groupBy(F.col("s.o").alias("o"), F.col("key").bitwiseAND(F.col("s.mask")).alias("key")).agg(F.sum("n").alias("n"))
    each, _ = materialize(each, "grams")
    level = [each.where(F.col("o") == o).select("key", "n", F.shiftright("key", 8).alias("context")) for o in range(order + 1)]
    totals = [e.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("q")) for e in level]
    last = -math.log10(max(1, SYMBOLS - level[0].count()))
    costed = None
    for o in range(order + 1):
        ready = totals[o]
        if o:
            # What the shorter context has left when this one escapes to it.
            short_key, short_context = F.lit(_bits(o - 1)), F.lit(_bits(o - 2) if o > 1 else 0)
            shorter = level[o - 1].select(F.col("key").alias("_short"), F.col("n").alias("_seen"))
            seen = level[o].select("context", F.col("key").bitwiseAND(short_key).alias("_short")).join(shorter, "_short").groupBy("context").agg(F.sum("_seen").alias("seen"))
            up = totals[o - 1].select(F.col("context").alias("_up"), F.col("total").alias("up_total"), F.col("q").alias("up_q"))
            away = F.greatest(F.col("up_q") - F.col("q"), F.lit(1))
            short_total = F.log10(F.col("up_total") - F.col("seen") + away)
            ready = ready.join(seen, "context").withColumn("_up", F.col("context").bitwiseAND(short_context)).join(up, "_up").select("context", "total", "q", short_total.alias("short_total"), (F.log10(away) - short_total).alias("short_escape"))
        own = asked.select(F.col("key").bitwiseAND(F.lit(_bits(o))).alias("key")).distinct().withColumn("context", F.shiftright("key", 8))
        rows = own.join(level[o].select("key", F.log10("n").alias("log_n")), "key", "left").join(ready, "context", "left")
        below, fresh = F.lit(last), F.lit(None).cast("double")
        if o:
            rows = rows.withColumn("_short", F.col("key").bitwiseAND(short_key)).join(costed.select(F.col("key").alias("_short"), F.col("log_n").alias("_log_n"), F.col("below").alias("_below"), F.col("fresh").alias("_fresh")), "_short")
            below = F.when(F.col("_log_n").isNotNull(), F.col("_log_n") - F.col("short_total")).otherwise(F.col("short_escape") + F.col("_below"))
            fresh = F.col("_fresh")
        # below: from here on when this context misses; fresh: when no longer context was seen.
        direct = F.log10(F.col("total") + F.col("q"))
        rows = rows.withColumn("below", below)
        costed = rows.select("key", "log_n", "below", F.when(F.col("total").isNull(), fresh).when(F.col("log_n").isNotNull(), F.col("log_n") - direct).otherwise(F.log10("q") - direct + F.col("below")).alias("fresh"))
        costed, _ = materialize(costed, "costed")
    return costed.select("key", F.col("fresh").alias("cost"))


class _Table:
    """Open addressing over 64-bit keys, all lookups of a batch at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = self._home(keys)
        out = self.slot[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slot[at]
            out[open_] = got
            more = (got >= 0) & (self.keys[got] != keys[open_])
            open_, at = open_[more], at[more]
        return out


class Frequent:
    """Costs of the most frequent grams; of other grams not known."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray, order: int):
        self.keys, self.values, self.order, self.table = keys, costs, order, None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability, NaN where it isn't known."""
        if self.table is None:
            self.table = _Table(self.keys)
        at = self.table.find(grams)
        return np.where(at >= 0, self.values[at], np.nan) if len(self.values) else np.full(len(grams), np.nan)


class Trie:
    """Code lengths of bytes after contexts."""

    def __init__(self, levels):
        self.levels = levels
        self.order = len(levels) - 1 if levels else 0
        self.ready = None

    def __getstate__(self):
        return {"levels": self.levels, "order": self.order, "ready": None}

    def prepare(self) -> None:
        """For each order: entries with log10 count and log10 of their probability
        when their context comes first; contexts with what an escape costs and,
        when they escape to the shorter context, its total and its escape. Counts
        are dropped as soon as no order needs them."""
        q0 = len(self.levels[0][0]) if self.levels else 0
        self.ready = [None] * len(self.levels)
        for o in range(len(self.levels) - 1, -1, -1):
            key, n, ctx, total = self.levels[o]
            own = np.searchsorted(ctx, key >> np.uint64(8)).astype(np.int32)
            q = np.bincount(own, minlength=len(ctx))
            kept = np.bincount(own, weights=n, minlength=len(ctx))
            pruned = total - kept
            direct = np.log10(total + q)
            escape = np.log10(pruned + q) - direct if len(q) else direct
            short_total = short_escape = np.zeros(len(ctx))
            if o:
                up_key, up_n, up_ctx, up_total = self.levels[o - 1]
                mask = np.uint64((1 << 8 * o) - 1)
                parent = np.searchsorted(up_ctx, ctx & (mask >> np.uint64(8)) if o > 1 else np.zeros(len(ctx), np.uint64))
                up_own = np.searchsorted(up_ctx, up_key >> np.uint64(8))
                up_q, up_kept = np.bincount(up_own, minlength=len(up_ctx)), np.bincount(up_own, weights=up_n, minlength=len(up_ctx))
                seen = np.bincount(own, weights=up_n[np.searchsorted(up_key, key & mask)], minlength=len(ctx))
                left = np.maximum(up_kept[parent] - seen, 0)
                away = (up_total - up_kept)[parent] + np.maximum(up_q[parent] - q, 1)
                short_total, short_escape = np.log10(left + away), np.log10(away) - np.log10(left + away)
                del up_own, up_q, up_kept, parent, seen, left, away
            log_n = np.log10(n)
            log_p = log_n - direct[own]
            self.levels[o] = None
            del n, total, own, q, kept, pruned, direct
            self.ready[o] = (_Table(key), log_n, log_p, _Table(ctx), escape, short_total, short_escape)
        self.last = -math.log10(max(1, SYMBOLS - q0))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability."""
        if self.ready is None:
            self.prepare()
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        came = np.full(len(grams), -1, dtype=np.int64)  # the longer context's index, of one order up
        for o in range(len(self.levels) - 1, -1, -1):
            table, log_n, log_p, ctx_table, escape, _, _ = self.ready[o]
            code = grams[todo] & np.uint64((1 << 8 * (o + 1)) - 1)
            hit = table.find(code)
            fresh = came < 0
            got = hit >= 0
            a = got & fresh
            out[todo[a]] += log_p[hit[a]]
            if not fresh.all():
                up_total, up_escape = self.ready[o + 1][5:7]
                b = got & ~fresh
                out[todo[b]] += log_n[hit[b]] - up_total[came[b]]
                c = ~got & ~fresh
                out[todo[c]] += up_escape[came[c]]
            todo, came, code = todo[~got], came[~got], code[~got]
            if not len(todo):
                return out
            here = ctx_table.find(code >> np.uint64(8))
            first = (came < 0) & (here >= 0)
            out[todo[first]] += escape[here[first]]
            came = here
        out[todo] += self.last
        return out


def _model(grams: DataFrame, order: int, max_nodes: int) -> Trie | Frequent:
    """All of the model if it is small, else the costs of its most frequent grams."""
    if grams.count() <= max_nodes:
        return Trie(contexts(grams, order, max_nodes))
    by_context = grams.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("q"))
    most = grams.where(F.col("n") >= _least_count(grams, max_nodes)).withColumn("context", F.shiftright("key", 8))
    # A gram that was seen is found in its longest context.
    rows = most.join(by_context, "context").select("key", (F.log10("n") - F.log10(F.col("total") + F.col("q"))).alias("cost")).toArrow()
    return Frequent(rows.column("key").to_numpy().astype(np.uint64), rows.column("cost").to_numpy(), order)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    train = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("_text"))
    counts, _ = materialize(count_training(train, order), "counts")
    own_words = counts.where("kind = 1").select("key", "n")
    total, distinct = own_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    own_grams = counts.where("kind = 0").select("key", "n")
    model = _model(own_grams, order, max_nodes) if total else Trie([])
    grams_asked = isinstance(model, Frequent)
    often = own_words.where(F.col("n") >= _least_count(own_words, max_words)).toArrow()
    at = np.argsort(often.column("key").to_numpy())
    sent = spark.sparkContext.broadcast((model, often.column("key").to_numpy()[at], often.column("n").to_numpy()[at]))
    below = math.log10(total + 0.1 * (distinct + 1)) if total else math.log10(0.1)
    narrow = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    kind = narrow.schema[0].dataType.simpleString()
    rare_exist = distinct > len(at)

    def run(batches):
        model, key, n = sent.value
        log_n = np.log10(n + 0.1) - below
        unknown = math.log10(0.1) - below
        hashes_of = worker_cache("lm_score", _Hashes)
        for b in batches:
            start = 0
            for group in _groups(b.column(2), _SCORE_BATCH):
                grams, sizes = codes(group, model.order)
                ends = np.cumsum(sizes)
                costs = model.costs(grams) if total else np.full(len(grams), -math.log10(SYMBOLS))
                open_ = np.isnan(costs)
                score = np.add.reduceat(np.where(open_, 0.0, costs), ends - sizes)
                n_open = np.add.reduceat(open_.astype(np.int64), ends - sizes)
                asked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_open)]).astype(np.int32)), pa.array(grams[open_].astype(np.int64)))
                lengths = np.array([len(t) + 1 for t in group], dtype=np.int64)
                hashes = np.fromiter((h for t in group for h in [*map(hashes_of.__getitem__, t), END_WORD]), dtype=np.int64, count=int(lengths.sum()))
                p = np.minimum(np.searchsorted(key, hashes), len(key) - 1) if len(key) else np.zeros(len(hashes), np.int64)
                found = key[p] == hashes if len(key) else np.zeros(len(hashes), bool)
                cost = np.where(found, log_n[p], 0.0 if rare_exist else unknown) if len(key) else np.full(len(hashes), unknown)
                first = np.cumsum(lengths) - lengths
                base, known = np.add.reduceat(cost, first), np.add.reduceat(found.astype(np.int64), first)
                rare = hashes[~found] if rare_exist else hashes[:0]
                n_rare = np.add.reduceat((~found).astype(np.int64), first) if rare_exist else np.zeros(len(group), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)), pa.array(rare))
                rows = len(group)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, rows), b.column(1).slice(start, rows), pa.array(lengths), pa.array(known), pa.array(base), pa.array(score), lists, asked], names=[id_col, "_row", "n_tokens", "n_known", "base_score", "score", "_rare", "_asked"])
                start += rows

    scored = narrow.mapInArrow(run, f"`{id_col}` {kind}, _row long, n_tokens long, n_known long, base_score double, score double, _rare array<long>, _asked array<long>")
    if rare_exist or grams_asked:
        scored, _ = materialize(scored, "scored")
    if grams_asked:
        asked = scored.select("_row", F.explode("_asked").alias("key")).groupBy("_row", "key").agg(F.count(F.lit(1)).alias("_times"))
        costs = gram_costs(own_grams, asked.select("key").distinct(), order)
        added = asked.join(costs, "key").groupBy("_row").agg(F.sum(F.col("_times") * F.col("cost")).alias("_score"))
        scored = scored.join(added, "_row", "left").withColumn("score", F.col("score") + F.coalesce("_score", F.lit(0.0))).drop("_score")
    if rare_exist:
        asked = scored.select("_row", F.explode("_rare").alias("key"))
        joined = asked.join(own_words, "key", "left").groupBy("_row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1) - below).alias("_base"), F.count("n").alias("_known"))
        scored = scored.drop("_rare").join(joined, "_row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("_base", F.lit(0.0)))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast(T.LongType()).alias("train_tokens"), "base_score", "score")
