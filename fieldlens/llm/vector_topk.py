"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Candidates are dealt to shards by a hash of their id; each shard builds a ball
tree with numpy. Queries are replicated to the shards and stream through each
shard's task in blocks, so a task holds its own shard and one block. A node of
centre c and radius r holds no score above q.c + |q| r; nodes are visited in
descending order of that bound, for those queries of the block whose k-th best
score doesn't rule the node out. Shards are searched in waves: the first
``WAVES[0]`` of them with all queries, and so on; the k-th scores so far are shared
with the shards of the next wave, which prune by them from the start.

Components become integers floor(scale * x), x as double; scores are exact integers.
If the largest component would let a score leave 64 bits, that is an error.

Defined results: vectors that are null, empty, or hold null or non-finite
components, and rows with a null id, take no part; vectors of another length
than the query's are no candidates of it; ties go to the smaller id; a query with
fewer candidates than k returns them all; a repeated id is a candidate each time,
but never of a query with that id; a repeated query row is searched once, and query
rows with one id but other vectors are ranked together, as one query. Ids are
integers; what can't be cast to one is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import materialize

SCALE, LEAF, BLOCK = 256, 128, 256
#: Shares of the shards up to which a wave goes; one shard in eight at the least number of shards.
WAVES, LEAST_SHARDS = (0.125, 0.5, 1.0), 8
ROWS_PER_SHARD = 20_000
LOWEST = -(1 << 62)


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False))), F.lit(False))


class BallTree:
    """Nodes in arrays: centre, radius, range of rows, children; leaves of ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        # Sums of products stay exact in doubles up to 2 ** 53.
        self.exact = rows.shape[1] * float(np.abs(self.rows).max(initial=0)) ** 2 < 2.0**53
        at = np.arange(len(ids))
        self.nodes = []
        stack = [(at, -1, 0)]
        pieces, filled = [], 0
        while stack:
            at, parent, side = stack.pop()
            x = self.rows[at]
            centre = x.mean(axis=0)
            gap = np.sqrt(((x - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            node = {"c": centre, "r": gap.max() * (1 + 1e-9) + 1e-6, "kids": [], "span": None}
            self.nodes.append(node)
            if parent >= 0:
                self.nodes[parent]["kids"].append(me)
            if len(at) <= leaf or gap.max() == 0:
                pieces.append(at)
                node["span"] = (filled, filled + len(at))
                filled += len(at)
                continue
            # Split between two far points, halved, so that copies can't unbalance it.
            far = x[gap.argmax()]
            other = x[((x - far) ** 2).sum(axis=1).argmax()]
            along = np.argsort(x @ (other - far), kind="stable")
            half = len(at) // 2
            stack += [(np.sort(at[along[:half]]), me, 0), (np.sort(at[along[half:]]), me, 1)]
        at = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        self.ids, self.rows = self.ids[at], self.rows[at]

    def scores(self, q: np.ndarray, span: tuple[int, int]) -> np.ndarray:
        x = self.rows[span[0] : span[1]]
        if self.exact and x.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2.0**53:
            return (q @ x.T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores and ids of each query, k columns; absent: LOWEST. ``bound``:
        a k-th score known from elsewhere."""
        n = len(q)
        best, best_id = np.full((n, k), LOWEST, dtype=np.int64), np.full((n, k), np.iinfo(np.int64).max)
        size = np.sqrt((q**2).sum(axis=1))
        upper = lambda node, who: q[who] @ self.nodes[node]["c"] + size[who] * self.nodes[node]["r"]
        stack = [(0, np.arange(n), upper(0, np.arange(n)))]
        while stack:
            node, who, ub = stack.pop()
            keep = ub * (1 + 1e-12) + 1e-3 >= np.maximum(best[who, -1], bound[who])
            who = who[keep]
            if not len(who):
                continue
            kids, span = self.nodes[node]["kids"], self.nodes[node]["span"]
            if span is None:
                bounds = [(kid, who, upper(kid, who)) for kid in kids]
                stack += sorted(bounds, key=lambda x: x[2].mean())  # the highest is popped first
                continue
            got, ids = self.scores(q[who], span), np.broadcast_to(self.ids[span[0] : span[1]], (len(who), span[1] - span[0]))
            got = np.where(ids == qid[who, None], LOWEST, got)
            s, i = np.hstack([best[who], got]), np.hstack([best_id[who], ids])
            if s.shape[1] > 4 * k:
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                s = np.where(s >= least, s, LOWEST)
            top = np.lexsort((i, -s))[:, :k]
            best[who], best_id[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return best, best_id


def _wave(shards: DataFrame, queries: DataFrame, n_shards: int, which: tuple[int, int], k: int) -> DataFrame:
    """(query_id, vec_id, score): each shard's best for each query. ``which``: shards from, to."""
    sent = queries.select(F.explode(F.sequence(F.lit(which[0]), F.lit(which[1] - 1))).alias("_shard"), F.lit(1).alias("_kind"), F.col("_id"), F.col("_v"), F.col("_bound"))
    own = shards.where((F.col("_shard") >= which[0]) & (F.col("_shard") < which[1])).select("_shard", F.lit(0).alias("_kind"), "_id", "_v", F.lit(None).cast("long").alias("_bound"))
    dealt = own.union(sent).repartition(max(1, which[1] - which[0]), "_shard").sortWithinPartitions("_shard", "_kind")

    def run(batches):
        shard, ids, rows, trees = None, [], [], None
        waiting: list[tuple] = []

        def plant():
            found = {}
            for d in {len(r) for r in rows}:
                own = [i for i, r in enumerate(rows) if len(r) == d]
                found[d] = BallTree(np.array([ids[i] for i in own]), np.stack([rows[i] for i in own]))
            return found

        def answer():
            for d in {len(w[1]) for w in waiting}:
                if d not in trees:
                    continue
                own = [w for w in waiting if len(w[1]) == d]
                qid = np.array([w[0] for w in own])
                best, best_id = trees[d].search(qid, np.stack([w[1] for w in own]), np.array([w[2] for w in own]), k)
                there = best > LOWEST
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, k)[there.ravel()]), pa.array(best_id[there]), pa.array(best[there])], names=["query_id", "vec_id", "score"])
            waiting.clear()

        for b in batches:
            vectors = b.column(3)
            at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for i, (s, kind, x, bound) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if s != shard:
                    if waiting:
                        yield from answer()
                    shard, ids, rows, trees = s, [], [], None
                v = values[at[i] : at[i + 1]]
                if kind == 0:
                    ids.append(x)
                    rows.append(v)
                    continue
                if trees is None:
                    trees = plant()
                waiting.append((x, v, LOWEST if bound is None else bound))
                if len(waiting) >= BLOCK:
                    yield from answer()
        if waiting:
            yield from answer()

    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query``, its k best
    among all other rows. ``is_query`` is an expression over the id column."""
    whole = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    spread = F.monotonically_increasing_id().alias("_spread")  # kept in the table: a repeated row is dealt to many shards
    own, _ = materialize(whole.select(F.col(id_col).cast("long").alias("_id"), F.col(id_col), scaled.alias("_v"), spread).withColumn("_q", is_query).select("_id", "_v", "_spread", F.coalesce("_q", F.lit(False)).alias("_q")), "vectors")
    n, width, high, low = own.agg(F.count(F.lit(1)), F.max(F.size("_v")), F.max(F.array_max("_v")), F.min(F.array_min("_v"))).first()
    if n and width * max(abs(high), abs(low)) ** 2 >= 2**63:
        raise ValueError(f"scores of {width} components up to {max(abs(high), abs(low))} may not fit 64 bits")
    n_shards = max(LEAST_SHARDS, -(-n // rows_per_shard))
    shards = own.withColumn("_shard", F.pmod(F.xxhash64("_id", "_v", "_spread"), F.lit(n_shards)).cast("int"))
    queries = own.where("_q").dropDuplicates(["_id", "_v"]).select("_id", "_v")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # At most k rows of each wave's shards for a query.
    found, bounds, start = None, queries.withColumn("_bound", F.lit(None).cast("long")), 0
    for share in WAVES:
        stop = max(start + 1, round(n_shards * share))
        wave = _wave(shards, bounds, n_shards, (start, stop), k)
        found = wave if found is None else found.union(wave)
        ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        if stop >= n_shards:
            break
        found, _ = materialize(ranked.drop("rank"), "best")
        kth = found.groupBy(F.col("query_id").alias("_id")).agg(F.min("score").alias("_bound"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") == k).drop("_c")
        bounds, start = queries.join(kth, "_id", "left"), stop
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
