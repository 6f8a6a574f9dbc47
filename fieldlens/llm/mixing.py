"""Mixing sources to target weights.

A source's weight is its share of all tokens to the power of an exponent, over
the sum of those (temperature mixing). The exponent is bisected (in sections of
32, each one pass over the sources) to the smallest one that keeps every source
within a repetition limit, or to the largest whose weights have a target entropy.
The budget makes the least repeated source appear exactly once, so no document
is lost, unless a number of tokens is given.

Each source then gets weight * budget tokens: whole passes over its documents and
a part of one more. Every pass (epoch) is a permutation of its own, by a hash of
seed, epoch and document; the running sum of tokens in that order tells where a
source's budget ends and to which of ``blocks`` blocks a document belongs, so that
each block has the target mix. Within a block the order is another hash.

Rows with the same source, id and text are one document with a number of copies.
Running sums are taken over range-partitioned documents: a source with a third of
all rows spreads over a third of the tasks, and so does a row with a third of them.
Tokens are words (runs of anything but white space).

Defined results: a null source is a source of its own; a document without words
counts as one token; copies of a row are drawn as often as they occur, and of the
last document of a source's budget only as many copies as the budget reaches, so a
source is over its budget by less than one document; :func:`mixed_documents` then
repeats one of these copies, should they differ in other columns; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, running_sums

MAX_REPEATS, BLOCKS, SEED = 2.0, 64, 17
MAX_BROADCAST_SOURCES = 100_000


def n_tokens(text: Column) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).cast("long")


def _sections(sources: DataFrame, exponents: list[float]) -> dict[float, tuple]:
    """For each exponent: sum of shares to its power, the same with the log, the least and
    the largest ratio of weight to share. One pass; one short row comes back."""
    aggs = []
    for i, a in enumerate(exponents):
        p = F.pow("_share", F.lit(a))
        aggs += [F.sum(p).alias(f"s{i}"), F.sum(p * F.log("_share") * a).alias(f"l{i}"), F.min(p / F.col("_share")).alias(f"a{i}"), F.max(p / F.col("_share")).alias(f"b{i}")]
    row = sources.agg(*aggs).first()
    return {a: tuple(row[f"{c}{i}"] for c in "slab") for i, a in enumerate(exponents)}


def find_exponent(sources: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, rounds: int = 6) -> float:
    """``sources``: rows with _share. The smallest exponent in 0..1 within the
    repetition limit (the largest over the least ratio of weight to share), or the
    largest with an entropy (in nats) of at least ``entropy``; 0 if none has it."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / 32 for i in range(33)]
        found = _sections(sources, grid)
        if entropy is not None:
            good = [a for a in grid if math.log(found[a][0]) - found[a][1] / found[a][0] >= entropy - 1e-12]
            at = max(good, default=0.0)
            low, high = at, min(1.0, at + (high - low) / 32)
        else:
            good = [a for a in grid if found[a][3] / found[a][2] <= max_repeats * (1 + 1e-12)]
            at = min(good, default=1.0)
            low, high = max(0.0, at - (high - low) / 32), at
    return low if entropy is not None else high


def _beside(sources: DataFrame) -> DataFrame:
    """A table of sources, to be broadcast if it is small (its rows are counted)."""
    return F.broadcast(sources) if sources.count() <= MAX_BROADCAST_SOURCES else sources


def _tagged(docs: DataFrame, columns: list[Column], source_col: str, text_col: str, id_col: str) -> DataFrame:
    # A prefix keeps a null source apart from an empty one.
    source = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-"))
    return docs.select(*columns, source.alias("_g"), n_tokens(F.col(text_col)).alias("_tokens"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_doc"))


def _plan(own: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None) -> DataFrame | None:
    """(_g, _size, _budget): each source's tokens and how many are drawn."""
    sizes, _ = materialize(own.groupBy("_g").agg(F.sum("_weight").alias("_size")), "sources", own.sparkSession.sparkContext.defaultParallelism)
    total = sizes.agg(F.sum("_size")).first()[0]
    if not total:
        return None
    shares = sizes.withColumn("_share", F.col("_size") / F.lit(total))
    a = find_exponent(shares, max_repeats, entropy)
    weight_sum, _, least, _ = _sections(shares, [a])[a]
    # Passes over a source: weight * budget / size; without a budget the least is one.
    power = F.pow("_share", F.lit(a))
    passes = power / F.col("_share") / F.lit(least) if budget is None else power / F.lit(weight_sum) * F.lit(float(budget)) / F.col("_size")
    return shares.select("_g", "_size", F.round(passes * F.col("_size")).cast("long").alias("_budget")).where("_budget > 0")


def _counted(tagged: DataFrame, *columns: Column) -> DataFrame:
    """Each document once, with its copies and what they weigh."""
    once = tagged.groupBy("_g", "_doc", "_tokens").agg(F.count(F.lit(1)).alias("_copies"), *columns)
    return once.withColumn("_weight", F.col("_tokens") * F.col("_copies"))


def _drawn(own: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """A row for each pass that a document may be part of, with its place in the pass."""
    epochs = F.sequence(F.lit(0), F.floor((F.col("_budget") - 1) / F.col("_size")).cast("int"))
    return own.join(_beside(plan), "_g").withColumn("_epoch", F.explode(epochs)).withColumn("_perm", F.xxhash64(F.lit(seed), "_epoch", "_doc"))


def _placed(own: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The documents within the budgets, in each pass; ``_times``: how many copies."""
    summed = running_sums(_drawn(own, plan, seed), "_g", ["_epoch", "_perm", "_doc"], ["_weight"], "mix").where(F.col("_weight_before") < F.col("_budget"))
    return summed.withColumn("_times", F.least(F.col("_copies"), F.ceil((F.col("_budget") - F.col("_weight_before")) / F.col("_tokens"))).cast("int"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The drawn rows: id, source, epoch, block, block_order, n_tokens."""
    tagged = _tagged(docs, [F.col(id_col).alias("_id")], source_col, text_col, id_col)
    own, _ = materialize(_counted(tagged, F.first("_id").alias("_id")), "mix-rows")
    plan = _plan(own, max_repeats, entropy, budget)
    if plan is None:
        return own.select(F.col("_id").alias(id_col), F.col("_g").alias(source_col), F.lit(0).alias("epoch"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("block_order"), F.col("_tokens").alias("n_tokens"))
    placed = _placed(own, plan, seed).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    before = F.col("_weight_before") + F.col("_copy") * F.col("_tokens")
    block = F.least(F.lit(blocks - 1), F.floor(before * F.lit(float(blocks)) / F.col("_budget")).cast("int"))
    name = F.when(F.col("_g") != "-", F.substring("_g", 2, 1 << 30))
    return placed.select(F.col("_id").alias(id_col), name.alias(source_col), F.col("_epoch").alias("epoch"), block.alias("block"), F.xxhash64(F.lit(seed + 1), block, "_epoch", "_doc").alias("block_order"), F.col("_tokens").alias("n_tokens"))


def mixed_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents as often as they are drawn, columns as they were. Texts are
    never shuffled: where a source's budget ends is one place in its last pass."""
    own, _ = materialize(_counted(_tagged(docs, [], source_col, text_col, id_col)), "mix-rows")
    plan = _plan(own, max_repeats, entropy, budget)
    if plan is None:
        return docs
    place = F.struct("_epoch", "_perm", "_doc")
    last = _placed(own, plan, seed).groupBy("_g").agg(F.max(F.struct(place.alias("at"), F.col("_times").alias("times"))).alias("_last"))
    last, _ = materialize(plan.join(last, "_g"), "mix-ends", docs.sparkSession.sparkContext.defaultParallelism)
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]
    drawn = _drawn(_tagged(docs, columns, source_col, text_col, id_col), last, seed)
    names = [f"k{i}" for i in range(len(docs.columns))]
    whole = drawn.where(place < F.col("_last.at")).select(*names)
    # Copies of the last document: one of them stands for those that the budget reaches.
    ends = drawn.where(place == F.col("_last.at")).groupBy("_g").agg(F.first(F.struct(*names)).alias("_row"), F.first("_last.times").alias("_times"))
    ends = ends.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(f"_row.{n}").alias(n) for n in names])
    return whole.union(ends).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
