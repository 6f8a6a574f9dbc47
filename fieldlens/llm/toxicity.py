"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over word and word-prefix features is trained with numpy
from confirmed toxic texts and unlabelled texts. Its risk is corrected for the
class prior and kept non-negative:

    prior * mean_P[l(g)] + max(0, mean_U[l(-g)] - prior * mean_P[l(-g)])

(when the second term is negative its gradient is turned round). The prior is
the share of toxic rows among the labels that may be used. Training takes about
``MAX_POSITIVE`` confirmed toxic texts and ``MAX_UNLABELLED`` others at most (those
labelled 0 are among the others), chosen by a hash of id and text, each (id, text)
once, so that the bound holds for rows, however often an id or a row repeats.
Features are counted in Spark, and the ``MAX_FEATURES`` that tell the two samples
apart best reach the driver: words that speak for toxicity and words that speak
against it. Scoring covers every whole text.

Defined results: null and empty texts have no features and score the bias; an id
that is null is never held out and never trained on; without a toxic label, or
without any other text, every score is below 1e-200; repeated rows give repeated
results; rows keep extra columns in :func:`keep_clean`, which leaves out what is
predicted toxic.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, drop_path, materialize, worker_cache
from .decontaminate import words

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 8000, 4096
THRESHOLD = 0.3
#: A feature is of use if by Bayes' rule at least this share of the texts that have it are toxic.
LEAST_POSTERIOR = 0.5
PREFIXES = (4, 5, 6, 7)
_CACHE_WORDS = 150_000


def held_out(id_: Column) -> Column:
    """Ids whose labels are never learnt: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: bytes) -> list[int]:
    """Hashes of a word and of its prefixes."""
    return [xxhash.xxh3_64_intdigest(word) >> 1, *(xxhash.xxh3_64_intdigest(word[:n], seed=n) >> 1 for n in PREFIXES if len(word) > n)]


class _Known(dict):
    """Word -> its features among those selected."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(self.index[f] for f in features(word) if f in self.index)
        return found


def _selected(text: str | None, known: _Known) -> list[int]:
    return sorted({f for w in set(words(text)) for f in known[w]})


def gradient(w: np.ndarray, flat: np.ndarray, row_of: np.ndarray, positive: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Of the risk by weights and bias (the last); where the second term is negative, of
    that term turned round. ``flat``: feature indices, ``row_of``: their rows."""
    n_p, n_u = positive.sum(), (~positive).sum()
    g = np.bincount(row_of, weights=w[flat], minlength=len(positive)) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    # The sigmoid loss: l(g) = 1 - p, l(-g) = p; it is bounded, so that sure scores weigh no more.
    rest = p[~positive].sum() / n_u - prior * p[positive].sum() / n_p
    slope = p * (1 - p)
    of_rest = np.where(positive, -prior * slope / n_p, slope / n_u)
    each = np.where(positive, -prior * slope / n_p, 0) + of_rest if rest >= 0 else -of_rest
    d = np.append(np.bincount(flat, weights=each[row_of], minlength=len(w) - 1), each.sum())
    d[:-1] += ridge * w[:-1]
    return d


def train(lengths: np.ndarray, flat: np.ndarray, positive: np.ndarray, prior: float, dims: int, steps: int = 2000, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; ``lengths``: how many of the
    feature indices ``flat`` each row has."""
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    w = np.zeros(dims + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        d = gradient(w, flat, row_of, positive, prior, ridge)
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, index: dict[int, int], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias, self.key = index, weights, bias, uuid.uuid4().hex

    def score(self, texts: list[str | None]) -> np.ndarray:
        known = worker_cache("toxicity " + self.key, lambda: _Known(self.index))
        g = np.array([self.weights[_selected(t, known)].sum() for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model:
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    n, toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not toxic:
        return Model({}, np.empty(0), -1e3)
    prior = min(0.9, toxic / n)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    own = own.withColumn("_key", F.xxhash64("_id", "_text"))
    confirmed = usable.where("_y = 1").select("_id").distinct()
    positive, other = own.join(confirmed, "_id", "left_semi"), own.join(confirmed, "_id", "left_anti")

    def part(rows: DataFrame, most: int, of: int) -> DataFrame:
        chosen = F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1, most / max(1, of)))
        return rows.where(chosen).dropDuplicates(["_key"])

    pos = part(positive, max_positive, positive.select("_key").distinct().count()).select(F.lit(True).alias("_p"), "_text")
    free = part(other, max_unlabelled, own.count()).select(F.lit(False).alias("_p"), "_text")
    sample, path = materialize(pos.union(free), "toxicity-sample")

    def explode(batches):
        for b in batches:
            sets = [np.fromiter({f for w in set(words(t.as_py())) for f in features(w)}, dtype=np.int64) for t in b.column(1)]
            which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            if len(which):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(np.concatenate(sets))], names=["_p", "_f"])

    n_p, n_u = sample.agg(F.sum(F.col("_p").cast("long")), F.sum((~F.col("_p")).cast("long"))).first()
    if not n_p or not n_u:
        return Model({}, np.empty(0), -1e3)
    counts = sample.mapInArrow(explode, "_p boolean, _f long").groupBy("_f").agg(F.sum(F.col("_p").cast("long")).alias("p"), F.sum((~F.col("_p")).cast("long")).alias("u"))
    mean = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)
    scored = counts.withColumn("z", z)
    # Of a thousandth of the toxic texts at least, and toxic where they occur; or clean words.
    speaks_for = (F.col("p") >= max(4, n_p / 1000)) & (F.col("z") > 4) & (prior * F.col("p") / n_p >= LEAST_POSTERIOR * (F.col("u") + 1) / n_u)
    best = [r[0] for r in scored.where(speaks_for).orderBy(F.desc("z"), "_f").limit(max_features).select("_f").collect()]
    speaks_against = (F.col("u") >= max(4, n_u / 1000)) & (F.col("z") < -4)
    best += [r[0] for r in scored.where(speaks_against).orderBy("z", "_f").limit(max_features).select("_f").collect()]
    index = {f: i for i, f in enumerate(best)}
    sent, key = spark.sparkContext.broadcast(index), "toxicity " + uuid.uuid4().hex

    def select(batches):
        known = worker_cache(key, lambda: _Known(sent.value))
        for b in batches:
            got = [_selected(t.as_py(), known) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["_p", "_x"])

    data = sample.mapInArrow(select, "_p boolean, _x array<int>").toArrow()  # about max_positive + max_unlabelled short rows
    drop_path(spark, path)
    lists = data.column("_x").combine_chunks()
    lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    return Model(index, *train(lengths, flat, data.column("_p").to_numpy(), prior, len(index)))


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, **options):
    """The score of a text column. Only texts go to Python, only scores come back."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(texts.to_pylist()), pa.float64())

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row: the id, held_out, score and predicted (score >= threshold)."""
    score = _scorer(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col), score(F.col(text_col)).alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that are not predicted toxic, columns as they were."""
    score = _scorer(docs, labels, id_col, text_col, **options)
    return docs.where(score(F.col(text_col)) < threshold)
