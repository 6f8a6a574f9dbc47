"""URL verdicts from a list of host and path rules, DataFrame functions only.

A blocked Bloom filter of the listed canonical keys (host + path) passes
possible hits; an exact hash join with the list removes the false positives.
A block is one 64-bit word in which each key sets four bits. The words are one
array of at most ``MAX_BLOCKS``, whatever the list's length, which each row looks
into; the list itself is joined as Spark sees fit, with the distinct urls that the
filter passes, and all other pages are never shuffled.

A url's candidate keys are its host and parent domains, each with the prefixes
of its path, but only for label counts and path lengths that occur in the list.

Defined results: null urls and urls without ``://`` have an empty host and path
and get the default verdict; so do urls that no rule fits. Of several rules that
fit, the longest wins, then the one with the longer host, then ``block``.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 5
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """Four bits of a word, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(4):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def bloom_words(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, word): the filter, one row for each block that holds a key."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("word"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per page: id, host, path, rule (host + path of the winning rule) and verdict.

    ``rules``: host, path, verdict (``block`` or ``allow``).
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_verdict")).dropna()
    listed = listed.withColumn("_key", F.concat("_rh", "_rp"))
    # Aggregates of integers only: how many keys, which label counts and path lengths.
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("_rh", r"\."))).alias("labels"), F.collect_set(F.length("_rp")).alias("lengths")).first()
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if shape["n"] == 0:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = min(MAX_BLOCKS, 1 << max(4, (shape["n"] // KEYS_PER_BLOCK).bit_length()))
    # The filter as one array of at most MAX_BLOCKS words (2 MB), a scalar subquery.
    dense = pages.sparkSession.range(blocks).join(bloom_words(listed, "_key", blocks), F.col("id") == F.col("block"), "left")
    words = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))), lambda x: x["word"]).alias("words")).scalar()

    parts = F.split("host", r"\.")
    labels, lengths = (F.array(*[F.lit(n) for n in sorted(shape[x])]) for x in ("labels", "lengths"))
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    listed_perhaps = lambda k: F.get("_words", _block(k, blocks).cast("int")).bitwiseAND(_bits(k)) == _bits(k)
    tried = urls.withColumn("_words", words).withColumn("_keys", F.when(F.col("host") != "", F.filter(keys, listed_perhaps))).drop("_words")
    hit = F.coalesce(F.size("_keys") > 0, F.lit(False))

    # Only pages with a possible hit are shuffled, each url of them once for the join with the list.
    possible = tried.where(hit).groupBy("host", "path").agg(F.first("_keys").alias("_keys")).select("host", "path", F.explode("_keys").alias("_key"))
    order = F.struct(F.length("_key"), F.length("_rh"), F.col("_verdict"))
    best = possible.join(listed, "_key").groupBy("host", "path").agg(F.max_by(F.struct("_key", "_verdict"), order).alias("_best"))
    joined = tried.where(hit).drop("_keys").join(best, ["host", "path"], "left").select(id_col, "host", "path", "_best")
    passed = tried.where(~hit).select(id_col, "host", "path", F.lit(None).cast("struct<_key:string,_verdict:string>").alias("_best"))
    return joined.union(passed).select(id_col, "host", "path", F.col("_best._key").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
