"""Exact dedup by Grace hash partitioning.

1. Tasks delete white space from each text, hash what is left (its content) and look
   it up in an open-addressing table of their own, which compares whole contents: a
   task passes on one record of each content, and its other rows only name that
   record. So a group of copies has a record for each task, however large it is.
   Rows and records are written to the shared folder, the first spill files.
2. Records are dealt to buckets by the first bits of their hash, and each bucket
   that fits goes through one table; the record met first leads those that are equal.
3. A bucket that doesn't fit is dealt again by four more bits, and by a salt, so that
   not even the records of one content meet in one task; a table for each piece
   leaves one record of each content, and those are spilled to new files, which the
   next level deals as in 2.
4. Counts and the row that stays are summed by record, then by leader, and joined back
   by record, so no key of a join is hot.

Texts are equal when they are identical after deleting all of ``[\\x20\\x09-\\x0D]``. Of
equal texts the row with the most code points stays, then that with the smallest id.

Defined results: null text counts as empty, and all texts without content are one
group; null ids come after all others; of rows that repeat an id and a text one
stays; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialize, rows_that_stay

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of content in a task's own table, beyond which it begins anew.
OWN_BYTES = 16 << 20
#: Mean bytes of a bucket, and those from which a bucket is dealt again.
BUCKET_BYTES, MOST_BYTES = 4 << 20, 64 << 20
#: First bits at least, and bits more at each level.
LEAST_BITS, MORE_BITS, ALL_BITS = 10, 4, 63
#: Bytes of content that a task reads, about, and records of a piece at least.
TASK_BYTES, PIECE_ROWS = 64 << 20, 8


class ContentTable:
    """Open addressing with linear probing. A content is found by its hash, and is
    equal only if all of it is."""

    def __init__(self, slots: int = 1 << 10):
        self.slots: list[tuple | None] = [None] * slots
        self.used = self.bytes = 0

    def place(self, h: int, content: bytes, value: int) -> int:
        """The value of the equal content that came first; its own if none did."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) is not None:
            if entry[0] == h and entry[1] == content:
                return entry[2]
            at = (at + 1) & mask
        slots[at] = (h, content, value)
        self.used += 1
        self.bytes += len(content)
        if 3 * self.used > 2 * len(slots):
            self._grow()
        return value

    def _grow(self) -> None:
        old, self.slots = self.slots, [None] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry in old:
            if entry is not None:
                at = entry[0] & mask
                while self.slots[at] is not None:
                    at = (at + 1) & mask
                self.slots[at] = entry


def _rows(docs: DataFrame, id_col: str, text_col: str, own_bytes: int) -> DataFrame:
    """Each row with its record; _hash, _size and _content where it is the record itself."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        at, table = TaskContext.get().partitionId() << 40, ContentTable()
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            records, hashes, contents, digests = [], [], [], []
            for i, text in enumerate(texts.cast(pa.binary()).to_pylist(), at):
                content = text.translate(None, SPACES)
                h = xxhash.xxh3_64_intdigest(content)
                record = table.place(h, content, i)
                records.append(record)
                hashes.append(h if record == i else None)
                contents.append(content if record == i else None)
                digests.append(hashlib.sha256(content).digest())
                if table.bytes > own_bytes:
                    table = ContentTable()
            content = pa.array(contents, pa.binary())
            rows = pa.array(np.arange(at, at + len(texts)))
            points = pc.utf8_length(texts).cast(pa.int64())
            size = pc.binary_length(content).cast(pa.int64())
            at += len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), rows, pa.array(records, pa.int64()), points, pa.array(digests, pa.binary()), pa.array(hashes, pa.uint64()).view(pa.int64()), size, content],
                names=["_id", "_key", "_row", "_record", "_points", "_sha", "_hash", "_size", "_content"],
            )

    schema = f"_id {kind}, _key long, _row long, _record long, _points long, _sha binary, _hash long, _size long, _content binary"
    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, schema)


def _tables(records: DataFrame, bucket: str, tasks: int) -> DataFrame:
    """(_record, _leader) of the records that are equal to one that came first in
    their bucket. One table at a time: a task's buckets come one after another."""

    def run(batches):
        last, table = None, ContentTable()
        for b in batches:
            found, leaders = [], []
            for bucket_, h, record, content in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket_ != last:
                    last, table = bucket_, ContentTable()
                leader = table.place(h & 0xFFFFFFFFFFFFFFFF, content, record)
                if leader != record:
                    found.append(record)
                    leaders.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(leaders, pa.int64())], names=["_record", "_leader"])

    dealt = records.select(bucket, "_hash", "_record", "_content").repartition(tasks, bucket).sortWithinPartitions(bucket)
    return dealt.mapInArrow(run, "_record long, _leader long")


def _links(records: DataFrame, bucket_bytes: int, most_bytes: int) -> list[DataFrame]:
    """For each level, (_record, _leader): equal records, of which the leader may be
    led itself at a later level."""
    spark, out = records.sparkSession, []
    total, n = records.agg(F.sum("_size"), F.count(F.lit(1))).first()
    bits = min(ALL_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, (total or 0) / bucket_bytes)))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_BYTES))
    while n:
        records = records.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits))
        sizes = records.groupBy("_bucket").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
        large, _ = materialize(sizes.where((F.col("_bytes") > most_bytes) & (F.col("_n") > 1)), "large-buckets", 1)
        if bits == ALL_BITS or large.isEmpty():
            out.append(materialize(_tables(records, "_bucket", tasks), "links")[0])
            break
        small = _tables(records.join(large, "_bucket", "left_anti"), "_bucket", tasks)
        bits = min(ALL_BITS, bits + MORE_BITS)
        pieces = F.greatest(F.lit(1), F.least(F.ceil(F.col("_bytes") / most_bytes), F.floor(F.col("_n") / PIECE_ROWS)))
        piece = F.xxhash64(F.shiftrightunsigned("_hash", 64 - bits), F.pmod(F.xxhash64("_record"), pieces))
        spilled, _ = materialize(records.join(large, "_bucket").select("_hash", "_record", "_size", "_content", piece.alias("_piece")), "spill")
        merged, _ = materialize(_tables(spilled, "_piece", tasks), "links")
        out.append(materialize(small.union(merged), "links")[0])
        records, _ = materialize(spilled.drop("_piece").join(merged, "_record", "left_anti"), "spill")
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, own_bytes: int, bucket_bytes: int, most_bytes: int) -> DataFrame:
    """Per row: _id, _key (hash of the text), _keep, _n, _stays, _sha."""
    bound_batches(docs.sparkSession)
    rows, _ = materialize(_rows(docs, id_col, text_col, own_bytes), "rows")
    links = _links(rows.where("_size is not null").select("_hash", "_record", "_size", "_content"), bucket_bytes, most_bytes)
    best = F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_row").alias("row"))
    each = rows.groupBy("_record").agg(F.count(F.lit(1)).alias("_n"), F.min(best).alias("_best")).withColumn("_now", F.col("_record"))
    for level in links:
        led = level.select(F.col("_record").alias("_now"), "_leader")
        each = each.join(led, "_now", "left").withColumn("_now", F.coalesce("_leader", "_now")).drop("_leader")
    groups = each.groupBy("_now").agg(F.sum("_n").alias("_n"), F.min("_best").alias("_best")).where("_n > 1")
    named = each.select("_record", "_now").join(groups, "_now").select("_record", "_n", "_best")
    alone = F.col("_n").isNull()
    return rows.select("_id", "_key", "_row", "_record", "_sha").join(named, "_record", "left").select(
        "_id",
        "_key",
        F.when(alone, F.col("_id")).otherwise(F.col("_best.id")).alias("_keep"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("_n"),
        (alone | (F.col("_row") == F.col("_best.row"))).alias("_stays"),
        "_sha",
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own_bytes: int = OWN_BYTES, bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per row: the id, keep_id (of the row of its group that stays), group_size, kept,
    text_sha256 (of the content)."""
    found = _judged(docs, id_col, text_col, own_bytes, bucket_bytes, most_bytes)
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_stays").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, columns as they were."""
    return rows_that_stay(docs, id_col, text_col, _judged(docs, id_col, text_col, OWN_BYTES, BUCKET_BYTES, MOST_BYTES))
