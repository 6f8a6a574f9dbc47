"""What several operators share: scratch tables, table reading, running sums."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ARROW_BYTES, ARROW_ROWS = 4 << 20, 4000
#: Rows of one side of a join that is broadcast; their hash table takes several times this.
TRUE_BROADCAST = "1MB"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Unset: a temporary folder if all runs in one JVM (tests); on a cluster an error,
    for no folder of one machine would do.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="fieldlens-"))
        return "file://" + _own_dir[0]
    raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    return f"{shared_dir(spark)}/fieldlens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, files: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of
    the lineage that survives lost executors. ``files``: at most so many files, for
    tables that are small beside the number of partitions. Returns the table and
    its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch tables that this application's operators left in the shared
    folder, once what is read from them is written elsewhere."""
    drop_path(spark, scratch_dir(spark))


def rows_that_stay(docs: DataFrame, id_col: str, text_col: str, judged: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns as they were whatever their names, but for those
    that ``judged`` (_id, _key: hash of the text, _stays) sends away; of rows that
    repeat an id and a text one stays. Rows that ``judged`` doesn't hold stay."""
    each = judged.groupBy("_id", "_key").agg(F.max("_stays").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    # Of an id and text only what goes or repeats is looked up.
    odd = each.where("not _stays or _rows > 1").select(F.col("_id").alias("_odd_id"), F.col("_key").alias("_odd_key"), F.col("_stays").alias("_odd_stays"))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]).alias("_row"))
    own = own.join(odd, F.col("_id").eqNullSafe(F.col("_odd_id")) & (F.col("_key") == F.col("_odd_key")), "left")
    once = own.where("_odd_stays").groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row")
    return own.where("_odd_key is null").select("_row").union(once).select(*[F.col(f"_row.k{i}").alias(c) for i, c in enumerate(docs.columns)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary lies; another folder by
    ``FIELDLENS_TOKENIZERS``."""
    folder = os.environ.get("FIELDLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_kept: dict[str, object] = {}


def worker_cache(owner: str, make):
    """What a Python worker keeps from one task of an operator to the next, made by
    ``make``. Workers outlive operators: the next owner's first call drops it."""
    if owner not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[owner] = make()
    return _kept[owner]


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BYTES`` or ``ARROW_ROWS``, unless the session
    has settings of its own: long rows make batches of many megabytes otherwise,
    which JVM and Python worker hold several times."""
    for key, value in (("maxBytesPerBatch", ARROW_BYTES), ("maxRecordsPerBatch", ARROW_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(value))


@contextmanager
def joins_by_true_size(spark: SparkSession):
    """While tables are worked out here, Spark broadcasts one side of a join by the size
    that its rows have after a shuffle, never by that of the files it is read from:
    numbers that lie close together take a few bits in a file and 16 bytes and more in
    a hash table, which is built in the driver. Broadcasts asked for by name stay."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    spark.conf.set(names[1], before[1] or ("-1" if before[0] == "-1" else TRUE_BROADCAST))
    spark.conf.set(names[0], "-1")
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def slices_by_bytes(texts: pa.Array, most: int):
    """(start, stop) row ranges of about ``most`` bytes, one row at least."""
    if len(texts) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    yield from zip(edges[:-1], edges[1:], strict=True)


def running_sums(df: DataFrame, group: str, order: list[str], sums: list[str], name: str) -> DataFrame:
    """Add ``<c>_before`` for each long column c of ``sums``: the sum over the
    rows of the same group that come earlier in ``order``.

    Rows are range-partitioned by group and order, so a group with a third of
    all rows spreads over a third of the tasks. Each task sums its own rows;
    what earlier tasks hold of a group that crosses task borders comes from a
    table of at most two rows a task. ``group`` must not be null. Sums wrap at
    64 bits. The result is a scratch table.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), *(T.StructField(f"{c}_before", T.LongType()) for c in sums)])

    def add(batches):
        part = TaskContext.get().partitionId()
        last, carry = None, {c: np.int64(0) for c in sums}
        for b in batches:
            if b.num_rows == 0:
                continue
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            first = np.ones(len(g), dtype=bool)
            first[1:] = g[1:] != g[:-1]
            first[0] = last is None or g[0] != last
            starts = np.flatnonzero(first)
            run = np.cumsum(first) - 1  # -1: the run that the last batch left open
            out = [*b.columns, pa.array(np.full(len(g), part, dtype=np.int64))]
            for c in sums:
                v = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                base = np.concatenate([before[starts], [-carry[c]]])  # run -1 takes the last
                here = before - base[run]
                carry[c] = (here[-1:] + v[-1:])[0]  # wraps
                out.append(pa.array(here))
            last = g[-1]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    ordered = df.repartitionByRange(*[F.col(c) for c in [group, *order]]).sortWithinPartitions(group, *order)
    done, _ = materialize(ordered.mapInArrow(add, schema), name)
    wide = T.DecimalType(38, 0)
    per_task = done.groupBy(group, "_part").agg(*[F.sum(F.col(c).cast(wide)).alias(c) for c in sums])
    w = Window.partitionBy(group).orderBy("_part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        per_task.withColumn("_n", F.row_number().over(w))
        .select(F.col(group).alias("_rs_group"), F.col("_part").alias("_rs_part"), "_n", *[F.sum(c).over(earlier).alias(f"_o_{c}") for c in sums])
        .where("_n > 1")
        .drop("_n")
    )
    joined = done.join(F.broadcast(crossing), (F.col(group) == F.col("_rs_group")) & (F.col("_part") == F.col("_rs_part")), "left")
    # Two to the 63rd: sums stay in the range of a non-negative long.
    wrap = F.lit("9223372036854775808").cast(T.DecimalType(20, 0))
    for c in sums:
        whole = F.pmod(F.col(f"{c}_before").cast(wide) + F.col(f"_o_{c}"), wrap).cast("long")
        alone = F.col(f"{c}_before").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
        joined = joined.withColumn(f"{c}_before", F.when(F.col(f"_o_{c}").isNull(), alone).otherwise(whole))
    return joined.drop("_rs_group", "_rs_part", "_part", *[f"_o_{c}" for c in sums])
