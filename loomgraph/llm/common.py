"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a new one in local mode and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside get Arrow batches of about ``size`` bytes, unless the caller has set a size; else long texts come ten thousand at once.

    A batch stands in the JVM, with up to as much again as its buffers double, and in the Python worker of each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key)


def spread_join(rows: DataFrame, values: DataFrame, key: str, times: str, *, share: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has each key once and in ``times`` how many of the rows have it.

    A key that more than one in ``share`` rows have (there are fewer than ``share`` of them) is sent to all tasks, so that
    its rows stay where they are; the others meet by a shuffle. ``rows`` should be narrow: they are read twice.
    """
    total = values.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    often = F.col(times) > max(total // share, 1)
    hot, rest = values.where(often).drop(times), values.where(~often).drop(times)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(rest, key))


def ascii_lower(col: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def least_picks(df: DataFrame, total: int, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df`` with the least values of ``pick`` (an even 64-bit hash), one for each value.

    A filter on the hash passes about twice as many of the ``total`` rows, so what tasks hand on to the
    final sort does not grow with their number; copies are dropped before it.
    """
    share = min(1.0, 2 * rows / max(total, 1))
    top = min(2**63 - 1, -(2**63) + int(share * 2**64))
    return df.where(F.col("pick") <= top).dropDuplicates(["pick"]).orderBy("pick").limit(rows)


def byte_steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (bytes, offsets) over consecutive rows of an Arrow string array, about ``size`` each.

    Null rows are empty. ``offsets`` has one entry more than the step has rows and starts at 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield values[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ordered_partitions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-partitioned by ``order``, with ``_part`` (rises with the order), as a written table.

    The rows should be narrow; the partition ids are fixed by the write, so later steps may rely on them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return materialize(dealt, "ordered")


def numbered_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with a dense ``row_no`` from 0 in the order of ``order``, without a single-task sort, and the number of rows.

    Counts per range partition (one row each) give every partition its first number. Columns of the caller wait in one
    struct, so any name may occur; one named ``row_no`` is replaced.
    """
    from pyspark.sql import Window

    keys = [f"o{k}" for k in range(len(order))]
    held = df.select(F.struct(*df.columns).alias("_row"), *[F.col(c).alias(k) for c, k in zip(order, keys)])
    cut = ordered_partitions(held, *keys)
    counts = materialize(cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "counts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    numbered = cut.withColumn("_i", F.row_number().over(inside))
    # one row per partition: as small as the number of shuffle partitions
    placed = numbered.join(F.broadcast(starts), "_part")
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c != "row_no"]
    return placed.select(*kept, (F.col("_start") + F.col("_i") - 1).alias("row_no")), counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
