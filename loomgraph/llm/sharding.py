"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get dense numbers in key order (range partitions plus their counts, no single
task). A four-round Feistel network over the least even number of bits permutes the
numbers; values that fall outside are walked along their cycle until they are
inside, so the permutation is exact for any row count. Position p goes to shard
``p mod shards`` at slot ``p div shards``: shard sizes differ by one row at most,
slots have no gaps, and both follow from the row number alone.

Defined results: null text has size of the fixed part only and the crc32 of empty
text; null keys are numbered first; rows with equal keys are numbered by the other
columns of the order, repeated rows one after another, and all are kept; an empty table
has no rows; a text of any length is read where it lies and only its size and checksum
travel. Extra columns pass through ``shard_rows`` whatever their names, but for ``row_no``,
``shard`` and ``slot``, which are replaced; ``shard_documents`` returns its own columns only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered_rows

ROUNDS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right + k) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Images of ``numbers`` (0 <= n < total) under the seed's permutation of range(total)."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = _feistel(numbers.astype(np.uint64), half, keys)
    while (outside := out >= np.uint64(total)).any():
        out[outside] = _feistel(out[outside], half, keys)
    return out.astype(np.int64)


def positions(number: Column, total: int, seed: int) -> Column:
    @F.arrow_udf("long")
    def place(n: pa.Array) -> pa.Array:
        return pa.array(permute(n.to_numpy(zero_copy_only=False), total, seed))

    return place(number)


def shard_rows(df: DataFrame, shards: int, order: list[str], *, seed: int = 20) -> DataFrame:
    """Narrow ``df`` with ``row_no``, ``shard`` and ``slot``; counts of shards differ by one at most. Order by all columns that tell rows apart."""
    numbered, total = numbered_rows(df, *order)
    kept = [c for c in numbered.columns if c not in ("shard", "slot")]
    placed = numbered.select(F.struct(*kept).alias("r"), positions(F.col("row_no"), total, seed).alias("p"))
    return placed.select(*[F.col("r")[c].alias(c) for c in kept], (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {int(shards)}").alias("slot"))


def shard_documents(df: DataFrame, shards: int = 40, *, key: str = "doc_id", text: str = "text", overhead: int = 16, seed: int = 20) -> DataFrame:
    """(key, size, text_crc32, row_no, shard, slot): sizes are UTF-8 bytes plus ``overhead``. Texts are read once and not shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(F.col(key).alias("key"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    return shard_rows(narrow, shards, ["key", "text_crc32", "size"], seed=seed).withColumnRenamed("key", key)
