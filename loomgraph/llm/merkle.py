"""Merkle manifest of a dataset: one tree for each group of rows, one over the groups' roots, and a proof for every row.

Leaves are range-sorted by group and order as an RDD, whose partitioner stays the same in every pass over it. A first pass
counts: of a partition only its first and last group can go on in others, so two counts a partition give every group its
offset in every partition, whatever the number of groups. A second pass builds, inside each partition and at most
``2^UNIT`` leaves at a time, all subtrees that are complete and aligned, and writes the numbered leaves and the nodes at the
ragged edges. These nodes meet by coordinate: a task gets those below one node of a higher level (``2^STEP`` units wide),
builds it, and notes each one's siblings on the way; a further round does the same with what was built until no group is
wider. Last, leaves meet the edge nodes of their unit again and get whole proofs. Only the counts pass the driver. The
roots of the groups are the leaves of one more such tree.

Two consecutive nodes are hashed together, the last of an odd number alone; a digest is the lower-case hex sha256 of what
lies below, concatenated as text.

Defined results: a null group is a group of its own and the first; null keys come first in their group; rows with equal
keys are ordered by their leaf, equal rows stay and follow one another; a group of one row has its leaf as root; an empty
table has no rows. Columns of the caller wait in one struct, so any name may occur (``subroot``, ``root`` and ``proof`` are
replaced). Texts of any length are hashed where they are read; only what ``manifest`` is given is shuffled, so give it
narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, spread_join

#: Levels that are built inside a partition, and levels that one task adds in each later round.
UNIT, STEP = 13, 12

_HEX = 64


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in order, concatenated."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def depth(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return max(size - 1, 0).bit_length()


def _hash(*below: str) -> str:
    return sha256("".join(below).encode()).hexdigest()


def grow(leaves: list[str], first: int, size: int | None, levels: int) -> list[tuple[int, list[str]]]:
    """(index of the first, digests) by level, as far as leaves ``first`` and following complete them.

    ``size`` is given if the tree ends with these leaves, so that a last node may stand alone.
    """
    out = [(first, leaves)]
    for level in range(levels):
        low, below = out[-1]
        skip = low & 1
        made = [_hash(below[k], below[k + 1]) for k in range(skip, len(below) - 1, 2)]
        ends = size is not None and low + len(below) == -(-size // (1 << level))
        if ends and (len(below) - skip) % 2:
            made.append(_hash(below[-1]))
        if not made:
            break
        out.append(((low + 1) // 2, made))
    return out


def edges(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes whose parent is not among ``levels``."""
    for k, (low, nodes) in enumerate(levels):
        if k + 1 < len(levels):
            above, parents = levels[k + 1]
            inside = range(2 * above - low, 2 * (above + len(parents)) - low)
        else:
            inside = range(0)
        for j in {0, len(nodes) - 1} if k + 1 < len(levels) else range(len(nodes)):
            if j not in inside:
                yield k, low + j, nodes[j]


def _counted(part: int, rows) -> Iterator[tuple]:
    """One record for a partition that has rows: its number, first group and count, last group and count."""
    first = last = None
    n = first_n = 0
    for r in rows:
        if r[0] != last:
            if last is not None and first_n == 0:
                first_n = n
            first = r[0] if first is None else first
            last, n = r[0], 0
        n += 1
    if last is not None:
        yield part, first, first_n or n, last, n


def _offsets(counts: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """By partition: leaves that its first group has in earlier ones, size of that group, size of its last group."""
    total, runs, now, out = [], [], None, {}
    for part, first, first_n, last, last_n in sorted(counts):
        if first != now:
            total.append(0)
        start, a = total[-1], len(total) - 1
        total[-1] += first_n
        if last != first:
            total.append(last_n)
        now = last
        runs.append((part, start, a, len(total) - 1))
    for part, start, a, b in runs:
        out[part] = start, total[a], total[b]
    return out


def _built(part: int, rows, plan: dict, wide: int) -> Iterator[tuple]:
    """Numbered leaves and edge nodes of one partition: (group, part, unit, level, index, digest, row); a leaf has no level."""
    if part not in plan:
        return
    start, _, last_size = plan[part]
    group, at, unit = None, start, []

    def flush(size):
        low = at - len(unit)
        top = wide if size is None else min(wide, depth(size))
        for level, index, digest in edges(grow(unit, low, size, top)):
            yield group, part, low >> wide, level, index, digest, None

    for g, digest, row in rows:
        if g != group:
            if unit:
                yield from flush(at)
            at = start if group is None else 0
            group, unit = g, []
        yield group, part, at >> wide, None, at, digest, row
        unit.append(digest)
        at += 1
        if not at % (1 << wide):
            yield from flush(None)
            unit = []
    if unit:
        yield from flush(last_size if at == last_size else None)


def _grown(leaves: DataFrame, unit: int, step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (_h, _o, _leaf, _row): the numbered leaves; the edge nodes with ``_path`` (siblings up to the root), ``_size`` and ``_top``; sizes of groups."""
    spark = leaves.sparkSession
    held = materialize(leaves.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    keys = ["_o", "_leaf", "_tie"]
    dealt = held.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    rows = dealt.select("_h", "_leaf", "_row").rdd
    plan = spark.sparkContext.broadcast(_offsets(rows.mapPartitionsWithIndex(_counted).collect()))
    schema = T.StructType().add("_h", "string").add("_part", "integer").add("_unit", "long").add("_level", "integer").add("_index", "long").add("_hash", "string")
    schema = schema.add("_row", held.schema["_row"].dataType)
    built = materialize(spark.createDataFrame(rows.mapPartitionsWithIndex(lambda k, it: _built(k, it, plan.value, unit)), schema, verifySchema=False), "built")
    sizes = materialize(held.groupBy("_h").agg(F.count(F.lit(1)).alias("_size")).withColumn("_times", F.col("_size")), "sizes")
    nodes = spread_join(built.where("_level is not null").drop("_row"), sizes, "_h", "_times").withColumn("_path", F.array().cast("array<string>"))
    most = depth(sizes.agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0])
    top = unit
    stages = []
    while True:
        top += step
        nodes = materialize(_round(nodes, top), "nodes")
        stages.append(nodes)
        if top >= most:
            break
        blocks = nodes.select("_h", "_size", F.col("_top_level").alias("_level"), F.col("_block").alias("_index"), F.col("_top").alias("_hash")).dropDuplicates(["_h", "_index"])
        nodes = blocks.withColumn("_part", F.lit(0)).withColumn("_unit", F.lit(0).cast("long")).withColumn("_path", F.array().cast("array<string>"))
    done = stages.pop()
    while stages:
        above = done.select("_h", F.col("_index").alias("_block"), F.col("_path").alias("_rest"), F.col("_top").alias("_end"))
        below = stages.pop()
        done = below.join(above, ["_h", "_block"]).withColumn("_path", F.concat("_path", "_rest")).withColumn("_top", F.col("_end")).drop("_rest", "_end")
    return built.where("_level is null"), done, sizes


def _round(nodes: DataFrame, top: int) -> DataFrame:
    """Nodes with their siblings up to level ``top`` (or the root), and what they are below there."""

    def build(table: pa.Table) -> pa.Table:
        size = table["_size"][0].as_py()
        high = min(top, depth(size))
        level, index, digest = (table[c].to_pylist() for c in ("_level", "_index", "_hash"))
        by_level: list[dict[int, str]] = [{} for _ in range(high + 1)]
        for k, i, d in zip(level, index, digest):
            by_level[k][i] = d
        for k in range(high):
            for i in {j >> 1 for j in by_level[k]}:
                pair = [by_level[k][j] for j in (2 * i, 2 * i + 1) if j in by_level[k]]
                by_level[k + 1][i] = _hash(*pair)
        paths = [[by_level[k].get((i >> (k - own)) ^ 1, "") for k in range(own, high)] for own, i in zip(level, index)]
        out = table.drop_columns(["_path"])
        out = out.append_column("_path", pa.array(paths, pa.list_(pa.string())))
        block = table["_block"][0].as_py()
        n = len(out)
        return out.append_column("_top_level", pa.array([high] * n, pa.int32())).append_column("_top", pa.array([by_level[high][block]] * n, pa.string()))

    # a tree of fewer levels than top has one block, its root
    block = F.expr(f"shiftright(_index, {top} - _level)")
    cols = ["_h", "_part", "_unit", "_level", "_index", "_hash", "_size", "_block", "_path"]
    schema = "_h string, _part int, _unit long, _level int, _index long, _hash string, _size long, _block long, _path array<string>, _top_level int, _top string"
    return nodes.withColumn("_block", block).select(*cols).groupBy("_h", "_block").applyInArrow(build, schema)


def _texts(flat: np.ndarray, there: np.ndarray) -> pa.Array:
    """Strings of 64 characters where ``there``, else empty."""
    ends = np.cumsum(there, dtype=np.int64) * _HEX
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(there), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[there].tobytes()))


def _proved(leaves: DataFrame, nodes: DataFrame, wide: int) -> DataFrame:
    """(_row, _number, _root, _up, _proof): ``nodes`` has _path, _top, and of the tree above the groups _at, _over and _root."""

    def prove(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["_index"].to_numpy(), kind="stable")))
        pos, n = rows["_index"].to_numpy(), len(rows)
        size, at = nodes["_size"][0].as_py(), nodes["_at"][0].as_py()
        over = nodes["_over"][0].as_py()
        own, ends = depth(size), int(pos[-1]) + 1 == size
        levels = grow(rows["_hash"].to_pylist(), int(pos[0]), size if ends else None, min(wide, own))
        near = np.zeros((n, own + len(over)), f"S{_HEX}")
        for k in range(len(levels) - 1):
            low, digests = levels[k]
            above, parents = levels[k + 1]
            index = pos >> k
            other = (index ^ 1) - low
            there = (index >> 1 >= above) & (index >> 1 < above + len(parents)) & (other >= 0) & (other < len(digests))
            near[there, k] = np.array(digests, f"S{_HEX}")[other[there]]
        for level, index, path in zip(nodes["_level"].to_pylist(), nodes["_index"].to_pylist(), nodes["_path"].to_pylist()):
            if path or over:
                a, b = np.searchsorted(pos >> level, [index, index + 1])
                near[a:b, level:] = np.array(path + over, f"S{_HEX}")
        right_child = np.concatenate([(pos[:, None] >> np.arange(own)) & 1, np.broadcast_to((at >> np.arange(len(over))) & 1, (n, len(over)))], axis=1).astype(bool).ravel()
        flat = near.ravel()
        there = flat != b""
        steps = pa.StructArray.from_arrays([_texts(flat, there & right_child), _texts(flat, there & ~right_child)], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (own + len(over)), pa.int32()), steps)
        same = lambda c: pa.array([nodes[c][0].as_py()] * n, pa.string())
        return pa.table([rows["_row"], rows["_index"], same("_top"), same("_root"), proof], names=["_row", "_number", "_up", "_root", "_proof"])

    schema = T.StructType(
        [T.StructField("_row", leaves.schema["_row"].dataType), T.StructField("_number", T.LongType()), T.StructField("_up", T.StringType()), T.StructField("_root", T.StringType())]
    ).add("_proof", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))
    unit = ["_h", "_part", "_unit"]
    a = leaves.select(*unit, "_index", "_hash", "_row").groupBy(*unit)
    b = nodes.select(*unit, "_level", "_index", "_path", "_size", "_top", "_at", "_over", "_root").groupBy(*unit)
    return a.cogroup(b).applyInArrow(prove, schema)


def manifest(df: DataFrame, *, group: str, order: list[str], leaf: str = "leaf", unit: int = UNIT, step: int = STEP) -> DataFrame:
    """``df`` with ``subroot`` (of the row's group), ``root``, and ``proof``: siblings from the leaf up, each on its side and empty on the other.

    A level at which a node has no sibling is empty on both sides, so ``fold`` follows the proof alone.
    """
    name = F.sha2(framed(F.col(group)), 256)
    rows = df.select(name.alias("_h"), F.struct(F.col(group).alias("g"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)]).alias("_o"), F.col(leaf).alias("_leaf"), F.struct(*df.columns).alias("_row"))
    leaves, nodes, sizes = _grown(rows, unit, step)
    groups = leaves.select("_h", F.col("_row")[group].alias("_g")).dropDuplicates(["_h"])
    tops = nodes.select("_h", "_top").dropDuplicates(["_h"]).join(groups, "_h")
    all_groups = tops.select(F.lit("").alias("_h"), F.struct(F.col("_g").alias("g")).alias("_o"), F.col("_top").alias("_leaf"), F.struct(F.col("_h").alias("of")).alias("_row"))
    roots, above, _ = _grown(all_groups, unit, step)
    lone = above.withColumn("_at", F.lit(0).cast("long")).withColumn("_over", F.array().cast("array<string>")).withColumn("_root", F.col("_top"))
    over = _proved(roots, lone, unit).select(F.col("_row.of").alias("_h"), F.col("_number").alias("_at"), F.transform("_proof", lambda s: F.concat(s["left"], s["right"])).alias("_over"), "_root")
    got = _proved(leaves, spread_join(nodes, over.join(sizes.drop("_size"), "_h"), "_h", "_times"), unit)
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in ("subroot", "root", "proof")]
    return got.select(*kept, F.col("_up").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"))
