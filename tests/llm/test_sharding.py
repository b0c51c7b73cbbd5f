"""The permutation is one, does not depend on partitions, and names of the caller's columns do not matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import sharding


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(total):
    a = sharding.permute(np.arange(total), total, 20)
    assert sorted(a.tolist()) == list(range(total))
    if total >= 64:
        assert a.tolist() != sharding.permute(np.arange(total), total, 21).tolist()
        assert np.corrcoef(np.arange(total), a)[0, 1] < 0.5


def test_names_and_partitions(spark):
    df = spark.range(500).selectExpr("id as k", "'x' as row_no", "id * 2 as _part", "'i' as _i", "'s' as shard", "'p' as _pos", "map('a', 1) as slot", "'o' as o0", "'r' as r")
    a = sharding.shard_rows(df, 7, ["k"])
    assert a.columns == ["k", "_part", "_i", "_pos", "o0", "r", "row_no", "shard", "slot"]
    rows = sorted(map(tuple, a.collect()))
    assert [r[6] for r in rows] == list(range(500)) and {r[1] for r in rows} == {2 * k for k in range(500)} and {r[2] for r in rows} == {"i"}
    assert rows == sorted(map(tuple, sharding.shard_rows(df.repartition(13, F.rand(1)), 7, ["k"]).collect()))
    assert max(np.bincount([r[7] for r in rows])) - min(np.bincount([r[7] for r in rows])) <= 1
    assert sharding.shard_rows(df.limit(0), 7, ["k"]).collect() == []


def test_ties(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, "a")], "k int, t string")
    got = sorted((r.row_no, r.k, r.t) for r in sharding.shard_rows(df, 2, ["k", "t"]).collect())
    assert got == [(0, None, "a"), (1, None, "b"), (2, 1, "a"), (3, 1, "a")]
