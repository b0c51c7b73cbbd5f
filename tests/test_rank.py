"""PageRank ends when it has converged, however many nodes there are."""

from pyspark.sql import functions as F

from loomgraph.operators import rank


def test_long_chain_among_many_nodes(spark):
    """As many nodes as 1 / tolerance: what flows down a chain of 12 has to reach its end."""
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(12)], "src string, dst string")
    many = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("c0").alias("dst"))
    got = {r.node: r.pagerank for r in rank.pagerank(chain.unionByName(many), spark.createDataFrame([], "node string"), tolerance=1e-3).where("node like 'c%'").collect()}
    y, want = 0.0, {}
    for i in range(13):
        y = 1 + 0.85 * (y if i else 2000)
        want[f"c{i}"] = y
    total = sum(want.values()) + 2000
    assert all(abs(got[k] - v / total) < 1e-3 * v / total for k, v in want.items())
