"""Which rows of a component stay."""

from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm import simhash
from loomgraph.llm.common import spread_join


def test_keep_one(spark):
    same = "one text that several rows have, word for word"
    rows = [(1, "alpha beta gamma delta"), (1, "completely other words are here"), (2, same), (3, same), (3, same), (4, None), (5, ""), (None, same), (None, "a text whose row has no id at all"), (6, "twice the same row"), (6, "twice the same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit("own") for k in ("fp", "key", "row", "h1", "id", "least", "times")})
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter([(1, rows[0][1]), (1, rows[1][1]), (2, same), (4, None), (None, rows[8][1]), (6, "twice the same row")])
    assert {(r.fp, r.key, r.row, r.h1) for r in got.collect()} == {("own",) * 4}
    assert simhash.keep_one(df.limit(0)).count() == 0
    ids = simhash.keep_one(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert {r.doc_id for r in ids.collect()} == {"d1", "d2", "d4", "d6", None}


def test_spread_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)], "k string, i int")
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("times"), F.max("i").alias("top"))
    got = spread_join(rows, values, "k", "times", share=5)
    assert Counter((r.k, r.i, r.top) for r in got.collect()) == Counter((r.k, r.i, r.top) for r in rows.join(values.drop("times"), "k").collect())
    assert spread_join(rows.limit(0), values.limit(0), "k", "times").count() == 0
