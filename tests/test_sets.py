"""Callers of many targets as sets of numbers; text search that moves the asked terms alone."""

from pyspark.sql import functions as F

from loomgraph.operators import many, search


def test_numbers_of_targets_and_rows_of_a_hop(spark):
    """Each caller is reached by a few of 30,000 targets: a word of 64 had a row for nearly each of them."""
    targets = spark.range(30_000).select(F.concat(F.lit("c#t"), "id").alias("target"))
    n = many.counted(targets).cache()
    assert n.select("set", "no").distinct().count() == n.count() == 30_000 and n.select("set").distinct().count() == 1
    big = many.numbered(targets).select("target", "word").where("word >= 0")  # partitions of about 10,000
    assert big.select((F.col("word") / (1 << 32)).cast("long")).distinct().count() == 3
    calls = spark.range(6000).select(F.concat(F.lit("c#a"), F.col("id") % 20).alias("src"), F.concat(F.lit("c#t"), (F.col("id") * 7) % 30_000).alias("dst"), F.lit(1).alias("line"))
    calls = calls.unionByName(spark.createDataFrame([("c#top", f"c#a{k}", 1) for k in range(20)], calls.schema))
    methods = calls.select(F.col("src").alias("fqn")).unionByName(calls.select(F.col("dst").alias("fqn"))).distinct().select("fqn", F.lit("c").alias("classFqn"), F.lit("f").alias("filePath"))
    got = many.callers_many({"calls": calls, "method": methods}, targets.select(F.col("target").alias("fqn")), 2)
    assert {tuple(r) for r in got.groupBy("depth", "caller").agg(F.countDistinct("target"), F.count("target")).collect()} == {*((1, f"c#a{k}", 300, 300) for k in range(20)), (2, "c#top", 6000, 6000)}
    assert "BIT_OR" not in got._jdf.queryExecution().optimizedPlan().toString().upper()


def test_text_search_moves_asked_terms(spark):
    """All postings were shuffled three times."""
    docs = spark.range(400).select(F.lit("class").alias("type"), F.col("id").cast("string").alias("key"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("v"), "id")).alias("body"))
    index = search.postings(docs, {"body": 1.0})
    q = spark.createDataFrame([(1, "w7 all"), (2, "none")], "query_id long, query string")
    for documents in (None, docs.select("type", "key")):
        got = search.fts_search(index, q, 5, documents)
        assert [(r.query_id, r.key, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(1, k, i) for i, k in enumerate(sorted(map(str, range(7, 400, 50)))[:5])]
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # the texts are not cut again
    both = search.fts_search(index, spark.createDataFrame([(1, "w7 v1*")], "query_id long, query string"), 500)
    assert both.count() == len({k for k in range(400) if k % 50 == 7 or str(k).startswith("1")})
