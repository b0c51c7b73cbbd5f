"""Queries in blocks, call sites cut before they are collected, sessions reduced before they are."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import search
from loomgraph.plans import drawers
from loomgraph.streaming import changes


def plan(df):
    return df._jdf.queryExecution().toString()


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    q = v.where("id < 1000").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    sizes = [r.n for r in search.query_blocks(q, "query_id", "vector").select(F.size("qs").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 2 * search.QUERY_BLOCK
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(1 - u[:1000] @ u.T, axis=1, kind="stable")[:, :3]
    got = {(r.query_id, r["rank"]): r.id for r in search.knn(v, q, 3).collect()}
    assert got == {(i, k): want[i, k] for i in range(1000) for k in range(3)}


def test_direct_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    graph = {
        "class": spark.createDataFrame([(f"com.ex.Cls{i}", f"Cls{i}") for i in range(40)], "fqn string, name string"),
        "method": spark.createDataFrame([("com.ex.Cls1#doIt()", "doIt", None)], "fqn string, name string, external boolean"),
        "endpoint": spark.createDataFrame([("GET:/a", "/a")], "id string, path string"),
    }
    routed = search.route_queries(spark.createDataFrame([*((i, f"Cls{i}") for i in range(10, 40)), (90, "GET /a"), (91, "com.ex.Cls1#doIt"), (92, "just words")], "query_id long, query string"))
    asked = routed.where("hint.kind is not null")
    assert max(r.n for r in search.query_blocks(asked, "query").select(F.size("qs").alias("n")).collect()) <= 20
    got = {(r.query_id, r.key, r.score) for r in search.graph_direct(graph, routed).collect()}
    assert got == {*((i, f"com.ex.Cls{i}", 1.0) for i in range(10, 40)), (90, "GET:/a", 1.0), (91, "com.ex.Cls1#doIt()", 0.9)}


def test_first_call_sites(spark):
    calls = spark.createDataFrame([(f"p.A{i % 997:03d}#m()", "java.time.Clock#now()", None if i == 3 else i // 2) for i in range(5000)], "src string, dst string, line int")
    got = drawers._names(calls, "dst", "src", 8, 5)
    assert "WindowGroupLimit" in plan(got)
    first = sorted((0 if i == 3 else i // 2, f"A{i % 997:03d}.m") for i in range(5000))[:8]
    assert [tuple(r) for r in got.collect()] == [("java.time.Clock#now()", sorted({n for _, n in first})[:5])]


def test_hot_session(spark):
    rows = [("p", i // 100, i, "delete" if i % 7 == 0 else "modify", f"a/{i % 2500}.java", None) for i in range(6000)]
    rows += [("p", 200, 9000, "modify", "a/1.java", None), ("q", 3, 1, "modify", "a/1.java", None)]
    e = spark.createDataFrame(rows, "project string, s int, seq long, event string, path string, old_path string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df = changes.debounce(changes.classify(e))
    assert "collect_list(struct(path, path, seq" not in plan(df) and "max(struct(seq" in plan(df)
    got = {(r.project, r.start.timestamp(), r.end.timestamp()): [tuple(c) for c in r.changes] for r in df.collect()}
    last = sorted({f"a/{i % 2500}.java": "delete" if i % 7 == 0 else "modify" for i in range(6000)}.items())
    assert got == {("p", 0, 64): last, ("p", 200, 205): [("a/1.java", "modify")], ("q", 3, 8): [("a/1.java", "modify")]}
