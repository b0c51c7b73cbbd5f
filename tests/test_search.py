"""Routing, sanitising, fusion and debouncing on hand-made rows; streams against batch."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import sanitize
from loomgraph.operators import search
from loomgraph.streaming import changes


def test_router(spark):
    rows = [("PATCH /vendor/{id}", "endpoint", 2.5), ("/orders", "endpoint", 2.5), ("com.ex.A#m", "method", 2.0), ("com.ex.A", None, 2.0), ("VendorController", "class", 1.5), ("doWork", "method", 1.5), ("do_work", "method", 1.5), ("how does auth work", None, 1.0), ("auth", None, 1.0), ("URL", None, 1.0), ("get users", "endpoint", 2.5)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "query_id long, query string")
    for r in search.route_queries(df).collect():
        assert (r.hint.type, r.hint.boost) == rows[r.query_id][1:], r.query


def test_sanitizer(spark):
    long = "x" * 500
    rows = [("short", "short", "passthrough"), (long + "\nWhere is auth?", "Where is auth?", "question_extraction"), (long + "\n" + "y" * 40, "y" * 40, "tail_sentence"), ("\n".join(["abc def"] * 40), None, "tail_truncation"), (None, "", "passthrough")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, q string").select("i", sanitize(F.col("q")).alias("s"))
    for r in df.collect():
        assert r.s.method == rows[r.i][2] and r.s.clean_length <= 250
        assert rows[r.i][1] is None or r.s.query == rows[r.i][1]


def test_fusion(spark):
    mk = lambda ks: spark.createDataFrame([(1, k, i) for i, k in enumerate(ks)], "query_id long, key string, rank int")
    got = {r.key: round(r.score, 4) for r in search.rrf_fuse({"fts": mk("ab"), "semantic": mk("bc")}).collect()}
    assert got == {"b": 0.0331, "a": 0.0167, "c": 0.0164}


def test_text_search(spark):
    d = spark.createDataFrame([("class", "A", "user service"), ("class", "B", "order service"), ("class", "C", "userland")], "type string, key string, name string")
    idx = search.postings(d, {"name": 10.0})
    q = spark.createDataFrame([(1, "user"), (2, "user*"), (3, "%servise%1"), (4, "zzz")], "query_id long, query string")
    got = {}
    for r in search.fts_search(idx, q).collect():
        got.setdefault(r.query_id, set()).add(r.key)
    assert got == {1: {"A"}, 2: {"A", "C"}, 3: {"A", "B"}}


EVENTS = [("p", "2024-01-01 00:00:00", 1, "create", "a/A.java", None), ("p", "2024-01-01 00:00:03", 2, "delete", "a/A.java", None), ("p", "2024-01-01 00:00:06", 3, "rename", "a/C.java", "a/B.java"), ("p", "2024-01-01 00:01:00", 4, "modify", "a/A.java", None), ("p", "2024-01-01 00:01:01", 5, "modify", "target/X.java", None), ("p", "2024-01-01 00:01:02", 6, "modify", "a/x.txt", None)]
WANT = [[("a/A.java", "delete"), ("a/B.java", "delete"), ("a/C.java", "modify")], [("a/A.java", "modify")]]


def frame(spark):
    return spark.createDataFrame(EVENTS, "project string, ts string, seq long, event string, path string, old_path string").withColumn("ts", F.to_timestamp("ts"))


def test_debounce(spark):
    got = changes.debounce(changes.classify(frame(spark))).orderBy("start").collect()
    assert [[tuple(c) for c in r.changes] for r in got] == WANT


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark).coalesce(1).write.json(src, timestampFormat="yyyy-MM-dd HH:mm:ss")
    late = frame(spark).limit(1).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 03:00:00")))
    late.coalesce(1).write.mode("append").json(src, timestampFormat="yyyy-MM-dd HH:mm:ss")
    events = spark.readStream.schema(changes.EVENTS).option("maxFilesPerTrigger", 1).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(src)
    seen = []
    q = changes.watch(events, lambda df, n: seen.extend(df.orderBy("start").collect()), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    for _ in range(50):
        if not q.isActive:
            break
        time.sleep(0.2)
    assert [[tuple(c) for c in r.changes] for r in seen] == WANT
