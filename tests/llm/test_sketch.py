"""Merging and estimates of sketches, and keys of any type."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.llm import sketch


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [("", ""), ("a b", "a b"), ("", "a b c d e f")]
    for n in (10, 100, 1000, 5000):
        base = words(n)
        rows += [(base, base + " " + words(n)), (base + " " + words(n // 2), base), (words(n), words(n))]
    s = [sketch.sketch(F.col(c)) for c in "ab"]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", s[0].alias("sa"), s[1].alias("sb"))
    got = df.select("a", "b", sketch.resemblance(F.col("sa"), F.col("sb")).alias("j"), sketch.containment(F.col("sa"), F.col("sb")).alias("c"), sketch.distinct_count(F.col("sa")).alias("n"), sketch.merge(F.col("sa"), F.col("sb")).alias("m"), "sa", "sb")
    for r in got.collect():
        a, b = grams(r.a), grams(r.b)
        assert abs(r.j - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        assert abs(r.c - (len(a & b) / len(a) if a else 1)) < 0.25
        assert r.n == len(a) if len(a) < sketch.K else abs(r.n - len(a)) < 0.3 * len(a)
        assert r.m == sorted(set(r.sa) | set(r.sb))[: sketch.K]


def test_keys_of_any_type(spark):
    rows = [("b", "two words of the second text here"), ("a", "first " * 9), (None, "no key " * 9), (None, "no key either"), ("b", "again the second key")]
    df = spark.createDataFrame(rows, "id string, text string").withColumns({k: F.lit("own") for k in ("at", "key", "g", "sk", "owner")})
    got = {(r.id, r.text): r.edited for r in sketch.with_edits(df, key="id").collect()}
    assert len(got) == 5
    t, n = "first " * 9, min(rows[0][1], rows[4][1])
    assert got["a", t] == t[: len(t) - len(t) // 3] + n[: len(t) // 3]
    assert got[None, "no key either"] == "no key either"[: 13 - 4]
    least = spark.createDataFrame([(-(2**63), "the least id there is"), (5, "another id")], "doc_id long, text string")
    assert {r.doc_id for r in sketch.with_edits(least).collect()} == {-(2**63), 5}
