"""Posting blocks, prefixes, names by grams and walks of many targets against brute force and single runs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import impact, index, many, search, traverse
from loomgraph.plans import delta as deltas
from loomgraph.sources.export import read_full
from loomgraph.sources.store import GraphStore

from .graph_fixture import PKG, document, save


@pytest.fixture(scope="module")
def corpus(spark):
    """2,000 documents of few frequent and many rare words."""
    draw = random.Random(2)
    words = [f"w{int(1.13 ** k)}" for k in range(60)]
    rows = [("class" if k % 3 else "method", f"d{k}", " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=12))) for k in range(2000)]
    docs = spark.createDataFrame(rows, "type string, key string, body string")
    return rows, search.postings(docs, {"body": 1.0}).cache()


def brute(rows, match, k):
    tf, df, n = {}, defaultdict(Counter), Counter()
    for t, d, text in rows:
        tf[t, d] = Counter(text.split())
        n[t] += 1
        df[t].update(set(tf[t, d]))
    out = set()
    for t in n:
        terms = [w for w in df[t] if match(w)]
        s = {d: round(sum(c[w] * math.log(1 + n[t] / df[t][w]) for w in terms), 6) for (u, d), c in tf.items() if u == t}
        best = sorted((x for x in s.items() if x[1] > 0), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(t, d, v, i) for i, (d, v) in enumerate(best)}
    return out


def test_blocks_answer_as_a_scan(spark, corpus):
    rows, postings = corpus
    queries = [(1, "w1 w7 w90"), (2, "w2* w1"), (3, "%w10%1"), (4, "nothing here"), (5, "w1")]
    q = spark.createDataFrame(queries, "query_id long, query string")
    made = index.blocks(postings, size=16).cache()
    assert made.agg(F.max("n")).first()[0] == 16 and made.where("size(entries) <> n").isEmpty()
    got, took = index.search(made, index.sizes(postings), postings, q, 10)
    got = defaultdict(set, {k: {(r.type, r.key, r.score, r["rank"]) for r in got.collect() if r.query_id == k} for k, _ in queries})
    match = {1: lambda w: w in ("w1", "w7", "w90"), 2: lambda w: w == "w1" or w.startswith("w2"), 3: lambda w: w in ("w10", "w1", "w0") or (len(w) == 3 and sum(a != b for a, b in zip(w, "w10")) <= 1) or (len(w) == 4 and any(w[:i] + w[i + 1 :] == "w10" for i in range(4))) or (len(w) == 2 and any("w10"[:i] + "w10"[i + 1 :] == w for i in range(3))), 4: lambda w: False, 5: lambda w: w == "w1"}
    for k, f in match.items():
        assert got[k] == brute(rows, f, 10), k
    read = {(r.query_id, r.type): (r.read, r.blocks) for r in took.collect()}
    assert all(a <= b for a, b in read.values()) and read[5, "class"][0] < read[5, "class"][1]  # blocks are left out


def test_names_that_contain_a_text(spark):
    draw = random.Random(8)
    texts = [("ab"[k % 2], "".join(draw.choices("abcX", k=draw.randrange(0, 12))), k) for k in range(300)] + [("a", None, 999)]
    needles = [(k, "ab"[k % 2], "".join(draw.choices("abcX", k=1 + k % 5))) for k in range(40)] + [(90, "a", "zzz"), (91, "a", ""), (92, "none", "ab")]
    t = spark.createDataFrame(texts, "field string, text string, id int")
    q = spark.createDataFrame(needles, "query_id int, field string, needle string")
    got = sorted((r.query_id, r.id) for r in index.containing(t, q).collect())
    assert got == sorted((i, k) for i, f, n in needles for g, x, k in texts if n and f == g and x and n in x)
    assert index.containing(t, q.where("false")).count() == 0


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("many")
    store = GraphStore(spark, str(d / "store"))
    store.write("g", deltas.graph_of(deltas.fact_tables(read_full(spark, save(document(), d / "full.json")))))
    return store.read("g")


def test_walks_of_many_targets_are_single_walks(spark, graph):
    fqns = [r.fqn for r in graph["method"].collect()]
    table = spark.createDataFrame([(f,) for f in fqns] + [("no.Such#method()",), (fqns[0],)], "fqn string")
    got = sorted((r.target, r.caller, r.depth) for r in many.callers_many(graph, table, 3).collect())
    calls = defaultdict(set)
    for r in graph["calls"].collect():
        calls[r.dst].add(r.src)
    want = []
    for f in fqns:
        step = {f}
        for k in (1, 2, 3):
            step = set().union(*(calls[x] for x in step)) if step else set()
            want += [(f, x, k) for x in step]
    assert got == sorted(want)
    both = many.impact_many(graph, table)
    rows = defaultdict(set)
    for r in both.collect():
        rows[r.target].add((r.endpoint, r.handler, r.hops, r.precision))
    for f in (PKG + "UserSvcImpl#hook()", PKG + "BaseSvc#hook()", PKG + "UserSvcImpl#create(java.lang.String)"):
        assert rows[f] == {(r.endpoint, r.handler, r.hops, r.precision) for r in impact.impact(graph, f).collect()}, f


def test_words_of_more_than_64_targets(spark):
    targets = spark.createDataFrame([(f"t{k}", f"t{k}") for k in range(150)], "target string, node string")
    edges = spark.createDataFrame([(f"t{k}", "hub") for k in range(150)] + [("hub", "end")], "node string, to string")
    n = many.numbered(targets)
    assert n.select("word", "bit").distinct().count() == 150 and n.select("word").distinct().count() == 3
    found = many.named(many.walk_many(many._start(n, targets), edges, 2), n)
    assert found.groupBy("node", "depth").count().collect() and sorted((r.node, r.depth, r["count"]) for r in found.groupBy("node", "depth").count().collect()) == [("end", 2, 150), ("hub", 1, 150)]


def test_overridden_is_transitive(graph):
    assert traverse.overridden(graph).count() == 2
