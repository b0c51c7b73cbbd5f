"""Embeddings and hybrid retrieval, whole results against a plain version of every step."""

import math
import re
from collections import defaultdict

import pytest
import xxhash

from loomgraph.operators import search
from loomgraph.plans import delta as deltas
from loomgraph.plans.drawers import drawers
from loomgraph.sources.export import read_full
from loomgraph.sources.store import GraphStore

from .graph_fixture import PKG, document, save

QUERIES = [(1, "UserSvcImpl"), (2, "save ent hook"), (3, "/users"), (4, "com.ex.User"), (5, "DELETE /admin"), (6, "setName"), (7, "   "), (8, f"{PKG}BaseSvc#save(com.ex.Ent)")]


def embedding(text, size=64):
    v = [0.0] * size
    for t in filter(None, re.split(r"[\W_]+", text.lower())):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        h -= (h >> 63) << 64
        v[h % size] += -1.0 if h < 0 else 1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("retrieve")
    store = GraphStore(spark, str(d / "store"))
    g = deltas.graph_of(deltas.fact_tables(read_full(spark, save(document(), d / "full.json"))))
    store.write("g", g | {"drawers": drawers(g, "ex"), "postings": search.graph_postings(g)})
    return store.read("g")


def test_embed(spark):
    texts = ["", "Hello, hello WORLD", "été 42 日本", "a_b-c"] + [" ".join(f"w{k * j % 97}" for k in range(30)) for j in range(20)]
    got = search.embed(spark.createDataFrame([(t,) for t in texts], "document string")).collect()
    for r in got:
        assert max(abs(a - b) for a, b in zip(r.embedding, embedding(r.document), strict=True)) < 1e-12, r.document


def hint(q):
    """(kind, preferred type, boost, substring, verb, path) of the queries above."""
    if q.startswith("/") or q.startswith("DELETE "):
        verb, path = ("DELETE", q.split(" ", 1)[1]) if " " in q else (None, q)
        return "endpoint", "endpoint", 2.5, None, verb, path
    if "#" in q:
        return "method", "method", 2.0, q, None, None
    if " " not in q and "." in q:
        return "fqn", None, 2.0, q, None, None
    if q == "UserSvcImpl":
        return "class", "class", 1.5, None, None, None
    return ("name", "method", 1.5, None, None, None) if q == "setName" else (None, None, 1.0, None, None, None)


def brute(graph, n_results, fanout=50):
    post = graph["postings"].collect()
    docs = [(r.id, r.fqn, r.type, embedding(r.document)) for r in graph["drawers"].collect()]
    df, keys = defaultdict(set), defaultdict(set)
    for r in post:
        df[r.type, r.term].add(r.key)
        keys[r.type].add(r.key)
    nodes = [(r.fqn, r.name, "class", True) for r in graph["class"].collect()] + [(r.fqn, r.name, "method", r.external is None) for r in graph["method"].collect()] + [(r.id, r.path, "endpoint", True) for r in graph["endpoint"].collect()]
    kind_of = {k: t for k, _, t, _ in nodes}
    out = {}
    for i, q in QUERIES:
        if not q.strip():
            continue
        kind, liked, boost, part, verb, path = hint(q)
        words = {w for w in re.split(r"[\W_]+", q.lower()) if w}
        sums = defaultdict(float)
        for r in post:
            if r.term in words:
                sums[r.type, r.key] += r.weight * math.log(1 + len(keys[r.type]) / len(df[r.type, r.term]))
        ranked, fts = defaultdict(list), []
        for (t, k), s in sums.items():
            ranked[t].append((-round(s, 6), k))
        for t in ("class", "method", "endpoint"):
            fts += [k for _, k in sorted(ranked[t])[:fanout] if k not in fts]
        v = embedding(q)
        near = sorted((1 - sum(a * b for a, b in zip(v, x)) if any(v) and any(x) else 1.0, d, f, t) for d, f, t, x in docs)
        near = [(round(d, 9), *rest) for d, *rest in near]
        sem = []
        lists = {"fts": {k: r for r, k in enumerate(fts[:fanout])}, "semantic": {}, "graph": {}}
        for r, (_, d, f, t) in enumerate(sorted(near)[:fanout]):
            key = d.removeprefix("endpoint:") if t == "endpoint" else f
            lists["semantic"].setdefault(key, r)
            sem.append(key)
        direct = []
        for k, name, t, own in nodes:
            s = None
            if kind == "endpoint" and t == "endpoint" and path in name and (verb is None or k.startswith(verb + ":")):
                s = 1.0
            elif kind in ("method", "fqn") and t != "endpoint" and q in k:
                s = 0.9
            elif (kind == "class" and t == "class") or (kind == "name" and t == "method" and own):
                s = 1.0 if name == q else 0.8 if q in name else None
            if s:
                direct.append((-s, ["method", "class", "endpoint"].index(t), k))
        lists["graph"] = {k: r for r, (_, _, k) in enumerate(sorted(direct)[:fanout])}
        fused = {k: sum(1 / (60 + x[k]) for x in lists.values() if k in x) for k in {k for x in lists.values() for k in x}}
        wide = sorted(fused.items(), key=lambda x: (-x[1], x[0]))[: max(2 * n_results, n_results + 20)]
        scored = [(s * (boost if liked and kind_of.get(k) == liked else 1.0) * (2.0 if part and part in k else 1.0), k) for k, s in wide]
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:n_results]
        out[i] = [(k, round(s, 4), {n: x[k] for n, x in lists.items() if k in x}) for s, k in best]
    return out


def test_retrieve(spark, graph):
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    got = defaultdict(list)
    for r in search.retrieve(graph, graph["drawers"], queries, n_results=5, index=graph["postings"]).collect():
        got[r.query_id].append((r.key, r.score, r.ranks))
    want = brute(graph, 5)
    assert got.keys() == want.keys() and 7 not in got
    for i in want:
        assert got[i] == want[i], i
