"""Deltas over buckets agree with full imports in every table, and write in proportion to the change."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.operators import push, rank
from loomgraph.schemas import EDGES, NODES
from loomgraph.sources.buckets import BucketStore

from .graph_fixture import PKG, delta, document, save

S = "java.lang.String"
OWN = {"classes": "fqn", "methods": "fqn", "fields": "fqn", "callGraph": "callerFqn", "inheritance": "childFqn", "methodOverrides": "methodFqn", "annotations": "targetFqn"}


def rows(g, tables):
    return {t: sorted(map(str, g[t].collect())) for t in tables}


def owned(doc, *names):
    return {t: [r for r in doc[t] if r[k].split("#")[0].removeprefix(PKG) in names] for t, k in OWN.items()}


def same(a, b, graph="ex"):
    x, y = a.graph(graph), b.graph(graph)
    tables = [*NODES, *EDGES, "drawers", "postings", "refs", "calls_in"]
    assert rows(x, tables) == rows(y, tables)
    p, q = ({r.node: r.pagerank for r in g["pagerank"].collect()} for g in (x, y))
    assert p.keys() == q.keys() and sum(abs(p[k] - q[k]) for k in p) < 1e-5 and abs(sum(p.values()) - 1) < 1e-9


def test_deltas_agree_with_full_imports(spark, tmp_path):
    a = Engine(spark, str(tmp_path / "a"), buckets=8)
    first = document()
    assert a.import_graph(save(first, tmp_path / "full.json"), "ex") == 1
    # OrderSvc calls something new and no more what it called, and is annotated; its overload appears; a library method becomes a stub
    changed = document()
    changed["callGraph"] = [c for c in changed["callGraph"] if not c["callerFqn"].startswith(PKG + "OrderSvc#")]
    place = f"{PKG}OrderSvc#place(long,{S})"
    changed["callGraph"] += [{"callerFqn": place, "calleeFqn": PKG + "Ent#setName(" + S + ")", "line": 51}, {"callerFqn": place, "calleeFqn": "org.lib.Log#info()", "line": 52}]
    changed["annotations"].append({"targetFqn": place, "targetKind": "METHOD", "annotationFqn": "org.x.Scheduled", "params": {}})
    up = delta(**owned(changed, "OrderSvc"))
    assert a.import_graph(save(up, tmp_path / "d1.json"), "ex") == 2
    b = Engine(spark, str(tmp_path / "b"), buckets=8)
    b.import_graph(save(changed, tmp_path / "full2.json"), "ex")
    same(a, b)
    # UserSvcImpl goes: its stubs and callers' edges change, what only it named goes too
    gone = delta()
    gone["deleted"]["classes"] = [PKG + "UserSvcImpl"]
    a.import_graph(save(gone, tmp_path / "d2.json"), "ex")
    left = {k: v for k, v in changed.items()}
    for t, k in OWN.items():
        left[t] = [r for r in changed[t] if r[k].split("#")[0] != PKG + "UserSvcImpl"]
    c = Engine(spark, str(tmp_path / "c"), buckets=8)
    c.import_graph(save(left, tmp_path / "full3.json"), "ex")
    same(a, c)
    assert "java.util.List" not in {r.fqn for r in a.graph("ex")["class"].collect()}
    # older versions stay readable until they are removed
    assert a.files("ex").read(1)["calls"].count() == 10
    assert a.vacuum("ex") > 0 and a.vacuum("ex") == 0
    same(a, c)


def chains(n, seed=1):
    """n classes in chains of calls, ten methods each."""
    draw = random.Random(seed)
    base = {"classes": [], "methods": [], "callGraph": []}
    for k in range(n):
        name = f"{PKG}C{k}"
        base["classes"].append({"fqn": name, "name": f"C{k}", "kind": "CLASS", "filePath": f"src/C{k}.java", "lineStart": 1, "lineEnd": 90, "packageName": "com.ex", "modifiers": [], "annotations": []})
        for j in range(10):
            base["methods"].append({"fqn": f"{name}#m{j}()", "name": f"m{j}", "classFqn": name, "returnType": "void", "parameters": [], "isConstructor": False, "filePath": f"src/C{k}.java", "lineStart": 10, "lineEnd": 19, "body": "x " * 40, "javadoc": ""})
            for _ in range(2):
                to = draw.randrange(k + 1, n + 1)
                if to < n:
                    base["callGraph"].append({"callerFqn": f"{name}#m{j}()", "calleeFqn": f"{PKG}C{to}#m{draw.randrange(10)}()", "line": 11})
    doc = document()
    return doc | {t: [] for t in OWN} | base | {"spring": {"beans": [], "endpoints": [], "injections": []}}


def test_a_small_delta_writes_little(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), buckets=64)
    doc = chains(300)
    e.import_graph(save(doc, tmp_path / "full.json"), "ex")
    whole = e.buckets.bytes_of("ex", 1)
    # C290 gets another body and calls one more method near the end of the chains
    new = {t: [dict(r) for r in rows_] for t, rows_ in owned(doc, "C290").items()}
    for r in new["methods"]:
        r["body"] = "changed"
    new["callGraph"].append({"callerFqn": PKG + "C290#m0()", "calleeFqn": PKG + "C299#m9()", "line": 12})
    e.import_graph(save(delta(**new), tmp_path / "d.json"), "ex")
    assert e.buckets.bytes_of("ex", 2) < whole / 5
    m, before = e.buckets.manifest("ex"), e.buckets.manifest("ex", 1)
    moved = {t: sum(v != before.folders[t].get(b) for b, v in f.items()) for t, f in m.folders.items()}
    assert moved["fact.methods"] == 1 and moved["fact.fields"] == 0 and moved["method"] <= 2, moved
    assert m.notes["pushed"] < 60  # of 3,000 nodes
    # a lookup opens the file of its bucket and no other
    whole, some = e.graph("ex")["method"], e.lookup("ex", "method", [PKG + "C7#m3()"])
    assert len(whole.inputFiles()) > 50 and len(some.inputFiles()) == 1 and [r.name for r in some.collect()] == ["m3"]
    assert "PushedFilters: [IsNotNull(fqn), EqualTo(fqn" in some._jdf.queryExecution().executedPlan().toString() or "In(fqn" in some._jdf.queryExecution().executedPlan().toString()
    keys = spark.createDataFrame([(PKG + "C299#m9()",), ("no.Such#m()",)], "key string")
    into = e.lookup("ex", "calls_in", keys)
    assert sorted(map(str, into.collect())) == sorted(map(str, e.graph("ex")["calls"].where(F.col("dst") == PKG + "C299#m9()").collect()))
    assert {r.body for r in e.graph("ex")["method"].where(F.col("classFqn") == PKG + "C290").collect()} == {"changed"}


def test_push_over_cycles(spark):
    """Random edges with cycles change; pushed masses are those of a new solution, up to what is kept back."""
    draw = random.Random(4)
    old = {(draw.randrange(40), draw.randrange(40)) for _ in range(120)}
    new = (old - set(list(sorted(old))[:6])) | {(1, 2), (3, 50), (50, 1)}
    frame = lambda es: spark.createDataFrame([(str(a), str(b)) for a, b in sorted(es)], "src string, dst string")
    seeds = lambda *x: spark.createDataFrame([(str(k),) for k in x], "node string")
    (a, _, _), (b, total, n) = rank.mass(frame(old), seeds(0, 1), alpha=0.5, tolerance=1e-6), rank.mass(frame(new), seeds(1, 5), alpha=0.5, tolerance=1e-6)
    ranks = a.withColumn("residual", F.lit(0.0)).cache()
    s = push.changed_sources(frame(old), frame(new))
    w = {r.node: r.w for r in b.collect()}
    names = {str(x) for e in old | new for x in e} | {"0", "1", "5"}
    weights = spark.createDataFrame([(k, w.get(k, 0.0)) for k in sorted(names)], "node string, w double")
    of = lambda es: frame(es).join(s, "src", "left_semi")
    state, _, _ = push.push(push.start(of(old), of(new), ranks, weights, 0.5), lambda q: ranks.join(q, "node", "left_semi").select("node", "residual"), lambda q: frame(new).join(q.toDF("src"), "src", "left_semi"), 1e-3 * total / n, 0.5)
    got = {r.node: r.mass for r in push.merged(ranks, state, weights).collect()}
    want = {r.node: r.mass for r in b.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-3 * total


def test_a_version_is_published_once(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=4)
    df = spark.range(10).selectExpr("cast(id as string) as k", "id")
    first = store.stage("g", store.manifest("g"), {"t": (df, F.col("k"))})
    second = store.stage("g", store.manifest("g"), {"t": (df.limit(1), F.col("k"))})
    assert store.commit("g", first) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit("g", second)
    assert store.read("g")["t"].count() == 10 and store.some("g", ["t"], [])["t"].count() == 0
    store.clear("g")
    assert store.read("g")["t"].count() == 0 and store.read("g", 1)["t"].count() == 10
