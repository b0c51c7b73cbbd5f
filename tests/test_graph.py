"""Goldens of the small graph, and a delta that must agree with a full import."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.operators import catalog, impact, rank, traverse
from loomgraph.plans import delta as deltas
from loomgraph.plans.drawers import drawers
from loomgraph.sources.export import read_delta, read_full
from loomgraph.sources.store import GraphStore
from loomgraph.streaming import changes

from .graph_fixture import PKG, delta, document, save

S = "java.lang.String"


def short(x):
    return x.removeprefix(PKG).split("(")[0]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("f0")
    g = deltas.graph_of(deltas.fact_tables(read_full(spark, save(document(), d / "full.json"))))
    store = GraphStore(spark, str(d / "store"))
    store.write("f0", g)
    return store.read("f0")


def pairs(df, a, b="depth"):
    return {(short(r[a]), r[b]) for r in df.collect()}


def test_walks(graph):
    assert pairs(traverse.callers(graph, PKG + "BaseSvc#hook()", 3), "caller") == {("BaseSvc#save", 1), ("AdminCtl#wipe", 2), ("OrderSvc#place", 2), ("UserSvcImpl#create", 2), ("OrderCtl#put", 3)}
    assert pairs(traverse.callees(graph, PKG + f"UserSvcImpl#create({S})", 2), "callee") == {("BaseSvc#save", 1), ("Outer$Inner#Inner", 1), ("BaseSvc#hook", 2)}
    assert {short(r.caller) for r in traverse.blast_radius(graph, "src/BaseSvc.java").collect()} == {"AdminCtl#wipe", "BaseSvc#save", "OrderCtl#put", "OrderSvc#place", "UserSvcImpl#create"}
    assert {(r.endpoint, r.hops) for r in impact.impact_direct(graph, PKG + "BaseSvc#hook()").collect()} == {("DELETE /admin", 2), ("PUT /orders", 3)}


def test_impact(graph):
    def got(fqn, **how):
        return {(r.endpoint, r.hops, r.precision) for r in impact.impact(graph, PKG + fqn, **how).collect()}

    hook, create = "UserSvcImpl#hook()", f"UserSvcImpl#create({S})"
    assert got(hook) == {("DELETE /admin", 2, "precise"), ("POST /users", 3, "polymorphic")}
    assert got(hook, precision="path") == {("DELETE /admin", 2, "polymorphic"), ("POST /users", 3, "polymorphic")}
    assert got(hook, field_filter=False) == {("DELETE /admin", 2, "precise"), ("POST /users", 3, "polymorphic"), ("PUT /orders", 3, "polymorphic")} or got(hook, field_filter=False) >= got(hook)
    assert got(hook, polymorphic=False) == set()
    assert got(create) == {("POST /users", 1, "polymorphic")}


def test_types_and_reports(graph):
    start = graph["class"].where(F.col("fqn") == PKG + "UserSvcImpl").select(F.col("fqn").alias("node"))
    assert {short(r.node) for r in traverse.compatible_types(graph, start).collect()} == {"UserSvcImpl", "BaseSvc", "UserSvc"}
    assert {short(r.fqn) for r in catalog.unused_methods(graph).collect()} == {"AdminCtl#wipe", "OrderCtl#put", "UserCtl#post", "UserSvcImpl#create", "UserSvcImpl#hook"}
    stubs = {r.fqn: (r.external, r.isConstructor) for r in graph["method"].where("external is not null").collect()}
    assert stubs == {"java.util.List#add(java.lang.Object)": (True, False), PKG + "Outer$Inner#Inner()": (False, True)}
    assert {r.fqn for r in graph["class"].where("external").collect()} == {"java.util.List"}
    assert graph["calls"].count() == 10
    n = {r.label: r.n for r in catalog.stats(graph).collect()}
    assert n["Endpoint"] == 3 and n["Class"] == 11 and n["total"] == sum(v for k, v in n.items() if k != "total")
    fan = {short(r.fqn): r.fan_in for r in rank.fan_in_out(graph).collect()}
    assert fan["BaseSvc#save"] == 4
    imp = {short(r.fqn): r.importance for r in rank.importance(graph).collect()}
    assert (imp["BaseSvc#save"], imp["UserCtl#post"], imp["POST:/users"]) == (0.2, 0.3, 0.567)


def test_pagerank(graph):
    got = {short(r.node): r.pagerank for r in rank.method_pagerank(graph).collect()}
    want = {"BaseSvc#save": 0.2009, "BaseSvc#hook": 0.1820, "AdminCtl#wipe": 0.1116, "OrderSvc#place": 0.1061, "Ent#setName": 0.0159, "UserSvcImpl#create": 0.0112}
    assert abs(sum(got.values()) - 1) < 1e-6
    for k, v in want.items():
        assert abs(got[k] - v) < 2e-4, (k, got[k])
    e = [(r.src, r.dst) for r in graph["calls"].select("src", "dst").distinct().collect()]
    seed = {r.node for r in rank.entry_seeds(graph).collect()}
    names = sorted({x for p in e for x in p} | seed)
    at = {x: i for i, x in enumerate(names)}
    p = np.array([10.0 if x in seed else 1.0 for x in names])
    p /= p.sum()
    out = np.zeros(len(names))
    for a, _ in e:
        out[at[a]] += 1
    r = np.full(len(names), 1 / len(names))
    for _ in range(60):
        new = np.zeros(len(names))
        for a, b in e:
            new[at[b]] += r[at[a]] / out[at[a]]
        r = 0.85 * (new + r[out == 0].sum() * p) + 0.15 * p
    assert max(abs(r[at[x]] - got[short(x)]) for x in names) < 1e-4


def tables(g):
    return {k: sorted(map(str, g[k].collect())) for k in ("class", "method", "calls", "extends", "has_method")}


def test_delta_agrees_with_full(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "facts"))

    def kept(facts):  # as the engine does: facts are tables before a graph is built from them
        store.write("f", facts)
        return store.read("f")

    full = document()
    facts = kept(deltas.fact_tables(read_full(spark, save(full, tmp_path / "full.json"))))
    name = PKG + "OrderSvc"
    own = lambda rows, key: [r for r in rows if r[key].split("#")[0] == name]
    up = {"classes": own(full["classes"], "fqn"), "methods": own(full["methods"], "fqn"), "callGraph": [c | {"line": 55} for c in own(full["callGraph"], "callerFqn")], "inheritance": own(full["inheritance"], "childFqn")}
    up["classes"] = [c | {"lineStart": 0, "lineEnd": 0} for c in up["classes"]]
    new = kept(deltas.apply_delta(facts, read_delta(spark, save(delta(**up), tmp_path / "d.json"))))
    changed = document()
    for c in changed["callGraph"]:
        if c["callerFqn"].startswith(name):
            c["line"] = 55
    want = deltas.fact_tables(read_full(spark, save(changed, tmp_path / "full2.json")))
    a, b = tables(deltas.graph_of(new)), tables(deltas.graph_of(want))
    assert a == b
    again = kept(deltas.apply_delta(new, read_delta(spark, str(tmp_path / "d.json"))))
    assert sorted(map(str, deltas.graph_of(again)["calls"].collect())) == b["calls"]
    gone = delta()
    gone["deleted"]["classes"] = [name]
    left = deltas.graph_of(kept(deltas.apply_delta(facts, read_delta(spark, save(gone, tmp_path / "g.json")))))
    ext = {r.fqn: r.external for r in left["method"].where("external is not null").collect()}
    assert ext[f"{name}#place(long,{S})"] is True and left["calls"].count() == 9


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.import_graph(save(document(), tmp_path / "full.json"), "ex") == 1
    assert {r.caller for r in e.callers("ex", PKG + "BaseSvc#hook()", 1).collect()} == {PKG + "BaseSvc#save(com.ex.Ent)"}
    assert e.context_stats("ex").count() == 3 and e.entry_points("ex").count() == 3
    assert e.sql("ex", "select count(*) as n from calls").first().n == 10
    hits = e.retrieve("ex", "UserSvcImpl", 3, rerank=False).collect()
    assert hits[0].key == PKG + "UserSvcImpl" and hits[0].label == "class"


def test_watch(spark, tmp_path):
    """Two micro-batches of saved files become two deltas; a batch that comes again is left out."""
    e = Engine(spark, str(tmp_path / "store"))
    e.import_graph = lambda path, graph, **notes: (imported.append(path), e.buckets.write(graph, {}, **notes))  # imports have tests of their own
    landing, asked, imported = tmp_path / "events", [], []
    landing.mkdir()

    def event(n, ts, path, kind="modify"):
        row = {"project": "ex", "ts": ts, "seq": n, "event": kind, "path": path}
        (landing / f"{n}.tmp").write_text(json.dumps(row))
        (landing / f"{n}.tmp").rename(landing / f"{n}.json")

    def exporter(sessions):
        names = sorted(c.path for r in sessions.collect() for c in r.changes)
        asked.append(names)
        gone = delta()
        gone["deleted"]["classes"] = [PKG + n.removeprefix("src/").removesuffix(".java") for n in names]
        return save(gone, tmp_path / f"d{len(asked)}.json")

    def run():
        events = spark.readStream.schema(changes.EVENTS).json(str(landing))
        q = e.watch(events, "ex", exporter, str(tmp_path / "checkpoint"), availableNow=True)
        assert q.awaitTermination(240)

    event(1, "2024-01-01T00:00:00Z", "src/OrderSvc.java", "delete")
    event(2, "2024-01-01T01:00:00Z", "src/AdminCtl.java", "delete")  # an hour later: closes the first session
    event(3, "2024-01-01T01:00:01Z", "target/AdminCtl.java", "delete")
    run()
    assert asked == [["src/OrderSvc.java"]]
    applied = list(e.buckets.manifest("ex").notes["applied"].values())
    # the same batch again, as after a failure between the import and the stream's own commit
    commits = tmp_path / "checkpoint" / "commits"
    for f in [commits / str(max(applied)), commits / f".{max(applied)}.crc"]:
        f.rename(tmp_path / f.name) if f.exists() else None
    run()
    assert len(asked) == 1
    event(4, "2024-01-01T03:00:00Z", "src/Ent.java")
    run()
    assert asked[1:] == [["src/AdminCtl.java"]] and imported == [str(tmp_path / f"d{k}.json") for k in (1, 2)]


def test_sync_mode():
    assert [deltas.choose_sync_mode(*x) for x in [(0, 9, True), (2, 9, True), (3, 9, True), (1, 9, False)]] == ["none", "delta", "full", "full"]


def test_drawers(graph):
    d = {r.id: r for r in drawers(graph, "ex").collect()}
    assert d[f"method:{PKG}UserCtl#post({S})"].document.startswith("UserCtl#post(String) | calls: UserSvc.create | endpoint: POST /users\n---\nDoes it.\n---\n")
    assert d[f"class:{PKG}UserSvcImpl"].document == "UserSvcImpl | 2 methods | extends BaseSvc | implements UserSvc"
    assert "endpoint:POST:/users" in d and all(r.wing == "ex" for r in d.values())
