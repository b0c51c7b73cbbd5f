"""Spring facts derived from annotations."""

import pytest
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.plans import spring
from loomgraph.plans.delta import FACTS
from loomgraph.sources.export import facts, read_full
from loomgraph.sources.store import Graph

from .graph_fixture import PKG, document, save

WEB = "org.springframework.web.bind.annotation."
STEREO = "org.springframework.stereotype."


@pytest.mark.parametrize(
    "text,value",
    [('"/a"', "/a"), ('  "/a\\"b"', '/a"b'), ('{"/x", "/y"}', "/x"), ("{ }", ""), ("{Paths.A}", ""), ("Paths.USERS", "Paths.USERS"), (None, ""), ('"a" + "b"', '"a" + "b"'), ('{"only"}', "only")],
)
def test_literals(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(spring.literal(F.col("t"))).first()[0] == value


def test_paths(spark):
    rows = [("", "", "/"), ("/", "", "/"), ("/api/", "/x", "/api/x"), ("api", "", "api"), ("", "x", "/x"), ("/api//", "//x/", "/api/x/")]
    df = spark.createDataFrame(rows, "p string, s string, want string")
    assert all(r[0] == r.want for r in df.select(spring.joined_path(F.col("p"), F.col("s")), "want").collect())


def annotated():
    doc = document() | {"spring": None}
    note = lambda target, kind, fqn, **params: {"targetFqn": PKG + target, "targetKind": kind, "annotationFqn": fqn, "params": params}
    S = "java.lang.String"
    doc["annotations"] = [
        note("UserCtl", "CLASS", WEB + "RestController"), note("UserCtl", "CLASS", WEB + "RequestMapping", value='"/api/"'),
        note(f"UserCtl#post({S})", "METHOD", WEB + "PostMapping", path='{"/users", "/people"}'), note("UserCtl#users", "FIELD", spring.AUTOWIRED),
        note("OrderCtl", "CLASS", STEREO + "Controller"), note("OrderCtl#put(long)", "METHOD", WEB + "RequestMapping", value="Paths.ORDERS", path='"/no"'), note("OrderCtl#put(long)", "METHOD", WEB + "PutMapping"),
        note("OrderCtl#orders", "FIELD", "javax.inject.Inject"), note("UserSvcImpl", "CLASS", STEREO + "Service"), note("UserSvcImpl", "CLASS", STEREO + "Component"),
        note("AdminCtl#wipe()", "METHOD", WEB + "DeleteMapping", value='"/admin"'), note("Outer$Inner", "CLASS", STEREO + "Repository"), note("no.Class", "CLASS", STEREO + "Service"),
    ]
    ctor = lambda owner, *types: {"fqn": f"{PKG}{owner}#{owner}({','.join(types)})", "name": owner, "classFqn": PKG + owner, "isConstructor": True, "parameters": [{"name": f"p{k}", "type": t} for k, t in enumerate(types)], "filePath": f"src/{owner}.java", "lineStart": 1, "lineEnd": 2}
    doc["methods"] += [ctor("UserSvcImpl", PKG + "OrderSvc", "int"), ctor("OrderCtl", PKG + "A"), ctor("OrderCtl", PKG + "A", PKG + "B")]
    return doc


def test_derived(spark, tmp_path):
    doc = read_full(spark, save(annotated(), tmp_path / "e.json"))
    d = spring.derived(Graph({t: facts(doc, t) for t in FACTS}))
    rows = lambda t, *c: sorted(tuple(r[x].removeprefix(PKG) for x in c) for r in d[t].collect())
    assert rows("beans", "name", "classFqn", "type") == sorted([("userCtl", "UserCtl", "REST_CONTROLLER"), ("orderCtl", "OrderCtl", "CONTROLLER"), ("userSvcImpl", "UserSvcImpl", "SERVICE"), ("userSvcImpl", "UserSvcImpl", "COMPONENT"), ("outer$Inner", "Outer$Inner", "REPOSITORY")])
    assert rows("endpoints", "httpMethod", "path", "handlerMethodFqn") == [("ALL", "/Paths.ORDERS", "OrderCtl#put(long)"), ("POST", "/api/users", "UserCtl#post(java.lang.String)"), ("PUT", "/", "OrderCtl#put(long)")]
    twice = [("UserSvcImpl", "p0", "OrderSvc", "CONSTRUCTOR"), ("UserSvcImpl", "p1", "int", "CONSTRUCTOR")]
    assert rows("injections", "targetClassFqn", "targetFieldOrParam", "injectedClassFqn", "injectionType") == sorted([("UserCtl", "users", "UserSvc", "FIELD"), *twice, *twice])


def test_import_that_derives(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), buckets=4)
    e.import_graph(save(annotated(), tmp_path / "e.json"), "ex", derive_spring=True)
    assert {r.id for r in e.graph("ex")["endpoint"].collect()} == {"ALL:/Paths.ORDERS", "POST:/api/users", "PUT:/"}
    assert {(r.src, r.dst) for r in e.graph("ex")["handles"].collect()} >= {(PKG + "UserCtl#post(java.lang.String)", "POST:/api/users")}
