"""The sanitiser against a direct reading of its rules, the context layers, checks of names, and deltas through the engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.functions.text import content_error, name_error, sanitize
from loomgraph.functions.vector import hashing_embedder
from loomgraph.plans.drawers import drawers
from loomgraph.sources import export

from .graph_fixture import PKG, delta, document, save


def unquoted(x):
    x = x.strip()
    while len(x) >= 2 and x[0] in "'\"" and x[0] == x[-1]:
        x = x[1:-1].strip()
    x = x[1:].strip() if x[:1] in ("'", '"') else x
    return x[:-1].strip() if x[-1:] in ("'", '"') else x


def trimmed(x):
    x = unquoted(x)
    fits = [f for f in map(unquoted, filter(str.strip, re.split(r"[.!?。！？\n]+", x))) if 10 <= len(f) <= 250]
    return x if len(x) <= 250 else fits[-1] if fits else x[-250:].strip()


def plain(raw):
    text = raw.strip()
    if len(text) <= 200:
        return (text or raw), "passthrough"
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    asked = [x for x in lines if re.search(r"[?？]\s*[\"']?\s*$", x)]
    if asked and len(asked[-1]) >= 10:
        return (trimmed(asked[-1]) if len(asked[-1]) > 250 else asked[-1]), "question_extraction"
    tails = [t for t in (trimmed(x) for x in lines if len(x) >= 10) if len(t) >= 10]
    return (tails[-1], "tail_sentence") if tails else (text[-250:].strip(), "tail_truncation")


def test_sanitize(spark):
    rng = random.Random(7)
    bits = ["word ", "Where is it? ", "\n", "'", '"', "!", "。", "why?\n", "a" * 40 + " ", "  ", "\t", "'quoted'\n", '""x""\n', "é ü "]
    texts = ["", "  ", "short?", "x" * 400, "'" * 300, "ok?\n" * 80, "\n" * 300 + "end"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 160))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sanitize(F.col("t")).alias("s")).select("i", "s.*").collect()
    for r in rows:
        assert (r.query, r.method) == plain(texts[r.i]), repr(texts[r.i])
        assert r.was_sanitized == (r.method != "passthrough") and r.clean_length == len(r.query)


def test_names(spark):
    got = spark.createDataFrame([("a",), (" ",), (None,), ("x" * 129,), ("a/b",), ("a..b",), ("a\x00",)], "n string").select(name_error(F.col("n")).alias("n"), content_error(F.col("n")).alias("c")).collect()
    assert [r.n for r in got] == [None, "empty", "empty", "too long", "path characters", "path characters", "null bytes"]
    assert [r.c for r in got] == [None, "empty", "empty", None, None, None, "null bytes"]


def test_embedder(spark):
    v = spark.createDataFrame([("one two two",), ("two one two",), ("",), (None,)], "t string").select(hashing_embedder()(F.col("t")).alias("v")).collect()
    assert v[0].v == v[1].v and abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and len(v[0].v) == 64
    assert set(v[2].v) == set(v[3].v) == {0.0}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("engine")
    e = Engine(spark, str(d / "store"))
    e.import_graph(save(document(), d / "full.json"), "ex")
    return e, d


def test_layers(engine):
    e, d = engine
    text = e.context_wakeup("ex")
    assert text.startswith("## L0 — PROJECT IDENTITY\nGraph: ex\nClass: 1") and "Key services: " in text and "## L1 — KEY CODE ELEMENTS" in text and "[com.ex]" in text
    e.context_import(str(d / "full.json"), "alone")
    alone = e.context_wakeup("alone")
    assert "Context drawers: " in alone and "class: " in alone


def test_delta_renews_what_it_reaches(engine):
    """After a delta the drawers are those of all, made anew; an export of the graph gives the graph again."""
    e, d = engine
    changed = {"fqn": PKG + "BaseSvc", "name": "BaseSvc", "kind": "ABSTRACT_CLASS", "filePath": "src/BaseSvc.java", "packageName": "com.ex", "interfaces": [], "modifiers": [], "annotations": []}
    m = {"fqn": PKG + "BaseSvc#save(com.ex.Ent)", "name": "save", "classFqn": PKG + "BaseSvc", "isConstructor": False, "filePath": "src/BaseSvc.java", "lineStart": 10, "lineEnd": 19, "body": "{ changed(); }"}
    doc = delta(classes=[changed], methods=[m])
    doc["deleted"]["classes"] = [PKG + "AdminCtl"]
    e.apply_delta(save(doc, d / "delta.json"), "ex")
    g = e.graph("ex")
    rows = lambda df: {r.id: r for r in df.collect()}
    assert rows(g["drawers"]) == rows(drawers(g, "ex"))
    assert "changed();" in rows(g["drawers"])[f"method:{m['fqn']}"].document
    e.export_json("ex", str(d / "out"), 3)
    again = export.read_full(e.spark, str(d / "out"))
    assert {(r.callerFqn, r.calleeFqn, r.line) for r in export.facts(again, "callGraph").collect()} == {tuple(r) for r in g["calls"].collect()}
