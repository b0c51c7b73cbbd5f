"""Benchmark items without an id still contaminate."""

import random
import re

import pytest

from loomgraph.llm import decontam


@pytest.mark.parametrize("pass_words", [decontam.MAX_PASS_WORDS, 1])
def test_item_without_id(spark, pass_words):
    w = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(None, " ".join(w[:20])), ("b", " ".join(w[20:33])), (None, None), (None, "w1 w2"), ("c", "w1 w2")], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(["x", *w[:20]])), (2, " ".join([*w[20:33], "y"])), (3, "w1 w2 z"), (4, "w2 w1"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, bench, pass_words=pass_words).collect()}
    assert got == {1: (21, 20, ["c"], True), 2: (14, 13, ["b"], True), 3: (3, 2, ["c"], True), 4: (2, 0, [], False), 5: (0, 0, [], False)}


def test_columns_of_the_caller(spark):
    """Names that the operator uses come back as they were; one pass and several agree; long texts take several steps."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    long = "plain filler words " * 200_000 + words + " end"
    rows = [(1, "x " + words, 5, "own", "own"), (2, None, 6, "own", "own"), (3, long, 7, "own", "own"), (4, "clean text", 8, "own", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hit int, row string, t string").coalesce(1)
    bench = spark.createDataFrame([("i", words), ("j", "plain filler words plain"), ("k", None), ("l", "x alpha")], "item_id string, text string")
    at_once = decontam.contamination(df, bench)
    passes = decontam.contamination(df, bench, pass_words=40)
    for got in (at_once, passes):
        assert got.columns == df.columns + ["n_words", "n_hit", "items", "contaminated"]
        found = {r.doc_id: r for r in got.collect()}
        assert {i: (r._hit, r.row, r.t) for i, r in found.items()} == {i: (4 + i, "own", "own") for i in (1, 2, 3, 4)}
        assert (found[1].n_words, found[1].n_hit, found[1].items) == (14, 14, ["i", "l"]) and found[2].n_words == 0
        assert (found[3].n_words, found[3].n_hit, found[3].items) == (600_014, 599_998 + 13, ["i", "j"]) and not found[4].contaminated
    assert decontam.contamination(df.limit(0), bench).count() == 0 and decontam.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_long_items_are_cut(spark):
    """Pieces of an item keep every window; chunks built by tasks and put together by row agree with brute force."""
    rng = random.Random(5)
    words = [f"v{k}" for k in range(30)] + ["été", "Ünit"]
    items = [(f"i{k}", " ".join(rng.choices(words, k=n))) for k, n in enumerate((1, 5, 12, 13, 14, 60, 400))] + [(None, " ".join(rng.choices(words, k=50)))]
    items += [items[5], ("i9", items[4][1]), ("i10", "...")]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(30)]
    for _ in range(60):
        own = rng.choice(items)[1].split()
        a = rng.randrange(len(own))
        texts.append(" ".join(rng.choices(words, k=9) + own[a : a + rng.randrange(10, 40)] + rng.choices(words, k=rng.randrange(30))))
    texts += [texts[40], "", None]

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def brute(t):
        w, hit, ids = split(t), set(), set()
        for i, u in items:
            u = split(u)
            for k in range(max(1, len(u) - 12)) if u else ():
                p = u[k : k + 13]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit |= set(range(a, a + len(p)))
                        ids |= {i} - {None}
        return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)

    want = {k: brute(t) for k, t in enumerate(texts)}
    assert any(x[3] for x in want.values()) and any(len(x[2]) > 1 for x in want.values())
    docs = spark.createDataFrame(list(enumerate(texts)), "no long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for pass_words in (decontam.MAX_PASS_WORDS, 3000):
        got = decontam.contamination(docs, bench, pass_words=pass_words)
        assert got.columns == ["no", "text", "n_words", "n_hit", "items", "contaminated"]
        assert {r.no: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()} == want
    assert len(list(decontam.window_chunks(bench, "item_id", "text", 3000))) > 1
    pieces = decontam.item_pieces(bench, "item_id", "text", 50).where("i = 'i6'").collect()
    assert len(pieces) == 8 and {tuple(split(r.t)[k : k + 13]) for r in pieces for k in range(len(split(r.t)) - 12)} == {tuple(split(items[6][1])[k : k + 13]) for k in range(388)}
