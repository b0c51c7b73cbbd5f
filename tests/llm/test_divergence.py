"""The divergence audit against a dense brute-force version, with one chunk of terms and with many."""

import itertools
import re
import string
import sys
import tempfile
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import divergence, queries

LETTERS = string.ascii_lowercase
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs=3, top=200):
    docs = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))) for t, g, s in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for g, s, w in docs:
        df[g].update(set(w))
        counts[g, s].update(w)
    out = []
    for g in {g for g, _, _ in docs}:
        kept = [t for t, n in df[g].items() if n >= min_docs]
        sources = [s for (h, s) in counts if h == g]
        whole = sum((counts[g, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[g, s]) for s in sources}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            lists = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[s][t], q[t]), t) for t in kept if counts[g, s][t] and p[s][t] > q[t]],
            }
            for part, found in lists.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(g, s, part, item, v, k) for k, (v, item) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out)


ODD = [
    (None, None, None), ("", "en", "a"), ("Only here", "lonely", "x"), ("é É e\x00É ß", "en", "b"), ("é É e", "en", None), ("é ÉE e", "en", "a"),
    *[("The the tHe cat cat's 日本 日本語", "en", s) for s in "abc"], ("x" * 50_000 + " the", "en", "c"), ("w " * 30_000, "en", "c"),
    *[("tie one tie two", "fr", s) for s in ("é", "z", "a")], *[("same same", "fr", "a")] * 4, ("unknown", "fr", "none of them"), ("1234 !!", "fr", "blank"),
]


@pytest.mark.parametrize("chunk_bytes", [divergence.CHUNK_BYTES, 60])
def test_odd_rows(spark, chunk_bytes):
    df = spark.createDataFrame([(*r, 1, 2) for r in ODD], "text string, lang string, source string, tid int, _part int")
    got = divergence.audit(df, chunk_bytes=chunk_bytes)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(ODD)


def test_given_documents(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_source_divergence(spark, sf_dir).collect())) == brute(rows)


def test_several_chunks_of_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = divergence.vocabulary(df, chunk_bytes=20_000)
    assert terms.select("chunk").distinct().count() > 2
    whole = divergence.postings(df, divergence.vocabulary(df)).groupBy("lang", "source").sum("n").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, divergence.postings(df, terms).groupBy("lang", "source").sum("n").collect()))


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = [(f"{a} {b} same", "en", f"s{k % 3}") for k, (a, b) in enumerate((x, y) for x in "abcde" for y in "fghij")]
    batches = lambda: iter(spark.createDataFrame(rows, "text string, lang string, source string").toArrow().to_batches())
    monkeypatch.setattr(divergence, "HELD_BYTES", 10)
    monkeypatch.setattr(divergence, "HELD", 1)
    found = Counter()
    for b in divergence._doc_counts(batches()):
        for t, n in zip(b["term"].to_pylist(), b["n"].to_pylist()):
            found[t] += n
    assert found["same"] == 25 and found["a"] == 5


def test_empty_and_no_vocabulary(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    rows = [("a b", "en", "x"), ("c", "en", "y")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema)).collect())) == brute(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_workers_keep_nothing_of_another_table(spark):
    """The same workers audit one table after another."""
    for words in ("alpha beta", "gamma alpha delta", "beta beta"):
        rows = [(words, "en", s) for s in ("x", "x", "x", "y")] + [(words.split()[0], "en", "z")]
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        assert sorted(map(tuple, divergence.audit(df).collect())) == brute(rows)


def test_texts_come_in_small_batches(spark, tmp_path, monkeypatch):
    """Both passes get batches of a bounded size, however long the texts; the session's setting is as before afterwards."""
    key, folder = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path)
    counts, recounter = divergence._doc_counts, divergence._recounter

    def noted(batches):
        for b in batches:
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                f.write(str(b["text"].nbytes))
            yield b

    monkeypatch.setattr(divergence, "_doc_counts", lambda batches: counts(noted(batches)))
    monkeypatch.setattr(divergence, "_recounter", lambda *a: lambda batches: recounter(*a)(noted(batches)))
    docs = spark.range(400).select(F.expr("repeat('some words and more ', 2500)").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source")).coalesce(1)
    before = spark.conf.get(key, None)
    assert divergence.audit(docs).count() == 0
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) >= 2 * 400 * 50_000
    assert max(sizes) < 2 * divergence.BATCH_BYTES
    assert spark.conf.get(key, None) == before


def test_a_task_hands_counts_on_within_a_batch(monkeypatch):
    """A batch with more terms than a task may hold is not counted whole; automata of an earlier call are let go of."""
    monkeypatch.setattr(divergence, "HELD", 500)
    monkeypatch.setitem(divergence._built, (("earlier", 0), "en"), (None, set()))
    batch = pa.RecordBatch.from_pylist([{"lang": f"l{k % 2}", "text": " ".join([*(a + b for a, b in itertools.product(LETTERS[k], LETTERS)), "same"])} for k in range(26)])
    held, found = [], Counter()
    for b in divergence._doc_counts(iter([batch])):
        assert not divergence._built
        held.append(b.num_rows)
        for lang, t, n in zip(*(b[c].to_pylist() for c in ("lang", "term", "n"))):
            found[lang, t] += n
    assert len(found) == 26 * 26 + 2 and found["l0", "same"] == found["l1", "same"] == 13
    assert max(held) <= 500 // 2 + 27


def test_sums_of_hits():
    keys = n = np.zeros(0, np.int64)
    want = Counter()
    for k in range(20):
        hits = [np.random.default_rng(k).integers(0, 60, m) | m << 32 for m in (0, 3, 50)]
        want.update(np.concatenate(hits).tolist())
        keys, n = divergence._added(keys, n, hits)
        assert not hits and dict(zip(keys.tolist(), n.tolist())) == want and (np.diff(keys) > 0).all()
    assert (divergence._added(keys, n, [])[0] == keys).all()


@pytest.mark.parametrize("more", [False, True])
def test_memory_of_a_task_that_counts_hits(monkeypatch, more):
    """What a worker keeps of a chunk, in bytes a term; counts and words the chunk lacks."""
    terms = ["".join(x) for x in itertools.product(LETTERS, repeat=4)][::9]
    table = pa.table([["en"] * len(terms), terms, range(1 << 40, (1 << 40) + len(terms))], ["lang", "term", "tid"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    texts = [" ".join([*terms[k :: 50], f"rest{LETTERS[k % 26]}"]) for k in range(50)] * 4
    batch = pa.record_batch([["en"] * 200, [f"s{k % 5}" for k in range(200)], texts], ["lang", "source", "text"])
    recount = divergence._recounter(("memory", 0), SimpleNamespace(value=sink.getvalue().to_pybytes()), more)
    divergence._built.clear()
    tracemalloc.start()
    n, rest = Counter(), []
    for b in recount(iter([batch])):
        for source, tid, k, text in zip(*(b[c].to_pylist() for c in ("source", "tid", "n", "text"))):
            rest += text.split() if text else []
            n[tid] += k or 0
    kept = tracemalloc.get_traced_memory()[0]
    del n[None]
    sizes = sum(map(sys.getsizeof, n.keys())) + sum(map(sys.getsizeof, rest)) + sys.getsizeof(n) + sys.getsizeof(rest)
    tracemalloc.stop()
    divergence._built.clear()
    assert set(n) == set(range(1 << 40, (1 << 40) + len(terms))) and set(n.values()) == {4}
    assert len(rest) == (200 if more else 0)
    assert (kept - sizes) / len(terms) < 150
