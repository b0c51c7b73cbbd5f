"""The model of op9 against a direct evaluation that knows every word and every pair."""

import math
import tempfile
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import katz, queries
from loomgraph.llm.common import batch_bytes, crc_mod

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


class Exact:
    def __init__(self, texts):
        self.uni, self.next = Counter(), defaultdict(Counter)
        for t in texts:
            w = [*words(t), None]
            self.uni.update(w)
            for a, b in zip([None, *w], w):
                self.next[a][b] += 1
        d = lambda ns: katz.discounts(np.array([0] + [Counter(ns)[r] for r in range(1, katz.KATZ + 2)], float))
        self.total, self.d1 = sum(self.uni.values()), d(self.uni.values())
        self.d2 = d([n for s in self.next.values() for n in s.values()])
        self.unseen = 1 - sum(self.p1(w) for w in self.uni)

    def p1(self, w):
        c = self.uni[w]
        return (self.d1[c] if c <= katz.KATZ else 1) * c / self.total if c else self.unseen

    def p(self, a, b):
        s = self.next.get(a, {})
        used = {w: (self.d2[n] if n <= katz.KATZ else 1) * n for w, n in s.items()}
        under = self.uni[a] + (sum(used.values()) >= self.uni[a] * (1 - 1e-12))
        if b in used:
            return used[b] / under
        return (1 - sum(used.values()) / under) / (1 - sum(map(self.p1, s))) * self.p1(b) if s else self.p1(b)

    def score(self, t):
        w = [*words(t), None]
        return sum(math.log10(self.p(a, b)) for a, b in zip([None, *w], w))


def op9(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return queries.op9_katz_scores(spark, str(folder)).collect()


def ids(held, n):
    return [i for i in range(100 * n) if (zlib.crc32(str(i).encode()) % 7 == 2) == held][:n]


def test_every_pair_counts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    docs = docs.unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "never Seen words\tHERE"), (1003, "A a a a"), (1003, "A a a a")], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    train = [r.text for r in docs.where(crc_mod(F.col("doc_id"), 7) != 2).collect()]
    model = Exact(train)
    for a in [None, *list(model.uni)[:10]]:
        assert abs(sum(model.p(a, b) for b in model.uni) + model.p(a, "never-seen") - 1) < 1e-9
    assert any(n == 1 for s in model.next.values() for n in s.values()) and 0 < model.d2[1] < 1
    got = op9(spark, docs, tmp_path)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        w = [*words(text[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in model.uni for x in w), model.total)
        assert math.isclose(r.base_score, sum(math.log10((model.uni[x] + 1) / (model.total + len(model.uni) + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, model.score(text[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9), r


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = katz.score(docs, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}


def test_no_vocabulary(spark, tmp_path):
    """More words than the head takes, all equally rare: what follows what still counts."""
    per, texts = 22_000, 50
    train = [" ".join(f"w{i}" for i in range(k * per, (k + 1) * per)) for k in range(texts)]
    assert per * texts > katz.HEAD
    held = ids(True, 2)
    rows = [*zip(ids(False, 2 * texts), train + train), (held[0], "w5 w6 w7 w8"), (held[1], "w8 w7 w6 w5")]
    got = {r.doc_id: r.score for r in op9(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path) if r.held_out}
    assert got[held[0]] > got[held[1]] + 3


def test_how_words_travel_changes_nothing(spark, sf_dir):
    """No head, a small one and a whole one, one part and many: the same scores, and bytes that do not follow the parts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 80")
    train = crc_mod(F.col("doc_id"), 7) != 2
    of = lambda **kw: {r.doc_id: (r.n_known, r.base_score, r.score) for r in katz.score(docs, train, **kw).collect()}
    want = of()
    for kw in ({"head": 0}, {"head": 40}, {"head": 40, "part_tokens": 500}, {"part_tokens": 500}):
        got = of(**kw)
        assert got.keys() == want.keys()
        for i, x in want.items():
            assert got[i][0] == x[0] and math.isclose(got[i][1], x[1], rel_tol=1e-9) and math.isclose(got[i][2], x[2], rel_tol=1e-9), (kw, i)


def test_asks_are_summed(spark):
    """Equal (key, text) entries are one, texts travel once a block, and answers name only texts that were hit."""
    docs = spark.createDataFrame([(1, 1, True, "a b " * 20_000), *((i, 0, False, "a b") for i in range(2, 500)), (500, 0, False, "c")], "r1 long, r2 long, train boolean, text string").coalesce(1)
    head = spark.sparkContext.broadcast(katz.Head(np.zeros(0, np.uint64), [], 1, 8))
    none = np.zeros(0)
    model = spark.sparkContext.broadcast(katz.Model(none, none, none, np.ones(katz.KATZ + 1), 1, 0.0, none.astype(np.uint64), none.astype(np.int64)))
    rows = katz.asks(docs, head, model)
    got = rows.collect()
    assert sum(len(katz._unpack(r.c, np.uint32)) for r in got if r.kind == 1) == 7 + 498 * 6 + 4  # words, ends and pairs of each text, once
    assert [len(katz._unpack(r.a, np.int64)) for r in got if r.kind == 2] == [500] and len({r.block for r in got}) == 1
    a, b = (katz._mix(h) for h in next(katz.token_steps(pa.array(["a b"])))[0].reshape(2, 1))
    key = katz.tail_keys(a, b)
    values = spark.createDataFrame([(int(key.astype(np.int64)[0]), 0.5, 0.25, -1)], "key long, vt double, vh double, c long")
    table = katz.far_rows(values, values.columns, head, lambda k, *x: (k.view(np.uint64), *x))
    found = katz.answers(table.unionByName(rows).repartition(8, "part").sortWithinPartitions("part", "kind", "block"), head, model)
    assert sum(len(katz._unpack(r.a, np.uint32)) for r in found.collect() if r.e is None) == 499
    sums = {r.r1: r.s for r in found.groupBy("block").applyInArrow(katz._gather, "r1 long, r2 long, n_words long, s double, base double, known long").collect()}
    assert len(sums) == 500 and sums[1] == 10_000 and sums[2] == 0.25 and sums[500] == 0


def test_frequent_pairs_and_words_are_dealt_out():
    """A frequent first word's pairs go to many parts, a rare one's to one."""
    head = katz.Head(katz._mix(np.arange(1, 101, dtype=np.uint64)), [(10_000, 1), (10, 99)], 20_000, 64)
    pairs = lambda w: np.uint64(w) << np.uint64(20) | np.arange(100, dtype=np.uint64)
    assert len(np.unique(head.part(pairs(0)))) > 30 and len(np.unique(head.part(pairs(5)))) == 1
    assert (head.codes(katz._mix(np.arange(0, 120, dtype=np.uint64))) == [-1, *range(100), *[-1] * 19]).all()


def test_texts_come_in_small_batches(spark, tmp_path, monkeypatch):
    """Tasks get batches of a bounded size, however long the texts; the session's setting is as before afterwards."""
    key, plain, folder = "spark.sql.execution.arrow.maxBytesPerBatch", katz.tokens, str(tmp_path)

    def noted(texts):
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
            f.write(str(texts.nbytes))
        yield from plain(texts)

    monkeypatch.setattr(katz, "tokens", noted)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('some words and more ', 2500)").alias("text")).coalesce(1)
    before = spark.conf.get(key, None)
    assert katz.score(docs, F.lit(True)).count() == 400
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) >= 3 * 400 * 50_000  # words, pairs and asks, of whole texts
    assert max(sizes) < 2 * katz.BATCH_BYTES
    assert spark.conf.get(key, None) == before


def test_a_callers_batch_size_holds(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "12345")
    try:
        with batch_bytes(spark, 99):
            assert spark.conf.get(key) == "12345"
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key)


def test_memory_of_a_block(monkeypatch):
    """What a task holds while it packs a block of asks or an emission of pairs, a token."""
    rng, n = np.random.default_rng(0), 1 << 16
    texts = pa.array([" ".join(f"w{x}" for x in rng.zipf(1.2, 1000) % 200_000) for _ in range(620)])
    hashes = np.unique(katz._mix(next(katz.token_steps(pa.array([" ".join(f"w{x}" for x in range(n))])))[0]))
    values = rng.random(n)
    head = SimpleNamespace(value=katz.Head(hashes, [(7, n)], 7 * n, 50))
    model = SimpleNamespace(value=katz.Model(values, values, np.ones(6), np.ones(6), 7 * n, -7.0, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    numbers = pa.array(np.arange(len(texts)))
    batch = pa.record_batch([numbers, numbers, pa.array(np.arange(len(texts)) % 7 != 2), texts], ["r1", "r2", "train", "text"])
    pairs = SimpleNamespace(mapInArrow=lambda f, _: SimpleNamespace(groupBy=lambda _: SimpleNamespace(applyInArrow=lambda *_: f)))
    asks = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda f, _: f))
    for task, given, most in ((katz.asks(asks, head, model), batch, 100), (katz.count_pairs(pairs, head), batch.select(["text"]), 45)):
        tracemalloc.start()
        assert sum(b.num_rows for b in task([given])) > 50
        peak = tracemalloc.get_traced_memory()[1] / (1001 * len(texts))
        tracemalloc.stop()
        assert peak < most
