"""Rollups against plain counting: inserts, revisions, deletes, commits that repeat or fail, snapshots."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, queries, rollup

ROWS = "source string, lang string, text string, extra int, d_docs string"


def want(*signed):
    out = Counter()
    for sign, version, rows in signed:
        for source, lang, n, docs in rows:
            out[source, lang, version, "docs"] += sign * docs
            out[source, lang, version, "tokens"] += sign * n
    return {k: v for k, v in out.items() if v}


def got(table):
    out = {}
    for r in table.totals().collect():
        out |= {(r.source, r.lang, r.tokenizer, "docs"): r.n_docs, (r.source, r.lang, r.tokenizer, "tokens"): r.n_tokens}
    return {k: v for k, v in out.items() if v}


def counted(rows):
    return [(s, g, len((t or "").split()), 1) for s, g, t, *_ in rows]


def test_signed_batches(spark, tmp_path):
    first = [("web", "en", "a b c", 1, "x"), ("web", "en", "a b c", 1, "x"), ("web", None, "d  e\t", 2, "x"), (None, "fr", None, 3, "x"), ("web", "en", "word " * 50_000, 4, "x")]
    second = [("book", "en", "one two", 5, "x"), ("web", "en", "", 6, "x")]
    df = lambda rows: spark.createDataFrame(rows, ROWS)
    n = rollup.word_count(F.col("text"))
    table = rollup.TokenRollup(spark, str(tmp_path / "t"))
    assert got(table) == {} and table.batches() == {}
    table.commit("b1", rollup.inserts(df(first), "w", n))
    table.commit("b2", rollup.inserts(df(second), "w", n))
    table.commit("b3", rollup.inserts(df([]), "w", n))
    a, b = counted(first), counted(second)
    assert got(table) == want((1, "w", a), (1, "w", b))
    table.commit("b1", rollup.inserts(df(first), "w", n))  # again
    assert got(table) == want((1, "w", a), (1, "w", b)) and table.batches() == {"b1": 2, "b2": 1, "b3": 1}
    table.compact()
    assert got(table) == want((1, "w", a), (1, "w", b))
    table.commit("b4", rollup.deletes(df(first[:1]), "w", n))
    revised = [(s, g, k + 2, 1) for s, g, k, _ in b]
    table.commit("b5", rollup.revisions(df(second), "w", n, n + 2))
    assert got(table) == want((1, "w", a), (-1, "w", a[:1]), (1, "w", revised))
    table.commit("b2", rollup.inserts(df(second[:1]), "w", n))  # replaces what the snapshot covers
    now = want((1, "w", a), (-1, "w", a[:1]), (1, "w", b[:1]), (1, "w", [(s, g, 2, 0) for s, g, *_ in b]))
    assert got(table) == now
    table.compact()
    table.compact()
    assert got(table) == now
    with pytest.raises(ValueError):
        table.commit("../b", rollup.inserts(df(second), "w", n))


def test_failed_commit_leaves_the_earlier(spark, tmp_path):
    table = rollup.TokenRollup(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n int")
    table.commit("b1", rollup.inserts(rows, "w", F.col("n")))
    before = got(table)

    def die(batches):
        yield from batches
        raise RuntimeError("lost")

    class Late(rollup.TokenRollup):  # fails while the folder is being written
        def _write(self, df, folder):
            super()._write(df.mapInArrow(die, df.schema), folder)

    with pytest.raises(Exception, match="lost"):
        Late(spark, table.path).commit("b1", rollup.inserts(rows, "w", F.col("n") + 1))
    assert got(table) == before
    table.commit("b1", rollup.inserts(rows, "w", F.col("n") + 2))
    assert got(table) == {("a", "en", "w", "docs"): 1, ("a", "en", "w", "tokens"): 5}


def test_counts_of_a_real_tokenizer(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    coded = docs.withColumn("n", bpe.digests(spark, F.col("text"), *queries.tokenizer())["n_tokens"])
    table = rollup.TokenRollup(spark, str(tmp_path / "t"))
    table.commit("b1", rollup.inserts(coded, "byte_bpe_50k", F.col("n")))
    assert got(table) == want((1, "byte_bpe_50k", [(r.source, r.lang, r.n, 1) for r in coded.collect()]))


def test_commits_do_not_need_success_marks(spark, tmp_path):
    """Some object stores are set up without Spark's success marks; a commit has a record of its own."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        table = rollup.TokenRollup(spark, str(tmp_path / "t"))
        df = spark.createDataFrame([("s", "en", 5)], "source string, lang string, n long")
        table.commit("b1", rollup.inserts(df, "v", F.col("n")))
        table.compact()
        table.commit("b2", rollup.inserts(df, "v", F.col("n")))
        assert [tuple(r) for r in table.totals().collect()] == [("s", "en", "v", 2, 10)]
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    # data without a record, as of a commit that broke off, does not count
    (tmp_path / "t" / "batches" / "b2" / "v1" / "_committed").unlink()
    assert [tuple(r) for r in table.totals().collect()] == [("s", "en", "v", 1, 5)]
