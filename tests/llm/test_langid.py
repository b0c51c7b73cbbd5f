"""Rejection: text in no language goes, text in a learned one stays, and the share that may be lost is followed."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langid
from loomgraph.llm.common import crc_mod


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_rejection(spark, docs):
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held))
    rng = random.Random(3)
    odd = ["zxcv qwrt plkj mnbv hgfd", "int main(int argc, char **argv) { for (int i = 0; i < 10; i++) printf(i); return 0; }", "0x1f2e3d4c a1b2c3d4"]
    odd += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(30)) for _ in range(40)]
    got = langid.identify(spark.createDataFrame([(t,) for t in odd], "text string"), model).collect()
    assert sum(r.lang_rejected for r in got) >= 0.95 * len(odd)
    seen = langid.identify(docs.where(held), model).collect()
    assert sum(r.lang_rejected for r in seen) <= 0.01 * len(seen)
    assert sum(r.lang_pred == r.lang for r in seen if r.lang) >= 0.97 * len(seen)
    strict = langid.train(docs.where(~held), false_reject=0.1)
    lost = sum(r.lang_rejected for r in langid.identify(docs.where(held), strict).collect())
    assert strict.threshold > model.threshold and 0.03 * len(seen) < lost < 0.25 * len(seen)


def test_names_and_labels(spark, docs):
    """Columns of the caller come back whatever their names; every label of the sample is learned."""
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20, f"l{k:03}") for k in range(300)]
    many = langid.train(spark.createDataFrame(rows * 2, "text string, lang string"))
    assert len(many.labels) == 300
    model = langid.train(docs)
    df = docs.limit(20).withColumns({k: F.lit("own") for k in ("row", "t", "out", "_lang_model_out", "lang_score", "best")})
    got = langid.identify(df, model)
    assert got.columns == [c for c in df.columns if c != "lang_score"] + ["lang_pred", "lang_score", "lang_rejected"]
    assert {(r.row, r.t, r.out, r.best) for r in got.collect()} == {("own",) * 4}
    none = langid.identify(df, langid.train(docs.limit(0)))
    assert {(r.lang_pred, r.lang_score, r.lang_rejected) for r in none.collect()} == {("und", 0.0, True)}


def test_a_rare_language_is_learned(spark, docs):
    """Ten documents of a language among ten times the others: dealt by label, all of them reach the fit."""
    words = "talossa on kissa ja koira jotka juoksevat pihalla kun aurinko paistaa ja lapset leikkivät järven rannalla vanha mies lukee kirjaa metsässä kävelee hirvi ja linnut laulavat".split()
    rng = random.Random(1)
    finnish = lambda: " ".join(rng.choice(words) for _ in range(60))
    rare = spark.createDataFrame([(-k, finnish(), "fi") for k in range(1, 11)], "doc_id long, text string, lang string")
    many = docs
    for _ in range(3):
        many = many.unionByName(docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"))))
    model = langid.train(many.unionByName(rare))
    got = langid.identify(spark.createDataFrame([(finnish(),) for _ in range(10)], "text string"), model).collect()
    assert sum(r.lang_pred == "fi" for r in got) >= 9
    seen = langid.identify(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in seen if r.lang) >= 0.97 * len(seen)


def test_shares():
    assert langid._shares({"a": 3, "b": 1000, "c": 1000}, 103) == {"a": 3, "b": 50, "c": 50}
    assert langid._shares({"a": 5, "b": 7}, 100) == {"a": 5, "b": 7} and langid._shares({}, 10) == {}
