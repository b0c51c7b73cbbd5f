"""From raw documents to token counts: five stages, each one operator, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's docs. All but the last
return the columns of documents. run() applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, langid, secrets, simhash
from loomgraph.llm.common import crc_mod, documents, materialize
from loomgraph.llm.queries import tokenizer


def _aside(docs: DataFrame) -> DataFrame:
    """(_row, text): columns whose names an operator uses for itself wait in ``_row``."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; the others keep their row as it is."""
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    return langid.identify(docs, model).where(~F.col("lang_rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the least id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows cover to a twentieth or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(_aside(docs), benchmark).where(~F.col("contaminated")).select("_row.*", "text").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(_aside(docs)).select("_row.*", "text").select(*docs.columns)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, their number, and the digest of what they decode to."""
    coded = docs.withColumn("_b", bpe.digests(spark, F.col("text"), *tokenizer()))
    return coded.select("doc_id", "lang", "source", "_b.*")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode_tokens),
]

#: Trained models, hashing and merges are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
