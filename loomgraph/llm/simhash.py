"""SimHash near-duplicates by multi-index hashing.

A fingerprint has the majority bits of the XXH64 (seed 42) hashes of a text's
3-word shingles. Fingerprints that differ in at most three bits differ in at most
one bit of their upper or of their lower half. So each half is a table key: a
distinct fingerprint enters both tables by its half, and looks up its own half and
each half that has one more bit set (the partner that has one bit less looks it
up). Hits are verified on the complete distance. Components are found by
alternating large and small stars on distinct linked fingerprints; documents are
joined to them once, at the end.

Defined results: null or empty text, and text of blanks only, has fingerprint zero
and is linked like any other; under three words the whole word sequence is the
shingle; texts of any length are read whole. Repeated rows get equal results, rows that
share an id and no text are told apart. A null id never becomes a component's name; a
component without any id has none. Ties do not arise: components are named by their
least id. An empty table has no rows. Of other columns, ``keep_one`` returns all, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

SEED = 42
HALF = 32


def _bits(hashes: np.ndarray) -> int:
    """Majority bits of unsigned 64-bit hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    major = 2 * ones > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprint_of(data: bytes) -> int:
    """Unsigned fingerprint of UTF-8 text."""
    words = data.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        return h(b" ".join(words), SEED)
    grams = map(b" ".join, zip(words, words[1:], words[2:]))
    return _bits(np.fromiter((h(g, SEED) for g in grams), np.uint64, len(words) - 2))


def fingerprint(text: Column) -> Column:
    """Signed 64-bit view of the fingerprint."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint_of(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return of(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column ``fp``, no repeats) within ``distance`` <= 3 bits, each once."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius one find distances up to 3")
    low_mask = (1 << HALF) - 1
    halves = {0: F.col("fp").bitwiseAND(F.lit(low_mask)), 1: F.shiftrightunsigned("fp", HALF)}
    key = lambda side, half: half.bitwiseOR(F.lit(side << HALF))
    table = fps.select("fp", F.explode(F.array(*[key(s, h) for s, h in halves.items()])).alias("key"))
    flips = F.array(*[F.lit(1 << i) for i in range(HALF)])
    # own half, and each half with one more bit
    ball = lambda s, h: F.concat(F.array(key(s, h)), F.transform(F.filter(flips, lambda m: h.bitwiseAND(m) == 0), lambda m: key(s, h.bitwiseOR(m))))
    probe = fps.select(F.col("fp").alias("other"), F.explode(F.concat(*[ball(s, h) for s, h in halves.items()])).alias("key"))
    own_half = F.when(F.shiftrightunsigned("key", HALF) == 0, F.col("other").bitwiseAND(F.lit(low_mask))).otherwise(F.shiftrightunsigned("other", HALF))
    same = F.col("key").bitwiseAND(F.lit(low_mask)) == own_half  # an unflipped probe meets its like from both ends
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    hit = (F.col("p.key") == F.col("t.key")) & near & ((F.col("fp") < F.col("other")) | (~F.col("same") & (F.col("fp") != F.col("other"))))
    pairs = probe.withColumn("same", same).alias("p").join(table.alias("t"), hit)
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable; by alternating large and small stars.

    Each round is two shuffles of the edges and a written table; the number of rounds grows with the logarithm
    of the longest path. ``rounds`` only guards against a fault and raises.
    """
    cur, mark = materialize(edges.select("a", "b").where("a <> b"), "edges"), None
    for _ in range(rounds):
        both = cur.union(cur.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: neighbours above a node go to the least node around it
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node's lower neighbours and itself go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(low, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("b")).where("m <> b")
        cur = materialize(down.select(F.col("m").alias("a"), "b").distinct(), "edges")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def classes(df: DataFrame, *, text: str = "text", key: str = "doc_id", distance: int = 3) -> DataFrame:
    """(key, fp, component_id): one row per row of ``df``; component_id is the least key reachable over links."""
    docs = materialize(df.select(F.col(key).alias("key"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    label = component_of(docs.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("times")), distance)
    label = materialize(label.withColumnRenamed("name", "component_id"), "labels")
    return spread_join(docs, label, "fp", "times").select(F.col("key").alias(key), "fp", "component_id")


def component_of(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, name, times) of distinct fingerprints with columns (fp, least, times): the least ``least`` reachable over links."""
    edges = materialize(links(fps.select("fp"), distance), "links")
    roots = components(edges)
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = both.join(fps, both["node"] == fps["fp"]).select("node", "root", "least")
    names = named.groupBy("root").agg(F.min("least").alias("name"))
    linked = named.join(names, "root").select(F.col("node").alias("fp"), "name")
    return fps.join(linked, "fp", "left").select("fp", F.coalesce("name", "least").alias("name"), "times")


def keep_one(df: DataFrame, *, text: str = "text", key: str = "doc_id", distance: int = 3) -> DataFrame:
    """One row of each component: the one with the least key, of those the one whose row has the least hash. Rows without a key come last."""
    hashes = [F.xxhash64(*df.columns).alias("h1"), F.xxhash64(F.lit("second"), *df.columns).alias("h2")]
    ids = df.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), *hashes).alias("id"), fingerprint(F.col(text)).alias("fp"))
    least = materialize(ids, "fingerprints").groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"))
    first = component_of(least, distance).select("name.h1", "name.h2").distinct()
    # rows that are equal in all have one name, and one of them stays
    named = df.select(F.struct(*df.columns).alias("row"), *hashes)
    return named.join(first, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")
