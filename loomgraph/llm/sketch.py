"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark expressions only.

A sketch is the sorted array of the k least distinct hashes of a text's five-word
shingles (a shorter text: of its whole word sequence; no word: an empty sketch).
Sketches of parts merge into the sketch of the whole; two of them estimate
resemblance, containment and the number of distinct shingles.

Defined results: null text is empty text; two empty sketches resemble each other
fully; equal texts have equal sketches, whatever their length (texts are read whole); hashes
that tie count once; an empty table has no rows. Ids may be of any type that can be ordered.
``with_edits`` returns its own columns only, so other columns of the table, whatever their
names, neither help nor disturb.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_partitions

K = 128
WORDS = 5


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hash of every ``words``-word shingle (blanks split words); each word is hashed once."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    hashed = F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        some = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        full = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n < words, some).otherwise(full)

    # the hashes are computed once and used many times within the expression
    return F.element_at(F.transform(F.array(hashed), of), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches (or arrays of hashes) stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k least hashes that both have."""

    def of(p: Column) -> Column:
        top = merge(p["a"], p["b"], k)
        both = F.size(F.array_intersect(F.array_intersect(top, p["a"]), p["b"]))
        return F.when(F.size(top) == 0, 1.0).otherwise(both / F.size(top))

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), 1)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63 + 1) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def next_in_order(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_key) for every distinct non-null key: the next lower key; after the least, the greatest.

    Only keys are sorted. Each range partition links its own keys; its least key gets the greatest of the
    nearest lower partition, found over one row per partition.
    """
    keys = ordered_partitions(df.select(F.col(key).alias("key")).where("key is not null").distinct(), "key")
    inside = Window.partitionBy("_part").orderBy("key")
    own = keys.select("_part", "key", F.lag("key").over(inside).alias("prev"))
    tops = keys.groupBy("_part").agg(F.max("key").alias("top"))
    over = Window.orderBy("_part")
    most = F.max("top").over(Window.partitionBy())
    edge = tops.select("_part", F.coalesce(F.lag("top").over(over), most).alias("below"))
    # one row per partition: as small as the number of shuffle partitions
    return own.join(F.broadcast(edge), "_part").select(F.col("key").alias(key), F.coalesce("prev", "below").alias("next_key"))


def with_edits(df: DataFrame, *, text: str = "text", key: str = "doc_id", k: int = K, words: int = WORDS) -> DataFrame:
    """(key, text, n_chars, sk, edited, next_sk): each text, its sketch, its edited text and the next text's sketch.

    The edited text has its last third replaced by the beginning of the next text. Texts are shuffled once, by key,
    and read twice; the beginnings that travel are a third of that. Where a key repeats, "the next text" is the least
    (beginning, sketch) of that key; a row without a key has an empty next text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    table = df.select(F.col(key).alias("at"), t.alias("text"))
    docs = table.where("at is not null").repartition("at")  # nothing but keys and texts is in the exchange
    need = next_in_order(df, key).withColumnRenamed(key, "key")
    wants = need.join(df.select(F.col(key).alias("key"), F.length(t).alias("n")), "key").groupBy("key", "next_key").agg(F.max("n").alias("n"))
    wants = wants.select(F.col("key").alias("owner"), F.col("next_key").alias("at"), F.expr("cast(n div 3 as int)").alias("need"))
    given = docs.join(wants, "at").select("owner", F.substring("text", F.lit(1), F.col("need")).alias("head"), sketch(F.col("text"), k, words).alias("next_sk"))
    given = given.groupBy("owner").agg(F.min(F.struct("head", "next_sk")).alias("g"))
    kind = docs.join(given, docs["at"] == given["owner"], "left").select("at", "text", "g")
    # rows without a key meet nobody and stay where they are
    out = kind.unionByName(table.where("at is null").select("at", "text", F.lit(None).cast(kind.schema["g"].dataType).alias("g")))
    out = out.withColumn("n_chars", F.length("text").cast("long")).withColumn("sk", sketch(F.col("text"), k, words))
    third = F.expr("cast(n_chars div 3 as int)")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int"))
    head = F.substring(F.coalesce("g.head", F.lit("")), F.lit(1), third)
    none = F.array().cast("array<bigint>")
    return out.select(F.col("at").alias(key), "text", "n_chars", "sk", F.concat(kept, head).alias("edited"), F.coalesce("g.next_sk", none).alias("next_sk"))
