"""Stored indexes for search: impact-ordered posting blocks with their greatest weight, and n-grams of names.

The postings of a term lie in blocks of BLOCK entries by falling weight, one list of blocks for each bucket of documents, so
that a delta replaces the blocks of its own buckets and a frequent term is many rows. A search for the best k of each query
and type reads them in two steps. First come the first blocks of each term; the k-th best sum of what they hold is a score that the
answer reaches in any case. With m terms, a document beyond all blocks whose greatest weight times idf is at least an m-th of it
cannot be among the best, so only such blocks are read next. Documents met then get their whole score from the forward postings.

Prefixes meet the dictionary on their own length and text, so a term meets only queries that it begins with. ``containing``
finds the names that contain a text by the text's rarest n-gram and tests those alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.ingest import union_all
from ..sources.store import Graph
from .rank import checkpointed
from .traverse import SENT

#: Postings of a block, length of the grams of names, and the error that sums of weights may have.
BLOCK, GRAM, SLACK = 128, 3, 1e-5


def blocks(postings: DataFrame, bucket: Column | None = None, size: int = BLOCK) -> DataFrame:
    """(bucket, type, term, block, n, most, entries: array of weight and key) of postings (type, key, term, weight)."""
    own = bucket if bucket is not None else F.pmod(F.xxhash64(ids.class_of(F.col("key"))), F.lit(16)).cast("int")
    order = Window.partitionBy("bucket", "type", "term").orderBy(F.desc("weight"), "key")
    cut = postings.withColumn("bucket", own).withColumn("block", F.call_function("div", F.row_number().over(order) - 1, F.lit(size)).cast("int"))
    made = cut.groupBy("bucket", "type", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"), F.collect_list(F.struct("weight", "key")).alias("entries"))
    return made.select("bucket", "type", "term", "block", "n", "most", "entries")


def sizes(postings: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(bucket, type, docs): documents with a term."""
    own = bucket if bucket is not None else F.lit(0)
    return postings.select(own.alias("bucket"), "type", "key").distinct().groupBy("bucket", "type").agg(F.count(F.lit(1)).alias("docs"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, q, prefix, edits) of queries (query_id, query): ``term*`` is a prefix, ``%term%k`` allows k edits."""
    raw = F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}*%]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))))
    q = queries.select("query_id", raw.alias("raw"))
    return q.select(
        "query_id", F.regexp_extract("raw", r"([\p{L}\p{N}]+)", 1).alias("q"), F.col("raw").endswith("*").alias("prefix"),
        F.expr("cast(nullif(regexp_extract(raw, '%[^%]+%([0-9])', 1), '') as int)").alias("edits"),
    )


def with_prefix(terms: DataFrame, q: DataFrame) -> DataFrame:
    """Terms (term, ...) joined to the queries (query_id, q) that they begin with: equal text of the lengths that are asked for."""
    lengths = F.broadcast(q.select(F.length("q").alias("l")).distinct().agg(F.collect_set("l").alias("ls")))  # as many as a word has letters
    cut = terms.crossJoin(lengths).withColumn("l", F.explode("ls")).where(F.length("term") >= F.col("l")).withColumn("head", F.expr("substring(term, 1, l)"))
    return cut.drop("ls", "l").join(q.select("query_id", F.col("q").alias("head")), "head").drop("head")


def term_hits(dictionary: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, type, term, idf) of a dictionary (type, term, idf): what the words of each query match."""
    from .search import within_edits

    q = asked_terms(queries)
    plain = dictionary.join(q.where("not prefix and edits is null").select("query_id", F.col("q").alias("term")), "term")
    ahead = with_prefix(dictionary, q.where("prefix"))
    fuzzy = within_edits(dictionary, q.where("not prefix and edits is not null"))
    return union_all([x.select("query_id", "type", "term", "idf") for x in (plain, ahead, fuzzy)]).distinct()


def dictionary(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(type, term, idf) from the sizes of blocks and the numbers of documents (bucket, type, docs)."""
    df = index.groupBy("type", "term").agg(F.sum("n").alias("df"))
    n = docs.groupBy("type").agg(F.sum("docs").alias("n"))
    return df.join(F.broadcast(n), "type").select("type", "term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


def _sums(read: DataFrame) -> DataFrame:
    each = read.select("query_id", "type", "term", "idf", F.explode("entries").alias("e"))
    return each.groupBy("query_id", "type", F.col("e.key").alias("key")).agg(F.sum(F.col("e.weight") * F.col("idf")).alias("s"), F.count(F.lit(1)).alias("seen"))


def search(index: DataFrame, docs: DataFrame, forward: DataFrame, queries: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The result of ``search.fts_search`` for blocks, their document numbers and the forward postings; and (query_id, type, blocks, read), what it took."""
    hits = checkpointed(term_hits(dictionary(index, docs), queries))
    hits = F.broadcast(hits) if hits.count() <= SENT else hits
    met = index.join(hits, ["type", "term"])
    first = met.where("block = 0")
    best = Window.partitionBy("query_id", "type").orderBy(F.desc("s"))
    kth = _sums(first).withColumn("i", F.row_number().over(best)).where(F.col("i") <= limit).groupBy("query_id", "type").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("c"))
    terms = hits.groupBy("query_id", "type").agg(F.count(F.lit(1)).alias("m"))
    reach = terms.join(kth, ["query_id", "type"], "left").select("query_id", "type", "m", F.when(F.col("c") >= limit, F.col("s") - SLACK).otherwise(0.0).alias("floor"))
    reach = checkpointed(reach)
    few = F.broadcast(reach) if reach.count() <= SENT else reach
    read = met.join(few, ["query_id", "type"]).where((F.col("block") == 0) | (F.col("most") * F.col("idf") >= F.col("floor") / F.col("m")))
    # terms that were not met add less than an m-th of the floor each
    could = F.col("s") + (F.col("m") - F.col("seen")) * F.col("floor") / F.col("m") >= F.col("floor")
    chosen = checkpointed(_sums(read).join(few, ["query_id", "type"]).where(could).select("query_id", "type", "key"))
    chosen = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    whole = forward.join(chosen, ["type", "key"]).join(hits, ["query_id", "type", "term"]).groupBy("query_id", "type", "key").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))
    order = Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "key")
    out = whole.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < limit)
    asked = met.groupBy("query_id", "type").agg(F.count(F.lit(1)).alias("blocks"))
    took = asked.join(read.groupBy("query_id", "type").agg(F.count(F.lit(1)).alias("read")), ["query_id", "type"])
    return out, took


# --- names that contain a text ------------------------------------------------
def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct substrings of length n."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame, n: int = GRAM) -> DataFrame:
    """Rows of ``texts`` (field, text, ...) joined to the needles (field, needle, ...) of their field that the text contains; none is empty.

    A needle's key is its rarest n-gram among the texts; one that is shorter is its own key. Texts are cut into the grams of
    the lengths asked for, and only those that are somebody's key travel, so a text meets the needles that share such a gram.
    """
    asked = needles.select("field", "needle").distinct().where("needle <> ''")
    own = checkpointed(asked.withColumn("g", F.explode(F.when(F.length("needle") < n, F.array("needle")).otherwise(grams(F.col("needle"), n)))))
    wanted = own.select("field", "g").distinct()
    lengths = [r[0] for r in own.select(F.length("g")).distinct().collect()]  # n at most
    if not lengths:
        return texts.join(needles, "field").where("false")
    cut = F.array_distinct(F.flatten(F.array(*[grams(F.col("text"), k) for k in sorted(lengths)])))
    small = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    count = texts.select("field", F.explode(cut).alias("g")).join(small, ["field", "g"]).groupBy("field", "g").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("field", "needle").orderBy("df", "g")
    # a needle with a gram that no text has is in none
    full = F.count(F.lit(1)).over(Window.partitionBy("field", "needle")) == F.count("df").over(Window.partitionBy("field", "needle"))
    key = own.join(count, ["field", "g"], "left").withColumn("ok", full).where("ok").withColumn("i", F.row_number().over(rarest)).where("i = 1").select("field", "needle", "g")
    key = checkpointed(key)
    pairs = needles.join(key, ["field", "needle"])
    keyed = texts.withColumn("g", F.explode(cut))
    few = key.count() <= SENT
    return keyed.join(F.broadcast(pairs) if few else pairs, ["field", "g"]).where(F.col("text").contains(F.col("needle"))).drop("g")


def graph_names(graph: Graph) -> DataFrame:
    """(field, text, key, type) of all names that a query may be a part of; fields: fqn, class, method (of the project), path."""
    c, m, e = graph["class"], graph["method"], graph["endpoint"]
    row = lambda df, field, text, key, type_: df.select(F.lit(field).alias("field"), F.col(text).alias("text"), F.col(key).alias("key"), F.lit(type_).alias("type"))
    rows = [row(c, "fqn", "fqn", "fqn", "class"), row(m, "fqn", "fqn", "fqn", "method"), row(c, "class", "name", "fqn", "class"), row(m.where("external is null"), "method", "name", "fqn", "method"), row(e, "path", "path", "id", "endpoint")]
    return union_all(rows).where("text is not null")


def graph_direct(graph: Graph, routed: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, key, type, score, rank): what a routed query names outright, found by grams of names."""
    from .search import strip

    h = routed.select("query_id", strip(F.col("query")).alias("q"), "hint.*").where("kind is not null")
    field = F.when(F.col("kind") == "endpoint", "path").when(F.col("kind").isin("method", "fqn"), "fqn").when(F.col("kind") == "class", "class").otherwise("method")
    asked = checkpointed(h.select("query_id", "kind", "verb", field.alias("field"), F.when(F.col("kind") == "endpoint", F.col("path")).otherwise(F.col("q")).alias("needle")))
    found = containing(graph_names(graph), asked).select("query_id", "kind", "verb", "needle", "text", "key", "type")
    # a verb alone names all its endpoints, of which the first are enough
    verbs = asked.where("needle = ''").select("query_id", "kind", "verb", "needle")
    ends = graph["endpoint"].select(F.substring_index("id", ":", 1).alias("verb"), F.col("path").alias("text"), F.col("id").alias("key"))
    first = ends.withColumn("i", F.row_number().over(Window.partitionBy("verb").orderBy("key"))).where(F.col("i") <= limit)
    alone = verbs.join(first, "verb").select("query_id", "kind", "verb", "needle", "text", "key", F.lit("endpoint").alias("type"))
    rows = found.unionByName(alone).where("kind <> 'endpoint' or verb is null or startswith(key, concat(verb, ':'))")
    score = F.when(F.col("kind") == "endpoint", 1.0).when(F.col("kind").isin("method", "fqn"), 0.9).when(F.col("text") == F.col("needle"), 1.0).otherwise(0.8)
    order = F.when(F.col("type") == "method", 0).when(F.col("type") == "class", 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order, "key")
    scored = rows.select("query_id", "key", "type", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)
