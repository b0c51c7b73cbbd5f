"""Search: weighted full text, exact vector search, rank fusion, boosts, reranking, and the hybrid of all.

Everything takes a *table* of queries (query_id, query), so a benchmark of many
queries is one plan. Ties are broken by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize, strip, terms
from ..functions.vector import Embedder, Reranker, hashing_embedder, overlap_reranker
from ..plans.ingest import union_all
from ..sources.store import Graph
from .catalog import locations, neighbors
from .index import asked_terms, graph_direct, term_hits
from .rank import checkpointed
from .traverse import SENT
from .vectors import nearest

RRF_K = 60
#: Queries that one array has, about.
QUERY_BLOCK = 256
#: Field weights of the text index, and the order of types in fused lists.
WEIGHTS = {"class": {"name": 10.0}, "method": {"name": 10.0, "javadoc": 3.0, "body": 1.0}, "endpoint": {"path": 5.0}}
TYPE_ORDER = {"class": 0, "method": 1, "endpoint": 2}


def postings(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(type, key, term, weight) of documents (type, key, fields...): term counts times field weights, summed."""
    each = [docs.select("type", "key", F.explode(terms(F.col(f))).alias("term"), F.lit(w).alias("w")) for f, w in fields.items()]
    return union_all(each).groupBy("type", "key", "term").agg(F.sum("w").alias("weight"))


def graph_postings(graph: Graph) -> DataFrame:
    split = lambda c: F.concat_ws(" ", c, F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])", " "))  # noqa: E731  camelCase words too
    c = graph["class"].select(F.lit("class").alias("type"), F.col("fqn").alias("key"), split(F.col("name")).alias("name"))
    m = graph["method"].select(F.lit("method").alias("type"), F.col("fqn").alias("key"), split(F.col("name")).alias("name"), "javadoc", "body")
    e = graph["endpoint"].select(F.lit("endpoint").alias("type"), F.col("id").alias("key"), "path")
    return union_all([postings(c, WEIGHTS["class"]), postings(m, WEIGHTS["method"]), postings(e, WEIGHTS["endpoint"])])


def within_edits(terms: DataFrame, q: DataFrame) -> DataFrame:
    """Terms (term, ...) joined to queries (query_id, q, edits) that are at most ``edits`` edits away; a pair may come twice.

    Of the edits + 1 pieces of a query at least one is untouched, and stands in the term at most ``edits`` places off.
    The join is on the query's length and such a piece, so the number of a term's keys depends on the edits alone.
    """
    cut = "cast(i * l div (edits + 1) as int)"
    piece = f"named_struct('k', edits, 'l', l, 'i', i, 'p', substring({{text}}, {{at}} + 1, {cut.replace('i *', '(i + 1) *')} - {cut}))"
    asked = q.withColumn("l", F.length("q")).withColumn("i", F.explode(F.expr("sequence(0, edits)"))).withColumn("key", F.expr(piece.format(text="q", at=cut)))
    n = "length(term)"
    places = f"transform(filter(transform(sequence(-edits, edits), s -> {cut} + s), x -> x >= 0 and x <= {n}), x -> {piece.format(text='term', at='x')})"
    keys = F.expr(f"array_distinct(flatten(flatten(transform(sequence(greatest({n} - edits, 1), {n} + edits), l -> transform(sequence(0, edits), i -> {places})))))")
    near = terms.crossJoin(F.broadcast(q.select("edits").distinct())).withColumn("key", F.explode(keys)).drop("edits")  # edits are one digit
    return near.join(asked.select("key", "query_id", "q", "edits"), "key").where(F.levenshtein("term", "q") <= F.col("edits"))


def fts_search(index: DataFrame, queries: DataFrame, limit: int = 50, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, type, key, score, rank): sum of weight times ln(1 + N / df) over a query's distinct terms; N and df by type.

    ``term*`` is a prefix and ``%term%k`` allows k edits. ``rank`` counts from 0 within query and type. ``documents`` (type, key):
    those with a term, if known without the index. Of the postings only those of asked terms are kept and dealt by
    document, so that sums need no shuffle of their own and each task hands on its best; a prefix or an edit asks the whole dictionary.
    """
    n = (documents if documents is not None else index.select("type", "key").distinct()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    asked = checkpointed(asked_terms(queries))
    words = asked.select(F.col("q").alias("term")).distinct()
    plain = asked.where("prefix or edits is not null").isEmpty() and words.count() <= SENT
    kept = checkpointed(index.join(F.broadcast(words), "term", "left_semi").select(*index.columns)) if plain else index
    df = kept.groupBy("type", "term").agg(F.count(F.lit(1)).alias("df"))
    hits = checkpointed(term_hits(df.join(n, "type").select("type", "term", F.log(1 + F.col("n") / F.col("df")).alias("idf")), queries))
    met = kept.join(F.broadcast(hits.select("type", "term").distinct()), ["type", "term"], "left_semi").repartition("type", "key").join(F.broadcast(hits), ["type", "term"]) if hits.count() <= SENT else kept.join(hits, ["type", "term"])
    scored = met.groupBy("query_id", "type", "key").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))  # rounded, so that equal documents tie
    w = Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def fts_ranked(hits: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, key, rank): classes, then methods, then endpoints; a key keeps its first place."""
    order = F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv])[F.col("type")]
    w = Window.partitionBy("query_id").orderBy("t", "rank", "key")
    once = Window.partitionBy("query_id", "key").orderBy("t", "rank")
    h = hits.withColumn("t", order).withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return h.select("query_id", "key", (F.row_number().over(w) - 1).alias("rank")).where(F.col("rank") < limit)


def embed(df: DataFrame, embedder: Embedder | None = None, text: str = "document", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, (embedder or hashing_embedder())(F.col(text)))


def query_blocks(queries: DataFrame, *fields: str) -> DataFrame:
    """(qs): the queries' fields in arrays of about QUERY_BLOCK structs each, dealt by a hash of the id."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.struct(*fields).alias("q"))
    return dealt.groupBy("block").agg(F.collect_list("q").alias("qs")).select("qs")


def knn(vectors: DataFrame, queries: DataFrame, k: int, max_distance: float = 0.0) -> DataFrame:
    """(query_id, id, distance, similarity, rank): exact top ``k`` by cosine distance of vectors (id, embedding) for queries (query_id, vector).

    Blocks of vectors meet blocks of queries by matrix products; each hands on a query's best k, and a window picks among them.
    """
    cell, q = F.lit(0).alias("cell"), queries.select("query_id", "vector")  # all vectors are one cell, cut into parts, that every query asks
    asked = q.select("query_id", cell, F.lit(0.0).alias("far"), F.lit(1.0).alias("reach"))
    near = nearest(vectors.select("id", "embedding", cell, F.lit(0.0).alias("residual")), asked, q, k)
    near = near if max_distance <= 0 else near.where(F.col("d") <= max_distance)
    w = Window.partitionBy("query_id").orderBy("d", "id")
    ranked = near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
    return ranked.select("query_id", "id", (F.round("d", 4) + 0.0).alias("distance"), F.round(F.greatest(F.lit(0.0), 1 - F.col("d")), 3).alias("similarity"), "rank")


def where_filter(drawers: DataFrame, wing: str = "", room: str = "", type_: str = "") -> DataFrame:
    for column, value in (("wing", wing), ("room", room), ("type", type_)):
        if value:
            drawers = drawers.where(F.col(column) == value)
    return drawers


def semantic_search(drawers: DataFrame, queries: DataFrame, k: int = 10, *, embedder: Embedder | None = None, max_distance: float = 0.0) -> DataFrame:
    """Drawers (with ``embedding``) nearest to each sanitised query."""
    e = embedder or hashing_embedder()
    q = queries.select("query_id", e(sanitize(F.col("query"))["query"]).alias("vector"))
    return knn(drawers.select("id", "embedding"), q, k, max_distance).join(drawers.drop("embedding"), "id")


def rrf_fuse(sources: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, ranks): sum of 1 / (k + rank) over ranked lists (query_id, key, rank from 0)."""
    rows = union_all([s.select("query_id", "key", F.lit(name).alias("source"), F.col("rank").cast("int").alias("rank")) for name, s in sources.items()])
    return rows.groupBy("query_id", "key").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("ranks"))


def route_queries(queries: DataFrame) -> DataFrame:
    """queries with hint: struct(type, boost, substring, verb, path, kind).

    In this order: a path, or anything that begins with a verb, asks for endpoints; anything with ``#`` for a method;
    more than three characters with a dot and no blank are part of a full name; PascalCase is a class, and camelCase or
    snake_case that begins with a small letter a method. The rest has no hint.
    """
    q = strip(F.col("query"))
    verb = F.upper(F.regexp_extract(q, r"^(\S+)", 1))
    has_verb = verb.isin("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
    path = F.when(has_verb, F.regexp_extract(q, r"(?s)^\S+\s+(.*)$", 1)).otherwise(q)
    one = ~q.contains(" ")
    word = one & q.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")
    kind = (
        F.when(has_verb | q.startswith("/"), "endpoint")
        .when(q.contains("#"), "method")
        .when(one & q.contains(".") & (F.length(q) > 3), "fqn")
        .when(word & q.rlike(r"^\p{Lu}.*\p{Ll}"), "class")
        .when(word & q.rlike(r"^\p{Ll}") & q.rlike(r"[\p{Lu}_]"), "name")
    )
    boost = F.when(kind == "endpoint", 2.5).when(kind.isin("method", "fqn"), 2.0).when(kind.isin("class", "name"), 1.5).otherwise(1.0)
    hint = F.struct(
        F.when(kind == "name", "method").when(kind == "fqn", F.lit(None)).otherwise(kind).alias("type"), boost.alias("boost"),
        F.when(kind.isin("method", "fqn"), q).alias("substring"), F.when(has_verb, verb).alias("verb"), F.when(kind == "endpoint", path).alias("path"), kind.alias("kind"),
    )
    return queries.withColumn("hint", hint)


def kind_boost(fused: DataFrame, routed: DataFrame) -> DataFrame:
    """Scores times the hint's boost where the type is preferred, and times two where the name has the asked part."""
    h = routed.select("query_id", "hint")
    f = fused.join(h, "query_id", "left")
    kind = F.when(F.coalesce(F.col("type") == F.col("hint.type"), F.lit(False)), F.col("hint.boost")).otherwise(1.0)
    part = F.when(F.coalesce(F.col("key").contains(F.col("hint.substring")), F.lit(False)), 2.0).otherwise(1.0)
    return f.withColumn("score", F.col("score") * kind * part).drop("hint")


def pagerank_boost(pool: DataFrame, ranks: DataFrame, weight: float = 0.3) -> DataFrame:
    """Scores times 1 + weight times the rank scaled to 0..1 within the query's pool; nothing where all are equal."""
    w = Window.partitionBy("query_id")
    p = pool.join(ranks.select(F.col("node").alias("key"), "pagerank"), "key", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    low, high = F.min("pagerank").over(w), F.max("pagerank").over(w)
    scaled = F.when(high > low, (F.col("pagerank") - low) / (high - low)).otherwise(0.0)
    return p.withColumn("score", F.col("score") * (1 + weight * scaled))


def top(df: DataFrame, n: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "key")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def rerank(pool: DataFrame, queries: DataFrame, reranker: Reranker | None = None, text: str = "document", floor: float = 0.02) -> DataFrame:
    """pool with rerank_score; rows under ``floor`` go, unless the query's scores are all zero (then the order stays)."""
    s = (reranker or overlap_reranker())(F.col("query"), F.coalesce(text, F.lit("")))
    p = pool.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", s)
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    return p.withColumn("_b", best).where((F.col("_b") == 0) | (F.col("rerank_score") >= floor)).drop("_b", "query")


def retrieve(graph: Graph, drawers: DataFrame, queries: DataFrame, *, n_results: int = 10, rerank_pool: int = 50, use_rerank: bool = False, ranks: DataFrame | None = None, index: DataFrame | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, fanout: int = 50, floor: float = 0.02, strict: bool = False) -> DataFrame:
    """Hybrid hits (query_id, key, label, file, line, score, ranks, callers, callees), best first within a query.

    Full text, vectors and direct lookup are fused by reciprocal ranks, boosted by kind and PageRank in a wide
    pool, reranked if asked. ``strict``: a query that neither text nor vectors answer has no hits.
    """
    q = route_queries(queries.where(F.length(F.trim("query")) > 0))
    fts = fts_ranked(fts_search(graph_postings(graph) if index is None else index, q, fanout), fanout)
    with_vec = drawers if "embedding" in drawers.columns else embed(drawers, embedder)
    key = F.when(F.col("type") == "endpoint", F.regexp_replace("id", "^endpoint:", "")).otherwise(F.col("fqn"))
    sem = semantic_search(with_vec, q, fanout, embedder=embedder).select("query_id", key.alias("key"), "rank")
    sem = sem.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    direct = graph_direct(graph, q, fanout).select("query_id", "key", "rank")
    if strict:
        direct = direct.join(fts.select("query_id").unionByName(sem.select("query_id")).distinct(), "query_id", "left_semi")
    fused = rrf_fuse({"fts": fts, "semantic": sem, "graph": direct})
    pool = max(n_results, rerank_pool) if use_rerank else n_results
    wide = top(fused, max(2 * pool, pool + 20))
    where = locations(graph, wide.select(F.col("key").alias("fqn"))).withColumnRenamed("fqn", "key")
    placed = wide.join(where, "key", "left").withColumn("type", F.col("label"))
    boosted = kind_boost(placed, q)
    if ranks is not None:
        boosted = pagerank_boost(boosted, ranks)
    hits = top(boosted, pool)
    if use_rerank:
        text = drawers.select(key.alias("key"), "document").groupBy("key").agg(F.min("document").alias("document"))
        hits = top(rerank(hits.join(text, "key", "left"), q, reranker, floor=floor), n_results, "rerank_score")
    near = neighbors(graph, hits.select(F.col("key").alias("fqn"))).withColumnRenamed("fqn", "key")
    out = hits.join(near, "key", "left")
    out = out.orderBy("query_id", F.desc("rerank_score" if use_rerank else "score"), F.desc("score"), "key")
    return out.select("query_id", "key", "label", "file", "line", F.round("score", 4).alias("score"), "ranks", "callers", "callees", *(["rerank_score"] if use_rerank else []))
