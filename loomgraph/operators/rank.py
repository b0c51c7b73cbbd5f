"""Personalised PageRank over distinct calls, its roll-up to classes, fan-in and fan-out, importance."""

from __future__ import annotations

import tempfile
import threading
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import union_all
from ..sources.store import Graph

#: Annotations (simple names) whose methods the framework enters; and those of the entry-point report (full names).
SEED_ANNOTATIONS = ("Scheduled", "PostConstruct", "EventListener", "KafkaListener")
ENTRY_ANNOTATIONS = ("org.springframework.scheduling.annotation.Scheduled", "javax.annotation.PostConstruct", "jakarta.annotation.PostConstruct")


#: Edges from which on they stay dealt by source, so that rounds shuffle sums of ranks only.
DEALT_EDGES = 20_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; only in local mode a temporary one is set where none is."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_name() -> str:
    return uuid.uuid4().hex


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writers = [0, None]  # how many writes run, and the caller's setting


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go as soon as each ends; else they stay until the driver collects its garbage."""
    with _writing:
        if not _writers[0]:
            _writers[1] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _writing:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(_CLEANUP, _writers[1])


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a compressed table in the folder that all executors share, and its path, which ``removed`` takes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{fresh_name()}"
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Tables of ``written`` that nothing reads any more go."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: a compressed table in the folder that all executors share, a fraction of what ``checkpoint`` writes."""
    return written(df)[0]


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` checkpointed in ``parts`` partitions by ``key``, which later joins and sums by it know, so that they do not shuffle it again.

    A table read back or an adaptive plan would forget how its rows are dealt; the setting holds for this plan alone.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(parts, key).sortWithinPartitions(key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def entry_seeds(graph: Graph) -> DataFrame:
    """(node): handlers and methods with a seed annotation."""
    marked = graph["annotated_with"].where(F.substring_index("dst", ".", -1).isin(*SEED_ANNOTATIONS)).select(F.col("src").alias("node"))
    return graph["handles"].select(F.col("src").alias("node")).unionByName(marked).distinct()


def _prepared(edges: DataFrame, entries: DataFrame, boost: float) -> tuple[DataFrame, DataFrame, DataFrame, int, float, list[str]]:
    """(names: node, id), (nodes: id, w, deg), (edges: s, ds: all its targets, by node id), the number of nodes, their weight, and the paths of what rounds read.

    Names become numbers once, so that rounds shuffle and compare numbers only; a source is one row. Nodes and edges of a large graph
    are dealt by id and s.
    """
    spark = edges.sparkSession
    e, first = written(edges.select("src", "dst").distinct())
    nodes = union_all([e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node")), entries.select("node")]).distinct()
    nodes = nodes.join(entries.select("node", F.lit(boost).alias("w")).distinct(), "node", "left").select("node", F.coalesce("w", F.lit(1.0)).alias("w"))
    named, _ = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    ids = named.select("node", "id")
    half, second = written(e.join(ids.toDF("src", "s"), "src").select("s", "dst"))
    removed(spark, first)
    numbered, third = written(half.join(ids.toDF("dst", "d"), "dst").select("s", "d"))
    removed(spark, second)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = numbered.count() > DEALT_EDGES  # below, sending the ranks to all edges is faster than sorting by node in each round
    outs, fourth = written(numbered.groupBy("s").agg(F.collect_list("d").alias("ds")))
    removed(spark, third)
    nodes, fifth = written(named.select("id", "w").join(outs.select(F.col("s").alias("id"), F.size("ds").alias("deg")), "id", "left"))
    n, weight = nodes.agg(F.count(F.lit(1)), F.sum("w")).first()
    paths = [fourth, fifth]
    if large:
        outs, nodes = dealt(outs, parts, "s"), dealt(nodes, parts, "id")
        removed(spark, *paths)
        paths = []
    return ids, nodes, outs, n, weight, paths


def _received(e: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, got): what each node gets of ranks (id, r, deg)."""
    sent = e.join(ranks.where("deg is not null").select(F.col("id").alias("s"), (F.col("r") / F.col("deg")).alias("out")), "s")
    return sent.select(F.explode("ds").alias("id"), "out").groupBy("id").agg(F.sum("out").alias("got"))


def mass(edges: DataFrame, entries: DataFrame, *, alpha: float = 0.85, boost: float = 10.0, iterations: int = 100, tolerance: float = 1e-6, every: int = 5) -> tuple[DataFrame, float, int]:
    """(node, w, mass), total mass and number of nodes: the solution of mass = alpha P mass + w, with w = ``boost`` for entries and 1 for others."""
    spark = edges.sparkSession
    ids, nodes, e, n, _, paths = _prepared(edges, entries, boost)
    if not n:
        return ids.join(nodes, "id").select("node", "w", F.col("w").alias("mass")), 0.0, 0
    y, last = nodes.withColumn("r", F.col("w")), None
    for k in range(1, iterations + 1):
        y = y.join(_received(e, y), "id", "left").select("id", "w", "deg", F.col("r").alias("old"), (alpha * F.coalesce("got", F.lit(0.0)) + F.col("w")).alias("r"))
        if k % every == 0 or k == iterations:
            y, path = written(y)
            if last:
                removed(spark, last)
            last = path
            total, change = y.agg(F.sum("r"), F.sum(F.abs(F.col("r") - F.col("old")))).first()
            if change < tolerance * total:
                break
    else:
        warnings.warn(f"PageRank: change is {change / total:.1e} of the total after {iterations} rounds, above {tolerance}", stacklevel=2)
    removed(spark, *paths)
    return ids.join(y, "id").select("node", "w", F.col("r").alias("mass")), total, n


def pagerank(edges: DataFrame, entries: DataFrame, *, alpha: float = 0.85, boost: float = 10.0, iterations: int = 100, tolerance: float = 1e-6, every: int = 5, fixed: bool = False) -> DataFrame:
    """(node, pagerank) over distinct (src, dst); entries weigh ``boost`` in the restart p, others 1.

    Mass of nodes without outgoing edges is dealt like the restart, so the ranks are a multiple of the solution
    of y = alpha P y + p: rounds of that need no sum over all nodes, and on call graphs, which hardly have
    cycles, they end after the longest chain. ``every`` rounds are one plan, then the lineage is cut and the
    total change compared with ``tolerance`` of the total; networkx allows that much for each node, which a
    million nodes meet whatever is left. ``fixed`` deals the lost mass in each round and does
    exactly ``iterations`` rounds from equal ranks.
    """
    if fixed:
        ids, nodes, e, n, weight, _ = _prepared(edges, entries, boost)
        return ids.join(_power(nodes.withColumn("p", F.col("w") / F.lit(weight)), e, n, alpha, iterations), "id").select("node", "pagerank") if n else ids.select("node", F.lit(0.0).alias("pagerank"))
    y, total, n = mass(edges, entries, alpha=alpha, boost=boost, iterations=iterations, tolerance=tolerance, every=every)
    return y.select("node", (F.col("mass") / F.lit(total)).alias("pagerank")) if n else y.select("node", F.lit(0.0).alias("pagerank"))


def _power(nodes: DataFrame, e: DataFrame, n: int, alpha: float, iterations: int) -> DataFrame:
    ranks, last = nodes.withColumn("r", F.lit(1.0 / n)), None
    for _ in range(iterations):
        lost = ranks.where("deg is null").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        new = ranks.join(_received(e, ranks), "id", "left")
        ranks, path = written(new.select("id", "p", "deg", (alpha * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p")) + (1 - alpha) * F.col("p")).alias("r")))
        if last:
            removed(nodes.sparkSession, last)
        last = path
    return ranks.select("id", F.col("r").alias("pagerank"))


def method_pagerank(graph: Graph, **how) -> DataFrame:
    return pagerank(graph["calls"], entry_seeds(graph), **how)


def class_pagerank(graph: Graph, ranks: DataFrame) -> DataFrame:
    """(fqn, pagerank): the sum over a class's methods; 0 without ranked methods."""
    r = graph["has_method"].join(ranks, graph["has_method"]["dst"] == ranks["node"]).groupBy("src").agg(F.sum("pagerank").alias("pagerank"))
    return graph["class"].join(r, F.col("fqn") == F.col("src"), "left").select("fqn", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))


def fan_in_out(graph: Graph) -> DataFrame:
    """(fqn, fan_in, fan_out): call sites, not distinct callers."""
    c = graph["calls"]
    one = lambda a, b: c.groupBy(F.col(a).alias("fqn")).agg(F.count(F.lit(1)).alias(b))
    return graph["method"].select("fqn").join(one("dst", "fan_in"), "fqn", "left").join(one("src", "fan_out"), "fqn", "left").select("fqn", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def _share(c: Column, over: float, most: float) -> Column:
    return F.least(c / over, F.lit(most))


def _flag(c: Column, worth: float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), worth).otherwise(0.0)


# The weights of the importance score.
def importance(graph: Graph) -> DataFrame:
    """(type, fqn, importance): methods, classes and endpoints of the project, 0 to 1, three decimals."""
    fans = fan_in_out(graph)
    part = lambda a: F.col("dst").contains(a)
    stereo = F.max(part("Service") | part("Controller") | part("Repository")).alias("stereo")
    has = graph["annotated_with"].groupBy(F.col("src").alias("fqn")).agg(*[F.max(part(a)).alias(a) for a in ("Transactional", "Scheduled", "Async")], stereo)
    handler = graph["handles"].select(F.col("src").alias("fqn"), F.lit(True).alias("handler")).distinct()
    own = graph["method"].where(~F.coalesce("external", F.lit(False))).select("fqn", "classFqn")
    m = own.join(fans, "fqn").join(has, "fqn", "left").join(handler, "fqn", "left")
    score = _share(F.col("fan_in"), 20, 0.4) + _flag(F.col("handler"), 0.3) + _flag(F.col("Transactional"), 0.15) + _flag(F.col("Scheduled"), 0.1) + _flag(F.col("Async"), 0.05)
    methods = m.select(F.lit("method").alias("type"), "fqn", score.alias("s"))
    sums = own.join(fans, "fqn").groupBy("classFqn").agg(F.sum("fan_in").alias("fan"), F.count(F.lit(1)).alias("n"))
    inj = graph["injects"].join(graph["bean"].select(F.col("name").alias("src"), "classFqn"), "src").groupBy("classFqn").agg(F.count(F.lit(1)).alias("inj"))
    c = graph["class"].where(~F.coalesce("external", F.lit(False))).select("fqn").join(sums, F.col("fqn") == sums["classFqn"], "left").drop("classFqn")
    c = c.join(inj, F.col("fqn") == inj["classFqn"], "left").join(has.select("fqn", "stereo"), "fqn", "left")
    z = lambda k: F.coalesce(k, F.lit(0))
    classes = c.select(F.lit("class").alias("type"), "fqn", (_share(z("fan"), 50, 0.4) + _share(z("n"), 30, 0.2) + _share(z("inj"), 10, 0.2) + _flag(F.col("stereo"), 0.1)).alias("s"))
    e = graph["endpoint"].join(fans.select(F.col("fqn").alias("handlerMethodFqn"), "fan_out"), "handlerMethodFqn", "left")
    ends = e.select(F.lit("endpoint").alias("type"), F.col("id").alias("fqn"), (0.5 + _share(z("fan_out"), 15, 0.3)).alias("s"))
    return union_all([methods, classes, ends]).select("type", "fqn", F.round(F.least("s", F.lit(1.0)), 3).alias("importance"))


def top_ranked(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(kind, name, pagerank): the method and the class with the highest rank, of equal ones the first by name."""
    best = lambda kind, df, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "pagerank").orderBy(F.desc("pagerank"), "name").limit(1)
    return best("method", methods, "node").unionByName(best("class", classes, "fqn"))
