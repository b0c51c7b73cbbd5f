"""Walks over the call graph, closures over the type graph, and what is read off them.

A walk of depth k is k joins of the frontier with the edges, each followed by a
distinct, so its size is bounded by the nodes and not by the number of paths. Each
frontier is written before the next step: one of up to SENT rows is sent to all tasks,
so that the edges are scanned and not shuffled; a larger one meets them by a shuffle.
Closures end when nothing is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.ingest import union_all
from ..sources.store import Graph
from .rank import checkpointed

#: Rows of a frontier that are sent to all tasks.
SENT = 100_000


def seeds(graph: Graph, fqn: str) -> DataFrame:
    return graph["method"].where(F.col("fqn") == fqn).select(F.col("fqn").alias("node"))


def links(edges: DataFrame, forward: bool = True) -> DataFrame:
    """(node, to) in the direction of the walk; edges that repeat stay, since every step is made distinct."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.select(F.col(a).alias("node"), F.col(b).alias("to"))


def sent(frontier: DataFrame) -> DataFrame:
    """A written frontier, marked for broadcast if its number of rows allows it."""
    return F.broadcast(frontier) if frontier.count() <= SENT else frontier


def walk(start: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """(node, depth) for every node reached by a walk of 1 to ``depth`` steps from ``start`` (column node); once per depth."""
    frontier, found = checkpointed(start.select("node").distinct()), []
    for k in range(1, depth + 1):
        if found and frontier.isEmpty():
            break
        frontier = checkpointed(step.join(sent(frontier), "node").select(F.col("to").alias("node")).distinct())
        found.append(frontier.select("node", F.lit(k).alias("depth")))
    return union_all(found)


def closure(start: DataFrame, step: DataFrame, depth: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``start`` (columns node and ``carry``) and all reached from them in up to ``depth`` steps, distinct."""
    cols = ["node", *carry]
    frontier = checkpointed(start.select(*cols).distinct())
    out = frontier
    for _ in range(depth):
        fresh = step.join(sent(frontier), "node").select(F.col("to").alias("node"), *carry).distinct()
        frontier = checkpointed(fresh.join(out, cols, "left_anti"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out


def _described(found: DataFrame, graph: Graph, name: str, more=()) -> DataFrame:
    m = graph["method"].select(F.col("fqn").alias("node"), F.col("classFqn").alias("className"), F.col("filePath").alias("file"), *more)
    return found.join(m, "node").withColumnRenamed("node", name)


def callers(graph: Graph, fqn: str, depth: int = 2) -> DataFrame:
    """(caller, className, file, depth), one to three hops."""
    hops = min(max(depth, 1), 3)
    return _described(walk(seeds(graph, fqn), links(graph["calls"], False), hops), graph, "caller").select("caller", "className", "file", "depth")


def callees(graph: Graph, fqn: str, depth: int = 2) -> DataFrame:
    hops = min(max(depth, 1), 3)
    return _described(walk(seeds(graph, fqn), links(graph["calls"]), hops), graph, "callee").select("callee", "className", "file", "depth")


def blast_radius(graph: Graph, file_path: str) -> DataFrame:
    """Callers within two hops of any method of the file, each once."""
    start = graph["method"].where(F.col("filePath") == file_path).select(F.col("fqn").alias("node"))
    found = walk(start, links(graph["calls"], False), 2).select("node").distinct()
    return _described(found, graph, "caller").select("caller", "className", "file")


def trace_method(graph: Graph, fqn: str, depth: int = 5) -> DataFrame:
    """(fqn, className, file, line, external, depth) of the forward walk; depth is at most five."""
    found = walk(seeds(graph, fqn), links(graph["calls"]), min(max(depth, 1), 5))
    return _described(found, graph, "fqn", (F.col("lineStart").alias("line"), "external")).select("fqn", "className", "file", "line", "external", "depth")


def _handlers(graph: Graph, path: str, verb: str = "") -> DataFrame:
    e = graph["endpoint"]
    e = e.where((F.col("path") == path) & (F.col("httpMethod") == verb.upper())) if verb else e.where(F.col("path").contains(path))
    e = e.select(F.col("id").alias("dst"), F.concat_ws(" ", "httpMethod", "path").alias("endpoint"))
    return graph["handles"].join(e, "dst").select(F.col("src").alias("node"), "endpoint").distinct()


def trace_endpoint(graph: Graph, path: str, verb: str = "", depth: int = 5) -> DataFrame:
    """Handlers at depth 0 with their endpoint, then the forward walk with an empty one."""
    h = _handlers(graph, path, verb)
    rest = walk(h, links(graph["calls"]), min(max(depth, 1), 5)).withColumn("endpoint", F.lit(""))
    found = h.withColumn("depth", F.lit(0)).unionByName(rest)
    return _described(found, graph, "fqn", (F.col("lineStart").alias("line"), "external")).select("fqn", "className", "file", "line", "external", "endpoint", "depth")


def endpoint_trace(graph: Graph, path: str) -> DataFrame:
    return trace_endpoint(graph, path, depth=2).select("fqn", "className", "depth").distinct()


def reverse_trace(graph: Graph, fqn: str, depth: int = 5) -> DataFrame:
    """Backward walk; endpoint is null where a caller handles none."""
    found = walk(seeds(graph, fqn), links(graph["calls"], False), min(max(depth, 1), 5))
    e = graph["endpoint"].select(F.col("id").alias("dst"), F.concat_ws(" ", "httpMethod", "path").alias("endpoint"))
    handled = graph["handles"].join(e, "dst").select(F.col("src").alias("node"), "endpoint")
    return _described(found.join(handled, "node", "left"), graph, "fqn").select("fqn", "className", "file", "endpoint", "depth")


def compact(trace: DataFrame, include_external: bool = False) -> DataFrame:
    """A trace for reading: no external code, no accessors below the first step, short names, ``file:line``."""
    t = trace if include_external else trace.where(~ids.is_external(F.col("external")))
    t = t.where((F.col("depth") < 2) | ~ids.is_accessor(F.col("fqn"))).dropDuplicates(["fqn", "depth"])
    where = F.when(F.coalesce("line", F.lit(0)) > 0, F.concat_ws(":", F.substring_index("file", "/", -1), "line")).otherwise(F.substring_index("file", "/", -1))
    short = F.concat(ids.method_name(F.col("fqn")), F.lit("("), ids.short_params(F.col("fqn")), F.lit(")"))
    return t.select("depth", ids.simple_class(F.col("className")).alias("class"), short.alias("method"), where.alias("at"), "fqn")


def override_closure(graph: Graph, start: DataFrame, depth: int = 5) -> DataFrame:
    """``start`` and all that its methods override, up to ``depth`` levels."""
    return closure(start, links(graph["overrides"]), depth)


def overridden(graph: Graph, depth: int = 5) -> DataFrame:
    """(node, to): each method and all that it overrides in up to ``depth`` steps; a small table, kept by an import."""
    own = graph["overrides"].select(F.col("src").alias("node")).distinct()
    up = closure(own.select("node", F.col("node").alias("origin")), links(graph["overrides"]), depth, ("origin",))
    return up.select(F.col("origin").alias("node"), F.col("node").alias("to")).where("node <> to")


def supertypes(graph: Graph) -> DataFrame:
    return links(graph["extends"].unionByName(graph["implements"]))


def type_ancestors(graph: Graph, start: DataFrame, depth: int = 5) -> DataFrame:
    """``start`` and its ancestors over extends and implements."""
    return closure(start, supertypes(graph), depth)


def compatible_types(graph: Graph, start: DataFrame, most: int = 10) -> DataFrame:
    """Ancestors with at most ``most`` distinct direct subtypes (generic bases go), and ``start`` itself."""
    up = type_ancestors(graph, start)
    subs = supertypes(graph).distinct().groupBy(F.col("to").alias("t")).agg(F.count(F.lit(1)).alias("subs"))
    few = up.join(subs, up["node"] == subs["t"], "left").where(F.coalesce("subs", F.lit(0)) <= most).select("node")
    return few.unionByName(start.select("node")).distinct()


def classes_with_field(graph: Graph, types: DataFrame, candidates: DataFrame, depth: int = 4) -> DataFrame:
    """Candidates that have, or inherit within ``depth`` levels, a field of one of the types. Owners first: the small side drives."""
    owners = graph["field"].join(types.select(F.col("node").alias("type")).distinct(), "type", "left_semi").select(F.col("classFqn").alias("node"))
    down = closure(owners, links(graph["extends"], False), depth)
    return candidates.select("node").distinct().join(down, "node", "left_semi")
