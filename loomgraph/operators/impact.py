"""Which endpoints does a method reach backwards? With polymorphic dispatch and narrowing by field types.

Each hop: the frontier, with what it overrides, has callers not met before; those
that handle an endpoint are hits, the first hop wins. ``precision="hop"`` calls a hit
polymorphic if its hop used an override; ``"path"`` if any way to it had to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.ingest import union_all
from ..sources.store import Graph
from .rank import checkpointed
from .traverse import SENT, classes_with_field, compatible_types, links, overridden, seeds, sent, walk


def _hits(graph: Graph, found: DataFrame) -> DataFrame:
    """found (node, hops, ...) -> its rows joined with the endpoints that the nodes handle."""
    e = graph["endpoint"].select(F.col("id").alias("dst"), F.concat_ws(" ", "httpMethod", "path").alias("endpoint"))
    m = graph["method"].select(F.col("fqn").alias("node"), "classFqn", F.col("filePath").alias("file"), F.col("lineStart").alias("line"))
    return found.join(graph["handles"].withColumnRenamed("src", "node"), "node").join(e, "dst").join(m, "node")


def impact_direct(graph: Graph, fqn: str, depth: int = 5) -> DataFrame:
    """(endpoint, controller, handler, file, line, hops) over direct calls only."""
    found = walk(seeds(graph, fqn), links(graph["calls"], False), min(max(depth, 1), 5)).withColumnRenamed("depth", "hops")
    return _hits(graph, found).select("endpoint", F.col("classFqn").alias("controller"), F.col("node").alias("handler"), "file", "line", "hops").distinct()


def impact(graph: Graph, fqn: str, depth: int = 5, *, polymorphic: bool = True, field_filter: bool = True, precision: str = "hop") -> DataFrame:
    """(endpoint, handler, file, line, hops, precision), one row an endpoint; precise ones first when sorted by precision, hops, endpoint."""
    if precision not in ("hop", "path"):
        raise ValueError("precision is hop or path")
    back = links(graph["calls"], False)
    # what each method overrides, over any number of steps: kept by an import, else found once
    over = (graph["overridden"] if "overridden" in graph else checkpointed(overridden(graph))) if polymorphic else None
    frontier = checkpointed(seeds(graph, fqn).withColumn("poly", F.lit(False)))
    visited, found = frontier.select("node"), []
    for hop in range(1, min(max(depth, 1), 8) + 1):
        reached, over_any = frontier, False
        if polymorphic:  # what the frontier overrides, found once a hop
            near = F.broadcast(frontier) if frontier.count() <= SENT else frontier
            up = checkpointed(over.join(near.select("node"), "node").select(F.col("to").alias("node")).distinct().join(near.select("node"), "node", "left_anti").withColumn("poly", F.lit(True)))
            over_any = not up.isEmpty()
            reached = checkpointed(frontier.unionByName(up)) if over_any else frontier
        calls = back.join(sent(reached), "node").select(F.col("to").alias("node"), "poly")
        # a caller is tainted on a path only if every way to it is
        new = checkpointed(calls.groupBy("node").agg(F.min("poly").alias("poly")).join(visited, "node", "left_anti"))
        if new.isEmpty():
            break
        # by hop: did any node of this hop override something?
        label = new.select("node", F.lit(over_any).alias("poly")) if precision == "hop" else new
        found.append(label.withColumn("hops", F.lit(hop)))
        frontier = new.select("node", F.lit(False).alias("poly")) if precision == "hop" else new
        visited = visited.unionByName(new.select("node"))
    none = frontier.limit(0).withColumn("hops", F.lit(0))
    hits = checkpointed(_hits(graph, union_all([none, *found])))
    first = Window.partitionBy("endpoint").orderBy("hops", "node")
    hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if polymorphic and field_filter:
        own = seeds(graph, fqn).select(ids.class_of(F.col("node")).alias("node"))
        near = walk(seeds(graph, fqn), back, 1).select(ids.class_of(F.col("node")).alias("node"))
        types = compatible_types(graph, own.unionByName(near).distinct())
        owners = classes_with_field(graph, types, hits.where("poly").select(F.col("classFqn").alias("node"))).select(F.col("node").alias("classFqn"), F.lit(True).alias("_ok"))
        hits = hits.join(owners, "classFqn", "left").where("not poly or _ok")
    label = F.when(F.col("poly"), "polymorphic").otherwise("precise")
    return hits.select("endpoint", F.col("node").alias("handler"), "file", "line", "hops", label.alias("precision"))


def impact_totals(hits: DataFrame) -> DataFrame:
    """(precision, endpoints) of the hits of ``impact``, and a row ``total``."""
    each = hits.groupBy("precision").agg(F.count(F.lit(1)).alias("endpoints"))
    return each.unionByName(hits.agg(F.lit("total").alias("precision"), F.count(F.lit(1)).alias("endpoints")).select("precision", "endpoints"))
