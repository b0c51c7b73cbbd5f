"""Walks from a table of targets at once: 64 targets are the bits of a word that travels along the edges.

A frontier has one row for each node and word, whose bits say which targets have reached the node; a hop is one join with the
edges and a sum that takes the bitwise or by node and word, so its size does not grow with the targets of a word. Results
name targets again only where they are read, for nodes that matter. Equal to one single walk a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.ingest import union_all
from ..sources.store import Graph
from .rank import checkpointed
from .traverse import closure, links, overridden, sent, supertypes

WORD = 64
#: Targets whose names are sent to all tasks.
MOST_SENT = 500_000


def _mask() -> Column:
    """The word in which only ``bit`` is set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))


def numbered(targets: DataFrame) -> DataFrame:
    """(target, word, bit) of distinct targets: dense enough words, whatever the partitions."""
    t = checkpointed(targets.select("target").distinct())
    parts = -(-t.count() // 10_000)
    # numbers inside partitions, so that no task sees all targets; a partition's last word may be part full
    part = checkpointed(t.repartition(max(parts, 1), "target").withColumn("p", F.spark_partition_id()))
    n = part.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("target")) - 1)
    word = F.col("p").cast("long") * (1 << 32) + F.call_function("div", F.col("i"), F.lit(WORD))
    return checkpointed(n.select("target", word.alias("word"), (F.col("i") % WORD).cast("int").alias("bit")))


def _ored(df: DataFrame) -> DataFrame:
    return df.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _start(targets: DataFrame, of: DataFrame) -> DataFrame:
    """(node, word, bits) of rows (target, node)."""
    return checkpointed(_ored(of.join(targets, "target").select("node", "word", _mask().alias("bits"))))


def named(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, ...) for every bit of rows (word, bits, ...)."""
    has = F.col("bits").bitwiseAND(_mask()) != 0
    bit = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("bit")
    return found.select("*", bit).where(has).join(targets, ["word", "bit"]).drop("word", "bit", "bits")


def walk_many(start: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """(node, word, bits, depth): who reaches a node by a walk of exactly that many steps."""
    frontier, found = start, []
    for k in range(1, depth + 1):
        if frontier.isEmpty():
            break
        frontier = checkpointed(_ored(step.join(sent(frontier), "node").select(F.col("to").alias("node"), "word", "bits")))
        found.append(frontier.withColumn("depth", F.lit(k)))
    return union_all([start.limit(0).withColumn("depth", F.lit(0)), *found])


def _methods(graph: Graph, fqns: DataFrame) -> DataFrame:
    """(target, node) of those names (column fqn) that are methods."""
    return fqns.select("fqn").distinct().join(graph["method"].select("fqn").distinct(), "fqn").select(F.col("fqn").alias("target"), F.col("fqn").alias("node"))


def counted(targets: DataFrame) -> DataFrame:
    """(target, set, no) of distinct targets: numbers of 16 bits within sets, which take four partitions of ``numbered`` each."""
    words = numbered(targets)
    part = F.call_function("shiftrightunsigned", F.col("word"), F.lit(32))
    n = (F.col("word") % (1 << 32)) * WORD + F.col("bit")
    # a partition of more than 2^14 targets goes on in further sets
    over, low = F.call_function("div", n, F.lit(1 << 14)), n % (1 << 14)
    return words.select("target", (F.call_function("div", part, F.lit(4)) + over * (1 << 40)).alias("set"), ((part % 4) * (1 << 14) + low - (1 << 15)).cast("short").alias("no"))


def callers_many(graph: Graph, fqns: DataFrame, depth: int = 2) -> DataFrame:
    """(target, caller, className, file, depth): ``traverse.callers`` of every method (column fqn).

    What reaches a node is the set of its targets' numbers, two bytes each: as many callers as a method has are far fewer than a
    word has targets, so words would have one bit set and a row each. Names, of callers and then of targets, come after the last
    hop, whose sets stay where they are put together. Callers are numbered, so that hops move no names.
    """
    of = _methods(graph, fqns)
    targets = checkpointed(counted(of))
    names = checkpointed(union_all([graph["calls"].select(F.col("src").alias("name")), of.select(F.col("node").alias("name"))]).distinct().withColumn("node", F.monotonically_increasing_id()))
    # only called methods that call, or are targets, lead on
    half = checkpointed(graph["calls"].select("src", F.col("dst").alias("name")).join(names, "name").select("src", "node"))
    back = checkpointed(half.join(names.select(F.col("name").alias("src"), F.col("node").alias("to")), "src").select("node", "to").distinct())
    start = of.join(targets, "target").join(names, F.col("name") == of["node"]).select(names["node"], "set", F.array("no").alias("nos"))
    m = graph["method"].select(F.col("fqn").alias("name"), F.col("fqn").alias("caller"), F.col("classFqn").alias("className"), F.col("filePath").alias("file"))
    frontier, found, hops = checkpointed(start), [], min(max(depth, 1), 3)
    for k in range(1, hops + 1):
        reached = back.join(sent(frontier), "node").select(F.col("to").alias("node"), "set", "nos").repartition("node")
        frontier = reached.groupBy("node", "set").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))
        if k < hops:
            frontier = checkpointed(frontier)
        found.append(frontier.withColumn("depth", F.lit(k)))
    named_callers = checkpointed(names.join(m, "name").select("node", "caller", "className", "file"))
    each = [f.join(named_callers, "node").select("set", F.explode("nos").alias("no"), "caller", "className", "file", "depth") for f in found]
    few = F.broadcast(targets) if targets.count() <= MOST_SENT else targets
    return union_all([e.join(few, ["set", "no"]).select("target", "caller", "className", "file", "depth") for e in each])


def blast_radius_many(graph: Graph, files: DataFrame) -> DataFrame:
    """(target, caller, className, file): ``traverse.blast_radius`` of every file (column filePath)."""
    of = graph["method"].join(files.select("filePath").distinct(), "filePath").select(F.col("filePath").alias("target"), F.col("fqn").alias("node"))
    targets = numbered(of)
    found = _ored(walk_many(_start(targets, of), links(graph["calls"], False), 2))
    m = graph["method"].select(F.col("fqn").alias("caller"), F.col("classFqn").alias("className"), F.col("filePath").alias("file"))
    return named(found, targets).withColumnRenamed("node", "caller").join(m, "caller").select("target", "caller", "className", "file")


def _without(rows: DataFrame, less: DataFrame) -> DataFrame:
    """Bits of rows that ``less`` has not, at the same node and word."""
    other = less.select("node", "word", F.col("bits").alias("_less"))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_less", F.lit(0).cast("long"))))
    return rows.join(other, ["node", "word"], "left").select("node", "word", rest.alias("bits")).where("bits <> 0")


def impact_many(graph: Graph, fqns: DataFrame, depth: int = 5, *, polymorphic: bool = True, field_filter: bool = True) -> DataFrame:
    """(target, endpoint, handler, file, line, hops, precision): ``impact.impact`` by hop of every method (column fqn)."""
    of = _methods(graph, fqns)
    targets = numbered(of)
    back = links(graph["calls"], False)
    over = (graph["overridden"] if "overridden" in graph else checkpointed(overridden(graph))) if polymorphic else None
    frontier = _start(targets, of)
    visited, hits = frontier, []
    handlers = checkpointed(graph["handles"].select(F.col("src").alias("node")).distinct())
    for hop in range(1, min(max(depth, 1), 8) + 1):
        reached, tainted = frontier, None
        if polymorphic:
            up = checkpointed(_without(_ored(over.join(sent(frontier), "node").select(F.col("to").alias("node"), "word", "bits")), frontier))
            tainted = F.broadcast(up.groupBy("word").agg(F.bit_or("bits").alias("over")))  # one row a word
            reached = checkpointed(_ored(frontier.unionByName(up)))
        called = _ored(back.join(sent(reached), "node").select(F.col("to").alias("node"), "word", "bits"))
        frontier = checkpointed(_without(called, visited))
        if frontier.isEmpty():
            break
        end = frontier.join(handlers, "node", "left_semi").withColumn("hops", F.lit(hop))
        end = end.join(tainted, "word", "left") if tainted is not None else end.withColumn("over", F.lit(0).cast("long"))
        hits.append(end.select("node", "word", "bits", "hops", F.coalesce("over", F.lit(0).cast("long")).alias("over")))
        visited = checkpointed(_ored(visited.unionByName(frontier)))
    none = frontier.limit(0).select("node", "word", "bits", F.lit(0).alias("hops"), F.lit(0).cast("long").alias("over"))
    rows = union_all([none, *hits])
    poly = F.col("over").bitwiseAND(_mask()) != 0
    bit = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("bit")
    has = F.col("bits").bitwiseAND(_mask()) != 0
    each = rows.select("*", bit).where(has).withColumn("poly", poly).join(targets, ["word", "bit"]).select("target", "node", "hops", "poly")
    e = graph["endpoint"].select(F.col("id").alias("dst"), F.concat_ws(" ", "httpMethod", "path").alias("endpoint"))
    m = graph["method"].select(F.col("fqn").alias("node"), "classFqn", F.col("filePath").alias("file"), F.col("lineStart").alias("line"))
    full = each.join(graph["handles"].withColumnRenamed("src", "node"), "node").join(e, "dst").join(m, "node")
    first = Window.partitionBy("target", "endpoint").orderBy("hops", "node")
    full = checkpointed(full.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    if polymorphic and field_filter:
        full = full.join(_holders(graph, of, targets, back, full), ["target", "classFqn"], "left").where("not poly or _ok")
    label = F.when(F.col("poly"), "polymorphic").otherwise("precise")
    return full.select("target", "endpoint", F.col("node").alias("handler"), "file", "line", "hops", label.alias("precision"))


def _holders(graph: Graph, of: DataFrame, targets: DataFrame, back: DataFrame, hits: DataFrame, most: int = 10, depth: int = 4) -> DataFrame:
    """(target, classFqn, _ok): handlers' classes with a field of a type that fits the target's class or its callers' classes."""
    near = named(walk_many(_start(targets, of), back, 1), targets).select("target", ids.class_of(F.col("node")).alias("node"))
    own = of.select("target", ids.class_of(F.col("node")).alias("node")).unionByName(near).distinct()
    up = closure(own, supertypes(graph), 5, ("target",))
    subs = supertypes(graph).distinct().groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("subs"))
    few = up.join(subs, "node", "left").where(F.coalesce("subs", F.lit(0)) <= most).select("node", "target")
    types = few.unionByName(own.select("node", "target")).distinct()
    owners = graph["field"].select("type", F.col("classFqn").alias("node")).distinct().join(types.withColumnRenamed("node", "type"), "type").select("node", "target").distinct()
    down = closure(owners, links(graph["extends"], False), depth, ("target",))
    asked = hits.where("poly").select("target", F.col("classFqn").alias("node")).distinct()
    return asked.join(down, ["target", "node"], "left_semi").select("target", F.col("node").alias("classFqn"), F.lit(True).alias("_ok"))
