"""Layered context: who am I (L0), key elements (L1), recall (L2), search (L3). Text is put together at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.store import Graph
from .catalog import key_services, stats
from .search import semantic_search, where_filter

# Sizes of the layers, and the labels that the first one counts.
KEY_ELEMENTS, SNIPPET, BUDGET, RECALL_SNIPPET = 15, 200, 3200, 300
COUNTED = ("Class", "Method", "Endpoint", "SpringBean")


def context_stats(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _snippet(size: int):
    return F.substring(F.trim(F.regexp_replace("document", r"\s+", " ")), 1, size)


def _joined(df: DataFrame, order, text, sep: str, name: str) -> DataFrame:
    """One row: the texts of a few rows in order."""
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep).alias(name))


def identity(graph: Graph, drawers: DataFrame, wing: str) -> DataFrame:
    """(n, line): who am I. Counts of the graph and its key services; of the drawers where there is no graph."""
    order = F.create_map(*[F.lit(x) for kv in enumerate(COUNTED) for x in reversed(kv)])[F.col("label")]
    counts = stats(graph).where(F.col("label").isin(*COUNTED))
    known = _joined(counts, order, F.concat_ws(": ", "label", "n"), " | ", "known").crossJoin(counts.agg(F.sum("n").alias("nodes")))
    few = key_services(graph).withColumn("name", F.substring_index("classFqn", ".", -1))
    services = _joined(few, F.struct(-F.col("callers"), "classFqn"), F.concat("name", F.lit(" ("), "callers", F.lit(" callers)")), ", ", "services")
    kinds = context_stats(drawers)
    held = _joined(kinds, F.col("type"), F.concat_ws(": ", "type", "n"), " | ", "kinds").crossJoin(kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("drawers")))
    row = known.crossJoin(services).crossJoin(held)
    of_graph = F.concat_ws(" | ", "known", F.when(F.col("services") != "", F.concat(F.lit("Key services: "), "services")))
    of_drawers = F.concat_ws("\n", F.concat(F.lit("Context drawers: "), "drawers"), F.nullif("kinds", F.lit("")))
    lines = F.array(F.lit("## L0 — PROJECT IDENTITY"), F.lit(f"Graph: {wing}"), F.when(F.col("nodes") > 0, of_graph).otherwise(of_drawers))
    return row.select(F.posexplode(lines).alias("n", "line"))


def key_elements(drawers: DataFrame, wing: str = "") -> DataFrame:
    """(room, id, type, importance, snippet, head, entry, at): the most important drawers by room, up to the first that overruns the budget.

    ``head`` is the room's line, on its first drawer only; ``at`` counts the characters so far.
    """
    flat = F.regexp_replace(strip(F.col("document")), "\n", " ")
    cut = F.when(F.length(flat) > SNIPPET, F.concat(F.substring(flat, 1, SNIPPET - 3), F.lit("..."))).otherwise(flat)
    best = where_filter(drawers, wing=wing).select("room", "id", "type", "importance", cut.alias("snippet")).orderBy(F.desc("importance"), "id").limit(KEY_ELEMENTS)
    order = Window.orderBy("room", F.desc("importance"), "id")  # fifteen rows
    room = F.when(F.size(F.split("room", r"\.")) > 2, F.substring_index("room", ".", -2)).otherwise(F.col("room"))
    first = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("importance"), "id")) == 1
    run = best.withColumn("head", F.when(first, F.concat(F.lit("\n["), room, F.lit("]")))).withColumn("entry", F.concat(F.lit("  - "), "snippet", F.lit(" (imp="), "importance", F.lit(")")))
    run = run.withColumn("at", F.sum(F.length("entry") + F.coalesce(F.length("head"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.min(F.when(F.col("at") > BUDGET, F.col("at"))).over(Window.partitionBy())
    return run.withColumn("_o", over).where(F.col("_o").isNull() | (F.col("at") < F.col("_o"))).drop("_o")


def key_lines(drawers: DataFrame, wing: str = "") -> DataFrame:
    """(n, line): the key elements as text, by room."""
    rows = key_elements(drawers, wing)
    shown = rows.select(F.col("at").alias("n"), F.concat_ws("\n", "head", "entry").alias("line"))
    all_ = where_filter(drawers, wing=wing).select("id").limit(KEY_ELEMENTS).agg(F.count(F.lit(1)).alias("of"))
    ends = rows.agg(F.count(F.lit(1)).alias("k")).crossJoin(all_)
    title = F.when(F.col("of") == 0, "## L1 — No context drawers yet.").otherwise("## L1 — KEY CODE ELEMENTS")
    more = F.when(F.col("k") < F.col("of"), "  ... (more in L3 search)")
    ends = ends.select(F.explode(F.array(F.struct(F.lit(0).alias("n"), title.alias("line")), F.struct(F.lit(2 * BUDGET).alias("n"), more.alias("line")))).alias("x")).select("x.*")
    return shown.select(F.col("n").cast("int").alias("n"), "line").unionByName(ends.where("line is not null"))


def recall(drawers: DataFrame, *, wing: str = "", room: str = "", type_: str = "", limit: int = 10) -> DataFrame:
    d = where_filter(drawers, wing, room, type_)
    return d.select("id", "room", "type", "importance", _snippet(RECALL_SNIPPET).alias("snippet")).orderBy(F.desc("importance"), "id").limit(limit)


def wakeup_lines(graph: Graph, drawers: DataFrame, wing: str) -> DataFrame:
    """(layer, n, line) of both layers; in this order they are the text."""
    first, second = identity(graph, drawers, wing), key_lines(drawers, wing)
    return first.select(F.lit(0).alias("layer"), "n", "line").unionByName(second.select(F.lit(1).alias("layer"), "n", "line"))


def wakeup_text(graph: Graph, drawers: DataFrame, wing: str) -> str:
    """L0 and L1 as text; a few dozen rows reach the driver."""
    rows = wakeup_lines(graph, drawers, wing).orderBy("layer", "n").collect()
    return "\n\n".join("\n".join(r.line for r in rows if r.layer == k) for k in (0, 1))


def search(drawers: DataFrame, queries: DataFrame, k: int = 5, **how) -> DataFrame:
    return semantic_search(drawers, queries, k, **how)
