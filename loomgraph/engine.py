"""The library's face: one object for a root folder of graphs. Every method returns a DataFrame unless it says text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, context, impact, index, many, search, traverse
from .plans import delta as deltas
from .plans import drawers
from .plans.incremental import GraphFiles
from .plans.ingest import conform
from .schemas import EDGES, NODES
from .sources import export
from .sources.buckets import BucketStore
from .sources.store import Graph, GraphStore
from .streaming import changes


class Engine:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store, self.buckets = spark, GraphStore(spark, root), BucketStore(spark, root, buckets)

    # --- import -------------------------------------------------------------
    def files(self, graph: str) -> GraphFiles:
        return GraphFiles(self.buckets, graph)

    def import_graph(self, path: str, graph: str, **notes) -> int:
        """Full or delta export, told apart by its exportType. Returns the committed version; ``notes`` are kept with it."""
        if export.export_type(self.spark, path) == "delta":
            return self.apply_delta(path, graph, **notes)
        return self.files(graph).import_full(export.read_full(self.spark, path), **notes)

    def apply_delta(self, path: str, graph: str, **notes) -> int:
        """Facts of changed classes are replaced; only the buckets that a change reaches are written."""
        doc = export.read_delta(self.spark, path).cache()  # one small row, asked for many times
        try:
            return self.files(graph).import_delta(deltas.read_change(doc), **notes)
        finally:
            doc.unpersist()

    def context_import(self, path: str, graph: str) -> int:
        """Drawers of an export alone, under ``<graph>.context``."""
        return self.store.write(f"{graph}.context", Graph(drawers=drawers.from_export(export.read_full(self.spark, path), graph)))

    def export_json(self, graph: str, path: str, shards: int = 16) -> None:
        """The graph as an export document in shards, a folder of JSON lines."""
        export.write_json(export.document(self.graph(graph), shards), path)

    def watch(self, events: DataFrame, graph: str, exporter: Callable[[DataFrame], str | None], checkpoint: str, **how):
        """Follow a stream of file changes: ``exporter`` writes a delta export for a micro-batch's sessions and returns its path.

        A micro-batch that comes a second time, after a failure, is known by its id, which the graph's own commit
        carries for each checkpoint folder, and is left out.
        """

        def apply(sessions: DataFrame, batch: int) -> None:
            applied = self.buckets.manifest(graph).notes.get("applied", {})
            # counted, not asked whether empty: a stateful batch must be read as a whole, also if it came before
            if not sessions.count() or batch <= applied.get(checkpoint, -1):
                return
            path = exporter(sessions)
            if path:
                self.import_graph(path, graph, applied=applied | {checkpoint: batch})

        return changes.watch(events, apply, checkpoint, **how)

    def clear(self, graph: str) -> None:
        self.buckets.clear(graph)

    def vacuum(self, graph: str, keep: int = 1) -> int:
        """Remove what only older versions than the last ``keep`` need."""
        return self.buckets.vacuum(graph, keep)

    def graph(self, graph: str) -> Graph:
        g = self.files(graph).read()
        empty = lambda ddl: conform(self.spark.range(0), ddl)
        return Graph({n: empty(d) for n, (_, d) in NODES.items()} | {n: empty(d) for n, d in EDGES.items()} | g)

    # --- structure ----------------------------------------------------------
    def stats(self, graph: str) -> DataFrame:
        return catalog.stats(self.graph(graph))

    def lookup(self, graph: str, table: str, keys: list[str] | DataFrame) -> DataFrame:
        """Rows of some keys, read from their buckets alone; ``calls_in`` has calls by the called method."""
        return self.files(graph).lookup(table, keys)

    def sql(self, graph: str, query: str, limit: int = 100) -> DataFrame:
        """Free-form queries: Spark SQL over the graph's tables (views named like the tables) in a session of their own."""
        session = self.spark.newSession()
        for name, df in self.graph(graph).items():
            session.read.parquet(*df.inputFiles()).createOrReplaceTempView(name) if df.inputFiles() else session.createDataFrame([], df.schema).createOrReplaceTempView(name)
        return session.sql(query).limit(limit)

    def search(self, graph: str, text: str, limit: int = 20) -> DataFrame:
        g = self.graph(graph)
        return index.search(g["blocks"], g["sizes"], g["postings"], self._one(text), limit)[0]

    def trace(self, graph: str, target: str, depth: int = 5, include_external: bool = False) -> DataFrame:
        """Of a method, or of an endpoint given as ``/path`` or ``VERB:/path``."""
        g = self.graph(graph)
        if "#" in target:
            return traverse.compact(traverse.trace_method(g, target, depth), include_external)
        verb, _, path = target.rpartition(":") if ":/" in target else ("", "", target)
        return traverse.compact(traverse.trace_endpoint(g, path, verb, depth), include_external)

    def entry_points(self, graph: str) -> DataFrame:
        return catalog.entry_points(self.graph(graph))

    def impact(self, graph: str, fqn: str, depth: int = 5, *, precise_only: bool = False, **how) -> DataFrame:
        out = impact.impact(self.graph(graph), fqn, depth, **how)
        return out.where("precision = 'precise'") if precise_only else out

    def callers(self, graph: str, fqn: str, depth: int = 2) -> DataFrame:
        return traverse.callers(self.graph(graph), fqn, depth)

    def impact_many(self, graph: str, fqns: DataFrame, depth: int = 5, **how) -> DataFrame:
        """Impact of all methods of a table (column fqn) at once."""
        return many.impact_many(self.graph(graph), fqns, depth, **how)

    def callees(self, graph: str, fqn: str, depth: int = 2) -> DataFrame:
        return traverse.callees(self.graph(graph), fqn, depth)

    def blast_radius(self, graph: str, file_path: str) -> DataFrame:
        return traverse.blast_radius(self.graph(graph), file_path)

    def reverse_trace(self, graph: str, fqn: str, depth: int = 5) -> DataFrame:
        return traverse.reverse_trace(self.graph(graph), fqn, depth)

    def find_class(self, graph: str, part: str) -> DataFrame:
        return catalog.find_class(self.graph(graph), part)

    def unused_methods(self, graph: str) -> DataFrame:
        return catalog.unused_methods(self.graph(graph))

    # --- retrieval and context ----------------------------------------------
    def _one(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, query string")

    def retrieve(self, graph: str, text: str, n_results: int = 10, *, rerank: bool = True, rerank_pool: int = 100, **how) -> DataFrame:
        return self.retrieve_many(graph, self._one(text), n_results=n_results, use_rerank=rerank, rerank_pool=rerank_pool, **how)

    def retrieve_many(self, graph: str, queries: DataFrame, **how) -> DataFrame:
        g = self.graph(graph)
        return search.retrieve(g, g["drawers"], queries, ranks=g["pagerank"], index=g["postings"], **how)

    def context_search(self, graph: str, text: str, k: int = 5, **where) -> DataFrame:
        return context.search(search.embed(search.where_filter(self.graph(graph)["drawers"], **where)), self._one(text), k)

    def context_wakeup(self, graph: str) -> str:
        g = self.graph(graph)
        if "drawers" not in g:  # an index without a graph
            g = Graph(g | self.store.read(f"{graph}.context"))
        return context.wakeup_text(g, g["drawers"], graph)

    def context_recall(self, graph: str, **how) -> DataFrame:
        return context.recall(self.graph(graph)["drawers"], **how)

    def context_stats(self, graph: str) -> DataFrame:
        return context.context_stats(self.graph(graph)["drawers"])
