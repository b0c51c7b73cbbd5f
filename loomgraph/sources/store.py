"""A graph as a folder of Parquet snapshots: ``<root>/<graph>/v<n>/<table>``, and a table of committed versions.

A version is written whole into a new folder and named in the commit log last, so
readers never see half of one, and no path is overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EDGES, NODES

#: Tables that are written at a time.
WRITERS = 8


class Graph(dict):
    """Lazy tables by name: nodes, edges, and what is derived from them."""

    def table(self, name: str) -> DataFrame:
        return self[name]


def empty_graph(spark: SparkSession) -> Graph:
    return Graph({n: spark.createDataFrame([], ddl) for n, (_, ddl) in NODES.items()} | {n: spark.createDataFrame([], ddl) for n, ddl in EDGES.items()})


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def version(self, graph: str) -> int:
        """The last committed version; 0 if there is none."""
        log = f"{self.root}/{graph}/commits"
        if not self._exists(log):
            return 0
        return self.spark.read.schema("version int").json(log).agg(F.max("version")).first()[0] or 0

    def stage(self, graph: str, tables: Graph) -> Graph:
        """Write tables into the folder of the next version, which is not committed by that, and read them back."""
        n = self.version(graph) + 1

        def put(name: str) -> None:
            df = tables[name]
            # sorted by key: row-group statistics serve as the index of a lookup
            key = "src" if "src" in df.columns else df.columns[0]
            df.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.root}/{graph}/v{n}/{name}")

        # many tables are small: their jobs run side by side
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(put), tables))
        return self._tables(graph, n, tables)

    def write(self, graph: str, tables: Graph, staged: Iterable[str] = ()) -> int:
        """Commit a version of ``tables`` and of those staged for it."""
        n = self.version(graph) + 1
        self.stage(graph, tables)
        names = self.spark.createDataFrame([(n, sorted({*tables, *staged}))], "version int, tables array<string>")
        names.coalesce(1).write.mode("append").json(f"{self.root}/{graph}/commits")
        return n

    def _tables(self, graph: str, n: int, names: Iterable[str]) -> Graph:
        return Graph({t: self.spark.read.parquet(f"{self.root}/{graph}/v{n}/{t}") for t in names})

    def read(self, graph: str) -> Graph:
        n = self.version(graph)
        if not n:
            return empty_graph(self.spark)
        log = self.spark.read.schema("version int, tables array<string>").json(f"{self.root}/{graph}/commits")
        names = log.where(F.col("version") == n).first().tables
        return self._tables(graph, n, names)

    def clear(self, graph: str) -> None:
        """A new version with empty tables; older ones stay until they are removed by hand."""
        self.write(graph, empty_graph(self.spark))
