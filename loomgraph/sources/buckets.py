"""Tables in hash buckets of their rows' owners, copied on write: a version names for every bucket the folder that holds it.

Rows lie in ``<root>/<graph>/data/<table>/_bucket=<b>/_version=<v>``; a manifest ``<root>/<graph>/manifest/<n>.json`` says which
folder of each bucket belongs to version n. A commit writes the buckets it changes into new folders and names all others as
they were, so what it writes follows the change and not the graph. The manifest is written last, by a rename that fails if
it exists: readers see whole versions, a commit that broke off leaves folders nobody names, and of two writers of one version
the second gets an error. ``vacuum`` removes folders that no kept version names.

The number of buckets is fixed when a graph is first written. A bucket with more rows than others (one class that makes a
third of all calls) is split over tasks and files when it is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import WRITERS, Graph


@dataclass
class Manifest:
    """One version: folders by table and bucket, schemas by table, and notes of the writer."""

    version: int = 0
    buckets: int = 0
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


def bucket_of(owner: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(owner, F.lit(""))), F.lit(buckets)).cast("int")


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.default = spark, root.rstrip("/"), buckets

    # --- files --------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, graph: str) -> list[int]:
        folder, fs = self._path(graph, "manifest"), self._fs()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, graph: str) -> int:
        """The last committed version; 0 if there is none."""
        return max(self._versions(graph), default=0)

    def manifest(self, graph: str, version: int | None = None) -> Manifest:
        n = self.version(graph) if version is None else version
        if not n:
            return Manifest(buckets=self.default)
        stream = self._fs().open(self._path(graph, "manifest", f"{n}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _publish(self, graph: str, m: Manifest) -> None:
        """Write the manifest beside its place, then move it there; the move fails if the version exists."""
        jvm, fs = self.spark._jvm, self._fs()
        draft = self._path(graph, "manifest", f".{m.version}-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, True)
        try:
            out.write(json.dumps(m.__dict__).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(draft, self._path(graph, "manifest", f"{m.version}.json"), options)

    # --- reading ------------------------------------------------------------
    def _read(self, graph: str, m: Manifest, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schemas[table]))
        named = m.folders[table]
        keep = named if buckets is None else {str(b): named[str(b)] for b in buckets if str(b) in named}
        if not keep:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{graph}/data/{table}"
        paths = [f"{base}/_bucket={b}/_version={v}" for b, v in sorted(keep.items())]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def read(self, graph: str, version: int | None = None) -> Graph:
        m = self.manifest(graph, version)
        return Graph({t: self._read(graph, m, t) for t in m.schemas})

    def some(self, graph: str, tables: Iterable[str], buckets: Iterable[int], m: Manifest | None = None) -> Graph:
        """The rows of some buckets only; other files are not opened."""
        m, buckets = m or self.manifest(graph), list(buckets)
        return Graph({t: self._read(graph, m, t, buckets) for t in tables if t in m.schemas})

    # --- writing ------------------------------------------------------------
    def stage(self, graph: str, m: Manifest, rows: dict[str, tuple[DataFrame, Column | None]], only: dict[str, Iterable[int]] | None = None) -> Manifest:
        """The manifest of the next version with ``rows`` (table, owner) written to new folders.

        A table without an owner has its buckets' numbers in ``bucket``. Buckets of a table in ``only`` are replaced and all others kept; a table that is not in it is replaced whole. Not committed by this.
        """
        token = f"{m.version + 1}-{uuid.uuid4().hex[:12]}"
        new = Manifest(m.version, m.buckets or self.default, {t: dict(f) for t, f in m.folders.items()}, dict(m.schemas), dict(m.notes))

        def put(table: str) -> None:
            df, owner = rows[table]
            dealt = df.withColumn("_bucket", bucket_of(owner, new.buckets) if owner is not None else F.col("bucket"))
            if only is not None and table in only:
                dealt = dealt.where(F.col("_bucket").isin(*only[table]) if only[table] else F.lit(False))
            out = dealt.withColumn("_version", F.lit(token)).hint("rebalance", "_bucket")
            # sorted by key inside a file, so that the statistics of its row groups serve a lookup
            keys = [c for c in ("fqn", "src", "dst", "target", "node", "key", "term", "id", "name") if c in df.columns and dict(df.dtypes)[c] == "string"]
            out = out.sortWithinPartitions("_bucket", "_version", *keys[:1])
            out.write.partitionBy("_bucket", "_version").mode("append").parquet(f"{self.root}/{graph}/data/{table}")

        # many tables are small: their jobs run side by side
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(put), rows))
        fs = self._fs()
        for table, (df, _) in rows.items():
            new.schemas[table] = df.schema.json()
            base = self._path(graph, "data", table)
            gone = range(new.buckets) if only is None or table not in only else only[table]
            kept = {b: v for b, v in new.folders.get(table, {}).items() if int(b) not in set(gone)}
            there = fs.globStatus(self._path(graph, "data", table, "_bucket=*", f"_version={token}")) if fs.exists(base) else []
            made = [s.getPath().getParent().getName().removeprefix("_bucket=") for s in there or []]
            new.folders[table] = kept | {b: token for b in made}
        return new

    def commit(self, graph: str, staged: Manifest, **notes) -> int:
        m = Manifest(staged.version + 1, staged.buckets, staged.folders, staged.schemas, staged.notes | notes)
        self._publish(graph, m)
        return m.version

    def write(self, graph: str, rows: dict[str, tuple[DataFrame, Column]], **notes) -> int:
        """A version in which these tables are new as a whole."""
        return self.commit(graph, self.stage(graph, self.manifest(graph), rows), **notes)

    def clear(self, graph: str) -> int:
        """A version with the same tables, all empty."""
        m = self.manifest(graph)
        return self.commit(graph, Manifest(m.version, m.buckets, {t: {} for t in m.schemas}, m.schemas, {}))

    def vacuum(self, graph: str, keep: int = 1) -> int:
        """Remove the manifests of all but the last ``keep`` versions and the folders that only they, or no version, name. Returns the number of folders.

        Nobody may write, or read an older version, meanwhile.
        """
        fs, versions = self._fs(), self._versions(graph)
        kept = [self.manifest(graph, n) for n in versions[-keep:]]
        named = {(t, b, v) for m in kept for t, f in m.folders.items() for b, v in f.items()}
        for n in versions[:-keep]:
            fs.delete(self._path(graph, "manifest", f"{n}.json"), False)
        gone = 0
        for s in fs.globStatus(self._path(graph, "data", "*", "_bucket=*", "_version=*")) or []:
            p = s.getPath()
            b, t = p.getParent(), p.getParent().getParent()
            if (t.getName(), b.getName().removeprefix("_bucket="), p.getName().removeprefix("_version=")) not in named:
                fs.delete(p, True)
                gone += 1
        return gone

    def bytes_of(self, graph: str, version: int) -> int:
        """Bytes in the folders that ``version`` was the first to name."""
        m, before = self.manifest(graph, version), self.manifest(graph, version - 1) if version > 1 else Manifest()
        fs = self._fs()
        fresh = [(t, b, v) for t, f in m.folders.items() for b, v in f.items() if before.folders.get(t, {}).get(b) != v]
        return sum(fs.getContentSummary(self._path(graph, "data", t, f"_bucket={b}", f"_version={v}")).getLength() for t, b, v in fresh)
