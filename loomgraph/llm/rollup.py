"""Token counts as delta-maintained rollups.

A batch of signed changes (an insert, a delete, or a revision: the old count out,
the new one in) is summed by source, language and tokenizer version and written as
one batch of the delta table. Totals are the sums over all committed batches, so no
text is counted twice. A batch has an id; committing an id again replaces that
batch's own rows and leaves the totals as they were. Any token count can be summed:
``word_count``, or the ids of ``bpe`` under a version's name.

Defined results: null source, language or version are groups of their own; null
text counts zero tokens; groups whose documents and tokens are both zero are not
reported; an empty batch is a commit without rows. Repeated rows count as often as
they come; a text of any length is one number here. Columns other than the group's
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def word_count(text: Column) -> Column:
    """Words split by ASCII blanks."""
    packed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(packed == "", 0).otherwise(F.length(packed) - F.length(F.replace(packed, F.lit(" "), F.lit(""))) + 1).cast("long")


def inserts(df: DataFrame, tokenizer: str, count: Column) -> DataFrame:
    return _changes(df, tokenizer, F.lit(1), count)


def deletes(df: DataFrame, tokenizer: str, count: Column) -> DataFrame:
    return _changes(df, tokenizer, F.lit(-1), -count)


def revisions(df: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    return _changes(df, tokenizer, F.lit(0), after - before)


def _changes(df: DataFrame, tokenizer: str, docs: Column, tokens: Column) -> DataFrame:
    return df.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), docs.cast("long").alias("d_docs"), tokens.cast("long").alias("d_tokens"))


class TokenRollup:
    """A delta table in a folder all executors share: ``<path>/batches/<id>/v<n>/`` and, once compacted, ``<path>/snapshots/v<n>/``.

    A commit is written beside the earlier one of its id and counts once its own record ``_committed`` stands, which is
    written last, so one that fails leaves the earlier in force. Success marks of Spark's committer play no part. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Sum the batch and put it in place of any earlier commit of the same id."""
        if not batch_id or any(c not in "abcdefghijklmnopqrstuvwxyz0123456789-_" for c in batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        delta = changes.groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        self._write(delta.where("n_docs <> 0 or n_tokens <> 0"), f"batches/{batch_id}")

    def batches(self) -> dict[str, int]:
        """Committed ids and the version in force of each."""
        return {b: n for b in self._names("batches") if (n := self._version(f"batches/{b}"))}

    def compact(self) -> None:
        """Write the totals as a snapshot with the versions it covers; later totals read it and what was committed since."""
        covered = list(self.batches().items())
        # versions stay where they are, so a snapshot and later commits of what it covers do not disturb each other
        n = self._next("snapshots")
        # both parts, then the record
        self._sum(covered).write.parquet(f"{self.path}/snapshots/{n}/sums")
        self.spark.createDataFrame(covered, "batch string, version int").coalesce(1).write.parquet(f"{self.path}/snapshots/{n}/covers")
        self._record(f"snapshots/{n}")

    def totals(self) -> DataFrame:
        return self._sum(list(self.batches().items()))

    def _sum(self, batches: list[tuple[str, int]]) -> DataFrame:
        """Newest snapshot, plus versions that it does not cover, less covered ones that are not in force any more."""
        n = self._version("snapshots")
        covered = {(r.batch, r.version) for r in self.spark.read.parquet(f"{self.path}/snapshots/v{n}/covers").collect()} if n else set()
        rows = self._read([f"snapshots/v{n}/sums"] if n else [], 1)
        rows = rows.unionByName(self._read([f"batches/{b}/v{v}" for b, v in batches if (b, v) not in covered], 1))
        rows = rows.unionByName(self._read([f"batches/{b}/v{v}" for b, v in sorted(covered - set(batches))], -1))
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def _read(self, paths: list[str], sign: int) -> DataFrame:
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.select(*GROUP, *[(F.col(c) * sign).alias(c) for c in ("n_docs", "n_tokens")])

    def _write(self, df: DataFrame, folder: str) -> None:
        n = self._next(folder)
        df.write.parquet(f"{self.path}/{folder}/{n}")
        self._record(f"{folder}/{n}")

    def _record(self, folder: str) -> None:
        fs, path = self._fs(f"{folder}/_committed")
        fs.create(path, True).close()

    def _next(self, folder: str) -> str:
        """A version that no attempt has used, failed ones included."""
        return f"v{max([int(x[1:]) for x in self._names(folder)], default=0) + 1}"

    def _version(self, folder: str, mark: str = "_committed") -> int:
        """The newest complete version, 0 if there is none."""
        for n in sorted((int(x[1:]) for x in self._names(folder)), reverse=True):
            fs, path = self._fs(f"{folder}/v{n}/{mark}")
            if fs.exists(path):
                return n
        return 0

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path
