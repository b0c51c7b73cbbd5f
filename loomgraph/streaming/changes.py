"""File changes as a stream: classified, debounced by session windows, applied in micro-batches.

A rename is a delete and a modify; within a session the last event of a path wins.
A session closes after ``gap`` without an event of its project; batches are applied one after another, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Build output and tool folders that are never watched.
EXCLUDED = ("/build/", "/target/", "/out/", "/.gradle/", "/.idea/")

EVENTS = "project string, ts timestamp, seq long, event string, path string, old_path string"


def classify(events: DataFrame, suffix: str = ".java") -> DataFrame:
    """(project, ts, seq, path, kind) with kind modify or delete, of events create, modify, delete, move and rename."""
    moved = F.col("event").isin("move", "rename")
    pair = lambda p, k: F.struct(p.alias("path"), F.lit(k).alias("kind"))
    both = F.when(moved, F.array(pair(F.col("old_path"), "delete"), pair(F.col("path"), "modify"))).when(F.col("event") == "delete", F.array(pair(F.col("path"), "delete"))).otherwise(F.array(pair(F.col("path"), "modify")))
    rows = events.select("project", "ts", "seq", F.explode(both).alias("x")).select("project", "ts", "seq", "x.*")
    keep = F.col("path").endswith(suffix)
    for folder in EXCLUDED:
        keep = keep & ~F.concat(F.lit("/"), F.col("path")).contains(folder)  # relative paths too
    return rows.where(keep)


def debounce(changes: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """(project, start, end, changes): one row a session, with the last kind of each path, sorted. Batch or stream (with a watermark on ts).

    A batch takes the last event of each path before it collects a session's paths. A stream's state holds the
    session's events, and its paths come from one pass over them in order.
    """
    w = F.session_window("ts", gap).alias("w")
    if changes.isStreaming:
        s = changes.groupBy("project", w).agg(F.collect_list(F.struct("path", "seq", "kind")).alias("all"))
        last = lambda a: F.filter(a, lambda x, i: ~x["path"].eqNullSafe(F.get(a, i + 1)["path"]) | (i == F.size(a) - 1))
        paths = F.transform(let(F.array_sort("all"), last), lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind")))
        return s.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), paths.alias("changes"))
    # a session's first row stands before its events, which take its bounds
    bounds = changes.groupBy("project", w).agg(F.lit(True).alias("first")).select("project", F.col("w.start").alias("ts"), F.col("w").alias("s"))
    rows = changes.select("project", "ts", "seq", "path", "kind").unionByName(bounds, allowMissingColumns=True)
    before = Window.partitionBy("project").orderBy("ts", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("w", F.last("s", ignorenulls=True).over(before)).where("s is null")
    each = held.groupBy("project", "w", "path").agg(F.max(F.struct("seq", "kind"))["kind"].alias("kind"))
    s = each.groupBy("project", "w").agg(F.array_sort(F.collect_list(F.struct("path", "kind"))).alias("changes"))
    return s.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, gap: str = "5 seconds", late: str = "10 minutes", **trigger):
    """Start the stream; ``apply`` gets the closed sessions of each micro-batch and its id, by which it can tell repeats."""
    sessions = debounce(classify(events).withWatermark("ts", late), gap)
    return sessions.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
