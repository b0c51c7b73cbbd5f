"""Incremental import: facts of changed classes replace the old ones, then the tables are built as for a full import.

Edges are kept by name, so calls from unchanged classes into a replaced class
survive; they are lost only with the target itself, and then become stubs. A
document whose ``spring`` is null leaves beans and endpoints as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.export import facts
from ..sources.store import Graph
from .ingest import build

#: fact table -> column with the owner's name
FACTS = {"classes": "fqn", "methods": "fqn", "fields": "fqn", "callGraph": "callerFqn", "inheritance": "childFqn", "methodOverrides": "methodFqn", "annotations": "targetFqn"}


def fact_tables(doc: DataFrame) -> Graph:
    """The fact tables of a full document; what a store keeps beside the graph for later deltas."""
    return Graph({name: facts(doc, name) for name in FACTS} | {name: doc.select(name) for name in ("spring", "modules")})


@dataclass
class Change:
    """What a delta says: owners that go (column owner), members that go (column member, or None), fact rows that come in by table, and new sections."""

    gone: DataFrame
    members: DataFrame | None
    up: dict[str, DataFrame]
    sections: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def touched(self) -> DataFrame:
        """(owner): every deleted or upserted class."""
        return self.gone.unionByName(self.up["classes"].select(F.col("fqn").alias("owner"))).distinct()


def read_change(delta: DataFrame) -> Change:
    """Of a delta document."""
    members = delta.select(F.explode(F.concat(F.coalesce("deleted.methods", F.array()), F.coalesce("deleted.fields", F.array()))).alias("member")).distinct()
    sections = {}
    for name in ("spring", "modules"):
        new = delta.select(name).where(F.col(name).isNotNull())
        if not new.isEmpty():
            sections[name] = new
    return Change(delta.select(F.explode("deleted.classes").alias("owner")), members, {name: facts(delta, f"upserted.{name}") for name in FACTS}, sections)


def apply_delta(old: Graph, delta: DataFrame) -> Graph:
    return apply_change(old, read_change(delta))


def apply_change(old: Graph, change: Change) -> Graph:
    """New fact tables: for every deleted or upserted class all it owns goes, then the upserted rows come in."""
    from ..operators.rank import checkpointed
    from ..operators.traverse import sent

    out, touched = Graph(), sent(checkpointed(change.touched))
    for name, key in FACTS.items():
        rows = old[name].withColumn("owner", ids.class_of(F.col(key))).join(touched, "owner", "left_anti").drop("owner")
        if change.members is not None:
            rows = rows.join(change.members.withColumnRenamed("member", key), key, "left_anti")
        rows, fresh = rows.select(*old[name].columns), change.up.get(name)
        if fresh is not None:
            if name == "classes":  # a delta knows no line numbers: keep the old ones
                before = old[name].select("fqn", F.col("lineStart").alias("_s"), F.col("lineEnd").alias("_e")).dropDuplicates(["fqn"])
                line = lambda c, o: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.coalesce(o, F.col(c))).otherwise(F.col(c)).alias(c)
                joined = fresh.join(before, "fqn", "left")
                fresh = joined.select(*[line(c, "_s" if c == "lineStart" else "_e") if c in ("lineStart", "lineEnd") else F.col(c) for c in fresh.columns])
            if name in ("callGraph", "methodOverrides", "inheritance", "annotations"):
                fresh = fresh.dropDuplicates([c for c in fresh.columns if c != "params"])
            rows = rows.unionByName(fresh, allowMissingColumns=True).select(*old[name].columns)
        out[name] = rows
    for name in ("spring", "modules"):
        if name in change.sections or name in old:
            out[name] = change.sections.get(name, old.get(name))
    return out


def graph_of(tables: Graph) -> Graph:
    from .ingest import module_tables, spring_tables

    return build(*[tables[n] for n in FACTS], spring_tables(tables["spring"]), module_tables(tables["modules"]))


def choose_sync_mode(changed: int, total: int, is_ancestor: bool) -> str:
    """none, delta or full: full if history diverged or over three tenths of the files changed."""
    if not is_ancestor:
        return "full"
    if changed == 0:
        return "none"
    return "full" if total and changed > 0.3 * total else "delta"
