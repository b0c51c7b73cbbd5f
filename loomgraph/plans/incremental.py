"""A stored graph that a delta changes bucket by bucket: what is written follows the change and not the graph.

Facts lie in the bucket of the class that owns them, nodes in that of their class, edges in that of their source. Two
more tables make a change local. ``refs`` (target, kind, owner) says which class names a target, in the target's bucket, so
that a stub comes and goes without a look at other buckets. ``calls_in`` has the calls in the bucket of the called class,
for drawers and for walks against the calls. A delta replaces the facts of its classes (buckets A0); where a class names
something for the first time or no more, the target's bucket joins in (A). Nodes and edges of A are made anew from the facts
and refs of A alone; an edge's target exists by being named. Drawers of the classes next to a change, postings of A and the
ranks that a push reaches follow.

Facts, graph and derived tables are one version of the store, so a reader sees all of a delta or nothing. Methods and fields are
taken to lie in the class that their name begins with.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import index, push, rank, search, traverse
from ..operators.rank import checkpointed
from ..schemas import EDGES, NODES
from ..sources.buckets import BucketStore, Manifest, bucket_of
from ..sources.export import facts
from ..sources.store import Graph
from . import drawers as drawer_plans
from . import spring
from .delta import FACTS, Change, apply_change
from .ingest import capped, conform, edge_load, external_stubs, module_tables, spring_tables, union_all

#: table -> column whose class is the owner
OWNERS = {
    "class": "fqn", "method": "fqn", "field": "fqn", "annotation": "fqn", "calls": "src", "has_method": "dst", "has_field": "dst", "extends": "src", "implements": "src",
    "overrides": "src", "annotated_with": "src", "handles": "src", "bean": "name", "endpoint": "id", "injects": "src", "module": "name", "module_depends": "src",
    "calls_in": "dst", "refs": "target", "overridden": "node", "drawers": "fqn", "postings": "key", "ranks": "node", "class_pagerank": "fqn", "fact.handles": "src",
} | {f"fact.{name}": key for name, key in FACTS.items()}
SECTIONS = {"spring": ("bean", "endpoint", "injects", "fact.handles"), "modules": ("module", "module_depends")}
#: Graph tables that follow from facts and refs of the same buckets.
LINKED = ("class", "method", "field", "annotation", "calls", "has_method", "has_field", "extends", "implements", "overrides", "annotated_with", "handles")
ALPHA, BOOST, TOLERANCE = 0.85, 10.0, 1e-6


def owner(column: str) -> Column:
    return ids.class_of(F.col(column))


def named_in(f: Graph) -> DataFrame:
    """(target, kind, owner) of facts: methods called or overridden, classes extended or implemented, annotations."""
    one = lambda t, target, kind, key: f[t].select(F.col(target).alias("target"), F.lit(kind).alias("kind"), owner(key).alias("owner"))
    rows = [one("callGraph", "calleeFqn", "method", "callerFqn"), one("methodOverrides", "overridesFqn", "method", "methodFqn"), one("inheritance", "parentFqn", "class", "childFqn"), one("annotations", "annotationFqn", "annotation", "targetFqn")]
    return union_all(rows).where("target is not null and target <> ''").distinct()


def linked(f: Graph, refs: DataFrame, endpoints: DataFrame) -> Graph:
    """Nodes and edges of some buckets (or of all) from their facts, the refs into them, and all endpoints."""
    classes, methods, fields = (f[t].dropDuplicates(["fqn"]) for t in ("classes", "methods", "fields"))
    methods = capped(methods)
    to = lambda kind: refs.where(F.col("kind") == kind).select("target").distinct()
    called, none = to("method").toDF("calleeFqn"), to("method").toDF("overridesFqn").where("false")
    class_stubs, method_stubs = external_stubs(classes, methods, called, to("class").toDF("parentFqn"), none)
    g = Graph()
    g["class"] = conform(classes, NODES["class"][1]).unionByName(class_stubs)
    g["method"] = conform(methods, NODES["method"][1]).unionByName(method_stubs)
    g["field"] = conform(fields, NODES["field"][1])
    g["annotation"] = to("annotation").select(F.col("target").alias("fqn"), F.substring_index("target", ".", -1).alias("name"))
    c, m, d = (g[t].select(F.col("fqn").alias("src")) for t in ("class", "method", "field"))

    def edges(rows: DataFrame, src: str, dst: str, sources: DataFrame, *more: str) -> DataFrame:
        pairs = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more).where("dst is not null and dst <> ''")
        return pairs.join(sources, "src", "left_semi").select("src", "dst", *more)

    g["calls"] = edges(f["callGraph"], "callerFqn", "calleeFqn", m, "line")
    g["overrides"] = edges(f["methodOverrides"], "methodFqn", "overridesFqn", m).distinct()
    for name in ("extends", "implements"):
        g[name] = edges(f["inheritance"].where(F.col("relationType") == name.upper()), "childFqn", "parentFqn", c).distinct()
    g["has_method"] = edges(g["method"], "classFqn", "fqn", c).distinct()
    g["has_field"] = edges(g["field"], "classFqn", "fqn", c).distinct()
    targets = union_all([t.select("src", F.lit(k).alias("kind")) for t, k in ((c, "CLASS"), (m, "METHOD"), (d, "FIELD"))])
    used = f["annotations"].select(F.col("targetFqn").alias("src"), F.col("annotationFqn").alias("dst"), F.col("targetKind").alias("kind")).distinct()
    g["annotated_with"] = used.join(targets, ["src", "kind"], "left_semi").select("src", "dst", "kind")
    g["handles"] = edge_load(f["handles"], m, endpoints.select("id"))
    return Graph({n: conform(df, NODES[n][1] if n in NODES else EDGES[n]) for n, df in g.items()})


def _sections(section: Graph | None, modules: DataFrame | None) -> Graph:
    out = Graph()
    if section is not None:
        s = section
        out |= {n: conform(s[n], NODES[n][1] if n in NODES else EDGES[n]) for n in ("bean", "endpoint", "injects")} | {"fact.handles": s["handles"]}
    if modules is not None:
        s = module_tables(modules)
        out |= {"module": conform(s["module"], NODES["module"][1]), "module_depends": conform(s["module_depends"], EDGES["module_depends"])}
    return out


class GraphFiles:
    """Imports into one graph of a bucket store."""

    def __init__(self, store: BucketStore, graph: str):
        self.store, self.graph = store, graph

    def _put(self, m: Manifest, tables: dict[str, DataFrame], only: dict[str, Iterable[int]] | None = None) -> Manifest:
        return self.store.stage(self.graph, m, {t: (df, owner(OWNERS[t]) if t in OWNERS else None) for t, df in tables.items()}, only)

    def _get(self, m: Manifest, tables: Iterable[str], buckets: Iterable[int] | None = None) -> Graph:
        return Graph({t.removeprefix("fact."): self.store._read(self.graph, m, t, buckets) for t in tables if t in m.schemas})

    def _buckets(self, owners: DataFrame, m: Manifest) -> list[int]:
        """Buckets of owners (one column): at most as many as the store has."""
        return sorted(r[0] for r in owners.select(bucket_of(F.col(owners.columns[0]), m.buckets).alias("b")).distinct().collect())

    _FACTS = (*[f"fact.{t}" for t in FACTS], "fact.handles")

    def read(self, version: int | None = None) -> Graph:
        """Graph and derived tables; ``pagerank`` from the stored masses."""
        m = self.store.manifest(self.graph, version)
        g = Graph({t: self.store._read(self.graph, m, t) for t in m.schemas if not t.startswith("fact.")})
        if "ranks" in g:
            total = m.notes.get("mass") or 1.0
            g["pagerank"] = g["ranks"].select("node", (F.col("mass") / F.lit(float(total))).alias("pagerank"))
        return g

    def lookup(self, table: str, keys: list[str] | DataFrame) -> DataFrame:
        """Rows of a table whose owner key (``OWNERS``: fqn of a node, source of an edge, and so on) is among ``keys``, a list or a column ``key``.

        Only the buckets of these keys are opened, and of their files only row groups that may hold one.
        """
        m, column = self.store.manifest(self.graph), OWNERS[table]
        asked = self.store.spark.createDataFrame([(k,) for k in keys], "key string") if isinstance(keys, list) else keys.select("key")
        rows = self.store._read(self.graph, m, table, self._buckets(asked.select(owner("key").alias("o")), m))
        if isinstance(keys, list) and len(keys) <= 100:
            return rows.where(F.col(column).isin(*keys))  # reaches the scan
        return rows.join(push._small(asked.distinct().withColumnRenamed("key", column)), column, "left_semi").select(*rows.columns)

    # --- full import ----------------------------------------------------------
    def import_full(self, doc: DataFrame, *, derive_spring: bool = False, **notes) -> int:
        """``derive_spring``: beans, endpoints and injections come from the facts, here and in later deltas, and not from the export."""
        m = self.store.manifest(self.graph)
        m = self._put(m, {f"fact.{t}": facts(doc, t) for t in FACTS})
        section = spring.tables(self._get(m, [f"fact.{t}" for t in FACTS])) if derive_spring else spring_tables(doc.select("spring"))
        m = self._put(m, _sections(section, doc.select("modules")))
        f = self._get(m, self._FACTS)
        m = self._put(m, {"refs": named_in(f)})
        refs, ends = self._get(m, ["refs"])["refs"], self._get(m, ["endpoint"])["endpoint"]
        m = self._put(m, linked(f, refs, ends))
        g = self._get(m, [*NODES, *EDGES])
        ranks, total, n = rank.mass(g["calls"], rank.entry_seeds(g), alpha=ALPHA, boost=BOOST, tolerance=TOLERANCE)
        ranks = checkpointed(ranks.withColumn("residual", F.lit(0.0)))
        named = ranks.select("node", F.col("mass").alias("pagerank"))
        derived = {"calls_in": g["calls"], "drawers": drawer_plans.drawers(g, self.graph), "postings": search.graph_postings(g), "ranks": ranks, "class_pagerank": _class_mass(g, named)}
        m = self._indexed(self._put(m, derived), None)
        return self.store.commit(self.graph, self._put(m, {"overridden": traverse.overridden(g)}), mass=total, nodes=n, derive_spring=derive_spring, **notes)

    def _indexed(self, m: Manifest, buckets: list[int] | None) -> Manifest:
        """Posting blocks and document numbers of the postings of some buckets, or of all."""
        p = self._get(m, ["postings"], buckets)["postings"]
        own = bucket_of(owner("key"), m.buckets)
        only = {} if buckets is None else {"blocks": buckets, "sizes": buckets}
        return self._put(m, {"blocks": index.blocks(p, own), "sizes": index.sizes(p, own)}, only)

    # --- delta -----------------------------------------------------------------
    def import_delta(self, change: Change, **notes) -> int:
        old = self.store.manifest(self.graph)
        # owners whose facts change: deleted and upserted classes, owners of deleted members and of rows that come in
        rows_of = [df.select(owner(FACTS[t]).alias("owner")) for t, df in change.up.items()]
        members = [] if change.members is None else [change.members.select(owner("member").alias("owner"))]
        owners = checkpointed(union_all([change.gone, *members, *rows_of]).where("owner is not null").distinct())
        a0 = self._buckets(owners, old)
        tables = [f"fact.{t}" for t in FACTS]
        before = self._get(old, tables, a0)
        after = apply_change(before, change)
        m = self._put(old, {f"fact.{t}": after[t] for t in FACTS}, {t: a0 for t in tables})
        section = spring_tables(change.sections["spring"]) if "spring" in change.sections else None
        if old.notes.get("derive_spring"):
            section = spring.tables(self._get(m, tables))
        after = self._get(m, tables, a0)
        # what the changed classes name now and named before
        own = lambda f: named_in(f).join(owners, "owner", "left_semi").select("target", "kind", "owner")
        came, went = checkpointed(own(after)), checkpointed(own(before))
        moved = came.exceptAll(went).unionByName(went.exceptAll(came))
        a = sorted({*a0, *self._buckets(moved.select(owner("target").alias("o")), old)})
        kept = self._get(old, ["refs"], a)["refs"].join(owners, "owner", "left_anti").select("target", "kind", "owner")
        m = self._put(m, {"refs": kept.unionByName(came)} | _sections(section, change.sections.get("modules")), {"refs": a})
        ends_anew = section is not None
        ends = self._get(m, ["endpoint"])["endpoint"]
        made = linked(self._get(m, self._FACTS, a), self._get(m, ["refs"], a)["refs"], ends)
        only: dict[str, Iterable[int]] = {t: a for t in LINKED}
        m = self._put(m, {t: df for t, df in made.items() if t != "handles" or not ends_anew}, only)
        if ends_anew:  # beans and endpoints are replaced whole
            m = self._put(m, {"handles": edge_load(self._get(m, ["fact.handles"])["handles"], self._get(m, ["method"])["method"].select("fqn"), ends.select("id"))})
        # calls, by the called class
        calls = lambda k: self._get(k, ["calls"], a)["calls"]
        lost, won = checkpointed(calls(old).exceptAll(calls(m))), checkpointed(calls(m).exceptAll(calls(old)))
        into = self._buckets(lost.unionByName(won).select(owner("dst").alias("o")), old)
        m = self._put(m, {"calls_in": self._get(old, ["calls_in"], into)["calls_in"].exceptAll(lost).unionByName(won)}, {"calls_in": into})
        # tables that do not need one another
        parts = {
            "drawers": lambda: (self._drawers(old, m, owners, came.unionByName(went), a0, ends_anew), {}),
            "postings": lambda: (self._postings(m, None if ends_anew else a, ends), {}),
            "overridden": lambda: (self._overridden(old, m, a), {}),
            "ranks": lambda: self._ranks(old, m, a, ends_anew),
        }
        results = [["drawers"], ["postings", "blocks", "sizes"], ["overridden"], ["ranks", "class_pagerank"]]
        with ThreadPoolExecutor(len(parts)) as pool:
            made_by = list(pool.map(inheritable_thread_target(self.store.spark)(lambda f: f()), parts.values()))
        done, more = replace(m, folders=dict(m.folders)), {}
        for (x, said), tables in zip(made_by, results):
            done.folders |= {t: x.folders[t] for t in tables}
            more |= said
        return self.store.commit(self.graph, done, **more, **notes)

    def _postings(self, m: Manifest, buckets: list[int] | None, ends: DataFrame) -> Manifest:
        g = self._get(m, ["class", "method"], buckets) | {"endpoint": ends}
        return self._indexed(self._put(m, {"postings": search.graph_postings(g)}, {} if buckets is None else {"postings": buckets}), buckets)

    def _overridden(self, old: Manifest, m: Manifest, a: list[int]) -> Manifest:
        """A small table, made anew only if an override came or went."""
        was, now = (self._get(k, ["overrides"], a)["overrides"] for k in (old, m))
        if was.exceptAll(now).isEmpty() and now.exceptAll(was).isEmpty():
            return m
        return self._put(m, {"overridden": traverse.overridden(self._get(m, ["overrides"]))})

    def _drawers(self, old: Manifest, m: Manifest, owners: DataFrame, named: DataFrame, a0: list[int], ends_anew: bool) -> Manifest:
        if ends_anew:
            return self._put(m, {"drawers": drawer_plans.drawers(self._get(m, [*NODES, *EDGES]), self.graph)})
        users = [self._get(k, ["refs"], a0)["refs"].select(owner("target").alias("o"), "owner").join(owners.withColumnRenamed("owner", "o"), "o", "left_semi").select("owner") for k in (old, m)]
        near = union_all([owners, *users, named.select(owner("target").alias("owner"))]).distinct()
        # only what has a file has drawers; a changed class loses its own first
        b = self._buckets(near, m)
        there = self._get(m, ["class"], b)["class"].where("coalesce(filePath, '') <> ''").select(F.col("fqn").alias("owner"))
        near = checkpointed(owners.unionByName(near.join(there, "owner", "left_semi")).distinct().select(F.col("owner").alias("fqn")))
        b = self._buckets(near, m)
        tables = ["class", "method", "field", "has_method", "extends", "implements", "annotated_with", "handles"]
        g = self._get(m, tables, b) | self._get(m, ["endpoint", "bean", "injects"])
        out, back = self._get(m, ["calls"], b)["calls"], self._get(m, ["calls_in"], b)["calls_in"]
        other = back.where(~bucket_of(owner("src"), m.buckets).isin(*b) if b else F.lit(True))
        g["calls"] = out.unionByName(other)
        renewed = drawer_plans.renew(self._get(m, ["drawers"], b)["drawers"], Graph(g), self.graph, near)
        return self._put(m, {"drawers": renewed}, {"drawers": b})

    def _ranks(self, old: Manifest, m: Manifest, a: list[int], ends_anew: bool) -> tuple[Manifest, dict]:
        """Ranks by pushing what changed; with new endpoints, which may be anywhere, over all tables."""
        part = None if ends_anew else a
        seeds = lambda k: rank.entry_seeds(self._get(k, ["annotated_with", "handles"], part))
        edges = lambda k, b: self._get(k, ["calls"], b)["calls"].select("src", "dst").distinct()
        was, now = checkpointed(edges(old, a)), checkpointed(edges(m, a))
        sources = checkpointed(push.changed_sources(was, now))
        was, now = was.join(sources, "src", "left_semi"), now.join(sources, "src", "left_semi")
        seed_old, seed_new = checkpointed(seeds(old)), checkpointed(seeds(m))
        entries = seed_old.exceptAll(seed_new).unionByName(seed_new.exceptAll(seed_old))
        if sources.isEmpty() and entries.isEmpty() and not ends_anew:
            return self._class_ranks(m, a), {"pushes": 0, "pushed": 0}
        nodes = checkpointed(union_all([sources.select(F.col("src").alias("node")), was.select(F.col("dst").alias("node")), now.select(F.col("dst").alias("node")), entries]).distinct())
        b = self._buckets(nodes.select(owner("node").alias("o")), m)
        ends = self._get(m, ["calls"], b)["calls"].select(F.col("src").alias("node")).unionByName(self._get(m, ["calls_in"], b)["calls_in"].select(F.col("dst").alias("node"))).distinct()
        is_seed = rank.entry_seeds(self._get(m, ["annotated_with", "handles"], b)).withColumn("s", F.lit(True))
        weights = nodes.join(ends.withColumn("e", F.lit(True)), "node", "left").join(is_seed, "node", "left")
        weights = checkpointed(weights.select("node", F.when(F.col("s"), BOOST).when(F.col("e"), 1.0).otherwise(0.0).alias("w")))
        ranks = self._get(old, ["ranks"], b)["ranks"]
        state = push.start(was, now, ranks, weights, ALPHA)

        def of(k: Manifest, table: str, asked: DataFrame, column: str) -> DataFrame:
            got = self._get(k, [table], self._buckets(asked.select(owner("node").alias("o")), k))[table]
            return got.join(push._small(asked.select(F.col("node").alias(column))), column, "left_semi")

        cut = TOLERANCE * (1 - ALPHA) * max(old.notes.get("mass", 0.0), 1.0) / max(old.notes.get("nodes", 1), 1)
        kept = lambda asked: of(old, "ranks", asked, "node").select("node", "residual")
        state, pushes, work = push.push(state, kept, lambda asked: of(m, "calls", asked, "src").select("src", "dst").distinct(), cut, ALPHA)
        reached = self._buckets(state.select(owner("node").alias("o")).unionByName(weights.select(owner("node").alias("o"))), m)
        before = self._get(old, ["ranks"], reached)["ranks"]
        after = checkpointed(push.merged(before, state, weights))
        both = [df.agg(F.coalesce(F.sum("mass"), F.lit(0.0)), F.count(F.lit(1))).first() for df in (before, after)]
        m = self._put(m, {"ranks": after}, {"ranks": reached})
        m = self._class_ranks(m, sorted({*reached, *a}))
        return m, {"mass": old.notes.get("mass", 0.0) + both[1][0] - both[0][0], "nodes": old.notes.get("nodes", 0) + both[1][1] - both[0][1], "pushes": pushes, "pushed": work}

    def _class_ranks(self, m: Manifest, owned: list[int]) -> Manifest:
        g = self._get(m, ["class", "has_method"], owned)
        named = self._get(m, ["ranks"], owned)["ranks"].select("node", F.col("mass").alias("pagerank"))
        return self._put(m, {"class_pagerank": _class_mass(g, named)}, {"class_pagerank": owned})


def _class_mass(graph: Graph, masses: DataFrame) -> DataFrame:
    return rank.class_pagerank(graph, masses).withColumnRenamed("pagerank", "mass")
