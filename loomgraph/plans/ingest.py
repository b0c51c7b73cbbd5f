"""Full import: export document -> typed node and edge tables, with stubs for what the project only refers to.

Nulls stay null; nodes are unique by key; an edge is kept when both ends exist (semi joins, so that nothing multiplies).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import EDGES, NODES
from ..sources.export import facts
from ..sources.store import Graph


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns and types of ``ddl``; missing ones are null."""
    want = [c.strip().split(" ") for c in ddl.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in want])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def edge_load(edges: DataFrame, src_keys: DataFrame, dst_keys: DataFrame) -> DataFrame:
    """Edges whose ends are both among the one-column key tables."""
    s, d = src_keys.toDF("src"), dst_keys.toDF("dst")
    return edges.join(s, "src", "left_semi").join(d, "dst", "left_semi").select(*edges.columns)


def external_stubs(classes: DataFrame, methods: DataFrame, calls: DataFrame, inheritance: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class stubs, method stubs): what is called, extended, implemented or overridden but not exported.

    A stub of a class of the project (an implicit constructor) has external = false; all others have true.
    """
    own = classes.select("fqn")
    refs = union_all([calls.select(F.col("calleeFqn").alias("fqn")), overrides.select(F.col("overridesFqn").alias("fqn"))]).where("fqn is not null and fqn <> ''").distinct()
    fresh = refs.join(methods.select("fqn"), "fqn", "left_anti").withColumn("classFqn", ids.class_of(F.col("fqn")))
    mine = own.select(F.col("fqn").alias("classFqn"), F.lit(True).alias("mine")).distinct()
    m = fresh.join(mine, "classFqn", "left").select("fqn", ids.method_name(F.col("fqn")).alias("name"), "classFqn", ids.is_constructor(F.col("fqn")).alias("isConstructor"), F.col("mine").isNull().alias("external"))
    parents = inheritance.select(F.col("parentFqn").alias("fqn")).where("fqn is not null and fqn <> ''")
    c = union_all([parents, m.select(F.col("classFqn").alias("fqn"))]).distinct().join(own, "fqn", "left_anti")
    c = c.select("fqn", ids.simple_class(F.col("fqn")).alias("name"), F.lit("EXTERNAL").alias("kind"), ids.package_of(F.col("fqn")).alias("packageName"), F.lit(True).alias("external"))
    return conform(c, NODES["class"][1]), conform(m, NODES["method"][1])


def annotation_dim(annotations: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct non-empty annotation names of all sources (one-column tables)."""
    names = union_all([annotations.select(F.col("annotationFqn").alias("fqn")), *[m.toDF("fqn") for m in more]])
    return names.where("fqn is not null and fqn <> ''").distinct().select("fqn", F.substring_index("fqn", ".", -1).alias("name"))


def spring_tables(doc: DataFrame) -> Graph:
    return spring_rows(facts(doc, "spring.beans"), facts(doc, "spring.endpoints"), facts(doc, "spring.injections"))


def spring_rows(beans: DataFrame, ends: DataFrame, inj: DataFrame) -> Graph:
    ends = ends.withColumn("id", ids.endpoint_id(F.col("httpMethod"), F.col("path")))
    g = Graph()
    g["bean"] = conform(beans.dropDuplicates(["name"]), NODES["bean"][1])
    g["endpoint"] = conform(ends.groupBy("id").agg(F.min(F.struct("path", "httpMethod", "controllerFqn", "handlerMethodFqn")).alias("e")).select("id", "e.*"), NODES["endpoint"][1])
    g["handles"] = ends.select(F.col("handlerMethodFqn").alias("src"), F.col("id").alias("dst")).distinct()
    by_class = beans.select("classFqn", "name").distinct()
    src, dst = by_class.toDF("targetClassFqn", "src"), by_class.toDF("injectedClassFqn", "dst")
    g["injects"] = inj.join(src, "targetClassFqn").join(dst, "injectedClassFqn").select("src", "dst", F.col("targetFieldOrParam").alias("field"), F.col("injectionType").alias("type"))
    return g


def module_tables(doc: DataFrame) -> Graph:
    modules = facts(doc, "modules")
    deps = modules.select(F.col("name").alias("src"), F.explode("dependencies").alias("d")).select("src", F.col("d.moduleName").alias("dst"), F.col("d.scope").alias("scope"))
    return Graph(module=conform(modules.dropDuplicates(["name"]), NODES["module"][1]), module_depends=deps.distinct())


#: Longer bodies are left out, longer javadoc is cut.
MOST_BODY, MOST_JAVADOC = 20_000, 2_000


def capped(methods: DataFrame) -> DataFrame:
    return methods.withColumns({"body": F.when(F.length("body") <= MOST_BODY, F.col("body")), "javadoc": F.substring("javadoc", 1, MOST_JAVADOC)})


def build(classes, methods, fields, calls, inheritance, overrides, annotations, spring: Graph, modules: Graph) -> Graph:
    """Graph tables from the fact tables of an export (or from those after a delta).

    Classes, methods and calls are written, since most other tables and all that reads a graph ask for them.
    """
    from ..operators.rank import checkpointed

    classes, methods, fields = classes.dropDuplicates(["fqn"]), capped(methods.dropDuplicates(["fqn"])), fields.dropDuplicates(["fqn"])
    class_stubs, method_stubs = external_stubs(classes, methods, calls, inheritance, overrides)
    g = Graph(spring | modules)
    g["method"] = checkpointed(conform(methods, NODES["method"][1]).unionByName(method_stubs))
    g["class"] = checkpointed(conform(classes, NODES["class"][1]).unionByName(class_stubs))
    g["field"] = conform(fields, NODES["field"][1])
    g["annotation"] = annotation_dim(annotations)
    c, m, f = (g[t].select("fqn") for t in ("class", "method", "field"))
    pair = lambda df, a, b, *more: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), *more)
    g["has_method"] = edge_load(pair(g["method"], "classFqn", "fqn"), c, m).distinct()
    g["has_field"] = edge_load(pair(g["field"], "classFqn", "fqn"), c, f).distinct()
    for name in ("extends", "implements"):
        g[name] = edge_load(pair(inheritance.where(F.col("relationType") == name.upper()), "childFqn", "parentFqn"), c, c).distinct()
    g["calls"] = checkpointed(_called(pair(calls, "callerFqn", "calleeFqn", "line"), m))
    g["overrides"] = edge_load(pair(overrides, "methodFqn", "overridesFqn"), m, m).distinct()
    targets = union_all([t.select(F.col("fqn").alias("src"), F.lit(k).alias("kind")) for t, k in ((c, "CLASS"), (m, "METHOD"), (f, "FIELD"))])
    used = annotations.select(F.col("targetFqn").alias("src"), F.col("annotationFqn").alias("dst"), F.col("targetKind").alias("kind")).distinct()
    g["annotated_with"] = used.join(targets, ["src", "kind"], "left_semi").select("src", "dst", "kind")
    g["handles"] = edge_load(g["handles"], m, g["endpoint"].select("id"))
    return Graph({n: conform(g[n], ddl) for n, ddl in [(n, d) for n, (_, d) in NODES.items()] + list(EDGES.items())})


def _called(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """``edge_load`` of the largest table, written half-way, so that the shuffles by either end do not lie beside each other."""
    from ..operators.rank import checkpointed

    half = checkpointed(edges.join(methods.toDF("src"), "src", "left_semi"))
    return half.join(methods.toDF("dst"), "dst", "left_semi").select(*edges.columns)


def ingest_full(doc: DataFrame) -> Graph:
    """Graph tables of a full document; ``export.read_full`` has parsed one in shards."""
    f = lambda c: facts(doc, c)
    spring = spring_rows(f("spring.beans"), f("spring.endpoints"), f("spring.injections"))
    return build(f("classes"), f("methods"), f("fields"), f("callGraph"), f("inheritance"), f("methodOverrides"), f("annotations"), spring, module_tables(doc))
