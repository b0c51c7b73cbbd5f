"""Reports over the graph: counts, finders, entry points, unused code and the recipe book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.ingest import union_all
from ..schemas import LABELS
from ..sources.store import Graph
from .index import containing
from .rank import ENTRY_ANNOTATIONS


def stats(graph: Graph) -> DataFrame:
    """(label, n) for every label, zeros too, and the total."""
    each = union_all([graph[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for t, label in LABELS.items()])
    return each.unionByName(each.agg(F.sum("n").alias("n")).select(F.lit("total").alias("label"), "n"))


def find_class(graph: Graph, part: str, limit: int = 20) -> DataFrame:
    return graph["class"].where(F.col("name").contains(part)).select("fqn", "name", "kind", "filePath").orderBy("fqn").limit(limit)


def find_classes(graph: Graph, parts: DataFrame, limit: int = 20) -> DataFrame:
    """``find_class`` for a table of parts (query_id, needle): (query_id, fqn, name, kind, filePath)."""
    names = graph["class"].select(F.lit("class").alias("field"), F.col("name").alias("text"), "fqn", "name", "kind", "filePath")
    found = containing(names, parts.select("query_id", F.lit("class").alias("field"), "needle"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("fqn"))
    return found.withColumn("_n", first).where(F.col("_n") <= limit).select("query_id", "fqn", "name", "kind", "filePath")


def entry_points(graph: Graph) -> DataFrame:
    """(fqn, type, detail): handlers, scheduled or post-construct methods, and project main methods."""
    e = graph["handles"].join(graph["endpoint"].select(F.col("id").alias("dst"), F.concat_ws(" ", "httpMethod", "path").alias("detail")), "dst")
    http = e.select(F.col("src").alias("fqn"), F.lit("ENDPOINT").alias("type"), "detail")
    timed = graph["annotated_with"].where(F.col("dst").isin(*ENTRY_ANNOTATIONS) & (F.col("kind") == "METHOD")).select(F.col("src").alias("fqn"), F.lit("SCHEDULED").alias("type"), F.substring_index("dst", ".", -1).alias("detail"))
    main = graph["method"].where((F.col("name") == "main") & F.col("external").isNull()).select("fqn", F.lit("MAIN").alias("type"), F.lit("main").alias("detail"))
    return union_all([http, timed, main]).distinct()


def unused_methods(graph: Graph) -> DataFrame:
    """Project methods that nothing calls, constructors aside."""
    m = graph["method"].where(~F.coalesce("isConstructor", F.lit(False)) & ~ids.is_external(F.col("external")))
    return m.join(graph["calls"].select(F.col("dst").alias("fqn")), "fqn", "left_anti").select("fqn", "name", "classFqn", "filePath")


def unused_methods_strict(graph: Graph) -> DataFrame:
    """Without what every object has, and without constructors the export did not list."""
    return unused_methods(Graph(graph | {"method": graph["method"].where(F.col("external").isNull() & ~F.col("name").isin("toString", "hashCode", "equals"))}))


def subclasses(graph: Graph, fqn: str) -> DataFrame:
    up = graph["extends"].withColumn("how", F.lit("EXTENDS")).unionByName(graph["implements"].withColumn("how", F.lit("IMPLEMENTS")))
    return up.where(F.col("dst") == fqn).select(F.col("src").alias("fqn"), "how").distinct()


def bean_deps(graph: Graph) -> DataFrame:
    b = graph["bean"]
    left = b.select(F.col("name").alias("src"), F.col("classFqn").alias("owner"))
    right = b.select(F.col("name").alias("dst"), F.col("classFqn").alias("needs"))
    return graph["injects"].join(left, "src").join(right, "dst").select("src", "owner", "dst", "needs", "field", "type")


def overriders(graph: Graph, fqn: str) -> DataFrame:
    m = graph["method"].select(F.col("fqn").alias("src"), "classFqn")
    return graph["overrides"].where(F.col("dst") == fqn).join(m, "src").select(F.col("src").alias("fqn"), "classFqn")


def annotated(graph: Graph, name: str) -> DataFrame:
    """Everything with an annotation of this full or simple name."""
    hit = (F.col("dst") == name) | (F.substring_index("dst", ".", -1) == name)
    return graph["annotated_with"].where(hit).select(F.col("src").alias("fqn"), "kind", F.col("dst").alias("annotation"))


def class_impact(graph: Graph, class_fqn: str) -> DataFrame:
    """(className, n): call sites in other classes that call into the class."""
    m = graph["method"].select("fqn", "classFqn")
    into = graph["calls"].join(m.where(F.col("classFqn") == class_fqn).select(F.col("fqn").alias("dst")), "dst", "left_semi")
    who = into.join(m.select(F.col("fqn").alias("src"), F.col("classFqn").alias("className")), "src").where(F.col("className") != class_fqn)
    return who.groupBy("className").agg(F.count(F.lit(1)).alias("n"))


def class_blast(graph: Graph, class_fqn: str, limit: int = 20) -> DataFrame:
    return class_impact(graph, class_fqn).orderBy(F.desc("n"), "className").limit(limit)


def key_services(graph: Graph, limit: int = 5) -> DataFrame:
    """Classes of the project with the most distinct callers."""
    m = graph["method"].where(~ids.is_external(F.col("external"))).select(F.col("fqn").alias("dst"), "classFqn")
    top = graph["calls"].join(m, "dst").groupBy("classFqn").agg(F.countDistinct("src").alias("callers"))
    return top.orderBy(F.desc("callers"), "classFqn").limit(limit)


def library_usage(graph: Graph, prefix: str) -> DataFrame:
    """Call sites into external methods whose name starts with ``prefix``."""
    ext = graph["method"].where(F.col("external") & F.col("fqn").startswith(prefix)).select(F.col("fqn").alias("dst"))
    return graph["calls"].join(ext, "dst", "left_semi").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "line")


def library_counts(graph: Graph) -> DataFrame:
    """(library, calls): call sites by the first two package segments of external callees."""
    ext = graph["method"].where("external").select(F.col("fqn").alias("dst"), F.concat_ws(".", F.slice(F.split("fqn", r"\."), 1, 2)).alias("library"))
    return graph["calls"].join(ext, "dst").groupBy("library").agg(F.count(F.lit(1)).alias("calls"))


def locations(graph: Graph, names: DataFrame) -> DataFrame:
    """(fqn, label, file, line) for names (column fqn): method first, then class, then endpoint (its handler's place)."""
    m = graph["method"].select("fqn", F.lit("method").alias("l1"), F.col("filePath").alias("f1"), F.col("lineStart").alias("n1"))
    c = graph["class"].select("fqn", F.lit("class").alias("l2"), F.col("filePath").alias("f2"), F.col("lineStart").alias("n2"))
    h = graph["method"].select(F.col("fqn").alias("handlerMethodFqn"), F.col("filePath").alias("f3"), F.col("lineStart").alias("n3"))
    e = graph["endpoint"].join(h, "handlerMethodFqn", "left").select(F.col("id").alias("fqn"), F.lit("endpoint").alias("l3"), "f3", "n3")
    out = names.select("fqn").distinct().join(m, "fqn", "left").join(c, "fqn", "left").join(e, "fqn", "left")
    return out.select("fqn", F.coalesce("l1", "l2", "l3").alias("label"), F.coalesce("f1", "f2", "f3").alias("file"), F.coalesce("n1", "n2", "n3").alias("line"))


def neighbors(graph: Graph, names: DataFrame, limit: int = 5) -> DataFrame:
    """(fqn, callers, callees): up to ``limit`` of each, in order of name."""
    n, c = names.select("fqn").distinct(), graph["calls"]

    def few(a: str, b: str) -> DataFrame:
        # the rank filter keeps each task's first names of a key, so a method that all call is not collected
        w = Window.partitionBy("fqn").orderBy(b)
        near = c.join(n.withColumnRenamed("fqn", a), a, "left_semi").select(F.col(a).alias("fqn"), b).distinct()
        kept = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
        return kept.groupBy("fqn").agg(F.array_sort(F.collect_list(b)).alias(b))

    none = F.array().cast("array<string>")
    return n.join(few("dst", "src"), "fqn", "left").join(few("src", "dst"), "fqn", "left").select("fqn", F.coalesce("src", none).alias("callers"), F.coalesce("dst", none).alias("callees"))


def snippets(spans: DataFrame, files: DataFrame, most: int = 80) -> DataFrame:
    """(fqn, snippet) for spans (fqn, file, start, end) over files (path, text): the lines, at most ``most``; empty if there is no file."""
    stop = F.when(F.col("end") <= F.col("start"), F.col("start") + most).otherwise(F.col("end"))
    size = F.greatest(F.least(stop - F.col("start") + 1, F.lit(most)), F.lit(1))
    j = spans.join(files, spans["file"] == files["path"], "left")
    text = F.rtrim(F.array_join(F.slice(F.split("text", "\n"), F.greatest("start", F.lit(1)), size), "\n"))
    return j.select("fqn", F.coalesce(text, F.lit("")).alias("snippet"))
