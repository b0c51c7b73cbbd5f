"""Drawers: one text document with metadata for each method, class and endpoint worth finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import clean_javadoc
from ..operators.rank import checkpointed, importance
from ..operators.traverse import SENT, sent
from ..sources.store import Graph
from .ingest import ingest_full, union_all


def _names(edges: DataFrame, key: str, other: str, first: int, most: int) -> DataFrame:
    """(fqn, names): short names of the first ``first`` by call line and name, distinct, sorted, ``most`` at most."""
    # the row_number filter keeps each task's first rows of a key, so a method that all call is not collected
    w = Window.partitionBy("fqn").orderBy("l", "o")
    sites = edges.select(F.col(key).alias("fqn"), F.coalesce("line", F.lit(0)).alias("l"), F.col(other).alias("o"))
    kept = sites.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    got = kept.groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct("l", "o"))).alias("x"))
    short = lambda x: F.concat(_short_class(x["o"]), F.lit("."), ids.method_name(x["o"]))
    return got.select("fqn", F.slice(F.array_sort(F.array_distinct(F.transform("x", short))), 1, most).alias(f"_{other}"))


def _short_class(fqn: Column) -> Column:
    return F.substring_index(ids.class_of(fqn), ".", -1)


def _part(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))


def _annotations(graph: Graph, most: int = 5) -> DataFrame:
    a = graph["annotated_with"].groupBy(F.col("src").alias("fqn")).agg(F.array_sort(F.collect_set(F.concat(F.lit("@"), F.substring_index("dst", ".", -1)))).alias("anns"))
    return a.select("fqn", F.slice("anns", 1, most).alias("anns"))


def indexable(df: DataFrame) -> DataFrame:
    return df.where((F.coalesce("filePath", F.lit("")) != "") & ~F.coalesce("isConstructor", F.lit(False)))


def method_docs(graph: Graph, include_trivial: bool = False) -> DataFrame:
    m = indexable(graph["method"])
    if not include_trivial:
        m = m.where(~ids.is_trivial(F.col("name"), F.col("lineStart"), F.col("lineEnd")))
    e = graph["handles"].join(graph["endpoint"].select(F.col("id").alias("dst"), F.concat_ws(" ", "httpMethod", "path").alias("ep")), "dst").groupBy(F.col("src").alias("fqn")).agg(F.min("ep").alias("ep"))
    d = m.join(_annotations(graph), "fqn", "left").join(_names(graph["calls"], "src", "dst", 10, 8), "fqn", "left").join(_names(graph["calls"], "dst", "src", 8, 5), "fqn", "left").join(e, "fqn", "left")
    params = F.when(F.col("fqn").contains("("), F.concat(F.lit("("), ids.short_params(F.col("fqn"), ", "), F.lit(")"))).otherwise("")
    head = F.concat(_short_class(F.col("classFqn")), F.lit("#"), F.col("name"), params)
    line = F.concat_ws(" | ", head, F.when(F.size("anns") > 0, F.array_join("anns", " ")), _part("calls: ", F.col("_dst")), _part("calledBy: ", F.col("_src")), F.concat(F.lit("endpoint: "), F.col("ep")))
    text = F.concat_ws("\n---\n", line, F.nullif(clean_javadoc(F.col("javadoc")), F.lit("")), F.nullif(F.substring("body", 1, 2000), F.lit("")))
    return d.select("fqn", "classFqn", text.alias("document"))


def class_docs(graph: Graph) -> DataFrame:
    c = graph["class"].where(F.coalesce("filePath", F.lit("")) != "")
    n = graph["has_method"].groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("n"))
    up = lambda t, most: graph[t].groupBy(F.col("src").alias("fqn")).agg(F.slice(F.array_sort(F.collect_set(_short_class(F.col("dst")))), 1, most).alias(t))
    inj = graph["injects"].join(graph["bean"].select(F.col("name").alias("src"), F.col("classFqn").alias("fqn")), "src").join(graph["bean"].select(F.col("name").alias("dst"), F.col("classFqn").alias("needs")), "dst")
    inj = inj.groupBy("fqn").agg(F.slice(F.array_sort(F.collect_set(_short_class(F.col("needs")))), 1, 8).alias("inj"))
    d = c.join(n, "fqn", "left").join(up("extends", 1), "fqn", "left").join(up("implements", 5), "fqn", "left").join(inj, "fqn", "left").join(_annotations(graph), "fqn", "left")
    kind = F.when(F.coalesce("kind", F.lit("CLASS")) == "CLASS", "").otherwise(F.concat(F.lit(" ("), F.lower("kind"), F.lit(")")))
    text = F.concat_ws(
        " | ", F.concat(F.col("name"), kind), F.when(F.size("anns") > 0, F.array_join("anns", " ")), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" methods")),
        _part("extends ", F.col("extends")), _part("implements ", F.col("implements")), _part("injected: ", F.col("inj")),
    )
    return d.select("fqn", "packageName", text.alias("document"))


def endpoint_docs(graph: Graph) -> DataFrame:
    # of the calls only those of handlers travel
    handlers = sent(checkpointed(graph["endpoint"].select(F.col("handlerMethodFqn").alias("src")).distinct()))
    calls = graph["calls"].join(handlers, "src", "left_semi")
    e = graph["endpoint"].join(_names(calls, "src", "dst", 8, 8).withColumnRenamed("fqn", "handlerMethodFqn"), "handlerMethodFqn", "left")
    h = F.concat(_short_class(F.col("handlerMethodFqn")), F.lit("#"), ids.method_name(F.col("handlerMethodFqn")))
    return e.select("id", "path", "httpMethod", "controllerFqn", "handlerMethodFqn", F.concat_ws(" | ", F.concat_ws(" ", "httpMethod", "path"), h, _part("calls: ", F.col("_dst"))).alias("document"))


def drawers(graph: Graph, wing: str) -> DataFrame:
    """(id, document, wing, room, hall, fqn, type, importance); room is the package. No timestamp, so that equal input gives equal rows."""
    m = method_docs(graph).select(F.concat(F.lit("method:"), F.col("fqn")).alias("id"), "document", ids.package_of(F.col("classFqn")).alias("room"), "fqn", F.lit("method").alias("type"), F.col("fqn").alias("k"))
    c = class_docs(graph).select(F.concat(F.lit("class:"), F.col("fqn")).alias("id"), "document", F.coalesce("packageName", ids.package_of(F.col("fqn"))).alias("room"), "fqn", F.lit("class").alias("type"), F.col("fqn").alias("k"))
    e = endpoint_docs(graph).select(F.concat_ws(":", F.lit("endpoint"), "httpMethod", "path").alias("id"), "document", ids.package_of(F.col("controllerFqn")).alias("room"), F.col("handlerMethodFqn").alias("fqn"), F.lit("endpoint").alias("type"), F.col("id").alias("k"))
    rank = importance(graph).select("type", F.col("fqn").alias("k"), "importance")
    all_ = union_all([m, c, e]).join(rank, ["type", "k"], "left")
    return all_.select("id", "document", F.lit(wing).alias("wing"), "room", F.lit("code").alias("hall"), "fqn", "type", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def around(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """(fqn): the classes (column fqn) and those that call them or that they call: whose drawers a change of them reaches."""
    pairs = calls.select(ids.class_of(F.col("src")).alias("a"), ids.class_of(F.col("dst")).alias("b")).distinct()
    own = F.broadcast(classes.select(F.col("fqn").alias("k")).distinct()) if classes.count() <= SENT else classes.select(F.col("fqn").alias("k")).distinct()
    near = pairs.join(own, F.col("a") == F.col("k")).select(F.col("b").alias("fqn")).unionByName(pairs.join(own, F.col("b") == F.col("k")).select(F.col("a").alias("fqn")))
    return classes.select("fqn").unionByName(near).distinct()


def drawers_of(graph: Graph, wing: str, classes: DataFrame) -> DataFrame:
    """The drawers of some classes (column fqn), their methods and endpoints: only rows that these need are read on."""
    k = checkpointed(classes.select("fqn").distinct())
    k = F.broadcast(k) if k.count() <= SENT else k
    of = lambda t, owner: graph[t].withColumn("_o", owner).join(k.withColumnRenamed("fqn", "_o"), "_o", "left_semi").drop("_o")
    cls = lambda c: ids.class_of(F.col(c))
    marked = k.withColumn("_in", F.lit(True))
    calls = graph["calls"].withColumn("_s", cls("src")).withColumn("_d", cls("dst"))
    calls = calls.join(marked.toDF("_s", "_si"), "_s", "left").join(marked.toDF("_d", "_di"), "_d", "left").where("_si or _di")
    part = {
        "class": of("class", F.col("fqn")), "method": of("method", F.col("classFqn")), "endpoint": of("endpoint", cls("handlerMethodFqn")), "calls": calls.select(*graph["calls"].columns),
        "annotated_with": of("annotated_with", cls("src")), "handles": of("handles", cls("src")), "has_method": of("has_method", F.col("src")), "extends": of("extends", F.col("src")), "implements": of("implements", F.col("src")),
    }
    # asked for many times: as written tables they are not found again each time, and plans stay short
    part |= {t: checkpointed(part[t]) for t in ("class", "method", "calls", "annotated_with", "handles")}
    # handlers name all their endpoints, also those of other controllers
    handled = graph["handles"].join(part["method"].select(F.col("fqn").alias("src")), "src", "left_semi")
    ends = graph["endpoint"].join(handled.select(F.col("dst").alias("id")), "id", "left_semi")
    made = drawers(Graph(graph | part | {"endpoint": part["endpoint"].unionByName(ends).distinct()}), wing)
    keep = made.withColumn("_o", cls("fqn")).join(k.withColumnRenamed("fqn", "_o"), "_o", "left_semi")
    return keep.select(*made.columns)


def renew(old: DataFrame, graph: Graph, wing: str, classes: DataFrame) -> DataFrame:
    """Drawers after a change: those of the classes (column fqn) are made anew over ``graph``, all others stay as they are."""
    kept = old.withColumn("_o", ids.class_of(F.col("fqn"))).join(classes.select(F.col("fqn").alias("_o")).distinct(), "_o", "left_anti").select(*old.columns)
    return kept.unionByName(drawers_of(graph, wing, classes).select(*old.columns))


def from_export(doc: DataFrame, wing: str) -> DataFrame:
    """Drawers of an export document alone, without a stored graph."""
    return drawers(ingest_full(doc), wing)


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """Drawers to index again: new ids and changed documents."""
    return new.join(old.select("id", "document"), ["id", "document"], "left_anti").select(*new.columns)


def cascade_delete(old: DataFrame, classes: DataFrame) -> DataFrame:
    """Drawers without those of the classes (column fqn) and of their methods."""
    gone = classes.select("fqn").distinct()
    owner = F.regexp_replace(F.split_part("id", F.lit("#"), F.lit(1)), "^(method|class):", "")
    return old.withColumn("_o", owner).join(gone.withColumnRenamed("fqn", "_o"), "_o", "left_anti").select(*old.columns)
