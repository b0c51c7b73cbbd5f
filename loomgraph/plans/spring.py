"""Beans, endpoints and injections derived from the facts of classes, methods, fields and annotations, for exports without such a section.

A class is a bean once for each stereotype it carries. A bean's fields with ``Autowired`` are injected, and the parameters
of its constructor if it has exactly one. Methods of controllers are endpoints once for each mapping annotation; their path is
the class's mapping and their own, joined by one slash. Annotation parameters are source text: of a literal its value counts,
of a list its first element if that is a literal, of anything else the text; ``value`` goes before ``path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.store import Graph
from .ingest import spring_rows

# The stereotypes with their kinds of bean, the mappings with their verbs, and the mark of an injected field.
STEREOTYPES = {
    "org.springframework.stereotype.Service": "SERVICE",
    "org.springframework.stereotype.Component": "COMPONENT",
    "org.springframework.stereotype.Repository": "REPOSITORY",
    "org.springframework.stereotype.Controller": "CONTROLLER",
    "org.springframework.web.bind.annotation.RestController": "REST_CONTROLLER",
    "org.springframework.context.annotation.Configuration": "CONFIGURATION",
}
MAPPING = "org.springframework.web.bind.annotation."
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ALL"}
AUTOWIRED = "org.springframework.beans.factory.annotation.Autowired"


def _coded(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def literal(text: Column) -> Column:
    """What an annotation parameter's source text stands for; null is empty."""
    t = strip(F.coalesce(text, F.lit("")))
    body = r'"((?:[^"\\]|\\.)*)"'
    value = lambda pattern: F.regexp_replace(F.regexp_extract(t, pattern, 1), r"""\\(["'\\])""", "$1")
    return F.when(t.startswith("{"), value(r"^\{\s*" + body)).when(t.rlike("^" + body + "$"), value("^" + body + "$")).otherwise(t)


def mapping_path(params: Column) -> Column:
    return literal(F.coalesce(params["value"], params["path"]))


def joined_path(prefix: Column, path: Column) -> Column:
    p, s = F.regexp_replace(prefix, "/+$", ""), F.regexp_replace(path, "^/+", "")
    return F.when((p == "") & (s == ""), "/").when(s == "", p).otherwise(F.concat(p, F.lit("/"), s))


def derived(f: Graph) -> Graph:
    """beans, endpoints and injections, in the columns of an export, from the facts ``classes methods fields annotations``."""
    notes = f["annotations"].select("targetFqn", "targetKind", "annotationFqn", F.struct(F.col("params")["value"].alias("value"), F.col("params")["path"].alias("path")).alias("params")).distinct()
    on = lambda kind: notes.where(F.col("targetKind") == kind)
    marked = on("CLASS").withColumn("type", _coded(STEREOTYPES, F.col("annotationFqn"))).where("type is not null").select(F.col("targetFqn").alias("classFqn"), "type").distinct()
    own = marked.join(f["classes"].select(F.col("fqn").alias("classFqn")).distinct(), "classFqn")
    short = F.substring_index("classFqn", ".", -1)
    beans = own.select(F.concat(F.lower(F.substring(short, 1, 1)), F.expr("substring(substring_index(classFqn, '.', -1), 2)")).alias("name"), "classFqn", F.lit("singleton").alias("scope"), "type")
    # injections: a class with two stereotypes is looked at twice
    wired = on("FIELD").where(F.col("annotationFqn") == AUTOWIRED).select(F.col("targetFqn").alias("fqn")).distinct()
    fields = f["fields"].dropDuplicates(["fqn"]).withColumnRenamed("type", "declared").join(wired, "fqn", "left_semi").join(own, "classFqn")
    by_field = fields.select(F.col("classFqn").alias("targetClassFqn"), F.col("name").alias("targetFieldOrParam"), F.col("declared").alias("injectedClassFqn"), F.lit("FIELD").alias("injectionType"))
    ctors = f["methods"].dropDuplicates(["fqn"]).where("isConstructor").groupBy("classFqn").agg(F.count(F.lit(1)).alias("n"), F.first("parameters").alias("parameters")).where("n = 1")
    params = ctors.join(own, "classFqn").select(F.col("classFqn").alias("targetClassFqn"), F.explode("parameters").alias("p"))
    by_ctor = params.select("targetClassFqn", F.coalesce("p.name", F.lit("")).alias("targetFieldOrParam"), F.col("p.type").alias("injectedClassFqn"), F.lit("CONSTRUCTOR").alias("injectionType"))
    # endpoints
    web = own.where(F.col("type").isin("CONTROLLER", "REST_CONTROLLER"))
    prefix = on("CLASS").where(F.col("annotationFqn") == MAPPING + "RequestMapping").groupBy(F.col("targetFqn").alias("classFqn")).agg(F.min(mapping_path(F.col("params"))).alias("prefix"))
    verb = F.when(F.col("annotationFqn").startswith(MAPPING), _coded(VERBS, F.expr(f"substring(annotationFqn, {len(MAPPING) + 1})")))
    mapped = on("METHOD").withColumn("httpMethod", verb).where("httpMethod is not null").select(F.col("targetFqn").alias("fqn"), "httpMethod", mapping_path(F.col("params")).alias("own"))
    handlers = f["methods"].dropDuplicates(["fqn"]).select("fqn", "classFqn").join(mapped, "fqn").join(web, "classFqn").join(prefix, "classFqn", "left")
    ends = handlers.select(joined_path(F.coalesce("prefix", F.lit("")), F.col("own")).alias("path"), "httpMethod", F.col("classFqn").alias("controllerFqn"), F.col("fqn").alias("handlerMethodFqn"))
    return Graph(beans=beans, endpoints=ends, injections=by_field.unionByName(by_ctor))


def tables(f: Graph) -> Graph:
    """Graph tables of what is derived, as ``ingest.spring_tables`` makes them of an export's section."""
    d = derived(f)
    return spring_rows(d["beans"], d["endpoints"], d["injections"])
