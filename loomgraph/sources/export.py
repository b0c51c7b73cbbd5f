"""Export documents: one nested JSON record each, full or delta; read with fixed schemas, and written for tests and exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..schemas import ANNOTATION, CALL, CLASS, DELTA, EXPORT, FIELD, INHERITANCE, METHOD, MODULE, OVERRIDE, SPRING
from .store import Graph


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A document, or one in shards: a folder of JSON lines, each with some rows of some sections."""
    return spark.read.schema(_schema(ddl)).json(path, multiLine=not _is_folder(spark, path), mode="PERMISSIVE")


def export_type(spark: SparkSession, path: str) -> str:
    row = _read(spark, path, "struct<exportType:string>").where("exportType is not null").first()
    return (row and row.exportType) or "full"


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """A full document; one in shards is parsed once, into a table whose sections are read alone."""
    from ..operators.rank import checkpointed

    doc = _read(spark, path, EXPORT)
    return checkpointed(doc) if _is_folder(spark, path) else doc


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DELTA)


def facts(doc: DataFrame, column: str) -> DataFrame:
    """Rows of one array of structs of the document (dots reach nested ones); null is empty."""
    return doc.select(F.explode(F.col(column)).alias("x")).select("x.*")


def _full(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with all fields of a section in its order; missing ones are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _schema(f"struct<{kind}>")])


def document(graph: Graph, shards: int = 1) -> DataFrame:
    """The export that gives ``graph`` when imported, in shards (columns of EXPORT), a row for each element of a section.

    Stubs stay out, since import makes them again. Nothing is collected or shuffled, so a section may have any size: tasks
    write what they read, in ``shards`` files or, of more than one, in a few for each core.
    """
    own = lambda t: graph[t].where("external is null")
    inherits = [graph[t].select(F.col("src").alias("childFqn"), F.col("dst").alias("parentFqn"), F.lit(t.upper()).alias("relationType")) for t in ("extends", "implements")]
    bean = graph["bean"].select("name", "classFqn")
    inj = graph["injects"].join(bean.toDF("src", "targetClassFqn"), "src").join(bean.toDF("dst", "injectedClassFqn"), "dst")
    sections = {
        "classes": (CLASS, own("class")),
        "methods": (METHOD, own("method")),
        "fields": (FIELD, graph["field"]),
        "callGraph": (CALL, graph["calls"].select(F.col("src").alias("callerFqn"), F.col("dst").alias("calleeFqn"), "line")),
        "inheritance": (INHERITANCE, inherits[0].unionByName(inherits[1])),
        "methodOverrides": (OVERRIDE, graph["overrides"].select(F.col("src").alias("methodFqn"), F.col("dst").alias("overridesFqn"))),
        "annotations": (ANNOTATION, graph["annotated_with"].select(F.col("src").alias("targetFqn"), F.col("kind").alias("targetKind"), F.col("dst").alias("annotationFqn"))),
        "beans": (None, graph["bean"]),
        # one row a handler, as the export has it
        "endpoints": (None, graph["handles"].join(graph["endpoint"].withColumnRenamed("id", "dst"), "dst").select("path", "httpMethod", "controllerFqn", F.col("src").alias("handlerMethodFqn"))),
        "injections": (None, inj.select("targetClassFqn", F.col("field").alias("targetFieldOrParam"), "injectedClassFqn", F.col("type").alias("injectionType"))),
        "modules": (MODULE, graph["module"]),
    }
    spring = {f.name: f.dataType.elementType.simpleString()[7:-1] for f in _schema(f"struct<{SPRING}>")}
    whole = _schema(EXPORT)
    head = graph["class"].sparkSession.range(1).select(F.lit("1").alias("version"), F.lit("full").alias("exportType"))
    parts = [head]
    for name, (kind, df) in sections.items():
        full = _full(df, kind or spring[name])
        one = F.array(F.struct(*full.columns))
        if name in spring:
            empty = [one.alias(n) if n == name else F.lit(None).cast(f"array<struct<{ddl}>>").alias(n) for n, ddl in spring.items()]
            parts.append(full.select(F.struct(*empty).alias("spring")))
        else:
            parts.append(full.select(one.alias(name)))
    rows = [p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole]) for p in parts]
    cores = graph["class"].sparkSession.sparkContext.defaultParallelism
    return reduce(DataFrame.unionByName, rows).coalesce(max(shards, 4 * cores) if shards > 1 else 1)


def write_json(doc: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON lines; packed, since names repeat in every line (``compression="none"`` for plain text)."""
    from ..operators.rank import shuffles_go

    with shuffles_go(doc.sparkSession):
        doc.write.mode("overwrite").option("ignoreNullFields", "true").option("compression", compression).json(path)
