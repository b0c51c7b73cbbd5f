"""A code graph over the driver's relational tables, so that every graph operator has data at scale.

Each view is one SQL text in the dialect that Spark and other ANSI engines share;
``{name}`` stands for a base table or another view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Graph
from .ingest import conform
from ..schemas import EDGES, NODES


def cust(k="c_custkey"):
    return f"'com.shop.crm.Customer' || {k}"


def order(k="o_orderkey"):
    return f"'com.shop.sales.Order' || {k}"


def part(k="p_partkey"):
    return f"'com.shop.parts.Part' || {k}"


def supp(k="s_suppkey"):
    return f"'com.shop.supply.Supplier' || {k}"


def nation(k="n_nationkey"):
    return f"'com.shop.geo.Nation' || {k}"


def region(k="r_regionkey"):
    return f"'com.shop.geo.Region' || {k}"


BASE = "'com.shop.parts.' || replace(p_brand, '#', '_') || 'Base'"
SIGNATURE = {cust: "#order(long)", order: "#place(long,java.lang.String)", part: "#supply()", supp: "#ship(int)", nation: "#getName()", region: "#main(java.lang.String[])"}
ENDPOINT = "'/nation/' || c_nationkey || '/' || lower(c_mktsegment)"


def m(of, k=None):
    return f"{of(k) if k is not None else of()} || '{SIGNATURE[of]}'"


_SOURCES = [(cust, "customer", "c_custkey", "crm", "c_name", "c_mktsegment"), (order, "orders", "o_orderkey", "sales", "o_orderstatus", "o_orderpriority"), (part, "part", "p_partkey", "parts", "p_name", "p_type"), (supp, "supplier", "s_suppkey", "supply", "s_name", "s_name"), (nation, "nation", "n_nationkey", "geo", "n_name", "n_name"), (region, "region", "r_regionkey", "geo", "r_name", "r_name")]


def _method(of, table, key, pkg, body, doc):
    name = SIGNATURE[of][1:].split("(")[0]
    simple = of().split("'")[1].rpartition(".")[2]
    return (
        f"select {m(of)} as fqn, '{name}' as name, {of()} as classFqn, 'void' as returnType, false as isConstructor, "
        f"'src/{pkg}/{simple}' || {key} || '.java' as filePath, cast({key} % 100 + 1 as int) as lineStart, cast({key} % 100 + 1 + {key} % 7 as int) as lineEnd, "
        f"{body} as body, '/** ' || {doc} || ' */' as javadoc, cast(null as boolean) as external from {{{table}}}"
    )


def _class(of, table, key, pkg, body, doc):
    simple = of().split("'")[1].rpartition(".")[2]
    return f"select {of()} as fqn, '{simple}' || {key} as name, 'CLASS' as kind, 'src/{pkg}/{simple}' || {key} || '.java' as filePath, 1 as lineStart, 200 as lineEnd, 'com.shop.{pkg}' as packageName, cast(null as boolean) as external from {{{table}}}"


_EXTERNAL = "select '{0}' as fqn, '{1}' as name, '{2}' as classFqn, 'void' as returnType, false as isConstructor, cast(null as varchar(1)) as filePath, cast(null as int) as lineStart, cast(null as int) as lineEnd, cast(null as varchar(1)) as body, cast(null as varchar(1)) as javadoc, true as external"
LIST_ADD, CLOCK_NOW = "java.util.List#add(java.lang.Object)", "java.time.Clock#now()"
SCHEDULED = "org.springframework.scheduling.annotation.Scheduled"

VIEWS = {
    "method": " union all ".join([_method(*s) for s in _SOURCES] + [_EXTERNAL.format(LIST_ADD, "add", "java.util.List"), _EXTERNAL.format(CLOCK_NOW, "now", "java.time.Clock")]),
    "class": " union all ".join(
        [_class(*s) for s in _SOURCES]
        + [f"select distinct {BASE} as fqn, replace(p_brand, '#', '_') || 'Base' as name, 'ABSTRACT_CLASS' as kind, 'src/parts/' || replace(p_brand, '#', '_') || 'Base.java' as filePath, 1 as lineStart, 20 as lineEnd, 'com.shop.parts' as packageName, cast(null as boolean) as external from {{part}}"]
        + ["select 'com.shop.api.Stocked' as fqn, 'Stocked' as name, 'INTERFACE' as kind, 'src/api/Stocked.java' as filePath, 1 as lineStart, 9 as lineEnd, 'com.shop.api' as packageName, cast(null as boolean) as external"]
    ),
    "calls": " union all ".join([
        f"select {m(cust, 'o_custkey')} as src, {m(order)} as dst, 1 as line from {{orders}}",
        f"select {m(order, 'l_orderkey')}, {m(part, 'l_partkey')}, l_linenumber from {{lineitem}}",
        f"select {m(part, 'l_partkey')}, {m(supp, 'l_suppkey')}, 2 from {{lineitem}}",
        f"select {m(supp)}, {m(nation, 's_nationkey')}, 3 from {{supplier}}",
        f"select {m(nation)}, {m(region, 'n_regionkey')}, 4 from {{nation}}",
        f"select {m(region)}, '{LIST_ADD}', 5 from {{region}}",
        f"select {m(order)}, '{CLOCK_NOW}', 6 from {{orders}} where o_orderstatus = 'F'",
    ]),
    "extends": f"select {part()} as src, {BASE} as dst from {{part}}",
    "implements": f"select distinct {BASE} as src, 'com.shop.api.Stocked' as dst from {{part}}",
    "overrides": f"select {m(part, 'p.p_partkey')} as src, {m(part, 'f.k')} as dst from {{part}} p join (select p_type as t, min(p_partkey) as k from {{part}} group by p_type) f on p.p_type = f.t where p.p_partkey <> f.k",
    "field": f"select {order('l_orderkey')} || '#item' as fqn, 'item' as name, {order('l_orderkey')} as classFqn, min({BASE}) as type, 'src/sales/Order' || l_orderkey || '.java' as filePath, 3 as lineStart from {{lineitem}} join {{part}} on l_partkey = p_partkey group by l_orderkey"
    f" union all select {cust('o_custkey')} || '#last' as fqn, 'last' as name, {cust('o_custkey')} as classFqn, {order('max(o_orderkey)')} as type, 'src/crm/Customer' || o_custkey || '.java' as filePath, 4 as lineStart from {{orders}} group by o_custkey",
    "endpoint": f"select 'GET:' || {ENDPOINT} as id, {ENDPOINT} as path, 'GET' as httpMethod, {cust('min(c_custkey)')} as controllerFqn, {m(cust, 'min(c_custkey)')} as handlerMethodFqn from {{customer}} group by c_nationkey, c_mktsegment",
    "handles": f"select {m(cust)} as src, 'GET:' || {ENDPOINT} as dst from {{customer}}",
    "bean": f"select 'supplier' || s_suppkey as name, {supp()} as classFqn, 'singleton' as scope, cast(null as varchar(1)) as profile, 'SERVICE' as type from {{supplier}} union all select 'nation' || n_nationkey, {nation()}, 'singleton', cast(null as varchar(1)), 'COMPONENT' from {{nation}}",
    "injects": "select 'supplier' || s_suppkey as src, 'nation' || s_nationkey as dst, 'nation' as field, 'FIELD' as type from {supplier}",
    "annotated_with": f"select {order()} as src, 'com.shop.ann.P' || substring(o_orderpriority, 1, 1) as dst, 'CLASS' as kind from {{orders}} union all select {m(order)}, '{SCHEDULED}', 'METHOD' from {{orders}} where o_orderstatus = 'O' union all select {m(cust)}, 'org.shop.Transactional', 'METHOD' from {{customer}} where c_acctbal < 0",
    "module": "select r_name as name, 'MAVEN' as type from {region}",
    "annotation": "select distinct dst as fqn, dst as name from {annotated_with}",
    "has_method": "select classFqn as src, fqn as dst from {method} where external is null",
    "has_field": "select classFqn as src, fqn as dst from {field}",
}
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def demo_graph(spark: SparkSession, sf_dir: str) -> Graph:
    base: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES}
    out = Graph()
    for name, sql in VIEWS.items():
        known = {k: v for k, v in (base | out).items() if "{" + k + "}" in sql}
        df = spark.sql(sql, **known)
        out[name] = conform(df, NODES[name][1] if name in NODES else EDGES[name])
    out["annotation"] = conform(out["annotated_with"].selectExpr("dst as fqn", "substring_index(dst, '.', -1) as name").distinct(), NODES["annotation"][1])
    for name, ddl in EDGES.items():
        out.setdefault(name, conform(spark.range(0).selectExpr("cast(null as string) as src", "cast(null as string) as dst"), ddl))
    return out


def with_views(sql: str) -> str:
    """The same views as common table expressions before ``sql``, for any engine that has the base tables."""
    parts = [f"{name if name not in ('class', 'extends', 'implements', 'method', 'module', 'field') else name + '_'} as ({text})" for name, text in VIEWS.items()]
    names = {n: (n if n not in ("class", "extends", "implements", "method", "module", "field") else n + "_") for n in VIEWS} | {t: t for t in BASE_TABLES}
    out = "with recursive " + ", ".join(parts) + " " + sql
    for n, alias in names.items():
        out = out.replace("{" + n + "}", alias)
    return out
