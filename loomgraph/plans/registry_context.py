"""Registered queries of impact, documents, context layers, import and deltas, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_error, name_error, sanitize
from ..functions.vector import hashing_embedder
from ..operators import many, catalog, context, impact, rank, search, traverse
from ..sources import export
from ..sources.store import Graph
from . import delta as deltas
from . import drawers, ingest, spring
from .registry import C1, _at, _say, _walk, on_graph, register
from .tables import demo_graph

# --- impact --------------------------------------------------------------------


def _overriding(g):
    """A method that overrides another, so that impact is polymorphic."""
    return g["overrides"].agg(F.min("src")).first()[0]


def _impact_sql(path: bool, depth: int = 5) -> str:
    """Unrolled hops: frontier f, what it overrides u, callers not met before."""
    out = ", f0 as (select min(src) as node, false as poly from {overrides}), v0 as (select node from f0)"
    for k in range(1, depth + 1):
        p = k - 1
        out += f", u{k}(node) as (select node from f{p} union select o.dst from u{k} join {{overrides}} o on o.src = u{k}.node)"
        out += f", r{k} as (select node, {'poly' if path else 'false'} as poly from f{p} union all select node, true from u{k} where node not in (select node from f{p}))"
        out += f", g{k} as (select c.src as node, min(r.poly) as poly from {{calls}} c join r{k} r on c.dst = r.node where c.src not in (select node from v{p}) group by 1)"
        label = "poly" if path else f"(select max(poly) from r{k})"
        out += f", f{k} as (select node, {label} as poly from g{k}), v{k} as (select node from v{p} union select node from f{k})"
    found = " union all ".join(f"select node, poly, {k} as hops from f{k}" for k in range(1, depth + 1))
    out += f", w as ({found}), hit as (select 'GET ' || substring(h.dst, 5) as endpoint, w.node, w.poly, w.hops, m.classFqn, m.filePath, m.lineStart, row_number() over (partition by h.dst order by w.hops, w.node) as pick from w join {{handles}} h on h.src = w.node join {{method}} m on m.fqn = w.node)"
    out += ", own as (select split_part(node, '#', 1) as node from f0 union select split_part(c.src, '#', 1) from {calls} c join f0 on c.dst = f0.node)"
    out += ", up as (select src, dst from {extends} union select src, dst from {implements}), anc(node) as (select node from own union select up.dst from anc join up on up.src = anc.node), subs as (select dst, count(*) as n from up group by 1)"
    out += ", types as (select node from own union select node from anc left join subs on subs.dst = anc.node where coalesce(n, 0) <= 10)"
    out += ", holder(node) as (select classFqn from {field} where type in (select node from types) union select x.src from holder join {extends} x on x.dst = holder.node)"
    out += ", kept as (select endpoint, node as handler, filePath as file, lineStart as line, cast(hops as int) as hops, case when poly then 'polymorphic' else 'precise' end as precision from hit where pick = 1 and (not poly or classFqn in (select node from holder)))"
    return out


on_graph("impact", _impact_sql(False) + " select * from kept")(lambda g: impact.impact(g, _overriding(g)))
on_graph("impact_path", _impact_sql(True) + " select * from kept")(lambda g: impact.impact(g, _overriding(g), precision="path"))
on_graph("impact_precise", _impact_sql(False) + " select * from kept where precision = 'precise'")(lambda g: impact.impact(g, _overriding(g)).where("precision = 'precise'"))


def _impact_many_sql(depth: int = 5) -> str:
    """Of every method named supply: unrolled hops with the target beside each node."""
    out = ", f0 as (select fqn as target, fqn as node from {method} where name = 'supply' and fqn in (select src from {overrides})), v0 as (select * from f0)"
    for k in range(1, depth + 1):
        p = k - 1
        out += f", c{k} as (select target, dst as node from f{p} join {{overrides}} on src = node union select target, dst from c{k} join {{overrides}} on src = node)"
        out += f", u{k} as (select c.target, c.node from c{k} c anti join f{p} f on f.target = c.target and f.node = c.node)"
        out += f", g{k} as (select distinct r.target, c.src as node from {{calls}} c join (select * from f{p} union select * from u{k}) r on c.dst = r.node)"
        out += f", f{k} as (select g.target, g.node from g{k} g anti join v{p} v on v.target = g.target and v.node = g.node), v{k} as (select * from v{p} union select * from f{k})"
    found = " union all ".join(f"select target, node, target in (select target from u{k}) as poly, {k} as hops from f{k}" for k in range(1, depth + 1))
    out += f", w as ({found}), hit as (select w.target, 'GET ' || substring(h.dst, 5) as endpoint, w.node as handler, m.filePath as file, m.lineStart as line, cast(w.hops as int) as hops,"
    out += " case when w.poly then 'polymorphic' else 'precise' end as precision, row_number() over (partition by w.target, h.dst order by w.hops, w.node) as pick from w join {handles} h on h.src = w.node join {method} m on m.fqn = w.node)"
    return out + " select target, endpoint, handler, file, line, hops, precision from hit where pick = 1"


def _supplying(g):
    return g["overrides"].select(F.col("src").alias("fqn")).distinct()


on_graph("impact_many", _impact_many_sql())(lambda g: many.impact_many(g, _supplying(g), field_filter=False))
on_graph("impact_totals", _impact_sql(False) + " select precision, count(*) as endpoints from kept group by 1 union all select 'total', count(*) from kept")(lambda g: impact.impact_totals(impact.impact(g, _overriding(g))))

_SHORT = "list_extract(string_split(split_part({0}, '#', 1), '.'), -1)"
_PARAMS = "array_to_string(list_transform(string_split(regexp_extract({0}, '\\((.*)\\)', 1), ','), lambda x: list_extract(string_split(trim(x), '.'), -1)), '{1}')"
_NAME = "split_part(split_part({0}, '#', 2), '(', 1)"
on_graph(
    "trace_compact",
    _walk("fwd", _at(C1), 5)
    + f"select distinct depth, {_SHORT.format('classFqn')} as class, {_NAME.format('fqn')} || '(' || {_PARAMS.format('fqn', ',')} || ')' as method, list_extract(string_split(filePath, '/'), -1) || ':' || lineStart as at, fqn from w join {{method}} on fqn = node where not coalesce(external, false) and (depth < 2 or not (regexp_matches(name, '^(get|set|is)') and fqn not like '%,%'))",
)(lambda g: traverse.compact(traverse.trace_method(g, _say(C1), 5)))

# --- ranks ---------------------------------------------------------------------
_CALLS_RANK = """, e as (select distinct src, dst from {calls}),
 ent as (select src as node from {handles} union select src from {annotated_with} where list_extract(string_split(dst, '.'), -1) in ('Scheduled', 'PostConstruct', 'EventListener', 'KafkaListener')),
 nd as (select node, case when node in (select node from ent) then 10.0 else 1.0 end as w from (select src as node from e union select dst from e union select node from ent) y),
 deg as (select src, count(*) as k from e group by 1),
 nn as (select node, (w / sum(w) over ())::double as p, k as deg from nd left join deg on deg.src = node),
 y0 as (select node, p, deg, p as r from nn)"""
for _k in range(1, 13):
    _CALLS_RANK += f", y{_k} as (select node, p, deg, 0.85::double * coalesce(g, 0) + p as r from y{_k - 1} left join (select dst, sum(r / deg) as g from e join y{_k - 1} on node = src group by 1) s on s.dst = node)"
_CALLS_RANK += ", pr as (select node, r / sum(r) over () as pagerank from y12)"
on_graph("pagerank_calls", _CALLS_RANK + " select node, round(pagerank, 9) as pagerank from pr")(lambda g: rank.method_pagerank(g).select("node", F.round("pagerank", 9).alias("pagerank")))
on_graph(
    "top_ranked",
    _CALLS_RANK + ", cr as (select c.fqn, coalesce(sum(pagerank), 0) as pagerank from {class} c left join {has_method} h on h.src = c.fqn left join pr on pr.node = h.dst group by 1)"
    " select * from (select 'method' as kind, node as name, round(pagerank, 9) as pagerank from pr order by pr.pagerank desc, node limit 1) union all select * from (select 'class', fqn, round(pagerank, 9) from cr order by cr.pagerank desc, fqn limit 1)",
)(lambda g: _top(g))


def _top(g):
    ranks = rank.checkpointed(rank.method_pagerank(g))
    return rank.top_ranked(ranks, rank.class_pagerank(g, ranks)).withColumn("pagerank", F.round("pagerank", 9))


# --- documents -----------------------------------------------------------------
_DOCS = (
    ", ann as (select src as fqn, array_to_string(list_sort(list(distinct '@' || list_extract(string_split(dst, '.'), -1)))[1:5], ' ') as a from {annotated_with} group by 1),"
    f" site as (select src, dst, {_SHORT.format('src')} || '.' || {_NAME.format('src')} as caller, {_SHORT.format('dst')} || '.' || {_NAME.format('dst')} as callee, row_number() over (partition by src order by coalesce(line, 0), dst) as i, row_number() over (partition by dst order by coalesce(line, 0), src) as j from {{calls}}),"
    " outs as (select src as fqn, array_to_string(list_sort(list(distinct callee))[1:8], ', ') as o from site where i <= 10 group by 1), outs8 as (select src as fqn, array_to_string(list_sort(list(distinct callee))[1:8], ', ') as o from site where i <= 8 group by 1),"
    " ins as (select dst as fqn, array_to_string(list_sort(list(distinct caller))[1:5], ', ') as i from site where j <= 8 group by 1),"
    " ep as (select src as fqn, min(httpMethod || ' ' || path) as e from {handles} join {endpoint} on id = dst group by 1),"
    f" md as (select m.fqn, m.classFqn, concat_ws(chr(10) || '---' || chr(10), concat_ws(' | ', {_SHORT.format('m.classFqn')} || '#' || name || '(' || {_PARAMS.format('m.fqn', ', ')} || ')', a, 'calls: ' || o, 'calledBy: ' || i, 'endpoint: ' || e),"
    " nullif(left(trim(regexp_replace(javadoc, '/\\*\\*|\\*/', '', 'g')), 500), ''), nullif(left(body, 2000), '')) as document from {method} m left join ann on ann.fqn = m.fqn left join outs on outs.fqn = m.fqn left join ins on ins.fqn = m.fqn left join ep on ep.fqn = m.fqn"
    " where filePath <> '' and not isConstructor and not (lineEnd - lineStart <= 3 and regexp_matches(name, '^(get|set|is|has|can)\\p{Lu}'))),"
    " ex as (select src as fqn, min(list_extract(string_split(dst, '.'), -1)) as x from {extends} group by 1), im as (select src as fqn, array_to_string(list_sort(list(distinct list_extract(string_split(dst, '.'), -1)))[1:5], ', ') as x from {implements} group by 1),"
    " inj as (select a.classFqn as fqn, array_to_string(list_sort(list(distinct list_extract(string_split(b.classFqn, '.'), -1)))[1:8], ', ') as x from {injects} i join {bean} a on a.name = i.src join {bean} b on b.name = i.dst group by 1),"
    " hm as (select src as fqn, count(*) as n from {has_method} group by 1),"
    " cd as (select c.fqn, packageName, concat_ws(' | ', c.name || case when kind = 'CLASS' then '' else ' (' || lower(kind) || ')' end, a, coalesce(n, 0) || ' methods', 'extends ' || ex.x, 'implements ' || im.x, 'injected: ' || inj.x) as document"
    " from {class} c left join ann on ann.fqn = c.fqn left join hm on hm.fqn = c.fqn left join ex on ex.fqn = c.fqn left join im on im.fqn = c.fqn left join inj on inj.fqn = c.fqn where filePath <> ''),"
    f" ed as (select id, path, httpMethod, controllerFqn, handlerMethodFqn, concat_ws(' | ', httpMethod || ' ' || path, {_SHORT.format('handlerMethodFqn')} || '#' || {_NAME.format('handlerMethodFqn')}, 'calls: ' || o) as document from {{endpoint}} left join outs8 on outs8.fqn = handlerMethodFqn)"
)
on_graph("method_docs", _DOCS + " select * from md")(drawers.method_docs)
on_graph("class_docs", _DOCS + " select * from cd")(drawers.class_docs)
on_graph("endpoint_docs", _DOCS + " select * from ed")(drawers.endpoint_docs)

_SCORES = (
    ", fan as (select fqn, classFqn, external, coalesce(i, 0) as fi, coalesce(o, 0) as fo from {method} left join (select dst, count(*) as i from {calls} group by 1) a on a.dst = fqn left join (select src, count(*) as o from {calls} group by 1) b on b.src = fqn),"
    " mark as (select src, max(contains(dst, 'Transactional')) as t, max(contains(dst, 'Scheduled')) as s from {annotated_with} group by 1), ij as (select classFqn, count(*) as n from {injects} join {bean} on name = src group by 1),"
    " score as (select 'method' as type, fqn as k, round(least(least(fi / 20.0, 0.4) + (case when fqn in (select src from {handles}) then 0.3 else 0 end) + (case when t then 0.15 else 0 end) + (case when s then 0.1 else 0 end), 1.0)::double, 3) as importance from fan left join mark on src = fqn where external is null"
    " union all select 'class', c.fqn, round((least(coalesce(f, 0) / 50.0, 0.4) + least(coalesce(m, 0) / 30.0, 0.2) + least(coalesce(ij.n, 0) / 10.0, 0.2))::double, 3) from {class} c left join (select classFqn, sum(fi) as f, count(*) as m from fan where external is null group by 1) x on x.classFqn = c.fqn left join ij on ij.classFqn = c.fqn"
    " union all select 'endpoint', id, round((0.5 + least(coalesce(fo, 0) / 15.0, 0.3))::double, 3) from {endpoint} left join fan on fan.fqn = handlerMethodFqn)"
)
_PKG = "regexp_extract({0}, '^(.*)\\.[^.]*$', 1)"
_DRAWERS = _DOCS + _SCORES + (
    f", raw as (select 'method:' || fqn as id, document, {_PKG.format('classFqn')} as room, fqn, 'method' as type, fqn as k from md union all select 'class:' || fqn, document, packageName, fqn, 'class', fqn from cd"
    f" union all select 'endpoint:' || httpMethod || ':' || path, document, {_PKG.format('controllerFqn')}, handlerMethodFqn, 'endpoint', id from ed),"
    " dr as (select raw.id, document, 'shop' as wing, room, 'code' as hall, fqn, type, coalesce(importance, 0.0) as importance from raw left join score using (type, k))"
)
on_graph("drawers", _DRAWERS + " select * from dr")(lambda g: drawers.drawers(g, "shop"))
on_graph("drawer_cascade", _DRAWERS + " select id from dr where not (type in ('method', 'class') and split_part(fqn, '#', 1) like '%1')")(
    lambda g: drawers.cascade_delete(drawers.drawers(g, "shop"), g["class"].where("fqn like '%1'").select("fqn")).select("id")
)
# an index that lacks some drawers and holds old text of others: these are to be indexed again
on_graph("resume_index", _DRAWERS + " select id from dr where length(id) % 3 = 0 or length(id) % 5 = 0")(lambda g: _resumed(g))


def _resumed(g):
    new = drawers.drawers(g, "shop")
    old = new.where("length(id) % 3 <> 0").withColumn("document", F.when(F.expr("length(id) % 5 = 0"), "old").otherwise(F.col("document")))
    return drawers.refresh(old, new).select("id")


_CHANGED = "m.classFqn like 'com.shop.supply.Supplier%7'"


@register("drawer_renew", _DRAWERS.replace("nullif(left(body, 2000), '')) as document", f"case when {_CHANGED} then 'changed' else nullif(left(body, 2000), '') end) as document") + " select * from dr")
def _renewed(spark, sf_dir):
    """Drawers after the bodies of some methods changed: only those of their classes and the classes around are made anew."""
    g = demo_graph(spark, sf_dir)
    # what a store keeps as tables: drawers read each many times
    g = Graph(g | {t: rank.checkpointed(g[t]) for t in ("method", "calls", "annotated_with")})
    old = rank.checkpointed(drawers.drawers(g, "shop"))
    some = F.col("classFqn").like("com.shop.supply.Supplier%7")
    g["method"] = g["method"].withColumn("body", F.when(some, "changed").otherwise(F.col("body")))
    touched = g["method"].where(some).select(F.col("classFqn").alias("fqn")).distinct()
    return drawers.renew(old, g, "shop", drawers.around(g["calls"], touched))


# --- context -------------------------------------------------------------------
on_graph("context_recall", _DRAWERS + " select id, room, type, importance, left(trim(regexp_replace(document, '\\s+', ' ', 'g')), 300) as snippet from dr where type = 'class' order by importance desc, id limit 20")(lambda g: context.recall(drawers.drawers(g, "shop"), type_="class", limit=20))
_IDENTITY = (
    ", svc as (select list_extract(string_split(classFqn, '.'), -1) || ' (' || callers || ' callers)' as s, callers, classFqn from (select classFqn, count(distinct src) as callers from {calls} join {method} on fqn = dst where not coalesce(external, false) group by 1 order by 2 desc, 1 limit 5) x),"
    " l0 as (select 0 as n, '## L0 — PROJECT IDENTITY' as line union all select 1, 'Graph: shop' union all select 2, 'Class: ' || (select count(*) from {class}) || ' | Method: ' || (select count(*) from {method}) || ' | Endpoint: ' || (select count(*) from {endpoint}) || ' | SpringBean: ' || (select count(*) from {bean}) || ' | Key services: ' || (select string_agg(s, ', ' order by callers desc, classFqn) from svc))"
)
_KEYS = (
    ", best as (select room, id, type, importance, replace(trim(document), chr(10), ' ') as flat from dr order by importance desc, id limit 15),"
    " cutd as (select room, id, type, importance, case when length(flat) > 200 then left(flat, 197) || '...' else flat end as snippet, row_number() over (partition by room order by importance desc, id) as i from best),"
    " told as (select *, case when i = 1 then chr(10) || '[' || case when len(string_split(room, '.')) > 2 then array_to_string(string_split(room, '.')[-2:], '.') else room end || ']' end as head, '  - ' || snippet || ' (imp=' || importance || ')' as entry from cutd),"
    " run as (select *, sum(length(entry) + coalesce(length(head), 0)) over (order by room, importance desc, id rows unbounded preceding) as upto from told),"
    " keys as (select room, id, type, importance, snippet, head, entry, cast(upto as bigint) as \"at\" from run where upto < coalesce((select min(upto) from run where upto > 3200), 1000000)),"
    " l1 as (select 0 as n, '## L1 — KEY CODE ELEMENTS' as line union all select cast(\"at\" as int), concat_ws(chr(10), head, entry) from keys union all select 6400, '  ... (more in L3 search)' where (select count(*) from keys) < (select count(*) from best))"
)
on_graph("key_elements", _DRAWERS + _KEYS + " select * from keys")(lambda g: context.key_elements(drawers.drawers(g, "shop"), "shop"))
on_graph("wakeup_l0", _IDENTITY + " select n, line from l0")(lambda g: context.identity(g, drawers.drawers(g, "shop"), "shop"))
on_graph("context_wakeup", _DRAWERS + _IDENTITY + _KEYS + " select 0 as layer, n, line from l0 union all select 1, n, line from l1")(lambda g: context.wakeup_lines(g, rank.checkpointed(drawers.drawers(g, "shop")), "shop"))


# --- import and deltas -----------------------------------------------------------
def _exported(spark, sf_dir):
    """The demo graph written as an export in shards, and read again."""
    path = f"{rank.shared_folder(spark)}/export-{rank.fresh_name()}"
    export.write_json(export.document(demo_graph(spark, sf_dir), 16), path)
    return path


#: What an import must give back: table -> columns compared; rows are told apart by their table's name.
_COMPARED = {
    "method": ("fqn", "name", "classFqn", "returnType", "isConstructor", "filePath", "lineStart", "lineEnd", "body", "javadoc", "external"),
    "field": ("fqn", "name", "classFqn", "type", "filePath", "lineStart"), "calls": ("src", "dst", "line"), "extends": ("src", "dst"), "implements": ("src", "dst"),
    "overrides": ("src", "dst"), "annotated_with": ("src", "dst", "kind"), "handles": ("src", "dst"), "injects": ("src", "dst", "field", "type"), "bean": ("name", "classFqn", "scope", "type"),
    "module": ("name", "type"), "has_field": ("src", "dst"), "annotation": ("fqn",),
}
_CLASS_COLUMNS = ("fqn", "name", "kind", "filePath", "lineStart", "lineEnd", "packageName")


def _lines(columns) -> str:
    """One text for a row; a null is a word of its own."""
    return " || '|' || ".join(f"coalesce(cast({c} as varchar(1000)), '~')" for c in columns)


def _contents_sql() -> str:
    # the library's classes, which the demo graph names only in methods, become stubs; its own stubs of methods keep what only their name tells
    stub = "select 'class' as name, fqn || '|' || s || '|EXTERNAL|~|~|~|' || p as line from (select 'java.util.List' as fqn, 'List' as s, 'java.util' as p union all select 'java.time.Clock', 'Clock', 'java.time') x"
    parts = [f"select 'class' as name, {_lines(_CLASS_COLUMNS)} as line from {{class}}", stub]
    known = "case when external then null else {0} end"
    for t, columns in _COMPARED.items():
        cols = [known.format(c) if t == "method" and c in ("returnType",) else c for c in columns]
        parts.append(f"select distinct '{t}', {_lines(cols)} from {{{t}}}" if t != "calls" else f"select '{t}', {_lines(cols)} from {{{t}}}")
    return " union all ".join(parts)


@register("ingest_full", _contents_sql())
def _ingest(spark, sf_dir):
    """Every row of the tables that an import of an export gives, not their sizes only."""
    g = ingest.ingest_full(export.read_full(spark, _exported(spark, sf_dir)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    each = lambda t, columns: g[t].select(F.lit(t).alias("name"), F.concat_ws("|", *[text(c) for c in columns]).alias("line"))
    return ingest.union_all([each("class", _CLASS_COLUMNS), *[each(t, columns) for t, columns in _COMPARED.items()]])


@register("export_json", "select 'calls' as section, src as a, dst as b, line as n from {calls} union all select 'inheritance', src, dst, 0 from {extends} union all select 'inheritance', src, dst, 1 from {implements} union all select 'field', fqn, type, lineStart from {field} union all select 'bean', name, classFqn, 0 from {bean}")
def _export(spark, sf_dir):
    doc = export.read_full(spark, _exported(spark, sf_dir))
    row = lambda section, t, a, b, n: export.facts(doc, t).select(F.lit(section).alias("section"), F.col(a).alias("a"), F.col(b).alias("b"), F.expr(n).cast("int").alias("n"))
    return ingest.union_all([
        row("calls", "callGraph", "callerFqn", "calleeFqn", "line"), row("inheritance", "inheritance", "childFqn", "parentFqn", "case relationType when 'EXTENDS' then 0 else 1 end"),
        row("field", "fields", "fqn", "type", "lineStart"), row("bean", "spring.beans", "name", "classFqn", "0"),
    ])


# an import takes the first handler by name
_FIRST = "(select e.id, e.path, e.httpMethod, e.controllerFqn, min(h.src) as handlerMethodFqn from {endpoint} e join {handles} h on h.dst = e.id group by all) y left join outs8"


@register("context_import", _DRAWERS.replace("{endpoint} left join outs8", _FIRST) + " select id, document, wing, room, hall, fqn, type from dr")
def _context_import(spark, sf_dir):
    return drawers.from_export(export.read_full(spark, _exported(spark, sf_dir)), "shop").select("id", "document", "wing", "room", "hall", "fqn", "type")


def _spring_facts(spark, sf_dir):
    """Facts over the tables: suppliers are services with a field or a constructor, customers controllers with mappings."""
    g = demo_graph(spark, sf_dir)
    supp = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("'com.shop.supply.Supplier' || s_suppkey as fqn", "s_suppkey as k", "'com.shop.geo.Nation' || s_nationkey as nation")
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("'com.shop.crm.Customer' || c_custkey as fqn", "c_custkey as k", "c_nationkey as n", "lower(c_mktsegment) as seg")
    note = lambda df, target, kind, ann, key=None, value=None: df.selectExpr(f"{target} as targetFqn", f"'{kind}' as targetKind", f"'{ann}' as annotationFqn", f"map('{key}', {value}) as params" if key else "cast(map() as map<string,string>) as params")
    web = spring.MAPPING
    notes = [
        note(supp, "fqn", "CLASS", "org.springframework.stereotype.Service"), note(supp.where("k % 2 = 0"), "fqn || '#nation'", "FIELD", spring.AUTOWIRED),
        note(cust, "fqn", "CLASS", web + "RestController"), note(cust, "fqn", "CLASS", web + "RequestMapping", "value", """'"/' || seg || '/"'"""),
        note(cust.where("k % 3 = 0"), "fqn || '#order(long)'", "METHOD", web + "PostMapping", "path", """'{ "/n' || n || '", "/other" }'"""), note(cust.where("k % 3 = 1"), "fqn || '#order(long)'", "METHOD", web + "GetMapping"),
        note(cust.where("k % 3 = 2"), "fqn || '#order(long)'", "METHOD", web + "RequestMapping", "value", "'Paths.ALL'"),
    ]
    fields = supp.selectExpr("fqn || '#nation' as fqn", "'nation' as name", "fqn as classFqn", "nation as type")
    one, two = supp.where("k % 3 = 0"), supp.where("k % 3 = 1")
    ctor = lambda df, sig: df.selectExpr(f"fqn || '#Supplier({sig})' as fqn", "fqn as classFqn", "true as isConstructor", "array(named_struct('name', 'home', 'type', nation)) as parameters")
    methods = g["method"].selectExpr("fqn", "classFqn", "isConstructor", "cast(null as array<struct<name:string,type:string>>) as parameters")
    methods = ingest.union_all([methods, ctor(one, "a"), ctor(two, "a"), ctor(two, "b")])
    return spring.derived(Graph(classes=g["class"].select("fqn"), methods=methods, fields=fields, annotations=ingest.union_all(notes)))


@register(
    "spring_facts",
    " select 'bean' as section, lower(substring(x, 1, 1)) || substring(x, 2) as a, fqn as b, t as c, 'singleton' as d from ("
    "select 'Supplier' || s_suppkey as x, 'com.shop.supply.Supplier' || s_suppkey as fqn, 'SERVICE' as t from {supplier} union all select 'Customer' || c_custkey, 'com.shop.crm.Customer' || c_custkey, 'REST_CONTROLLER' from {customer})"
    " union all select 'endpoint', '/' || lower(c_mktsegment) || case c_custkey % 3 when 0 then '/n' || c_nationkey when 1 then '/' else '/Paths.ALL' end,"
    " case c_custkey % 3 when 0 then 'POST' when 1 then 'GET' else 'ALL' end, 'com.shop.crm.Customer' || c_custkey, 'com.shop.crm.Customer' || c_custkey || '#order(long)' from {customer} where c_custkey % 3 <> 1"
    " union all select 'endpoint', '/' || lower(c_mktsegment), 'GET', 'com.shop.crm.Customer' || c_custkey, 'com.shop.crm.Customer' || c_custkey || '#order(long)' from {customer} where c_custkey % 3 = 1"
    " union all select 'injection', 'com.shop.supply.Supplier' || s_suppkey, 'nation', 'com.shop.geo.Nation' || s_nationkey, 'FIELD' from {supplier} where s_suppkey % 2 = 0"
    " union all select 'injection', 'com.shop.supply.Supplier' || s_suppkey, 'home', 'com.shop.geo.Nation' || s_nationkey, 'CONSTRUCTOR' from {supplier} where s_suppkey % 3 = 0",
)
def _spring(spark, sf_dir):
    d = _spring_facts(spark, sf_dir)
    row = lambda section, df, *cols: df.select(F.lit(section).alias("section"), *[F.col(c).alias(n) for c, n in zip(cols, "abcd")])
    return ingest.union_all([
        row("bean", d["beans"], "name", "classFqn", "type", "scope"), row("endpoint", d["endpoints"], "path", "httpMethod", "controllerFqn", "handlerMethodFqn"),
        row("injection", d["injections"], "targetClassFqn", "targetFieldOrParam", "injectedClassFqn", "injectionType"),
    ])


@register(
    "delta_apply",
    ", gone as (select fqn from {class} where fqn like 'com.shop.supply.Supplier%5'), touched as (select fqn from {class} where fqn like 'com.shop.supply.Supplier%7')"
    " select 'calls' as kind, src, dst, line from {calls} where split_part(src, '#', 1) not in (select fqn from gone union select fqn from touched)"
    " union all select 'calls', fqn || '#ship(int)', fqn || '#again()', 8 from touched"
    " union all select 'method', m.fqn, case when m.fqn like '%Supplier%7#%' then 'changed' else m.body end, m.lineStart from {method} m where external is null and classFqn not in (select fqn from gone)"
    " union all select 'method', fqn || '#again()', 'new', 9 from touched"
    " union all select distinct 'stub', dst, 'true', 0 from {calls} where split_part(dst, '#', 1) in (select fqn from gone)"
    " union all select 'stub', fqn, 'true', 0 from {method} where external",
)
def _delta(spark, sf_dir):
    facts = deltas.fact_tables(export.read_full(spark, _exported(spark, sf_dir)))
    c, m = facts["classes"], facts["methods"]
    touched = F.col("fqn").like("com.shop.supply.Supplier%7")
    methods = m.where(F.col("classFqn").like("com.shop.supply.Supplier%7"))
    again = methods.withColumn("fqn", F.concat("classFqn", F.lit("#again()"))).withColumns({"name": F.lit("again"), "body": F.lit("new"), "lineStart": F.lit(9)})
    calls = methods.select(F.col("fqn").alias("callerFqn"), F.concat("classFqn", F.lit("#again()")).alias("calleeFqn"), F.lit(8).alias("line"))
    change = deltas.Change(
        gone=c.where("fqn like 'com.shop.supply.Supplier%5'").select(F.col("fqn").alias("owner")),
        members=None,
        up={"classes": c.where(touched), "methods": methods.withColumn("body", F.lit("changed")).unionByName(again), "callGraph": calls},
    )
    g = deltas.graph_of(deltas.apply_change(facts, change))
    rows = [g["calls"].select(F.lit("calls").alias("kind"), "src", "dst", "line")]
    rows.append(g["method"].where("external is null").select(F.lit("method"), "fqn", "body", "lineStart"))
    rows.append(g["method"].where("external is not null").select(F.lit("stub"), "fqn", F.col("external").cast("string"), F.coalesce("lineStart", F.lit(0))))
    return ingest.union_all([r.toDF("kind", "src", "dst", "line") for r in rows])


# --- retrieval parts -------------------------------------------------------------
@register("embed")
def _embed(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", hashing_embedder()(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


@register(
    "rerank",
    f"with q as (select item_id as query_id, {_TERMS.format('text')} as t from benchmark), d as (select doc_id as key, {_TERMS.format('text')} as t from documents where true),"
    " p as (select query_id, key, case when len(q.t) = 0 then 0.0 else len(list_intersect(q.t, d.t))::double / len(q.t) end as s from q join d on key % 50 = cast(regexp_extract(cast(query_id as varchar), '(\\d+)', 1) as bigint) % 50)"
    " select query_id, key, round(s, 6) as rerank_score from (select *, max(s) over (partition by query_id) as b from p) x where b = 0 or s >= 0.02",
    views=False,
)
def _rerank(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as key", "text as document", "doc_id % 50 as deal")
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as query_id", "text as query")
    pool = q.selectExpr("query_id", "cast(regexp_extract(cast(query_id as string), '([0-9]+)', 1) as bigint) % 50 as deal").join(d, "deal").drop("deal")
    return search.rerank(pool, q).select("query_id", "key", F.round("rerank_score", 6).alias("rerank_score"))


@register("name_errors", "select c_custkey, case when trim(n) = '' then 'empty' when length(trim(n)) > 128 then 'too long' when contains(n, '..') or contains(n, '/') then 'path characters' end as name_error, case when trim(c_comment) = '' then 'empty' end as content_error from (select c_custkey, c_name as c_comment, case c_custkey % 5 when 0 then '  ' when 1 then c_name || '/x' when 2 then repeat(c_name, 9) when 3 then c_name || '..' else c_name end as n from customer) x", views=False)
def _names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = F.expr("case c_custkey % 5 when 0 then '  ' when 1 then c_name || '/x' when 2 then repeat(c_name, 9) when 3 then c_name || '..' else c_name end")
    return c.select("c_custkey", name_error(n).alias("name_error"), content_error(F.col("c_name")).alias("content_error"))


# --- queries as they come --------------------------------------------------------
_ROUTED = r"""q as (select *, trim(query) as t, upper(regexp_extract(trim(query), '^(\S+)', 1)) as v from asked),
 r as (select *, v in ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS') as hv from q),
 k as (select *, case when hv or t like '/%' then 'endpoint' when contains(t, '#') then 'method' when not contains(t, ' ') and contains(t, '.') and length(t) > 3 then 'fqn'
   when regexp_matches(t, '^[\p{L}_][\p{L}\p{N}_]*$') and regexp_matches(t, '^\p{Lu}.*\p{Ll}') then 'class'
   when regexp_matches(t, '^[\p{L}_][\p{L}\p{N}_]*$') and regexp_matches(t, '^\p{Ll}') and regexp_matches(t, '[\p{Lu}_]') then 'name' end as kind from r)"""
_SHAPES = "case c_custkey % 14 when 0 then 'GET /nation/' || c_nationkey when 1 then 'com.shop.crm.Customer' || c_custkey || '#order' when 2 then 'com.shop.geo.Nation' || c_nationkey when 3 then 'Nation' || c_nationkey when 4 then 'getName' when 5 then 'who calls the order' when 6 then 'delete' when 7 then 'Order # place' when 8 then 'a.b(c)<D>-e' when 9 then '_hidden' when 10 then '/x' when 11 then 'a.b' when 12 then 'ABC' else ' snake_case ' end"


@register(
    "route_queries",
    f"with asked as (select c_custkey as query_id, {_SHAPES} as query from customer), {_ROUTED} select query_id, query, case when kind = 'name' then 'method' when kind <> 'fqn' then kind end as type, case kind when 'endpoint' then 2.5 when 'method' then 2.0 when 'fqn' then 2.0 when 'class' then 1.5 when 'name' then 1.5 else 1.0 end::double as boost,"
    " case when kind in ('method', 'fqn') then t end as substring, case when hv then v end as verb, case when kind = 'endpoint' then case when hv then regexp_extract(t, '^\\S+\\s+(.*)$', 1) else t end end as path, kind from k",
    views=False,
)
def _route(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as query_id", f"{_SHAPES} as query")
    return search.route_queries(q).select("query_id", "query", "hint.*")


_QUERIES = [(1, "GET /nation/0/"), (2, "Nation7"), (3, "com.shop.supply.Supplier1#ship"), (4, "which region does a nation call"), (5, "getName"), (6, "Brand*"), (7, "com.shop.geo.Nation1"), (8, "/nation/1/"), (9, "POST /nation/")]
_ASKED = "asked(query_id, query) as (values " + ", ".join(f"({i}::bigint, '{q}')" for i, q in _QUERIES) + ")"


@register(
    "graph_direct",
    f", {_ASKED}, {_ROUTED}, p as (select *, case when hv then regexp_extract(t, '^\\S+\\s+(.*)$', 1) else t end as path from k where kind is not null),"
    " nodes as (select fqn, name, 'class' as type, true as own from {class} union all select fqn, name, 'method', external is null from {method} union all select id, path, 'endpoint', true from {endpoint}),"
    " s as (select query_id, fqn as key, type, case when kind = 'endpoint' and type = 'endpoint' and contains(name, p.path) and (not hv or fqn like v || ':%') then 1.0 when kind in ('method', 'fqn') and type <> 'endpoint' and contains(fqn, t) then 0.9"
    " when kind = 'class' and type = 'class' or kind = 'name' and type = 'method' and own then case when name = t then 1.0 when contains(name, t) then 0.8 end end::double as score from p, nodes),"
    " o as (select *, cast(row_number() over (partition by query_id order by score desc, case type when 'method' then 0 when 'class' then 1 else 2 end, key) - 1 as int) as rank from s where score is not null) select query_id, key, type, score, rank from o where rank < 50",
)
def _direct(spark, sf_dir):
    return search.graph_direct(demo_graph(spark, sf_dir), search.route_queries(spark.createDataFrame(_QUERIES, "query_id long, query string")))


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"


def _sql_let(x: str, name: str, body: str) -> str:
    return f"list_extract(list_transform([{x}], lambda {name}: {body}), 1)"


def _sql_unquoted(x: str, v: str) -> str:
    """Up to two pairs of quotes, then one at either end."""
    quote = lambda c: f"{c} in ('''', '\"')"
    pair = lambda y: f"case when length({y}) >= 2 and {quote(f'left({y}, 1)')} and left({y}, 1) = right({y}, 1) then {_sql_strip(f'substring({y}, 2, length({y}) - 2)')} else {y} end"
    left = lambda y: f"case when {quote(f'left({y}, 1)')} then {_sql_strip(f'substring({y}, 2)')} else {y} end"
    right = lambda y: f"case when {quote(f'right({y}, 1)')} then {_sql_strip(f'left({y}, length({y}) - 1)')} else {y} end"
    out = _sql_strip(x)
    for k, step in enumerate((pair, pair, left, right)):
        out = _sql_let(out, f"{v}{k}", step(f"{v}{k}"))
    return out


def _sql_trimmed(x: str, v: str) -> str:
    pieces = f"list_filter(list_transform(list_filter(regexp_split_to_array({v}, '[.!?。！？\\n]+'), lambda {v}f: {_sql_strip(f'{v}f')} <> ''), lambda {v}g: {_sql_unquoted(f'{v}g', v + 'h')}), lambda {v}i: length({v}i) between 10 and 250)"
    return _sql_let(_sql_unquoted(x, v + "u"), v, f"case when length({v}) <= 250 then {v} else coalesce(list_extract({pieces}, -1), {_sql_strip(f'right({v}, 250)')}) end")


# long texts as agents send them: a system prompt before the question, quotes around it
_CONTAMINATED = "select doc_id as k, case doc_id % 6 when 0 then text when 1 then text || chr(10) || 'where is the order placed?' when 2 then text || chr(10) || '\"' || left(text, 300) || '?\"' when 3 then left(text, 150) when 4 then text || chr(10) || 'why?' else left(text, 600) || chr(10) || '''the tail of it''' end as raw from documents"
_SAN = f"""with x as ({_CONTAMINATED}), t as (select k, raw, {_sql_strip('raw')} as t from x where raw is not null),
 l as (select k, raw, t, list_filter(list_transform(string_split(t, chr(10)), lambda a: {_sql_strip('a')}), lambda b: b <> '') as a from t),
 q as (select *, list_extract(list_filter(a, lambda y: regexp_matches(y, '[?？]\\s*["'']?\\s*$')), -1) as asked, list_extract(list_filter(list_transform(list_filter(a, lambda y: length(y) >= 10), lambda z: {_sql_trimmed('z', 'c')}), lambda y: length(y) >= 10), -1) as tail from l),
 m as (select *, case when t = '' or length(t) <= 200 then 'passthrough' when length(asked) >= 10 then 'question_extraction' when tail is not null then 'tail_sentence' else 'tail_truncation' end as method from q),
 o as (select *, case method when 'passthrough' then case when t = '' then raw else t end when 'question_extraction' then case when length(asked) > 250 then {_sql_trimmed('asked', 'd')} else asked end when 'tail_sentence' then tail else {_sql_strip('right(t, 250)')} end as query from m)
 select k, query, method, method <> 'passthrough' as was_sanitized, cast(length(case when t = '' then raw else t end) as int) as original_length, cast(length(query) as int) as clean_length from o"""


@register("sanitize_query", _SAN, views=False)
def _sanitize(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("_sanitize_documents")
    x = spark.sql(_CONTAMINATED.replace("from documents", "from _sanitize_documents").replace("'''the tail of it'''", "\"'the tail of it'\"").replace("chr(10)", "char(10)")).where("raw is not null")
    return x.select("k", sanitize(F.col("raw")).alias("s")).select("k", "s.*")
