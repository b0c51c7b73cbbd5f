"""What steps leave on disk: compressed tables, packed shards, and no shuffle files or tables that nobody reads."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.operators import rank
from loomgraph.plans import ingest
from loomgraph.plans import delta as deltas
from loomgraph.sources import export

from .graph_fixture import document, save


def size(path):
    return sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file())


def test_written_tables_are_small(spark):
    """A checkpoint takes every name as it is, in each row."""
    df = spark.range(20_000).select(F.concat(F.lit("com.shop.sales.Order"), "id", F.lit("#place(long,java.lang.String)")).alias("src"), F.lit("x").alias("dst"))
    before = size(rank.shared_folder(spark))
    assert rank.checkpointed(df).where("src like '%Order7#%'").count() == 1
    assert size(rank.shared_folder(spark)) - before < 20_000 * 15
    assert spark.conf.get(rank._CLEANUP, "false") == "false"


def test_ranks_leave_what_is_returned(spark):
    edges = spark.range(3000).select(F.concat(F.lit("com.shop.a"), F.col("id") % 700).alias("src"), F.concat(F.lit("com.shop.a"), (F.col("id") * 7) % 900).alias("dst"))
    tables = lambda: set(os.listdir(rank.shared_folder(spark).removeprefix("file:")))
    before = tables()
    got = rank.pagerank(edges, edges.limit(0).select(F.col("src").alias("node")))
    assert len(tables() - before) == 2  # names and ranks
    assert abs(got.agg(F.sum("pagerank")).first()[0] - 1) < 1e-9


def test_shards_are_packed_and_parsed_once(spark, tmp_path):
    g = deltas.graph_of(deltas.fact_tables(export.read_full(spark, save(document(), tmp_path / "full.json"))))
    many = g["calls"].crossJoin(spark.range(3000)).select("src", "dst", F.col("id").cast("int").alias("line"))
    g["calls"] = many
    doc = export.document(g, 4)
    assert "RoundRobin" not in doc._jdf.queryExecution().executedPlan().toString()
    export.write_json(doc, str(tmp_path / "out"))
    export.write_json(doc, str(tmp_path / "plain"), "none")
    assert size(str(tmp_path / "out")) < size(str(tmp_path / "plain")) / 5
    again = export.read_full(spark, str(tmp_path / "out"))
    assert all(f.endswith(".parquet") for f in again.inputFiles())
    calls = ingest.ingest_full(again)["calls"]
    assert sorted(calls.collect()) == sorted(many.collect())


def test_endpoint_documents_move_the_calls_of_handlers(spark, tmp_path):
    """All calls were put in order for a few endpoints."""
    from loomgraph.plans import drawers

    g = deltas.graph_of(deltas.fact_tables(export.read_full(spark, save(document(), tmp_path / "full.json"))))
    docs = drawers.endpoint_docs(g)
    assert {r.id: r.document for r in docs.collect()}["PUT:/orders"] == "PUT /orders | OrderCtl#put | calls: OrderSvc.place"
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("LeftSemi")
