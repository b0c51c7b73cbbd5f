"""PageRank after a change: residuals are pushed from the last ranks over the edges that changed.

Kept for every node are its weight w, its mass and a residual, with residual = w + alpha P mass - mass; the rank is the
mass over the sum of all. A change of edges or weights alters the residual at the ends of changed edges and at changed nodes
alone. A push adds a node's residual to its mass and hands alpha of it on along the node's edges; nodes whose residual is
under ``cut`` keep it. With cut = tolerance (1 - alpha) total / nodes, what is kept back is at most ``tolerance`` of the
total mass, however many changes came before, as it stays in the table and is pushed once it adds up.

Work and reading follow the nodes that a change reaches: edges are asked for by the nodes of a frontier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import checkpointed
from .traverse import SENT

#: Pushes after which a change counts as not converging.
MOST_PUSHES = 400


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def _dealt(edges: DataFrame, amounts: DataFrame, alpha: float) -> DataFrame:
    """(node, d): alpha times each node's amount (node, a) in equal parts to the ends of its distinct edges (src, dst)."""
    own = edges.join(_small(amounts.withColumnRenamed("node", "src")), "src")
    deg = own.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    return own.join(deg, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.lit(alpha) * F.col("a") / F.col("deg")).alias("d"))


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src) of nodes whose distinct edges (src, dst) differ."""
    a, b = (x.select("src", "dst").distinct() for x in (old, new))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("src").distinct()


def start(old_edges: DataFrame, new_edges: DataFrame, ranks: DataFrame, weights: DataFrame, alpha: float = 0.85) -> DataFrame:
    """(node, dm, r): residuals that a change makes, beside those kept.

    ``old_edges`` and ``new_edges`` (src, dst) are the distinct ones of the sources that changed, ``ranks`` (node, w, mass,
    residual) of at least all nodes in ``weights`` and all these sources; ``weights`` (node, w) are the new ones of nodes
    that may have changed, 0 for what is gone.
    """
    amounts = ranks.select("node", F.col("mass").alias("a"))
    gone = _dealt(old_edges, amounts.join(old_edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi"), alpha)
    come = _dealt(new_edges, amounts.join(new_edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi"), alpha)
    before = ranks.select("node", F.col("w").alias("w0"))
    moved = weights.join(before, "node", "left").select("node", (F.col("w") - F.coalesce("w0", F.lit(0.0))).alias("d"))
    each = moved.unionByName(come).unionByName(gone.select("node", (-F.col("d")).alias("d")))
    return each.groupBy("node").agg(F.sum("d").alias("r")).where("r <> 0").select("node", F.lit(0.0).alias("dm"), "r")


def push(state: DataFrame, kept: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame], DataFrame], cut: float, alpha: float = 0.85) -> tuple[DataFrame, int, int]:
    """(node, dm, r) when no residual is over ``cut``, the number of pushes, and the nodes pushed in all.

    ``kept(nodes)`` gives (node, residual) of nodes from before the change, ``edges(nodes)`` their distinct edges (src, dst) after it.
    """
    state, work = checkpointed(state), 0
    met = state.select("node").limit(0)
    for k in range(MOST_PUSHES):
        # residuals kept from earlier changes count once a node is met
        fresh = checkpointed(state.select("node").join(met, "node", "left_anti"))
        met = met.unionByName(fresh)
        old = kept(fresh).select("node", F.lit(0.0).alias("dm"), F.col("residual").alias("r"))
        state = checkpointed(state.unionByName(old).groupBy("node").agg(F.sum("dm").alias("dm"), F.sum("r").alias("r")))
        over = F.abs("r") > cut
        hot = checkpointed(state.where(over).select("node", F.col("r").alias("a")))
        n = hot.count()
        if not n:
            return state, k, work
        work += n
        got = _dealt(edges(hot.select("node")), hot, alpha).select("node", F.lit(0.0).alias("dm"), F.col("d").alias("r"))
        done = state.select("node", F.when(over, F.col("dm") + F.col("r")).otherwise(F.col("dm")).alias("dm"), F.when(over, 0.0).otherwise(F.col("r")).alias("r"))
        state = done.unionByName(got).groupBy("node").agg(F.sum("dm").alias("dm"), F.sum("r").alias("r"))
    raise RuntimeError(f"residuals are over {cut} after {MOST_PUSHES} pushes")


def merged(ranks: DataFrame, state: DataFrame, weights: DataFrame) -> DataFrame:
    """Ranks (node, w, mass, residual) after a push; nodes of weight 0 go."""
    new = weights.select("node", F.col("w").alias("w1")).join(state.select("node", "dm", F.col("r").alias("r1")), "node", "full")
    both = ranks.join(new, "node", "full")
    w = F.coalesce("w1", "w")
    # the state's residual holds what was kept before
    out = both.select("node", w.alias("w"), (F.coalesce("mass", F.lit(0.0)) + F.coalesce("dm", F.lit(0.0))).alias("mass"), F.coalesce("r1", "residual", F.lit(0.0)).alias("residual"))
    return out.where("w is not null and w > 0")
