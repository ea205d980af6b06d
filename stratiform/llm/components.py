"""Connected components of a link table, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratiform.llm.common import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every endpoint with the smallest id it can reach: (node, component_id).

    ``edges`` has two id columns; loops and repeated rows are allowed, an empty table gives an
    empty result. Each round hooks every node to its smallest neighbour, jumps pointers twice
    and contracts the links, so the links left at least halve in nodes; every exchange is a
    join Spark may split or a sum it combines before the shuffle, so hubs stay harmless.
    """
    e = materialize(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "cc-edges"
    )
    comp = None
    while True:
        hooks = e.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(
            e.select(F.col("a").alias("node"), F.col("b").alias("near"))
        )
        p = hooks.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent"))
        p = materialize(p, "cc-hook")
        hop = p.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        twice = p.join(hop, "parent").select("node", F.col("up").alias("parent")).join(hop, "parent")
        q = materialize(twice.select("node", F.col("up").alias("parent")), "cc-jump")
        if comp is None:
            new = q.select("node", F.col("parent").alias("component_id"))
        else:
            up = q.select(F.col("node").alias("component_id"), "parent")
            new = comp.join(up, "component_id", "left").select("node", F.coalesce("parent", "component_id").alias("component_id"))
        new = materialize(new, "cc-labels")
        qa, qb = q.select(F.col("node").alias("a"), F.col("parent").alias("pa")), q.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = e.join(qa, "a").select("b", "pa").join(qb, "b").where("pa <> pb")
        left = materialize(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        for old in (e, p, q, comp):
            if old is not None:
                release(old)
        e, comp = left, new
        if e.isEmpty():
            release(e)
            return comp
