"""Dependency-graph queries: orders are sessions, their line numbers dimensions that depend on those before them.

The graph of the planning dimensions themselves (``operators.graph.DIMENSIONS``) is fixed and small:
tests hold its goldens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import graph as G
from stratiform.plans.base import query, table
from stratiform.settle import settled

#: Three layers of up to three, two and two lines; keys are unique over all orders.
_D = """d AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS key, l_orderkey AS session_id, (CASE WHEN l_linenumber <= 3 THEN 1 WHEN l_linenumber <= 5 THEN 2 ELSE 3 END)::INTEGER AS layer, l_linenumber AS pos FROM lineitem),
 e AS (SELECT s.key AS src, t.key AS dst, CASE WHEN s.layer = t.layer THEN 'depends_on' WHEN s.layer = 1 THEN 'layer_depends_on' ELSE 'phase_depends_on' END AS kind FROM d s JOIN d t ON s.session_id = t.session_id AND (s.pos = t.pos - 1 OR s.pos = t.pos - 2) AND (s.session_id + t.pos) % 4 > 0),
 c AS (SELECT key FROM d JOIN orders ON o_orderkey = session_id WHERE CASE o_orderstatus WHEN 'F' THEN pos <= 4 WHEN 'O' THEN pos % 3 <> 2 ELSE false END), tg AS (SELECT key AS target FROM d WHERE pos = 2 AND session_id % 3 = 0)"""
_R = "r(key, wave) AS (SELECT key, 1 FROM d UNION ALL SELECT e.dst, r.wave + 1 FROM r JOIN e ON e.src = r.key AND e.kind = 'depends_on'), w AS (SELECT key, max(wave)::INTEGER AS wave FROM r GROUP BY 1)"
_T = "t(target, key, level) AS (SELECT target, target, 0 FROM tg UNION SELECT t.target, e.dst, t.level + 1 FROM t JOIN e ON e.src = t.key), i AS (SELECT target, key, min(level)::INTEGER AS level FROM t WHERE key <> target GROUP BY 1, 2)"
_UNMET = "key NOT IN (SELECT key FROM c) AND key NOT IN (SELECT dst FROM e WHERE src NOT IN (SELECT key FROM c))"


def dims(spark, sf_dir):
    n = F.col("l_linenumber")
    layer = F.when(n <= 3, 1).when(n <= 5, 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + n).alias("key"), F.col("l_orderkey").alias("session_id"), layer.alias("layer"), n.alias("pos")).distinct()


def deps(spark, sf_dir, among=None):
    d = dims(spark, sf_dir) if among is None else among
    kind = F.when(F.col("sl") == F.col("layer"), "depends_on").when(F.col("sl") == 1, "layer_depends_on").otherwise("phase_depends_on")
    # each dimension asks for the two places before it
    asked = d.where((F.col("session_id") + F.col("pos")) % 4 > 0).withColumn("sp", F.explode(F.array(F.col("pos") - 1, F.col("pos") - 2)))
    s = d.select("session_id", F.col("pos").alias("sp"), F.col("key").alias("src"), F.col("layer").alias("sl"))
    return asked.join(s, ["session_id", "sp"]).select("src", F.col("key").alias("dst"), kind.alias("kind"))


def done(spark, sf_dir, among=None):
    d = dims(spark, sf_dir) if among is None else among
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), "o_orderstatus")
    holds = F.when(F.col("o_orderstatus") == "F", F.col("pos") <= 4).when(F.col("o_orderstatus") == "O", F.col("pos") % 3 != 2).otherwise(F.lit(False))
    return d.join(o, "session_id").where(holds).select("key")


def targets(spark, sf_dir):
    return dims(spark, sf_dir).where("pos = 2 and session_id % 3 = 0").select(F.col("key").alias("target"))


@query("dim_waves", f"WITH RECURSIVE {_D}, {_R} SELECT d.key, d.layer, d.pos, w.wave FROM d JOIN w USING (key)")
def dim_waves(spark, sf_dir):
    return G.waves(dims(spark, sf_dir), deps(spark, sf_dir))


@query("impact_tree", f"WITH RECURSIVE {_D}, {_T} SELECT * FROM i")
def impact_tree(spark, sf_dir):
    return G.impact(deps(spark, sf_dir), targets(spark, sf_dir))


@query("direct_downstream", f"WITH {_D} SELECT src, count(*) AS n, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS downstream FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1")
def direct_downstream(spark, sf_dir):
    return G.direct_downstream(deps(spark, sf_dir))


@query("ready_dims", f"WITH {_D} SELECT key, layer, pos FROM d WHERE {_UNMET}")
def ready_dims(spark, sf_dir):
    return G.ready(dims(spark, sf_dir), deps(spark, sf_dir), done(spark, sf_dir)).select("key", "layer", "pos")


@query("dispatch_dims", f"WITH {_D} SELECT key, layer, pos FROM d WHERE layer IN (1, 2) AND {_UNMET}")
def dispatch_dims(spark, sf_dir):
    return G.dispatch(dims(spark, sf_dir), deps(spark, sf_dir), done(spark, sf_dir), 1).select("key", "layer", "pos")


@query("next_wave", f"WITH RECURSIVE {_D}, {_R}, x AS (SELECT session_id, key, wave FROM d JOIN w USING (key) WHERE layer = 1), f AS (SELECT session_id, min(wave) AS wave FROM x WHERE key NOT IN (SELECT key FROM c) GROUP BY 1) SELECT session_id, key, wave FROM x JOIN f USING (session_id, wave)")
def next_wave(spark, sf_dir):
    d = settled(dims(spark, sf_dir).where("layer = 1"))  # edges that count for waves stay within a layer
    levels = G.waves(d, deps(spark, sf_dir, d), keep=["session_id"])
    return G.next_wave(levels.select("session_id", "key", "wave"), done(spark, sf_dir, d), ["session_id"]).select("session_id", "key", "wave")


@query("revision_plan", f"WITH RECURSIVE {_D}, {_T} SELECT target AS key, 0 AS wave FROM tg UNION ALL SELECT key, max(level)::INTEGER FROM i WHERE key IN (SELECT key FROM c) AND key NOT IN (SELECT target FROM tg) GROUP BY 1")
def revision_plan(spark, sf_dir):
    return G.revision_plan(deps(spark, sf_dir), targets(spark, sf_dir), done(spark, sf_dir))


@query("layer_complete", f"WITH {_D} SELECT d.session_id, d.layer, count(*) AS n, count(c.key) AS n_done, count(*) = count(c.key) AS complete FROM d LEFT JOIN c USING (key) GROUP BY 1, 2")
def layer_complete(spark, sf_dir):
    return G.layers_complete(dims(spark, sf_dir), done(spark, sf_dir), ["session_id"])


@query("first_pending", f"WITH {_D} SELECT session_id, layer, min(key) AS key FROM d WHERE key NOT IN (SELECT key FROM c) GROUP BY 1, 2")
def first_pending(spark, sf_dir):
    return G.first_pending(dims(spark, sf_dir), done(spark, sf_dir), ["session_id"])


@query("wave_counts", f"WITH RECURSIVE {_D}, {_R} SELECT d.session_id, d.layer, max(w.wave) AS n_waves, count(*) AS n FROM d JOIN w USING (key) GROUP BY 1, 2")
def wave_counts(spark, sf_dir):
    d = dims(spark, sf_dir)
    found = G.waves(d, deps(spark, sf_dir)).join(d.select("key", "session_id"), "key")
    return found.groupBy("session_id", "layer").agg(F.max("wave").alias("n_waves"), F.count(F.lit(1)).alias("n"))
