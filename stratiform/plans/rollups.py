"""Roll-ups and merges: orders play sessions and their reports, lineitem the texts and checks of a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.functions import geo
from stratiform.operators import rollups as U, spatial as P
from stratiform.plans.base import query, table
from stratiform.plans.events import numbered
from stratiform.plans.spatial import _F, _H, _P, facilities, points


@query("layer_availability", "SELECT o_orderkey AS session_id, round(((o_orderkey % 2 = 0)::INTEGER + (o_custkey % 3 = 0)::INTEGER + (o_orderstatus = 'F')::INTEGER) / 3.0::DOUBLE, 6) AS rate FROM orders")
def layer_availability(spark, sf_dir):
    flags = [F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 3 == 0, F.col("o_orderstatus") == "F"]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.round(U.availability(flags), 6).alias("rate"))


@query("distance_stats", f"WITH {_P}, {_F} SELECT p.kind, round(min({_H}), 4) AS least, round(avg({_H}), 4) AS mean, round(max({_H}), 4) AS most FROM p JOIN f USING (kind) WHERE {_H} <= 2500 GROUP BY 1")
def distance_stats(spark, sf_dir):
    near = P.weighted_pairs(points(spark, sf_dir), facilities(spark, sf_dir), 2500.0, ["kind"])
    return U.distance_stats(near, ["kind"], times="n").select("kind", *[F.round(c, 4).alias(c) for c in ("least", "mean", "most")])


_ST = "s AS (SELECT label, count(*) AS n, sum((vec_id % 7 = 0)::INTEGER)::BIGINT AS n_empty, sum(vec_id % 13)::BIGINT AS latency FROM embeddings GROUP BY 1)"


def stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 7 == 0).alias("n_empty"), F.sum(F.col("vec_id") % 13).alias("latency"))


@query("overall_retrieval", f"WITH {_ST} SELECT sum(n)::BIGINT AS n, sum(n_empty)::BIGINT AS n_empty, round(sum(n_empty)::DOUBLE / sum(n) * 100, 6) AS empty_rate, round(sum(latency)::DOUBLE / sum(n), 6) AS mean_latency FROM s")
def overall_retrieval(spark, sf_dir):
    out = U.overall(stats(spark, sf_dir), "n", "n_empty", "latency")
    return out.select("n", "n_empty", F.round("empty_rate", 6).alias("empty_rate"), F.round("mean_latency", 6).alias("mean_latency"))


@query("empty_rate_ranks", f"WITH {_ST} SELECT label, n, round(n_empty::DOUBLE / n, 6) AS rate, (row_number() OVER (ORDER BY round(n_empty::DOUBLE / n, 6) DESC, label))::INTEGER AS rank FROM s")
def empty_rate_ranks(spark, sf_dir):
    return U.by_rate(stats(spark, sf_dir).select("label", "n", F.round(F.col("n_empty") / F.col("n"), 6).alias("rate")), "rate", "label")


@query("article_strategies", "SELECT l_orderkey AS plan, l_linestatus AS strategy, count(*) AS n, sum((NOT contains(l_returnflag || l_linestatus, 'R'))::INTEGER)::BIGINT AS n_done FROM lineitem GROUP BY 1, 2")
def article_strategies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linestatus").alias("strategy"), F.concat("l_returnflag", "l_linestatus").alias("content"))
    return U.strategies(li, "plan", "strategy", "content", "R")


@query("keyword_ratios", "SELECT doc_id, round((contains(text, 'the')::INTEGER + contains(text, 'que')::INTEGER + contains(text, 'und')::INTEGER) / 3.0::DOUBLE, 6) AS positive, round((contains(text, 'License')::INTEGER + contains(text, 'token')::INTEGER) / 2.0::DOUBLE, 6) AS negative FROM documents WHERE text IS NOT NULL")
def keyword_ratios(spark, sf_dir):
    a, b = U.keyword_ratios(F.col("text"), ["the", "que", "und"], ["License", "token"])
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.round(a, 6).alias("positive"), F.round(b, 6).alias("negative"))


_L3 = "l1 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'a' || o_custkey END AS text FROM orders WHERE o_orderkey % 2 = 0), l2 AS (SELECT o_orderkey AS k, 'b' || o_custkey AS text FROM orders WHERE o_orderkey % 3 = 0), l3 AS (SELECT o_orderkey AS k, 'c' || o_custkey AS text FROM orders WHERE o_orderkey % 5 = 0)"


def layers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = lambda m, t: o.filter(F.col("o_orderkey") % m == 0).select(F.col("o_orderkey").alias("k"), t.alias("text"))
    name = lambda c: F.concat(F.lit(c), F.col("o_custkey").cast("string"))
    return [row(2, F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(name("a"))), row(3, name("b")), row(5, name("c"))]


@query("dependency_texts", f"WITH {_L3} SELECT o_orderkey AS k, coalesce(nullif(l1.text, ''), l2.text, l3.text) AS text FROM orders LEFT JOIN l1 ON l1.k = o_orderkey LEFT JOIN l2 ON l2.k = o_orderkey LEFT JOIN l3 ON l3.k = o_orderkey WHERE coalesce(nullif(l1.text, ''), l2.text, l3.text) IS NOT NULL")
def dependency_texts(spark, sf_dir):
    return U.first_layer_text(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), layers(spark, sf_dir), "k", "text")


@query("merged_layers", f"WITH {_L3}, u AS (SELECT *, 1 AS layer FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) SELECT k, arg_max(text, layer) AS text, max(layer)::INTEGER AS layer FROM u GROUP BY 1")
def merged_layers(spark, sf_dir):
    return U.later_layers_win(layers(spark, sf_dir), "k").select("k", "text", "layer")


@query("road_source_counts", "SELECT 'map' AS provider, count(*) AS n FROM supplier UNION ALL SELECT 'survey', count(*) FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'none', 0")
def road_source_counts(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"))
    return U.union_with_counts({"map": s, "survey": c, "none": s.filter("false")})[1]


@query("revised_scores", "SELECT a.doc_id, CASE WHEN length(b.text) > 0 THEN round(least(length(b.text), length(a.text))::DOUBLE / greatest(length(b.text), length(a.text), 1), 6) ELSE 0.0 END AS score FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 3")
def revised_scores(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = table(spark, sf_dir, "documents").select((F.col("doc_id") - 3).alias("doc_id"), "text")
    a, b = F.length("old"), F.length("new")
    return U.compared(old, new, "doc_id", F.round(F.least(a, b) / F.greatest(a, b, F.lit(1)), 6)).select("doc_id", "score")


@query("latest_checkpoints", "SELECT o_custkey AS session_id, o_orderkey % 4 AS layer, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS checkpoint_id, max(o_orderdate) AS created FROM orders GROUP BY 1, 2")
def latest_checkpoints(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 4).alias("layer"), F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderdate").alias("created"))
    return U.latest_checkpoint(c, ["session_id", "layer"], "created", "checkpoint_id")


@query("checkpoint_lists", "SELECT o_custkey AS session_id, o_orderkey % 4 AS layer, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS checkpoints FROM orders GROUP BY 1, 2")
def checkpoint_lists(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 4).alias("layer"), F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderdate").alias("created"))
    out = U.checkpoint_lists(c, ["session_id", "layer"], "created", "checkpoint_id")
    return out.select("session_id", "layer", F.array_join(F.transform("checkpoints", lambda x: x.cast("string")), ",").alias("checkpoints"))


@query("newest_reports", """WITH s AS (SELECT c_mktsegment AS project, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS session_id FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
 SELECT project, session_id, l_returnflag AS dimension_key, arg_max(l_partkey, (l_linenumber, l_partkey)) AS report_id, max(l_linenumber) AS version FROM s JOIN lineitem ON l_orderkey = session_id GROUP BY 1, 2, 3""")
def newest_reports(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project"))
    sessions = table(spark, sf_dir, "orders").join(c, "o_custkey").select("project", F.col("o_orderkey").alias("session_id"), "o_orderdate")
    reports = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("dimension_key"), F.col("l_linenumber").alias("version"), F.col("l_partkey").alias("report_id"))
    return U.newest_report(c.select("project").distinct(), sessions, reports, "project", "session_id", "o_orderdate", "dimension_key", "version", "report_id")


@query("layer_switches", "SELECT o_orderkey AS session_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 = 0 END, true) AS on_ FROM orders")
def layer_switches(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("session_id"), U.switches(F.when(k % 2 == 0, k % 4 == 0), F.when(k % 3 == 0, k % 9 == 0), F.lit(True)).alias("on_"))


@query("kept_parents", "SELECT o_orderkey AS chunk_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000")
def kept_parents(spark, sf_dir):
    return U.kept_parents(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderdate"), "o_orderdate", "chunk_id").select("chunk_id")


@query("without_source", "SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 7 AND source IS NOT NULL)")
def without_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return U.without_source(d, table(spark, sf_dir, "documents").filter("doc_id % 50 = 7").select("source"), "source").select("doc_id")


@query("inserted_projects", "SELECT c_custkey AS session_id, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, ''), 'plan') AS project FROM customer")
def inserted_projects(spark, sf_dir):
    k = F.col("c_custkey")
    name = U.first_nonempty(F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 == 0, F.col("c_mktsegment")), F.lit("plan"))
    return table(spark, sf_dir, "customer").select(k.alias("session_id"), name.alias("project"))


@query("travel_minutes", f"WITH {_P} SELECT point_id, round({_H} / 1000.0 / 15.0 * 60.0, 4) AS minutes FROM p, (SELECT 116.05::DOUBLE AS lon_2, 24.85::DOUBLE AS lat_2)")
def travel_minutes(spark, sf_dir):
    d = geo.haversine(F.col("lon"), F.col("lat"), F.lit(116.05), F.lit(24.85))
    return points(spark, sf_dir).select("point_id", F.round(U.travel_minutes(d, F.lit(15.0)), 4).alias("minutes"))


@query("nearest_within", f"WITH {_P}, {_F} SELECT point_id, facility_id, rank FROM (SELECT point_id, facility_id, (row_number() OVER (PARTITION BY point_id ORDER BY round({_H}, 4), facility_id))::INTEGER AS rank FROM p JOIN f USING (kind) WHERE {_H} <= 2000) WHERE rank <= 3")
def nearest_within(spark, sf_dir):
    return P.nearest_k(points(spark, sf_dir), facilities(spark, sf_dir), 2000.0, 3, "point_id", "facility_id", ["kind"]).select("point_id", "facility_id", "rank")


@query("water_buffer", f"WITH {_P}, {_F}, d AS (SELECT point_id, min({_H}) AS d FROM p, f WHERE {_H} < 400 GROUP BY 1) SELECT p.point_id, round(d, 1) AS distance, d IS NOT NULL AS in_buffer FROM p LEFT JOIN d USING (point_id)")
def water_buffer(spark, sf_dir):
    out = P.in_buffer(points(spark, sf_dir), facilities(spark, sf_dir).drop("kind"), 400.0, "point_id")
    return out.select("point_id", F.round("distance", 1).alias("distance"), "in_buffer")
