"""Planning-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import planning as N
from stratiform.plans.base import query, table
from stratiform.plans.events import numbered


@query("query_expansion", "SELECT n_nationkey, n_name || CASE WHEN contains(n_name, 'A') THEN '|' || replace(n_name, 'A', 'x') || '|' || replace(n_name, 'A', 'y') ELSE '' END AS variants FROM nation")
def query_expansion(spark, sf_dir):
    q = N.expand_query(F.col("n_name"), {"A": ["x", "y", "z"]})
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(q, "|").alias("variants"))


@query("next_layers", "SELECT o_orderkey AS session_id, l AS next_layer, CASE WHEN l <= 3 THEN 'layer' || l ELSE 'completed' END AS next_phase FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 + 1 WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END)::INTEGER AS l FROM orders)")
def next_layers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = N.next_layer((F.col("o_orderkey") % 4).cast("int"), [F.col("o_orderstatus") != "O", F.col("o_orderpriority") != "1-URGENT"]).cast("int")
    return o.select(F.col("o_orderkey").alias("session_id"), n.alias("next_layer"), N.phase_of(n).alias("next_phase"))


@query("citation_rates", "SELECT l_returnflag AS grp, count(*) AS n, round(avg((l_linenumber > 2)::INTEGER), 6) AS existence, round(avg((l_quantity * 2 >= 70)::INTEGER), 6) AS accuracy, round(avg((l_tax > 0.04)::INTEGER), 6) AS supportive, round(avg((l_tax <= 0.04)::INTEGER), 6) AS decorative FROM lineitem GROUP BY 1")
def citation_rates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_returnflag").alias("grp"), (F.col("l_linenumber") > 2).alias("exists"), (F.col("l_quantity") * 2).alias("score"), (F.col("l_tax") > 0.04).alias("supportive"))
    return N.citation_rates(c, "grp")


@query("saved_layers", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS seq FROM events),
 d AS (SELECT user_id, seq, event_type, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS k, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS completed_layer FROM n WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT user_id, min(seq) AS seq, min(completed_layer) AS completed_layer FROM d WHERE event_type = 'signup' AND k > 0 GROUP BY user_id, k""")
def saved_layers(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "layer_completed").when(F.col("event_type") == "signup", "checkpoint_saved").otherwise("other")
    return N.saved_layers(numbered(spark, sf_dir).withColumn("kind", kind), "user_id", "kind", "event_id")


@query("summary_parse", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(source) ELSE length(text) END::INTEGER AS word_count, CASE WHEN doc_id % 2 = 0 THEN source ELSE left(text, 200) END AS text_summary FROM documents")
def summary_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("summary", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("source").alias("summary")))).otherwise(F.col("text")))
    p = N.parse_summary(F.col("summary"), F.col("lang"), F.lit(1))
    return d.select("doc_id", p["word_count"].alias("word_count"), p["text_summary"].alias("text_summary"))
