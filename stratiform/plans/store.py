"""Report-store queries: orders play report versions (session = customer, dimension = priority)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.operators import store as S
from stratiform.plans.base import query, table

KEY = ["session_id", "dimension_key"]
_V = """(SELECT o_custkey AS session_id, o_orderpriority AS dimension_key, o_orderkey AS report_id, o_totalprice AS amount, o_orderstatus AS status, o_orderdate AS generated_at,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)::INTEGER AS version FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("dimension_key"), F.col("o_orderkey").alias("report_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("generated_at"),
    )
    return S.number_versions(o, KEY, ["generated_at", "report_id"])


@query("report_latest", f"SELECT session_id, dimension_key, version, report_id, amount, status FROM {_V} QUALIFY row_number() OVER (PARTITION BY session_id, dimension_key ORDER BY version DESC) = 1")
def report_latest(spark, sf_dir):
    return S.latest(versions(spark, sf_dir), KEY).select(*KEY, "version", "report_id", "amount", "status")


@query("report_latest_value", f"SELECT session_id, dimension_key, max(version) AS version, arg_max(report_id, version) AS report_id FROM {_V} GROUP BY 1, 2")
def report_latest_value(spark, sf_dir):
    return S.latest_value(versions(spark, sf_dir), KEY, "report_id")


@query("report_previous", f"SELECT session_id, dimension_key, version, report_id, lag(report_id) OVER (PARTITION BY session_id, dimension_key ORDER BY version) AS previous_report_id FROM {_V}")
def report_previous(spark, sf_dir):
    return S.previous(versions(spark, sf_dir), KEY, "report_id").select(*KEY, "version", "report_id", "previous_report_id")


@query("report_max_version", f"SELECT c_custkey AS session_id, coalesce(max(version), 0)::INTEGER AS max_version FROM customer LEFT JOIN {_V} v ON c_custkey = session_id GROUP BY 1")
def report_max_version(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return S.max_version(keys, versions(spark, sf_dir), ["session_id"])


@query("report_by_version", f"SELECT session_id, dimension_key, report_id, amount FROM {_V} WHERE version = 2 AND status = 'F'")
def report_by_version(spark, sf_dir):
    return S.where_given(versions(spark, sf_dir), version=2, status="F", report_id=None).select(*KEY, "report_id", "amount")


@query("report_by_id", "SELECT o_orderkey AS report_id, o_custkey AS session_id, o_totalprice AS amount FROM orders WHERE o_orderkey IN (1, 7, 42, 1000)")
def report_by_id(spark, sf_dir):
    o = S.where_given(table(spark, sf_dir, "orders"), o_orderkey=[1, 7, 42, 1000])
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("session_id"), F.col("o_totalprice").alias("amount"))


@query("project_rollup", "SELECT c_mktsegment AS project, count(*) AS n, max(o_orderdate) AS newest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def project_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project"))
    return S.rollup(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").join(c, "o_custkey"), "project", "o_orderdate")


@query("sessions_topn", "SELECT o_orderkey AS session_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def sessions_topn(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at"))
    return S.newest(o, "created_at", "session_id", 100)


@query("reports_for_dependencies", f"SELECT session_id, dimension_key, report_id FROM {_V} WHERE dimension_key IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY session_id, dimension_key ORDER BY version DESC) = 1")
def reports_for_dependencies(spark, sf_dir):
    wanted = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "dimension_key string")
    chosen = S.for_dependencies(versions(spark, sf_dir), wanted, "dimension_key")
    return S.latest(chosen, KEY).select(*KEY, "report_id")


@query("revision_append", f"""SELECT v.session_id, v.dimension_key, v.report_id, (1 + coalesce(t.top, 0) + row_number() OVER (PARTITION BY v.session_id, v.dimension_key ORDER BY v.report_id) - 1)::INTEGER AS version,
 substr(md5('report ' || v.report_id), 1, 16) AS content_hash FROM {_V} v LEFT JOIN (SELECT session_id, dimension_key, max(version) AS top FROM {_V} WHERE version <= 2 GROUP BY 1, 2) t USING (session_id, dimension_key) WHERE v.version > 2""")
def revision_append(spark, sf_dir):
    v = versions(spark, sf_dir)
    new = v.filter("version > 2").select(*KEY, "report_id", F.concat(F.lit("report "), F.col("report_id").cast("string")).alias("content"))
    return S.append_revisions(v.filter("version <= 2"), new, KEY, ["report_id"]).select(*KEY, "report_id", "version", "content_hash")


@query("session_update", """SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_mktsegment END AS project, c_acctbal AS balance FROM customer""")
def session_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("project"), F.col("c_acctbal").alias("balance"))
    changes = c.filter("session_id % 3 = 0").select("session_id", F.lit("updated").alias("project"), F.lit("ignored").alias("unknown"))
    return S.update_known(c, changes, "session_id", ["project"])


@query("session_delete", "SELECT o_orderkey AS report_id, o_custkey AS session_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def session_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("session_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("session_id"))
    return S.delete_keys(o, gone, "session_id").select("report_id", "session_id")


@query("hash_upsert_plan", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'insert' WHEN b.h IS NULL THEN 'keep' WHEN a.h = b.h THEN 'skip' ELSE 'update' END AS action
 FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id""")
def hash_upsert_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = d.filter("doc_id % 3 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    incoming = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5(changed.cast("binary")).alias("digest"))
    return S.upsert_plan(stored, incoming, "doc_id", "digest")


@query("source_priority_merge", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'upload:' || c_name WHEN c_custkey % 3 = 0 THEN 'fetch:' || c_name ELSE 'default' END AS layer,
 CASE WHEN c_custkey % 2 = 0 THEN 'user' WHEN c_custkey % 3 = 0 THEN 'auto' ELSE 'missing' END AS origin FROM customer""")
def source_priority_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    tagged = lambda prefix: F.concat(F.lit(prefix), F.col("c_name")).alias("layer")
    user = c.filter("id % 2 = 0").select("id", tagged("upload:"))
    auto = c.filter("id % 3 = 0").select("id", tagged("fetch:"))
    return S.first_given([("user", user), ("auto", auto), ("missing", c.select("id", F.lit("default").alias("layer")))], "id", "layer")


@query("checkpoint_kinds", """SELECT o_orderkey AS checkpoint_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderpriority = '1-URGENT' THEN 'revision' WHEN o_orderkey % 4 = 0 THEN 'layer' ELSE 'intermediate' END AS kind,
 NOT (CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderpriority = '1-URGENT' THEN 'revision' WHEN o_orderkey % 4 = 0 THEN 'layer' ELSE 'intermediate' END = 'intermediate') AS stable FROM orders""")
def checkpoint_kinds(spark, sf_dir):
    kind = S.stable_checkpoint(F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 4 == 0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("checkpoint_id"), kind.alias("kind"), (kind != "intermediate").alias("stable"))


@query("session_progress", """SELECT session_id, status, round(least(layer, 3) / 3.0 * 100, 1) AS progress FROM (SELECT o_custkey AS session_id, count(DISTINCT o_orderpriority) AS layer,
 CASE WHEN count(DISTINCT o_orderpriority) >= 4 THEN 'completed' WHEN bool_or(o_orderstatus = 'P') THEN 'paused' WHEN count(*) > 1 THEN 'running' ELSE 'pending' END AS status FROM orders GROUP BY 1)""")
def session_progress(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.countDistinct("o_orderpriority").alias("layer"), F.bool_or(F.col("o_orderstatus") == "P").alias("paused"), F.count(F.lit(1)).alias("n"))
    status = S.session_status(F.col("layer") >= 4, F.col("paused"), F.col("n") > 1)
    return g.select("session_id", status.alias("status"), F.round(F.least("layer", F.lit(3)) / 3.0 * 100, 1).alias("progress"))


@query("layer_char_stats", "SELECT source AS layer, count(*) AS n_dimensions, sum(length(text))::BIGINT AS n_chars, max(length(text))::BIGINT AS longest FROM documents GROUP BY 1")
def layer_char_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("layer")).agg(F.count(F.lit(1)).alias("n_dimensions"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("source_chunk_counts", "SELECT source, count(*) AS n_chunks, arg_min(lang, doc_id) AS doc_type FROM documents GROUP BY 1")
def source_chunk_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("lang", "doc_id").alias("doc_type"))


@query("knowledge_totals", "SELECT count(DISTINCT source) AS n_documents, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM documents")
def knowledge_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("report_summaries", "SELECT doc_id AS report_id, substr(text, 1, 500) AS summary, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS preview FROM documents")
def report_summaries(spark, sf_dir):
    preview = F.when(F.length("text") > 1000, F.concat(F.substring("text", 1, 1000), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), F.substring("text", 1, 500).alias("summary"), preview.alias("preview"))


@query("reducer_lists", """SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
def reducer_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).withColumn("types", F.array("event_type"))
    return S.merge_lists(e, "user_id", "types", "event_id").select("user_id", F.array_join("types", ",").alias("types"))


@query("reducer_maps", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def reducer_maps(spark, sf_dir):
    return S.merge_maps(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "event_id")


@query("completion_rollback", f"SELECT session_id, dimension_key, version, report_id FROM {_V} WHERE version <= 2")
def completion_rollback(spark, sf_dir):
    return versions(spark, sf_dir).filter("version <= 2").select(*KEY, "version", "report_id")
