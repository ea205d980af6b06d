"""Session transitions, rebuilt events, the event fold and queue rounds: orders are sessions, line items their dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import sessions as T
from stratiform.plans.base import query, table
from stratiform.plans.events import _N, numbered
from stratiform.streaming import fold as E, queue as Q

_PHASE = "(['init', 'layer1', 'layer2', 'layer3', 'completed'])[o_orderkey % 5 + 1]"
_LAYER = "CASE WHEN phase = 'init' THEN 0 WHEN phase LIKE 'layer%' THEN phase[6:6]::INTEGER END"
_S = f"""fin AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber::VARCHAR)) AS finished FROM lineitem GROUP BY 1),
 s AS (SELECT *, {_LAYER} AS layer, list_sort(coalesce(finished, [])) = expected AS same FROM (SELECT o_orderkey AS session_id, {_PHASE} AS phase, o_custkey % 2 = 0 AS step_mode, o_orderkey % 7 = 0 AS is_revision,
 list_transform(range(o_custkey % 5), lambda x: (x + 1)::VARCHAR) AS expected, finished FROM orders LEFT JOIN fin ON l_orderkey = o_orderkey))"""
_OUT = "o AS (SELECT *, CASE WHEN is_revision AND same THEN 'revision_complete' WHEN is_revision THEN 'revising' WHEN layer IS NULL THEN 'ended' WHEN len(expected) = 0 OR NOT same THEN 'incomplete' WHEN step_mode THEN 'paused' WHEN layer < 3 THEN 'advanced' ELSE 'completed' END AS outcome FROM s)"


def sessions(spark, sf_dir):
    fin = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.col("l_linenumber").cast("string"))).alias("finished"))
    phase = F.element_at(F.array(*map(F.lit, T.PHASES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    n = (F.col("o_custkey") % 5).cast("int")
    expected = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    o = table(spark, sf_dir, "orders").join(fin, "o_orderkey", "left")
    return o.select(
        F.col("o_orderkey").alias("session_id"), phase.alias("phase"), (F.col("o_custkey") % 2 == 0).alias("step_mode"), (F.col("o_orderkey") % 7 == 0).alias("is_revision"), F.lit(None).cast("boolean").alias("execution_paused"),
        F.lit(None).cast("boolean").alias("pause_after_step"), F.lit(None).cast("int").alias("previous_layer"), expected.alias("expected"), "finished", expected.alias("impacted"), F.col("finished").alias("revised"),
    )


@query("layer_completion", f"""WITH {_S}, {_OUT} SELECT session_id, outcome, CASE outcome WHEN 'advanced' THEN CASE phase WHEN 'init' THEN 'layer1' WHEN 'layer1' THEN 'layer2' ELSE 'layer3' END WHEN 'completed' THEN 'completed' ELSE phase END AS phase,
 outcome = 'paused' AS execution_paused, CASE WHEN outcome IN ('paused', 'advanced') THEN layer ELSE 0 END AS previous_layer, is_revision AND outcome <> 'revision_complete' AS is_revision, outcome IN ('paused', 'advanced', 'completed', 'revision_complete') AS clear_pending,
 CASE outcome WHEN 'paused' THEN 'layer_completed,layer_paused' WHEN 'advanced' THEN 'layer_completed,layer_started' WHEN 'completed' THEN 'layer_completed' ELSE '' END AS events FROM o""")
def layer_completion(spark, sf_dir):
    out = T.completion(sessions(spark, sf_dir))
    return out.select("session_id", "outcome", "phase", "execution_paused", "previous_layer", "is_revision", "clear_pending", F.array_join("events", ",").alias("events"))


@query("flushed_reports", f"""WITH {_S}, {_OUT} SELECT session_id, l_linenumber AS layer, l_partkey AS report_id FROM o JOIN lineitem ON l_orderkey = session_id
 WHERE CASE WHEN outcome IN ('paused', 'advanced', 'completed') THEN l_linenumber = layer WHEN is_revision THEN list_contains(expected, l_linenumber::VARCHAR) ELSE false END""")
def flushed_reports(spark, sf_dir):
    pending = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("layer"), F.col("l_linenumber").cast("string").alias("dimension_key"), F.col("l_partkey").alias("report_id"))
    return T.flushed(T.completion(sessions(spark, sf_dir)), pending).select("session_id", "layer", "report_id")


_A = "CASE o_orderkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END"
_ANSWER = "CASE WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' AND feedback <> '' THEN 'rejected' WHEN action = 'reject' THEN 'feedback required' END"


@query("review_decisions", f"""WITH d AS (SELECT *, {_ANSWER} AS answer FROM (SELECT o_orderkey AS session_id, {_PHASE} AS phase, {_A} AS action, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS feedback FROM orders))
 SELECT session_id, answer, CASE WHEN answer = 'approved' THEN CASE phase WHEN 'init' THEN 'layer1' WHEN 'layer1' THEN 'layer2' WHEN 'layer2' THEN 'layer3' ELSE 'completed' END ELSE phase END AS phase, CASE answer WHEN 'approved' THEN 'running' WHEN 'rejected' THEN 'revising' ELSE 'paused' END AS status,
 coalesce(answer NOT IN ('approved', 'rejected'), true) AS pause_after_step, CASE WHEN answer = 'rejected' THEN feedback END AS feedback, CASE WHEN answer = 'approved' THEN 1 ELSE 4 END AS current_wave, CASE WHEN answer IS DISTINCT FROM 'rejected' THEN 'e' END AS error FROM d""")
def review_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    s = sessions(spark, sf_dir).select("session_id", "phase", "is_revision", F.lit(True).alias("pause_after_step"), F.lit(2).alias("previous_layer"), F.lit(4).alias("current_wave"), F.lit("paused").alias("status"), F.lit("e").alias("error"))
    d = o.where(k % 3 < 2).select(k.alias("session_id"), F.when(k % 3 == 0, "approve").otherwise("reject").alias("action"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("feedback"), F.lit(None).cast("array<string>").alias("dimensions"))
    return T.decided(s, d).select("session_id", "answer", "phase", "status", "pause_after_step", "feedback", "current_wave", "error")


@query("session_status_view", f"""WITH s AS (SELECT o_orderkey AS k, {_PHASE} AS phase, o_custkey % 2 = 0 AS paused, CASE WHEN o_custkey % 5 = 0 THEN 12.5 END AS progress FROM orders WHERE o_orderkey % 4 > 0),
 v AS (SELECT o_orderkey AS session_id, o_orderdate AS created_at, CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority ELSE '' END AS project_name, coalesce(phase, 'init') AS phase, coalesce(paused, false) AS paused, progress FROM orders LEFT JOIN s ON k = o_orderkey),
 w AS (SELECT *, CASE phase WHEN 'init' THEN 0 WHEN 'completed' THEN 3 ELSE phase[6:6]::INTEGER END AS current_layer FROM v)
 SELECT session_id, created_at, project_name, phase, current_layer, CASE WHEN phase = 'completed' THEN 'completed' WHEN paused THEN 'paused' WHEN phase = 'init' THEN 'pending' ELSE 'running' END AS status, round(coalesce(progress, current_layer / 3.0::DOUBLE * 100), 4) AS progress, phase = 'completed' AS execution_complete FROM w""")
def session_status_view(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    stored = o.select(k.alias("session_id"), F.col("o_orderdate").alias("created_at"), F.when(c % 4 > 0, F.col("o_orderpriority")).alias("project_name"))
    phase = F.element_at(F.array(*map(F.lit, T.PHASES)), (k % 5 + 1).cast("int"))
    states = o.where(k % 4 > 0).select(k.alias("session_id"), phase.alias("phase"), (c % 2 == 0).alias("execution_paused"), F.when(c % 5 == 0, F.lit(12.5)).alias("progress"))
    return T.status_view(states, stored).withColumn("progress", F.round("progress", 4))


_R = f"""s AS (SELECT o_orderkey AS session_id, {_PHASE} AS phase, o_custkey % 3 = 0 AS pause, (o_custkey % 3)::INTEGER AS previous FROM orders), l AS (SELECT *, {_LAYER} AS reached FROM s),
 r AS (SELECT l_orderkey AS session_id, (l_linenumber % 3 + 1)::INTEGER AS layer, l_partkey::VARCHAR AS dimension_key, repeat('x', (l_quantity * 2)::INTEGER) AS content FROM lineitem WHERE l_linenumber <= 6),
 w AS (SELECT session_id, layer, reached FROM r JOIN l USING (session_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT dimension_key) >= 2 AND (reached IS NULL OR layer <= reached)),
 t AS (SELECT w.session_id, w.layer, count(r.layer) AS n, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM w LEFT JOIN r ON r.session_id = w.session_id AND r.layer = w.layer AND reached IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT session_id, 'layer_completed' AS type, layer, NULL AS dimension_key, n AS report_count, chars AS total_chars, 0 AS part FROM t
 UNION ALL SELECT r.session_id, 'dimension_complete', r.layer, dimension_key, NULL, NULL, 0 FROM r JOIN w ON w.session_id = r.session_id AND w.layer = r.layer AND reached IS NOT NULL WHERE length(content) > 50
 UNION ALL SELECT session_id, 'pause', previous, NULL, NULL, NULL, 1 FROM s WHERE pause)"""
_AT = "(row_number() OVER (PARTITION BY session_id ORDER BY part, layer, CASE WHEN type = 'layer_completed' THEN 0 ELSE 1 END, dimension_key))::INTEGER"


def _rebuilt(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 6")
    r = li.select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("layer"), F.col("l_partkey").cast("string").alias("dimension_key"), F.expr("repeat('x', cast(l_quantity * 2 as int))").alias("content"))
    s = sessions(spark, sf_dir).select("session_id", "phase").repartition(T.SHARES, "session_id").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 3 == 0).alias("pause_after_step"), (F.col("o_custkey") % 3).cast("int").alias("previous_layer")), "session_id")
    layers = spark.range(1, 4).select(F.col("id").cast("int").alias("layer"), F.lit(2).alias("expected"))
    return T.rebuilt(s, r, r, layers)


@query("rebuilt_events", f"WITH {_R} SELECT session_id, type, layer, dimension_key, report_count, total_chars, {_AT} AS position FROM e")
def rebuilt_events(spark, sf_dir):
    return _rebuilt(spark, sf_dir)


@query("restored_history", f"""WITH {_R}, x AS (SELECT session_id, type, layer, 1 AS part, {_AT} AS pos FROM e), k AS (SELECT l_orderkey AS session_id, l_linenumber AS pos, CASE WHEN l_partkey % 4 = 0 THEN 'layer_completed' ELSE 'dimension_delta' END AS type, l_linenumber AS layer FROM lineitem WHERE l_orderkey % 2 = 0),
 own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC, type DESC) AS n FROM (SELECT DISTINCT * FROM k)) WHERE n <= 5), u AS (SELECT session_id, 0 AS part, pos, type, layer FROM own UNION ALL SELECT session_id, 1, pos, type, layer FROM x WHERE session_id NOT IN (SELECT session_id FROM k WHERE type = 'layer_completed'))
 SELECT session_id, count(*) AS n, count(*) FILTER (part = 1) AS n_rebuilt, max(pos) FILTER (part = 0)::BIGINT AS last_seq FROM u GROUP BY 1""")
def restored_history(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0")
    own = li.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_partkey") % 4 == 0, "layer_completed").otherwise("dimension_delta").alias("type"), F.col("l_linenumber").alias("layer")).distinct()
    out = T.restored_history(own.withColumn("from_store", F.lit(True)), _rebuilt(spark, sf_dir), most=5)
    stored = own.groupBy("session_id").agg(F.max("seq").cast("long").alias("last_seq"), F.least(F.count(F.lit(1)), F.lit(5)).alias("_own"))
    n = out.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(stored, "session_id", "left")
    return n.select("session_id", "n", (F.col("n") - F.coalesce("_own", F.lit(0))).alias("n_rebuilt"), "last_seq")


_KIND = "CASE event_type WHEN 'signup' THEN 'layer_started' WHEN 'view' THEN 'dimension_start' WHEN 'click' THEN 'dimension_delta' WHEN 'purchase' THEN 'dimension_complete' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'layer_paused' ELSE 'resumed' END END"


def session_events(spark, sf_dir):
    """Events of users as those of sessions: kinds by event type, layer and dimension by id."""
    k = F.col("event_id")
    kinds = {"signup": F.lit("layer_started"), "view": F.lit("dimension_start"), "click": F.lit("dimension_delta"), "purchase": F.lit("dimension_complete"), "error": F.when(k % 2 == 0, "layer_paused").otherwise("resumed")}
    kind = F.coalesce(*[F.when(F.col("event_type") == name, value) for name, value in kinds.items()])
    text = F.when(F.col("event_type") == "click", F.repeat(F.lit("x"), (k % 50 + 1).cast("int")))
    data = E.described(layer=(k % 2 + 1).cast("int"), dimension_key=F.substring(F.lit("abc"), (k % 3 + 1).cast("int"), F.lit(1)), accumulated=text)
    return numbered(spark, sf_dir).select("user_id", "seq", kind.alias("type"), (k % 2 + 1).cast("int").alias("layer"), data.alias("data"), "event_id")


@query("event_fold", f"""WITH {_N}, k AS (SELECT user_id, seq, {_KIND} AS type, event_id % 2 + 1 AS layer, event_id % 3 AS dim FROM n),
 st AS (SELECT user_id, layer, max(seq) AS pos FROM k WHERE type = 'layer_started' GROUP BY 1, 2), d AS (SELECT k.*, pos FROM k LEFT JOIN st USING (user_id, layer) WHERE type LIKE 'dimension%'),
 p AS (SELECT user_id, layer, dim, coalesce(arg_max(type, seq) FILTER (type <> 'dimension_delta'), 'dimension_delta') AS last FROM d WHERE pos IS NULL OR seq > pos GROUP BY 1, 2, 3),
 x AS (SELECT user_id, count(*) AS executing FROM p WHERE last <> 'dimension_complete' GROUP BY 1), r AS (SELECT user_id, count(DISTINCT dim) FILTER (layer = 1) AS done_1, count(DISTINCT dim) FILTER (layer = 2) AS done_2 FROM d WHERE type <> 'dimension_start' GROUP BY 1),
 g AS (SELECT user_id, max(seq)::BIGINT AS last_seq, coalesce('layer' || arg_max(layer, seq) FILTER (type IN ('layer_started', 'dimension_complete')), 'init') AS phase, coalesce(CASE arg_max(type, seq) FILTER (type IN ('layer_paused', 'resumed')) WHEN 'layer_paused' THEN 'paused' WHEN 'resumed' THEN 'planning' END, 'idle') AS status FROM k GROUP BY 1)
 SELECT g.*, coalesce(executing, 0)::INTEGER AS executing, coalesce(done_1, 0)::INTEGER AS done_1, coalesce(done_2, 0)::INTEGER AS done_2 FROM g LEFT JOIN x USING (user_id) LEFT JOIN r USING (user_id)""")
def event_fold(spark, sf_dir):
    return E.fold_sessions(session_events(spark, sf_dir), "user_id").select("user_id", "last_seq", "phase", "status", "executing", "done_1", "done_2")


@query("cleared_cache", f"""WITH {_N}, k AS (SELECT user_id, event_id, seq, {_KIND} AS type, event_id % 2 + 1 AS layer FROM n), s AS (SELECT user_id, max(seq) AS pos, arg_max(layer, seq) AS cur FROM k WHERE type = 'layer_started' GROUP BY 1)
 SELECT k.user_id, event_id FROM k LEFT JOIN s USING (user_id) WHERE cur IS NULL OR NOT ((type IN ('dimension_start', 'dimension_complete') AND seq < pos) OR (type = 'layer_started' AND layer <> cur))""")
def cleared_cache(spark, sf_dir):
    return T.cached_events(session_events(spark, sf_dir), "user_id", "seq", "type", "layer").select("user_id", "event_id")


@query("delivery_rounds", f"""WITH RECURSIVE {_N}, a AS (SELECT user_id, event_id, seq, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM n),
 d AS (SELECT user_id, event_id, seq, day AS round FROM a WHERE seq <= 2 UNION ALL SELECT a.user_id, a.event_id, a.seq, greatest(a.day, d.round + 1) FROM d JOIN a ON a.user_id = d.user_id AND a.seq = d.seq + 2) SELECT user_id, event_id, round FROM d""")
def delivery_rounds(spark, sf_dir):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return Q.delivery_rounds(numbered(spark, sf_dir), "user_id", "seq", day, 2).select("user_id", "event_id", "round")
