"""Event-stream queries in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.plans.base import query, table
from stratiform.streaming import events as V

_N = "n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS seq FROM events)"


def numbered(spark, sf_dir):
    return V.sequence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query("event_seq", f"WITH {_N} SELECT user_id, event_id, seq FROM n")
def event_seq(spark, sf_dir):
    return numbered(spark, sf_dir).select("user_id", "event_id", "seq")


@query("event_replay", f"WITH {_N} SELECT user_id, event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM n) WHERE r <= 50 AND seq > 20")
def event_replay(spark, sf_dir):
    return V.replay(numbered(spark, sf_dir), "user_id", 20).select("user_id", "event_id", "seq")


@query("last_value_cache", f"WITH {_N} SELECT user_id, event_type, arg_max(value, seq) AS value, max(seq) AS seq FROM n GROUP BY 1, 2")
def last_value_cache(spark, sf_dir):
    return V.last_values(numbered(spark, sf_dir), ["user_id", "event_type"], "value")


@query("heartbeat_gaps", "SELECT user_id, event_id, round(gap, 3) AS gap_s, floor(gap / 30)::BIGINT AS beats FROM (SELECT user_id, event_id, epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) WHERE gap > 30")
def heartbeat_gaps(spark, sf_dir):
    return V.silences(table(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_id"]).select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"), "beats")


@query("accumulate_text", "SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS accumulated FROM conversations")
def accumulate_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("piece"))
    return V.accumulate(c, ["conv_id"], ["turn"], "piece").select("conv_id", "turn", "accumulated")


@query("delta_batches", """WITH b AS (SELECT *, floor(epoch_us(ts) / 3600000000)::BIGINT AS bucket FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, bucket, value IS NULL ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST, value DESC) AS r FROM b)
 SELECT user_id, event_type, bucket, max(value) FILTER (r = 1) AS value, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def delta_batches(spark, sf_dir):
    return V.batches(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600000, "value", "event_id")


@query("subscribe_order", f"WITH {_N} SELECT user_id, event_id, priority, (row_number() OVER (PARTITION BY user_id ORDER BY priority, seq))::INTEGER AS position FROM (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 99 END AS priority FROM n WHERE event_type NOT IN ('completed', 'error'))")
def subscribe_order(spark, sf_dir):
    return V.subscribe_order(numbered(spark, sf_dir), "event_type", {"signup": 0, "purchase": 1}, "user_id").select("user_id", "event_id", "priority", "position")


@query("expired_sessions", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR")
def expired_sessions(spark, sf_dir):
    return V.expired(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return V.windowed(table(spark, sf_dir, "events"), "ts", "10 minutes", None, "event_type").withColumn("total", F.round("total", 4))


@query("sliding_counts", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    return V.windowed(table(spark, sf_dir, "events"), "ts", "10 minutes", "5 minutes", "event_type").withColumn("total", F.round("total", 4))


@query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_counts(spark, sf_dir):
    return V.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")


@query("json_props_stats", "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, max(json_extract(props, '$.k')::BIGINT) AS k_max FROM events GROUP BY 1")
def json_props_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))
