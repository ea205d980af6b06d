"""Per-session event streams: batch forms of sequence, replay and folds, and their streaming twins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "error")
REPLAY, HISTORY, HEARTBEAT_S = 50, 5000, 30


def sequence(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Number the events of each session from 1."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def replay(numbered: DataFrame, session: str, after: int, keep: int = REPLAY) -> DataFrame:
    """Events after ``after`` among the last ``keep`` of each session."""
    w = Window.partitionBy(session).orderBy(F.desc("seq"))
    return numbered.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= keep) & (F.col("seq") > after)).drop("_r")


def last_values(numbered: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value of the newest event of each key."""
    return numbered.groupBy(*keys).agg(F.max_by(value, "seq").alias(value), F.max("seq").alias("seq"))


def silences(events: DataFrame, session: str, time: str, order: list[str], seconds: int = HEARTBEAT_S) -> DataFrame:
    """Gaps longer than ``seconds``, and the heartbeats a listener would have been sent in each."""
    before = F.lag(time).over(Window.partitionBy(session).orderBy(*order))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(time)) - micros(F.col("_before"))) / 1e6
    return events.withColumn("_before", before).withColumn("gap_s", gap).filter(F.col("gap_s") > seconds).withColumn("beats", F.floor(F.col("gap_s") / seconds).cast("long")).drop("_before")


def accumulate(chunks: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Text accumulated so far in each key, at every chunk."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("accumulated", F.array_join(F.collect_list(text).over(w), ""))


def batches(events: DataFrame, keys: list[str], time: str, millis: int, value: str, tie: str) -> DataFrame:
    """Last value of each key in each interval: what a display that merges updates would show.

    Of events of one time and ``tie`` the greatest value is last, so equal ones give the same in any order; a null
    value shows nothing, so the one before it stays. A null time or ``tie`` comes before all others. Intervals are
    counted from 1970 in both directions; events without a time share one.
    """
    bucket = F.floor(F.unix_millis(F.col(time).cast("timestamp")) / millis).cast("long")
    return events.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, tie, value))).alias(value), F.count(F.lit(1)).alias("n"))


def subscribe_order(numbered: DataFrame, kind: str, ranks: dict[str, int], session: str) -> DataFrame:
    """Events as a new listener gets them: by priority of their kind, then sequence; terminal kinds stay out."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(kind)], F.lit(99))
    live = numbered.filter(~F.col(kind).isin(*TERMINAL)).withColumn("priority", rank)
    return live.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy("priority", "seq")))


def expired(events: DataFrame, session: str, time: str, now: Column, hours: int = 24) -> DataFrame:
    """Sessions whose newest event is older than the time to live."""
    g = events.groupBy(session).agg(F.max(time).alias("last_seen"))
    return g.filter(F.col("last_seen") < now - F.expr(f"INTERVAL {hours} HOURS"))


def wire_format(df: DataFrame) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(*df.columns)), F.lit("\n\n"))


def windowed(events: DataFrame, time: str, width: str, slide: str | None, by: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window; on a stream, events later than ``late`` are dropped."""
    out = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return out.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(time, late) if events.isStreaming else events
    return out.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sequence_stream(events: DataFrame, session: str) -> DataFrame:
    """The stream twin of ``sequence``: a counter per session kept as state, freed after the time to live.

    Within a micro-batch events are ordered by (ts, event_id), across batches by arrival.
    """

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
        rows["seq"] = range(seq + 1, seq + 1 + len(rows))
        state.update((seq + len(rows),))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 24 * 3600 * 1000)
        yield rows[[session, "event_id", "seq"]]

    timed = events.withWatermark("ts", "1 hour").groupBy(session)
    return timed.applyInPandasWithState(number, f"{session} long, event_id long, seq long", "seq long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Any:
    """Process what is there and stop: restarts from the checkpoint repeat nothing."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_stream(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
