"""A bounded queue for each listener: what overflows waits its turn, and nothing is lost or sent twice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events that a listener takes in a round (a fixed value of the service).
CAPACITY = 2000


def delivery_rounds(events: DataFrame, session: str, number: str, arrived: Column, capacity: int = CAPACITY) -> DataFrame:
    """Add ``round``, in which each event leaves a queue that gives ``capacity`` events a round, in order.

    ``number`` counts a session's events from 1, ``arrived`` is the round of arrival and does not
    fall with it. The n-th event leaves when it has come and a round after the one ``capacity``
    places before it, so its round is the latest arrival among the places n, n - capacity, ...,
    each put off by the rounds between: a running maximum in each residue of n, which deals even
    a session of most events over ``capacity`` groups.
    """
    turn = F.floor(F.col(number) / capacity)
    lane = Window.partitionBy(session, F.pmod(F.col(number), F.lit(capacity))).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("round", (F.max(arrived - turn).over(lane) + turn).cast("long"))


class QueueProcessor(StatefulProcessor):
    """Gives each session at most ``capacity`` events a round; the rest waits in order in a map state.

    A map by place is the pending list: taking from its front and adding at its end touches only
    those places. A timer calls the next round while events wait. Numbers already seen are repeats.
    """

    def __init__(self, session: str, capacity: int, millis: int) -> None:
        self.session, self.capacity, self.millis = session, capacity, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "first long, last long, round long")
        self.pending = handle.getMapState("pending", "place long", "number long, payload string")
        self.seen = handle.getValueState("seen", "number long")

    def _drain(self, key: Any, first: int, last: int, turn: int, now: int) -> Iterator[Row]:
        stop = min(last, first + self.capacity)
        for place in range(first, stop):
            number, payload = self.pending.getValue((place,))
            self.pending.removeKey((place,))
            yield Row(**{self.session: key[0], "number": number, "payload": payload, "round": turn})
        self.ends.update((stop, last, turn + 1))
        if stop < last:
            self.handle.registerTimer(now + self.millis)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        first, last, turn = self.ends.get() if self.ends.exists() else (0, 0, 0)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for number, payload in sorted((r["number"], r["payload"]) for r in rows):
            if number > seen:
                self.pending.updateValue((last,), (number, payload))
                last, seen = last + 1, number
        self.seen.update((seen,))
        waiting = list(self.handle.listTimers())
        if waiting:  # a round is due already: what came joins the end of the queue
            self.ends.update((first, last, turn))
            return
        yield from self._drain(key, first, last, turn, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        first, last, turn = self.ends.get()
        yield from self._drain(key, first, last, turn, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, session: str, number: str, payload: str, capacity: int = CAPACITY, millis: int = 100) -> DataFrame:
    """The stream twin of ``delivery_rounds``: (session, number, payload, round), ``capacity`` a session and round.

    Events of a session must arrive by number; ones that come again are dropped. A source bounds
    what enters a micro-batch with its own option (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``),
    which is the back-pressure; the session must run with the RocksDB state store.
    """
    kind = events.schema[session].dataType.simpleString()
    rows = events.select(session, F.col(number).cast("long").alias("number"), F.col(payload).cast("string").alias("payload"))
    out = f"{session} {kind}, number long, payload string, round long"
    return rows.groupBy(session).transformWithState(QueueProcessor(session, capacity, millis), out, "Append", "ProcessingTime")
