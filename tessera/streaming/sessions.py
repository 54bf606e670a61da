"""Sessions on streams: by silence with the built-in windows, and to an outcome with state and timers of their own."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import ship_package


def sessions_by_silence(events: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    """by, began, ended, n: what lies less than the gap apart is one session, which ends a gap after its last event. On a
    stream with a watermark, late events within it extend sessions and merge those that they connect; a session is
    complete, and its state gone, once the watermark is at its end. Of a table, all sessions. Null times have none."""
    counts = events.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return counts.select(by, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


class SessionsToOutcome(StatefulProcessor):
    """Per key, the open session and the events that the watermark has not reached.

    Events wait until the watermark is at their time, the first of which has a timer, so however they arrive they are taken
    in the order of their times. An outcome ends the session with its event; so does silence, for which the open session
    has a timer. What has ended is emitted and its state cleared: a silent key has neither state nor timers. What waits is one
    value of packed numbers (time, number, whether it is an outcome), read and written at once: a list's entries would be sent one by one.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "events binary")
        self.open = handle.getValueState("open", "began long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = array("q")
        for r in rows:
            new.extend(r[1:4])
        if new:
            before = self.waiting.get()
            self.waiting.update(((bytes(before[0]) if before else b"") + new.tobytes(),))
            self._wake(min(new[::3]))
        return iter(())

    def _wake(self, at: int) -> None:
        """Have a timer at a time in microseconds, once the watermark is there."""
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.waiting.get()
        flat = array("q", bytes(held[0]) if held else b"")
        waiting = sorted(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
        due = [w for w in waiting if w[0] <= now * 1000]
        rest = waiting[len(due) :]
        if due and rest:
            self.waiting.update((array("q", [x for w in rest for x in w]).tobytes(),))
        elif due:
            self.waiting.clear()
        if rest:
            self._wake(rest[0][0])
        known = self.open.get()
        session = tuple(known) if known else None
        for at, _, over in due:
            if session and at - session[1] >= self.gap * 1000:
                yield self._closed(key, session, False)
                session = None
            session = (session[0], at, session[2] + 1) if session else (at, at, 1)
            if over:
                yield self._closed(key, session, True)
                session = None
        if session and session[1] + self.gap * 1000 <= now * 1000:
            yield self._closed(key, session, False)
            session = None
        if session:
            self.open.update(session)
            self._wake(session[1] + self.gap * 1000)
        elif known:
            self.open.clear()

    @staticmethod
    def _closed(key, session, by_outcome: bool) -> Row:
        return Row(by=key[0], began=session[0], last=session[1], n=session[2], by_outcome=by_outcome)

    def close(self) -> None:
        pass


def sessions_to_outcome(events: DataFrame, by: str, time: str, kind: str, number: str, gap_seconds: int, outcome: str) -> DataFrame:
    """by, began, last, n, by_outcome of a stream's sessions that are over: those that an event of the kind outcome has
    ended, and those after which nothing came for the gap. Of events at one time, number decides the order, a null one first. Events later than
    the watermark are dropped, and so are null keys and times. Needs the RocksDB state store (run_to_end's rocksdb)."""
    ship_package(events.sparkSession)
    kind_of_key = events.schema[by].dataType.simpleString()
    rows = events.where(F.col(by).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(
        F.col(by).alias("by"), F.unix_micros(time).alias("at"), F.coalesce(F.col(number).cast("long"), F.lit(-(2**63))).alias("number"),
        F.coalesce(F.col(kind) == outcome, F.lit(False)).cast("long").alias("over"), F.col(time),
    )
    schema = f"by {kind_of_key}, began long, last long, n long, by_outcome boolean"
    found = rows.groupBy("by").transformWithState(SessionsToOutcome(gap_seconds * 1000), schema, "append", "eventtime")
    return found.select(F.col("by").alias(by), F.timestamp_micros("began").alias("began"), F.timestamp_micros("last").alias("last"), "n", "by_outcome")
