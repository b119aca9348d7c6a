"""Keyed state over events that arrive in any order: marks of a climb, and the walk through a day's items.

Both hold what may still change, and let go of it when the watermark says that it cannot. Rows are updates: of the rows
that a stream gives for one key the last one holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wordloom.operators import puzzles
from wordloom.streaming import events as E

#: What events may be late by; without events for as long, a user's climb is over.
LATE, IDLE_DAYS = "2 days", 90
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000

Event = tuple[int, int, str]  # microseconds, id, type


def marked(open_events: Iterable[Event], misses: int) -> tuple[list[tuple[int, str]], int]:
    """The marks of events in order after so many misses, and the misses that they leave."""
    out = []
    for _, event_id, kind in open_events:
        if kind == "error":
            misses += 1
        elif kind in ("purchase", "signup"):
            out.append((event_id, "revealed" if kind == "signup" else "retry" if misses else "first"))
            misses = 0
    return out, misses


class RungMarks(StatefulProcessor):
    """Keeps the events that the watermark has not passed, and the misses before them. A late event corrects marks after it."""

    def __init__(self, idle_days: int = IDLE_DAYS):
        self.idle_ms = idle_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.misses = handle.getValueState("misses", "n int")
        self.open = handle.getListState("open", "at long, event_id long, kind string")

    def _waiting(self) -> list[Event]:
        return sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []

    def _settle(self, waiting: list[Event], watermark_ms: int) -> None:
        passed = [e for e in waiting if e[0] <= watermark_ms * 1000]  # Spark takes no more of these
        self.misses.update((marked(passed, self._before())[1],))
        left = waiting[len(passed) :]
        self.open.put(left) if left else self.open.clear()

    def _before(self) -> int:
        return self.misses.get()[0] if self.misses.exists() else 0

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        for some in rows:
            waiting += zip((some["ts"].astype("datetime64[us]").astype("int64")).tolist(), some["event_id"].tolist(), some["event_type"].tolist(), strict=True)
        waiting.sort()
        marks, _ = marked(waiting, self._before())
        self._settle(waiting, timerValues.getCurrentWatermarkInMs())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(waiting[-1][0] // 1000 + self.idle_ms)
        if marks:
            yield pd.DataFrame({"event_id": [m[0] for m in marks], "user_id": key[0], "mark": [m[1] for m in marks]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.misses.clear()
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def rung_marks(events: DataFrame, late: str = LATE, idle_days: int = IDLE_DAYS) -> DataFrame:
    """event_id, user_id and mark of each success and hint of the stream `events`; as events.rung_marks() while no user pauses for idle_days.

    Events later than `late` are not taken. An event is kept until the watermark passes it, then only a count is, until
    the user has paused for idle_days; the next event begins a new climb. One user's events of a batch are in one task.
    """
    kept = events.select("event_id", "user_id", "event_type", "ts").where("event_type IN ('error', 'purchase', 'signup')").withWatermark("ts", late)
    return kept.groupBy("user_id").transformWithStateInPandas(RungMarks(idle_days), T.StructType.fromDDL("event_id long, user_id long, mark string"), "Update", "EventTime")


class SessionWalk(StatefulProcessor):
    """Keeps a user's newest day until the watermark passes its end. What was played on an earlier day counts for nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "day int, attempts long, at long, event_id long, last_item long, ended boolean")
        self.done = handle.getMapState("done", "k long", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = tuple(self.day.get()) if self.day.exists() else (-1, 0, -1, -1, None, False)
        for some in rows:
            at = some["ts"].astype("datetime64[us]").astype("int64")
            days = at // (DAY_MS * 1000)
            if (newest := int(days.max())) > now[0]:
                now = (newest, 0, -1, -1, None, False)
                self.done.clear()
            some, at = some[days == now[0]], at[days == now[0]]
            done = some["event_type"] == "purchase"
            for k in some["k"][done].dropna().unique().tolist():
                self.done.updateValue((int(k),), (1,))
            attempts = now[1] + int((some["event_type"] == "error").sum())
            now = (now[0], attempts, *now[2:])
            last = max(zip(at.tolist(), some["event_id"].tolist(), some["k"].tolist(), done.tolist(), strict=True), default=None, key=lambda row: row[:2])
            if last is not None and last[:2] > now[2:4]:
                now = (now[0], attempts, last[0], last[1], None if pd.isna(last[2]) else int(last[2]), last[3])
        self.day.update(now)
        self.handle.registerTimer((now[0] + 1) * DAY_MS)
        yield pd.DataFrame({"user_id": [key[0]], "day": [str(pd.Timestamp(now[0], unit="D").date())], "completed": [sum(1 for _ in self.done.keys())], "attempts": [now[1]], "last_item": pd.array([now[4]], "Int64"), "ended": [now[5]]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.day.exists() and (self.day.get()[0] + 1) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.day.clear()
            self.done.clear()
        return iter([])

    def close(self) -> None:
        pass


def session_walk(events: DataFrame, late: str = LATE) -> DataFrame:
    """user_id, day, completed, attempts, last_item and ended of each user's newest day in the stream `events`; as puzzles.session_walk()."""
    kept = events.select("event_id", "user_id", "event_type", "ts", F.from_json("props", "k long")["k"].alias("k")).withWatermark("ts", late)
    return kept.groupBy("user_id").transformWithStateInPandas(SessionWalk(), T.StructType.fromDDL("user_id long, day string, completed long, attempts long, last_item long, ended boolean"), "Update", "EventTime")


def _with_rocks(spark: SparkSession, run):
    """What run() gives while keyed state is held in RocksDB, which transformWithState asks for."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return run()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def stream_rung_marks(spark: SparkSession, d: str) -> DataFrame:
    """As event_rung_marks, from the stream."""
    return _with_rocks(spark, lambda: E.streamed(spark, d, rung_marks, ["event_id"]))


def stream_session_walk(spark: SparkSession, d: str) -> DataFrame:
    """As session_walk, from the stream."""
    return _with_rocks(spark, lambda: E.streamed(spark, d, session_walk, ["user_id"]))


QUERIES = {"stream_rung_marks": stream_rung_marks, "stream_session_walk": stream_session_walk}
ORACLES = {"stream_rung_marks": E.ORACLES["event_rung_marks"], "stream_session_walk": puzzles.ORACLES["session_walk"]}
