"""The reader's relations kept up to date from a stream of interactions; results equal the batch forms in ``operators.reader``."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.operators.reader import HISTORY

RECENT = "user_id long, key string, ts timestamp, rank int"


def recent_stream(events: DataFrame, most: int = HISTORY) -> DataFrame:
    """After each trigger, the latest ``most`` different keys of each user that had events.

    ``events``: ``user_id``, ``key``, ``ts``, ``event_id``. A user's state is at most ``most`` keys, whatever the stream's length; an
    event that comes late takes the place that its time gives it, unless it is older than all that are kept.
    """
    state = "keys array<string>, ts array<long>, ids array<long>"

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        keys, ts, ids = held.get if held.exists else ([], [], [])
        last = {k: (t, i) for k, t, i in zip(keys, ts, ids, strict=True)}
        for batch in batches:
            for k, t, i in zip(batch["key"], batch["ts"], batch["event_id"], strict=True):
                last[k] = max(last.get(k, (-1 << 62, 0)), (pd.Timestamp(t).value // 1000, int(i)))
        best = sorted(last.items(), key=lambda x: x[0])
        best = sorted(best, key=lambda x: x[1], reverse=True)[:most]
        held.update(([k for k, _ in best], [t for _, (t, _) in best], [i for _, (_, i) in best]))
        yield pd.DataFrame({"user_id": [key[0]] * len(best), "key": [k for k, _ in best], "ts": [pd.Timestamp(t * 1000) for _, (t, _) in best], "rank": range(1, len(best) + 1)})

    return events.groupBy("user_id").applyInPandasWithState(update, RECENT, state, "update", GroupStateTimeout.NoTimeout)


def toggled_stream(events: DataFrame, *key: str) -> DataFrame:
    """Keys toggled an odd number of times so far (complete output)."""
    return events.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select(*key)


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each kind in each window of time; windows close when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n")).select("window.start", "key", "n")


NOTES = "user_id long, ref string, text string, saved timestamp"


class NoteKeeper(StatefulProcessor):
    """A note as its writer leaves it: what was typed last counts when nothing has been typed for a while."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.typed = handle.getValueState("typed", "text string, at long, id long")
        self.kept = handle.getValueState("kept", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.typed.get() if self.typed.exists() else None
        for at, number, text in sorted(((int(r["ts"].timestamp() * 1000), r["event_id"], r["text"]) for r in rows), key=lambda e: e[:2]):
            if last is not None and at - last[1] >= self.quiet_ms:
                yield from self.saved(key, last[0], last[1])
            if last is None or (at, number) >= (last[1], last[2]):
                last = (text, at, number)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.typed.update(last)
        self.handle.registerTimer(max(last[1] + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        text, at, _ = self.typed.get()
        self.typed.clear()
        yield from self.saved(key, text, at)

    def saved(self, key: tuple, text: str | None, at: int) -> Iterator[Row]:
        """The change, if there is one, that a text makes when its writer rests."""
        text = (text or "").strip()
        if text == (self.kept.get()[0] if self.kept.exists() else ""):
            return
        if text:
            self.kept.update((text,))
        else:
            self.kept.clear()
        yield Row(user_id=key[0], ref=key[1], text=text or None, saved=datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None))

    def close(self) -> None:
        pass


def notes_stream(edits: DataFrame, quiet_ms: int = 500, late: str = "1 second") -> DataFrame:
    """Notes saved (``text``) and deleted (a null ``text``), from a stream of what is typed: ``user_id``, ``ref``, ``text``, ``ts``, ``event_id``.

    A note is saved when its writer has been quiet for ``quiet_ms`` by the events' own time, with the white space at its ends gone; blank text deletes
    a note that is there. Only changes come out. Of edits of one time the one with the larger id counts; an edit that comes later than
    ``late`` may come too late. A note's state is its last text. Needs the RocksDB state store.
    """
    keyed = edits.withWatermark("ts", late).groupBy("user_id", "ref")
    return keyed.transformWithState(statefulProcessor=NoteKeeper(quiet_ms), outputStructType=NOTES, outputMode="Update", timeMode="eventTime")


def kept_notes(edits: DataFrame) -> DataFrame:
    """What ``notes_stream`` leaves once all is typed, from the same rows in batch: ``user_id``, ``ref``, ``text``."""
    last = edits.groupBy("user_id", "ref").agg(F.max_by("text", F.struct("ts", "event_id")).alias("text"))
    return last.select("user_id", "ref", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
