"""The clock of running exams: warnings before the end, the end itself, and exams that are taken up again.

Every event carries when its attempt started and how long it may last, as the client keeps it, so an attempt is known from
its first event on, whichever that is. Attempts are dealt into slots by a hash; the state of a slot has an entry for each
millisecond at which attempts of it end, with one timer on event time, so calls of the state are counted by slots and ends
and not by attempts. The timer reports the attempts that end and removes the entry. Spark drops events that are older than
the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: Seconds before the end at which a warning is due, how long it may come late, resumptions that end an attempt, and slots.
WARNINGS, WINDOW, STRIKES, SLOTS = (600, 300, 60), 10, 3, 1024
_STATE = "who array<string>, until array<long>, strikes array<int>, closed array<boolean>, given array<array<long>>"
#: Attempts are told apart by their columns as JSON, to the microsecond.
_WHO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class ExamClock(StatefulProcessor):
    """handleInputRows takes a slot's events of one micro-batch and holds them with the slot's attempts that have not ended."""

    def __init__(self, warnings: tuple[int, ...], window: int):
        self.warnings, self.window = sorted(warnings, reverse=True), window

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getMapState("attempts", "ends long", _STATE)

    def _row(self, who: str, what: str, mark: int, at) -> Row:
        return Row(_who=who, what=what, mark=mark, at=at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, known, gone, changed = timerValues.getCurrentWatermarkInMs(), set(), set(), set()
        live: dict[str, list] = {}
        for (ends,), (who, *rest) in self.state.iterator():
            known.add(ends)
            live |= {w: list(x) for w, *x in zip(who, *rest, strict=True)}
        for r in sorted((r for r in rows if r["_end"] is not None), key=lambda r: (r["_at"], r["event_id"])):
            who = r["_who"]
            if who in gone:
                continue
            if who not in live:
                if r["_end"] // 1000 <= watermark:
                    gone.add(who)  # its end has been reported, or was over before it was first heard of
                    continue
                live[who] = [r["_end"], 0, False, []]
                changed.add(r["_end"] // 1000)
            until, strikes, closed, given = live[who]
            if closed:
                continue
            left = (until - r["_at"]) // 1_000_000
            if left <= 0:
                closed = True
                yield self._row(who, "expired", 0, until)
            elif r["kind"] == "submit":
                closed = True
            elif r["kind"] == "resume":
                strikes += 0 if r["practice"] else 1
                closed = strikes >= STRIKES
                yield self._row(who, "forced" if closed else "resumed", strikes, r["_at"])
            if not closed:
                due = next((s for s in self.warnings if s - self.window < left <= s and s not in given), None)
                if due is not None:
                    given = [*given, due]
                    yield self._row(who, "warning", due, until - due * 1_000_000)
            if [until, strikes, closed, given] != live[who]:
                live[who] = [until, strikes, closed, given]
                changed.add(until // 1000)
        entries: dict[int, list] = {ends: [] for ends in changed}
        for who, x in live.items():
            if x[0] // 1000 in changed:
                entries[x[0] // 1000].append((who, *x))
        for ends, attempts in entries.items():
            if ends not in known:
                self.handle.registerTimer(ends)
            self.state.updateValue((ends,), tuple(map(list, zip(*attempts, strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ends = (expiredTimerInfo.getExpiryTimeInMs(),)
        for who, until, _, closed, _ in zip(*(self.state.getValue(ends) or ()), strict=True):
            if not closed:
                yield self._row(who, "expired", 0, until)
        self.state.removeKey(ends)

    def close(self) -> None:
        pass


def exam_clock(events: DataFrame, who: list[str], late: str = "1 minute", warnings: tuple[int, ...] = WARNINGS, window: int = WINDOW, slots: int = SLOTS) -> DataFrame:
    """events (who, event_id, at, kind, started, minutes, practice), a stream: what happens to each attempt (who).

    Rows (who, what, mark, at): warning with the mark in seconds and when it was due, once each, if an event tells that the
    attempt goes on within window seconds after; resumed and, at the third time, forced with the number of strikes (none in
    practice); expired, once, at the end of an attempt that was not submitted or forced. kind is beat, resume or submit.
    Nothing follows an attempt's end. Events without a start or a length are left out. slots: so many that one's attempts
    that run at a time, and its events of one micro-batch, fit a task.
    """
    end = F.unix_micros("started") + F.col("minutes").cast("long") * 60_000_000
    timed = events.withWatermark("at", late).withColumns({"_who": F.to_json(F.struct(*who), _WHO), "_at": F.unix_micros("at"), "_end": end})
    dealt = timed.select(F.pmod(F.xxhash64("_who"), F.lit(slots)).alias("_slot"), "_who", "event_id", "at", "kind", "practice", "_at", "_end")
    found = dealt.groupBy("_slot").transformWithState(ExamClock(warnings, window), "_who string, what string, mark long, at long", "append", "eventtime")
    keys = F.from_json("_who", StructType([events.schema[c] for c in who]), _WHO)
    return found.select(*(keys[c].alias(c) for c in who), "what", "mark", F.timestamp_micros("at").alias("at"))
