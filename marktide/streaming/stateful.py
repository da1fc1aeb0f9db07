"""Learners' cards and coins as stateful streams: what the batch operators compute from whole histories, event by event.

State is one small row per key: the value and the last event that it has seen. Events of one micro-batch are sorted, so
they may come in any order within it; one that is older than what its key has seen already comes out marked as late and
changes nothing, so that it can be counted or replayed in a batch. Spark drops what is older than the watermark. The rows of
one key in one micro-batch are held in memory: limit a trigger by maxFilesPerTrigger or the like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from marktide.operators.progress import BOX_DAYS
from marktide.streaming.arrivals import run

_DAY = timedelta(days=1) // timedelta(microseconds=1)


class OrderedFold(StatefulProcessor):
    """step(value or None, row) gives the next value and what comes out with the row. idle: after so many seconds
    of event time without an event a key is forgotten and begins anew; None: never."""

    def __init__(self, who: list[str], step: Callable[[int | None, Row], tuple[int, dict[str, Any]]], out: list[str], idle: int | None):
        self.who, self.step, self.out, self.idle = who, step, out, idle

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("fold", "value long, at long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value, *last = self.state.get() if self.state.exists() else (None, -(1 << 62), 0)
        for r in sorted(rows, key=lambda r: (r["_at"], r["event_id"])):
            late = [r["_at"], r["event_id"]] < last
            out = dict.fromkeys(self.out)
            if not late:
                value, out = self.step(value, r)
                last = [r["_at"], r["event_id"]]
            yield Row(**dict(zip(self.who, key, strict=True)), event_id=r["event_id"], late=late, **out)
        self.state.update((value, *last))
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(last[0] // 1000 + 1000 * self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, who: list[str], step, out: str, late: str, idle: int | None) -> DataFrame:
    kinds = StructType.fromDDL(out)
    schema = StructType([*(rows.schema[c] for c in who), *StructType.fromDDL("event_id long, late boolean"), *kinds])
    timed = rows.withWatermark("at", late).withColumn("_at", F.unix_micros("at"))
    return timed.groupBy(*who).transformWithState(OrderedFold(who, step, kinds.names, idle), schema, "append", "eventtime")


def card_stream(reviews: DataFrame, card: list[str], late: str = "1 hour", idle: int = 400 * 86_400) -> DataFrame:
    """reviews (card, event_id, at, remembered) with the box and the due time that each leaves its card in, and late.

    A card that nobody has seen for idle seconds begins in box 1 again.
    """

    def step(box: int | None, r: Row) -> tuple[int, dict[str, Any]]:
        box = min(5, (box or 1) + 1) if r["remembered"] else 1
        return box, {"box": box, "due": r["_at"] + (BOX_DAYS[box] * _DAY if r["remembered"] else 600_000_000)}

    return _folded(reviews, card, step, "box int, due long", late, idle).withColumn("due", F.timestamp_micros("due"))


def balance_stream(ops: DataFrame, who: str, late: str = "1 hour") -> DataFrame:
    """ops (who, event_id, at, delta) with the balance that each leaves, 0 at least, and late. Accounts are kept for ever."""

    def step(balance: int | None, r: Row) -> tuple[int, dict[str, Any]]:
        balance = max(0, (balance or 0) + int(r["delta"] or 0))
        return balance, {"balance": balance}

    return _folded(ops, [who], step, "balance long", late, None)


def collected(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there into a folder and reads all that it has written there by now."""
    return run(stream, path)
