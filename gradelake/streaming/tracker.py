"""The tracker of one sitting as a stateful stream: away segments, full screen and pastes, with records taken back.

Signals come in order for each sitting; every record is sent in the trigger that completes it.  When what follows shows that a record
was only a part (back and away again within the merge gap) or no behaviour at all (full screen left and entered again at once), a row
that takes it back is sent, so that additions without what was taken back are at any time what the batch operators give.  A timer ends
a sitting that has been silent: an absence that is still open then is recorded without a length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.proctor import LONG_MS, MERGE_MS, SHORT_MS

#: Fixed value: records of one sitting that one trigger sends at most.
MAX_QUEUE = 200
SILENT_MS = 6 * 3_600_000
ADD, BACK = "ADD", "TAKE_BACK"
COLUMNS = "attempt_id long, change string, record long, type string, at_ms long, duration_ms long, question int, bursts int, chars long, count int"
_START = {"hidden": False, "blurred": False, "away": None, "back": None, "full": False, "out": None, "paste": None, "question": None, "next": 1, "dropped": 0, "last": None}


class Sitting:
    """The state of one sitting (plain values, so that it is stored as JSON) and the rows that a trigger sends."""

    def __init__(self, state: dict[str, Any] | None, most: int = MAX_QUEUE):
        self.s = state or dict(_START)
        self.most = most
        self.sent: list[dict[str, Any]] = []

    def add(self, type_: str, at: int, duration: int | None = None, question: int | None = None, bursts: int | None = None, chars: int | None = None, count: int | None = None) -> int | None:
        """Sends a record and gives its number; None where the trigger has sent as many as it may (they are counted)."""
        if sum(r["change"] == ADD for r in self.sent) >= self.most:
            self.s["dropped"] += 1
            return None
        n = self.s["next"]
        self.s["next"] = n + 1
        self.sent.append({"change": ADD, "record": n, "type": type_, "at_ms": at, "duration_ms": duration, "question": question, "bursts": bursts, "chars": chars, "count": count})
        return n

    def take_back(self, record: int | None, type_: str) -> None:
        """A record of this trigger is removed, one sent before is taken back."""
        if record is None:
            return
        kept = [r for r in self.sent if r["record"] != record]
        if len(kept) == len(self.sent):
            kept.append({"change": BACK, "record": record, "type": type_, "at_ms": None, "duration_ms": None, "question": None, "bursts": None, "chars": None, "count": None})
        self.sent = kept

    def signal(self, kind: str, at: int, value: int | None) -> None:
        s = self.s
        if kind == "question":
            s["question"] = value
        elif kind in ("hidden", "visible", "blur", "focus"):
            s["hidden" if kind in ("hidden", "visible") else "blurred"] = kind in ("hidden", "blur")
            (self._leave if s["hidden"] or s["blurred"] else self._return)(at)
        elif kind in ("full", "window"):
            self._screen(kind == "full", at)
        elif kind == "paste":
            self._paste(max(0, value or 0), at)
        elif kind == "close":
            self.close()

    def _leave(self, at: int) -> None:
        s = self.s
        if s["away"]:
            s["away"]["hidden"] |= s["hidden"]
            return
        before, s["back"] = s["back"], None
        if before and 0 <= at - before["end"] <= MERGE_MS:
            self.take_back(before["record"], before["type"])
            s["away"] = {"start": before["start"], "hidden": before["hidden"] or s["hidden"], "question": before["question"], "bursts": before["bursts"] + 1, "told": False}
        else:
            s["away"] = {"start": at, "hidden": s["hidden"], "question": s["question"], "bursts": 1, "told": False}

    def _return(self, at: int) -> None:
        a, self.s["away"] = self.s["away"], None
        if not a:
            return
        self.s["back"] = None
        if a["told"]:
            return
        length = max(0, at - a["start"])
        type_ = "LONG_ABSENCE" if length >= LONG_MS else "TAB_VISIBLE" if a["hidden"] else "WINDOW_FOCUS"
        record = self.add(type_, at, length, a["question"], a["bursts"]) if length >= SHORT_MS else None
        self.s["back"] = {"start": a["start"], "hidden": a["hidden"], "question": a["question"], "bursts": a["bursts"], "end": at, "record": record, "type": type_}

    def _screen(self, full: bool, at: int) -> None:
        s = self.s
        if full == s["full"]:
            return
        s["full"] = full
        if not full:
            s["out"] = {"start": at, "question": s["question"], "record": self.add("FULLSCREEN_EXIT", at, None, s["question"])}
            return
        out, s["out"] = s["out"], None
        if not out:
            self.add("FULLSCREEN_ENTER", at, None, s["question"])
        elif at - out["start"] < SHORT_MS and out["record"] is not None:
            self.take_back(out["record"], "FULLSCREEN_EXIT")
        else:
            self.add("FULLSCREEN_ENTER", at, max(0, at - out["start"]), out["question"])

    def _paste(self, chars: int, at: int) -> None:
        before = self.s["paste"]
        if before and before["record"] is not None and at - before["at"] <= MERGE_MS:
            self.take_back(before["record"], "PASTE")
            chars, count, question = chars + before["chars"], before["count"] + 1, before["question"]
        else:
            count, question = 1, self.s["question"]
        self.s["paste"] = {"at": at, "chars": chars, "count": count, "question": question, "record": self.add("PASTE", at, None, question, None, chars, count)}

    def close(self) -> None:
        """The page goes: an open absence is told without a length, and nothing is merged any more."""
        a = self.s["away"]
        if a and not a["told"]:
            a["told"] = True
            self.add("TAB_HIDDEN" if a["hidden"] else "WINDOW_BLUR", a["start"], None, a["question"], a["bursts"])
        self.s["back"] = self.s["paste"] = None


class Tracker(StatefulProcessor):
    def __init__(self, silent_ms: int = SILENT_MS, most: int = MAX_QUEUE):
        self.silent_ms, self.most = silent_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sitting", "json string")

    def _load(self) -> Sitting:
        found = self.state.get()
        return Sitting(json.loads(found[0]) if found else None, self.most)

    def _rows(self, key, sitting: Sitting) -> Iterator[Row]:
        return (Row(attempt_id=key[0], **r) for r in sitting.sent)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sitting = self._load()
        last = sitting.s["last"]
        for at, _, kind, value in sorted(((r.at_ms, r.seq, r.kind, r.value) for r in rows), key=lambda r: r[:2]):
            sitting.signal(kind, at, value)
            last = at if last is None else max(last, at)
        if sitting.s["last"] is None:  # one timer a sitting: it asks again for the last signal when it is due
            self.handle.registerTimer(last + self.silent_ms)
        sitting.s["last"] = last
        self.state.update((json.dumps(sitting.s),))
        return self._rows(key, sitting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sitting = self._load()
        due = sitting.s["last"] + self.silent_ms
        if due > expiredTimerInfo.getExpiryTimeInMs() and due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return iter(())
        sitting.close()
        self.state.clear()
        return self._rows(key, sitting)

    def close(self) -> None:
        pass


def tracked(signals: DataFrame, silent_ms: int = SILENT_MS, late: str = "0 seconds", most: int = MAX_QUEUE) -> DataFrame:
    """A stream of signals (attempt_id, seq, kind, at_ms, value) as a stream of record changes (``COLUMNS``).

    kind: hidden, visible, blur, focus, full, window (full screen left), paste (value: characters), question (value: its number), close.  Needs
    the RocksDB state store (``run_available(..., rocksdb=True)`` sets it).  The watermark is on ``at_ms`` as a time; signals behind it are late and left out.
    """
    s = signals.select(F.col("attempt_id").cast("long").alias("attempt_id"), "seq", "kind", F.col("at_ms").cast("long").alias("at_ms"), F.col("value").cast("long").alias("value"), F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return s.groupBy("attempt_id").transformWithState(Tracker(silent_ms, most), COLUMNS, "Append", "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """The records that were added and not taken back."""
    gone = changes.where(F.col("change") == BACK).select("attempt_id", "record")
    return changes.where(F.col("change") == ADD).join(gone, ["attempt_id", "record"], "left_anti").drop("change")
