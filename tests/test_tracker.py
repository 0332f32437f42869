"""The tracker on stated signals, and as a stream of several triggers against the batch operators."""

import random

from pyspark.sql import Row

from gradelake.operators import proctor
from gradelake.streaming import tracker as K
from gradelake.streaming.tables import replayed, run_available


def sent(*signals, most=200, split=()):
    """(type, at, duration, bursts or characters) standing after signals (kind, at[, value]) in triggers cut before the given positions."""
    state, changes = None, []
    for i in range(len(split) + 1):
        part = signals[([0, *split])[i] : ([*split, len(signals)])[i]]
        sitting = K.Sitting(state, most)
        for kind, at, *value in part:
            sitting.signal(kind, at, value[0] if value else None)
        state = sitting.s
        changes += sitting.sent
    back = {c["record"] for c in changes if c["change"] == K.BACK}
    return [(c["type"], c["at_ms"], c["duration_ms"], c["bursts"] or c["chars"]) for c in changes if c["change"] == K.ADD and c["record"] not in back]


def test_both_signals_are_one_absence():
    assert sent(("blur", 0), ("hidden", 10), ("visible", 5000), ("focus", 6000)) == [("TAB_VISIBLE", 6000, 6000, 1)]
    assert sent(("blur", 0), ("focus", 1000)) == []
    assert sent(("hidden", 0), ("visible", 31_000)) == [("LONG_ABSENCE", 31_000, 31_000, 1)]


def test_back_and_away_again_takes_the_record_back():
    signals = [("blur", 0), ("focus", 3000), ("blur", 4000), ("focus", 5000)]
    for split in ((), (1,), (2,), (3,), (1, 2, 3)):
        assert sent(*signals, split=split) == [("WINDOW_FOCUS", 5000, 5000, 2)]
    assert sent(("blur", 0), ("focus", 900), ("blur", 1500), ("focus", 2000), split=(2,)) == [("WINDOW_FOCUS", 2000, 2000, 2)]
    assert len(sent(("blur", 0), ("focus", 3000), ("blur", 6000), ("focus", 9000))) == 2


def test_full_screen():
    assert sent(("full", 0), ("window", 1000), ("full", 1200), split=(2,)) == [("FULLSCREEN_ENTER", 0, None, None)]
    assert [r[:3] for r in sent(("full", 0), ("window", 1000), ("full", 5000))] == [("FULLSCREEN_ENTER", 0, None), ("FULLSCREEN_EXIT", 1000, None), ("FULLSCREEN_ENTER", 5000, 4000)]


def test_pastes_close_and_the_cap():
    assert sent(("paste", 0, 5), ("paste", 1000, 7), ("paste", 9000, -3), split=(1,)) == [("PASTE", 1000, None, 12), ("PASTE", 9000, None, 0)]
    assert sent(("blur", 100), ("close", 900), ("focus", 9000)) == [("WINDOW_BLUR", 100, None, 1)]
    many = [x for i in range(50) for x in (("blur", i * 10_000), ("focus", i * 10_000 + 2000))]
    assert len(sent(*many, most=20)) == 20 and len(sent(*many, most=20, split=(40, 80))) == 50


def test_the_stream_equals_the_batch(spark):
    r = random.Random(6)
    rows = []
    for sitting in range(40):
        at = 0
        for seq in range(60):
            at += r.choice([300, 900, 1600, 1900, 1900, 2500, 31_000 if seq % 20 == 9 else 700])
            rows.append((sitting, seq, r.choice(["hidden", "visible", "blur", "focus", "paste", "paste", "paste"]), at, r.randrange(50)))
    signals = spark.createDataFrame(rows, "attempt_id long, seq int, kind string, at_ms long, value long")
    changes = run_available(K.tracked(replayed(signals, "at_ms", 8)), rocksdb=True).cache()
    assert changes.where("change = 'TAKE_BACK'").count() > 0
    now = K.standing(changes).cache()
    away = proctor.away_segments(signals.where("kind <> 'paste'"), ["attempt_id"])
    kinds = "type in ('TAB_VISIBLE', 'WINDOW_FOCUS', 'LONG_ABSENCE')"
    want = sorted((x.attempt_id, x.type, x.at_ms, x.duration_ms, x.bursts) for x in away.collect())
    assert sorted((x.attempt_id, x.type, x.at_ms, x.duration_ms, x.bursts) for x in now.where(kinds).collect()) == want
    pasted = proctor.pastes(signals.where("kind = 'paste'").withColumnRenamed("value", "chars"), ["attempt_id"])
    assert sorted((x.attempt_id, x.at_ms, x.chars, x["count"]) for x in now.where("type = 'PASTE'").collect()) == sorted((x.attempt_id, x.at_ms, x.chars, x["count"]) for x in pasted.collect())


def test_a_silent_sitting_is_ended(spark):
    rows = [(1, 0, "hidden", 1_000, None), (2, 0, "blur", 2_000, None), (2, 1, "focus", 9_000, None), (2, 2, "hidden", 20_000_000, None), (3, 0, "blur", 40_000_000, None), (3, 1, "focus", 50_000_000, None)]
    signals = spark.createDataFrame(rows, "attempt_id long, seq int, kind string, at_ms long, value long")
    got = K.standing(run_available(K.tracked(replayed(signals, "at_ms", 3), silent_ms=1_000_000), rocksdb=True)).collect()
    assert sorted((x.attempt_id, x.type, x.at_ms, x.duration_ms) for x in got) == [(1, "TAB_HIDDEN", 1_000, None), (2, "TAB_HIDDEN", 20_000_000, None), (2, "WINDOW_FOCUS", 9_000, 7_000), (3, "LONG_ABSENCE", 50_000_000, 10_000_000)]


class _Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.calls.append(("timer", at))

    def get(self):
        return getattr(self, "value", None)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_a_sitting_has_one_timer_and_asks_again():
    """Signals only move the time at which a sitting is silent; the timer that is there looks it up."""
    h, t = _Handle(), K.Tracker(silent_ms=1000)
    t.init(h)
    now = lambda at: type("T", (), {"getCurrentWatermarkInMs": lambda self: at, "getExpiryTimeInMs": lambda self: at})()
    for at in (0, 400, 900):
        list(t.handleInputRows((1,), iter([Row(attempt_id=1, seq=at, kind="blur" if at == 900 else "focus", at_ms=at, value=None)]), now(at)))
    assert h.calls == [("timer", 1000)]
    assert list(t.handleExpiredTimer((1,), now(1500), now(1000))) == [] and h.calls[1:] == [("timer", 1900)]
    ended = list(t.handleExpiredTimer((1,), now(2500), now(1900)))
    assert [(r.attempt_id, r.type, r.at_ms) for r in ended] == [(1, "WINDOW_BLUR", 900)] and h.get() is None


def test_large_triggers_are_several_files(spark):
    rows = spark.range(4000).selectExpr("id as at_ms", "id % 7 as k")
    out = run_available(replayed(rows, "at_ms", 4, file_rows=300))
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in rows.collect())
    seen = []
    q = replayed(rows, "at_ms", 4, file_rows=300).writeStream.trigger(availableNow=True).foreachBatch(lambda b, n: seen.append(b.count()))
    q.start().awaitTermination()
    assert len(seen) == 4 and all(900 < n < 1100 for n in seen)
