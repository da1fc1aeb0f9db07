"""Streams over several arrivals, each a run of its own on the state that the last one left; late rows; odd rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marktide.streaming import clock, journal, presence
from marktide.streaming.arrivals import land, landed, run

T = datetime(2024, 3, 1, 9, 0, 0)


def at(seconds):
    return T + timedelta(seconds=seconds)


def arrivals(spark, folder, parts, schema, make):
    """Rows that make() has written after each arrival."""
    out = []
    for k, rows in enumerate(parts):
        land(spark.createDataFrame(rows, schema), f"{folder}/in", k)
        out.append(sorted(map(tuple, run(make(landed(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)), f"{folder}/out").collect()), key=str))
    return out


SIGNS = "who string, event_id long, at timestamp, kind string, started timestamp, minutes int, practice boolean"


def sign(who, n, seconds, kind="beat", minutes=20, practice=False):
    return (who, n, at(seconds), kind, T, minutes, practice)


def test_exam_clock(spark, tmp_path):
    parts = [
        [sign("a", 1, 5), sign("a", 2, 602), sign("a", 3, 604), sign("b", 4, 1), sign("b", 5, 10, "resume"), sign("c", 6, 3, "resume", practice=True), (None, 7, at(4), "beat", T, 20, False), ("x", 8, at(5), "beat", None, 20, False), ("x", 9, at(5), "beat", T, None, False)],
        # a's ten-minute mark was given before the restart; b's five-minute mark comes and its second and third strike; c submits
        [sign("a", 10, 606), sign("a", 11, 895), sign("b", 12, 905), sign("b", 13, 910, "resume"), sign("b", 14, 911, "resume"), sign("b", 15, 1141), sign("c", 16, 912, "submit"), sign("d", 17, 913)],
        # late for everything: dropped; a's one-minute mark is missed by 10 s
        [sign("a", 18, 1151), sign("a", 19, 902), sign("e", 20, 4000, minutes=1), sign("d", 21, 1195)],
        [sign("f", 22, 9000, minutes=300)],
    ]
    got = arrivals(spark, f"file://{tmp_path}", parts, SIGNS, lambda s: clock.exam_clock(s, ["who"], "1 minute"))
    first = [("a", "warning", 600, at(600)), ("b", "resumed", 1, at(10)), ("c", "resumed", 0, at(3))]
    assert got[0] == sorted(first, key=str)
    second = [("b", "warning", 300, at(900)), ("b", "resumed", 2, at(910)), ("b", "forced", 3, at(911))]
    assert got[1] == sorted(first + second, key=str)
    # null is a key like any other; e was over before it was first heard of
    third = [("a", "expired", 0, at(1200)), ("d", "expired", 0, at(1200)), (None, "expired", 0, at(1200))]
    assert got[3] == sorted(first + second + third, key=str)
    assert len([r for r in got[3] if r[0] == "a"]) == 2  # one warning, one end


def test_attempts_of_a_slot_share_their_state(spark, tmp_path):
    """The state has an entry for each slot and millisecond at which attempts end, not for each attempt, and loses none."""
    begin = lambda k: T + timedelta(microseconds=k % 2)
    signs = [(f"w{k}", k, at(5 + k % 7), "resume" if k % 5 == 0 else "submit" if k % 5 == 1 else "beat", begin(k), 20 + k % 3, False) for k in range(300)]
    make = lambda s: clock.exam_clock(s, ["who"], "1 minute", slots=2)
    first = arrivals(spark, f"file://{tmp_path}", [signs], SIGNS, make)[0]
    assert first == sorted(((f"w{k}", "resumed", 1, at(5 + k % 7)) for k in range(0, 300, 5)), key=str)
    assert spark.read.format("statestore").option("stateVarName", "attempts").load(f"file://{tmp_path}/out-state").count() == 6
    land(spark.createDataFrame([sign("z", 999, 9000, minutes=300)], SIGNS), f"file://{tmp_path}/in", 1)
    out = run(make(landed(spark, f"file://{tmp_path}/in", spark.createDataFrame([], SIGNS).schema)), f"file://{tmp_path}/out")
    ended = [(f"w{k}", "expired", 0, begin(k) + timedelta(minutes=20 + k % 3)) for k in range(300) if k % 5 != 1]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(first + ended, key=str)


def test_results_settle_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    results = [[(1, at(0)), (2, at(10)), (3, at(20)), (None, at(30))], [(4, at(700))], [(5, at(5000))]]
    acks = [[(10, 1, at(5)), (11, 1, at(6)), (12, 9, at(7))], [(13, 2, at(605)), (14, 3, at(699)), (15, None, at(700))], [(16, 5, at(5000))]]
    seen = []
    for k in range(3):
        land(spark.createDataFrame(results[k], "result_id long, at timestamp"), f"{base}/r", k)
        land(spark.createDataFrame(acks[k], "ack_id long, acked_id long, at timestamp"), f"{base}/a", k)
        r, a = landed(spark, f"{base}/r", spark.createDataFrame([], "result_id long, at timestamp").schema), landed(spark, f"{base}/a", spark.createDataFrame([], "ack_id long, acked_id long, at timestamp").schema)
        out = run(journal.settled(r, a, "10 MINUTES", "1 minute"), f"{base}/out")
        seen.append(sorted(map(tuple, journal.once(out).collect()), key=str))
        assert out.where("what <> 'confirmed'").count() == out.where("what <> 'confirmed'").distinct().count()
    assert (1, None, "confirmed", at(0)) in seen[0] and not [r for r in seen[0] if r[2] == "pending"]
    assert (2, None, "confirmed", at(10)) in seen[1]
    want = [(1, None, "confirmed", at(0)), (2, None, "confirmed", at(10)), (3, None, "pending", at(20)), (None, None, "pending", at(30)), (4, None, "pending", at(700)), (5, None, "confirmed", at(5000)), (None, 12, "late", at(7)), (None, 14, "late", at(699)), (None, 15, "late", at(700))]
    assert seen[2] == sorted(want, key=str)


def test_join_keeps_one_store(spark, tmp_path):
    """Each partition of the join had four stores; the session's own settings stay."""
    base, counted = f"file://{tmp_path}", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    land(spark.createDataFrame([(1, at(0))], "result_id long, at timestamp"), f"{base}/r", 0)
    land(spark.createDataFrame([(2, 1, at(1))], "ack_id long, acked_id long, at timestamp"), f"{base}/a", 0)
    r, a = landed(spark, f"{base}/r", spark.createDataFrame([], "result_id long, at timestamp").schema), landed(spark, f"{base}/a", spark.createDataFrame([], "ack_id long, acked_id long, at timestamp").schema)
    assert [x.result_id for x in run(journal.settled(r, a), f"{base}/out").collect()] == [1]
    assert not [x.name for x in (tmp_path / "out-state/state/0/0").iterdir() if x.name.startswith(("left-", "right-"))]
    assert spark.conf.get(counted, None) is None


def test_presence_over_a_restart(spark, tmp_path):
    schema = "who string, at timestamp, kind string"
    parts = [
        [("a", at(0), "beat"), ("a", at(25), "beat"), ("b", at(0), "beat"), (None, at(3), "beat")],
        [("a", at(50), "away"), ("b", at(100), "beat"), ("b", at(31), "none")],
        [("a", at(5), "beat"), ("c", at(1000), "beat")],
    ]
    gap = F.when(F.col("kind") == "away", "2 minutes").when(F.col("kind") == "none", "0 seconds").otherwise("30 seconds")
    got = arrivals(spark, f"file://{tmp_path}", parts, schema, lambda s: presence.sessions(s, ["who"], gap, "1 minute"))
    assert got[0] == []
    assert (("b", at(0), at(30), 1)) in got[1] and (None, at(3), at(33), 1) in got[1]
    # the late sign of a is dropped; its stretch went on over the restart and was kept open for two minutes
    assert got[2] == sorted([("a", at(0), at(170), 3), ("b", at(0), at(30), 1), ("b", at(100), at(130), 1), (None, at(3), at(33), 1)], key=str)
    rows = spark.createDataFrame(got[2], "who string, began timestamp, ended timestamp, n long")
    assert {r.who for r in presence.present(rows, F.lit(at(29))).collect()} == {"a", "b", None}
    assert {r.who for r in presence.present(rows, F.lit(at(30))).collect()} == {"a", None}


@pytest.mark.parametrize("make", [lambda s: clock.exam_clock(s, ["who"]), lambda s: presence.sessions(s.select("who", "at"), ["who"], "30 seconds")])
def test_nothing_arrives(spark, tmp_path, make):
    assert arrivals(spark, f"file://{tmp_path}", [[], []], SIGNS, make) == [[], []]


def test_cards_and_balances_over_a_restart(spark, tmp_path):
    from marktide.streaming.stateful import balance_stream, card_stream

    schema = "who string, event_id long, at timestamp, remembered boolean, delta long"
    day = 86_400
    parts = [
        [("a", 2, at(20), True, -50), ("a", 1, at(10), True, 30), ("b", 3, at(30), False, 5), (None, 4, at(30), True, 7)],
        # event 5 is older than what a has seen, but not older than the watermark: late; event 6 is dropped with the watermark
        [("a", 5, at(15), True, 100), ("a", 7, at(40), True, 8), ("b", 8, at(5000), True, 1)],
        [("a", 6, at(41), True, 1000), ("a", 9, at(2 * day), None, None)],
    ]
    cards = arrivals(spark, f"file://{tmp_path}/c", parts, schema, lambda s: card_stream(s.select("who", "event_id", "at", "remembered"), ["who"], idle=day))
    box = {r[1]: r[2:] for r in cards[2]}
    assert {k: v[1] for k, v in box.items()} == {1: 2, 2: 3, 3: 1, 4: 2, 5: None, 7: 4, 8: 2, 9: 1} and [k for k, v in box.items() if v[0]] == [5]
    assert box[7][2] == at(40 + 16 * day) and box[3][2] == at(30 + 600)
    balances = arrivals(spark, f"file://{tmp_path}/b", parts, schema, lambda s: balance_stream(s, "who"))
    assert {r[1]: r[3] for r in balances[0]} == {1: 30, 2: 0, 3: 5, 4: 7}
    assert {r[1]: r[3] for r in balances[2]} == {1: 30, 2: 0, 3: 5, 4: 7, 5: None, 7: 8, 8: 6, 9: 8}


def test_folded_log(spark):
    from marktide.streaming.store import folded

    rows = spark.createDataFrame([(1, 0, "a", 5), (1, 1, None, 6), (1, 1, None, 6), (2, 0, None, None), (None, 0, "x", 1)], "id long, at int, note string, score int")
    assert sorted(map(tuple, folded(rows, "id", "at").collect())) == [(1, "a", 6), (2, None, None)]
