"""Ordered folds over ranges against the same folds in one task, with keys that hold most rows, ties, nulls and odd recordings."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marktide.operators import alignment, ordered, progress


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.fixture(scope="module")
def events(spark):
    draw, t = random.Random(2), datetime(2024, 1, 1)
    who = lambda: 7 if draw.random() < 0.5 else draw.choice([1, 2, 3, None])
    rows = [(k, who(), t + timedelta(seconds=draw.randrange(900)), draw.choice([None, -30, -5, 1, 4, 9]), draw.random() < 0.7) for k in range(1500)]
    return spark.createDataFrame(rows, "event_id long, who long, at timestamp, delta long, remembered boolean")


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_balances_and_boxes(events, parts):
    ops = events.withColumn("delta", F.coalesce("delta", F.lit(0)))
    plain = progress.clamped_balance(ops, "who", ["at", "event_id"], "delta").select("event_id", "balance")
    assert same(plain, ordered.clamped_balance(events, "who", ["at", "event_id"], "delta", parts=parts))
    plain = progress.card_boxes(events, ["who"], ["at", "event_id"], "remembered", "at").select("event_id", "box", "due")
    assert same(plain, ordered.card_boxes(events, ["who"], ["at", "event_id"], "remembered", "at", parts=parts))
    assert ordered.clamped_balance(events.limit(0), "who", ["at", "event_id"], "delta").collect() == []


def test_a_hot_key_uses_all_ranges(events):
    ranged = ordered.in_ranges(events.where("who = 7"), ["who"], ["at", "event_id"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8


@pytest.mark.parametrize("parts", [1, 9])
def test_places_and_running_maximum(events, parts):
    got = ordered.running_max(ordered.numbered(events, ["who"], ["at", "event_id"], "pos", parts), ["who"], ["pos"], "delta", "top", parts)
    rows = sorted((r for r in events.collect()), key=lambda r: (r.at, r.event_id))
    want = {}
    for who in {r.who for r in rows}:
        top = None
        for k, r in enumerate(x for x in rows if x.who == who):
            top = max((x for x in (top, r.delta) if x is not None), default=None)
            want[r.event_id] = (k, top)
    assert {r.event_id: (r.pos, r.top) for r in got.collect()} == want


@pytest.mark.parametrize(("parts", "exact"), [(1, True), (6, True), (6, False)])
def test_as_of_and_nearest(spark, parts, exact):
    draw = random.Random(5)
    key = lambda: 1 if draw.random() < 0.7 else draw.choice([2, 3, None])
    left = [(k, key(), draw.choice([None, *range(40)])) for k in range(300)] + [(300, 9, 5)]
    right = [(key(), draw.choice([None, *range(0, 40, 3)]), k) for k in range(120)]
    a, b = spark.createDataFrame(left, "id long, k long, at int"), spark.createDataFrame(right, "k long, place int, n long")
    got = {r.id: r.found for r in ordered.as_of(a, b, ["k"], F.col("at"), F.col("place"), F.col("n"), F.col("n"), exact, parts=parts).collect()}
    fit = lambda p, at: p is not None and at is not None and (p <= at if exact else p < at)
    assert got == {i: max(((p, n) for k2, p, n in right if k2 == k and fit(p, at)), default=(None, None))[1] for i, k, at in left}
    near = {r.id: r.nearest for r in ordered.nearest(a, b, ["k"], "at", "place", "n", parts).collect()}
    assert near == {i: min(((abs(p - at), n, p) for k2, p, n in right if k2 == k and p is not None and at is not None), default=(0, 0, None))[2] for i, k, at in left}


@pytest.mark.parametrize("parts", [1, 6])
def test_transcript_blocks(spark, parts):
    draw, rows = random.Random(11), []
    for rec in range(12):
        t = 0.0
        for k in range(250 if rec == 0 else draw.randint(0, 30)):
            length = draw.choice([0.5, 2.0, 3.0, 20.0])
            # some recordings have ends that run back
            rows.append((rec, k, t, t + length - (draw.choice([0, 15]) if rec % 4 == 3 else 0), draw.choice(["one", "two three", " ", None, "four"])))
            t += draw.choice([0.0, 1.0, 3.0])
    df = spark.createDataFrame(rows, "rec long, k long, s double, e double, t string")
    plain = alignment.transcript_blocks(df, "rec", "k", "s", "e", "t")
    assert same(plain, ordered.transcript_blocks(df, "rec", "k", "s", "e", "t", parts=parts))
    assert ordered.transcript_blocks(df.limit(0), "rec", "k", "s", "e", "t").collect() == []


def test_orbit_takes_few_rounds(spark, monkeypatch):
    rounds = []
    put = ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, label: rounds.append(label) or put(df, label))
    steps = spark.range(500).select(F.lit(1).alias("key"), F.col("id").alias("pos"), F.when(F.col("id") < 498, F.col("id") + 2).alias("next"))
    got = ordered.orbit(steps, steps.where("pos = 0"), ["key"])
    assert sorted(r.pos for r in got.collect()) == list(range(0, 500, 2)) and rounds.count("jumps") <= 9
