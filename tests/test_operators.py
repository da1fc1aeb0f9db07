"""Rules worked by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marktide.functions import values
from marktide.operators import merging, progress, scoring, search
from marktide.streaming.presence import ledger_sink

def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (-0.4, 0)])
def test_half_up(spark, x, want):
    assert one(spark, values.half_up(F.lit(x))) == want


@pytest.mark.parametrize(("x", "want"), [("", 0.0), (None, 0.0), (" 7 ", 7.0)])
def test_number(spark, x, want):
    assert one(spark, values.number(F.lit(x).cast("string"))) == want


def test_number_not(spark):
    assert one(spark, F.isnan(values.number(F.lit("N/A"))))


def test_text_helpers(spark):
    assert one(spark, values.strip_tags(F.lit("<p>a&nbsp;b</p>\n<b>c</b>"))) == "a b c"
    assert one(spark, values.item_key(F.lit("Élan -- vital"))) == "elan vital"
    assert one(spark, values.title_case(F.lit("mcDonald lee"))) == "McDonald Lee"
    assert one(spark, values.coin_amount(F.lit("+ 1,200.9 coins"))) == 1200
    assert one(spark, values.clock(F.lit(75))) == "1:15"
    assert str(one(spark, values.local_time(F.lit("2024-01-01T07:00")))) == "2024-01-01 00:00:00"


def test_answers(spark):
    out = scoring.multiple_outcome(F.array(F.lit(0), F.lit(2)), F.array(F.lit(2), F.lit(3)))
    assert [one(spark, out[k]) for k in ("score", "total", "skipped", "full")] == [1, 2, 0, False]
    over = scoring.multiple_outcome(F.array(F.lit(0)), F.array(F.lit(0), F.lit(1)))
    assert one(spark, over["score"]) == 0
    assert one(spark, scoring.single_correct(F.lit("BLANK"), F.lit("Colour / color"), F.lit(" COLOR ")))
    assert not one(spark, scoring.single_correct(F.lit("CHOICE"), F.lit("A"), F.lit("a")))


@pytest.mark.parametrize(("score", "skill", "want"), [(40, "Listening", 9.0), (32, "listen", 7.5), (32, "Reading", 7.0), (3, "Reading", None), (4, "Reading", 2.5)])
def test_band(spark, score, skill, want):
    assert one(spark, scoring.band(F.lit(score), F.lit(40), F.lit(skill))) == want


def test_clamped_balance(spark):
    draw = random.Random(7)
    rows = [(who, k, draw.randint(-20, 15)) for who in range(20) for k in range(40)]
    got = {(r.who, r.k): r.balance for r in progress.clamped_balance(spark.createDataFrame(rows, "who int, k int, delta long"), "who", ["k"], "delta").collect()}
    for who in range(20):
        balance = 0
        for w, k, delta in rows:
            if w == who:
                balance = max(0, balance + delta)
                assert got[(w, k)] == balance


def test_card_boxes(spark):
    rows = [(k, ok) for k, ok in enumerate([True, True, False, True, True, True, True, True, True])]
    df = spark.createDataFrame(rows, "k int, ok boolean").withColumn("card", F.lit(1)).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    out = progress.card_boxes(df, ["card"], ["k"], "ok", "at").orderBy("k").collect()
    assert [r.box for r in out] == [2, 3, 1, 2, 3, 4, 5, 5, 5]
    assert str(out[2].due) == "2024-01-01 00:10:00"


def test_overlay_twice_is_once(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, x string, y int")
    b = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, x string, y int")
    once = merging.overlay(a, b, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)] == sorted(map(tuple, merging.overlay(once, b, "id").collect()))


def test_overlay_of_repeated_keys(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", None), (None, "x", 3)], "id int, x string, y int")
    b = spark.createDataFrame([(1, None, 5), (1, "c", 4), (2, "d", None)], "id int, x string, y int")
    assert sorted(map(tuple, merging.overlay(a, b, "id").collect()), key=str) == [(1, "c", 4), (2, "d", None)]


def test_changed_tells_nulls_apart(spark):
    a = spark.createDataFrame([(1, None, 5), (2, None, None), (3, 1, 1)], "id int, x int, y int")
    b = spark.createDataFrame([(1, 5, None), (2, None, None), (4, None, None)], "id int, x int, y int")
    assert sorted(map(tuple, merging.changed(a, b, "id").collect())) == [(1, False), (4, True)]


def test_grounded(spark):
    asked = [("carried out", "They carry out the plan", 0), ("carry out", "They carry it all out", 4), ("carry out", "They carry it all out", 0), ("", "text", 0)]
    rows = spark.createDataFrame(asked, "phrase string, source string, gap int").select(search.stands_in(search.words_of(F.col("phrase")), search.words_of(F.col("source")), F.col("gap")).alias("x"))
    assert [r.x for r in rows.collect()] == [True, True, False, False]


def test_ledger_sink_is_idempotent(spark):
    put = ledger_sink(spark, "ledger_test")
    batch = spark.createDataFrame([(1, 10), (2, 20), (2, 30)], "op_id long, ts long")
    for n in (0, 0, 1):
        put(batch, n)
    assert sorted(r.op_id for r in spark.table("ledger_test").collect()) == [1, 2]
    spark.sql("DROP TABLE ledger_test")
