"""Values of whole texts are worked out once a row, not once a word, sentence or branch."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from marktide.functions import exams
from marktide.operators import alignment


def seconds(df):
    begin = time.monotonic()
    rows = df.collect()
    return rows, time.monotonic() - begin


def test_citations_read_their_transcript_once(spark):
    cols = [F.col(c) for c in ("draft", "script", "correct")]
    row = spark.createDataFrame([("See [1:15].", "(0:10 - 0:20)\na b\n(1:15 - 1:25)\nword here", "word", ["word"], 0, "")], "draft string, script string, correct string, answers array<string>, index int, hints string")
    out = row.select(alignment.settled_citations(*cols, F.col("answers"), F.col("index"), F.col("hints"), F.lit(3)).alias("x"))
    assert out.first().x == "See [1:15]."
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[\\s\\S]*") <= 2


def test_proof_of_a_long_draft(spark):
    row = spark.createDataFrame([("a b  c " * 60_000, "The old mill stands here now. " * 6000)], "draft string, passage string")
    rows, took = seconds(row.select(F.length(alignment.proven(F.col("draft"), F.col("passage"), F.lit("mill"), F.lit("mill"))).alias("n")))
    assert rows[0].n > 360_000 and took < 15


def test_hints_of_a_long_block(spark):
    words = ["w" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(1000, 1400)]
    blocks = spark.createDataFrame([(1, 0, 5.0, "x - y " * 150_000 + words[0])], "k int, block_no int, start_s double, block_text string")
    rows, took = seconds(alignment.hinted_block(blocks, spark.createDataFrame([(1, " ".join(words))], "k int, hint string"), "k"))
    assert [r.anchor for r in rows] == [5.0] and took < 15


def test_structures_of_a_long_text(spark):
    text = "The old mill stands here. " * 6000 + "Never had I seen it."
    rows, took = seconds(spark.createDataFrame([(text,)], "t string").select(F.explode(alignment.grammar_items(F.col("t"))).alias("x")))
    assert [tuple(r.x) for r in rows] == [("neg_inversion", "Never had I seen it.")] and took < 15


def test_loose_json_is_trimmed_once(spark):
    out = spark.createDataFrame([('```json\n{"a": [1, 2]}\n```',)], "t string").select(exams.json_items(F.col("t")).alias("x"))
    assert out.first().x == ["1", "2"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(?i:json)") == 1
