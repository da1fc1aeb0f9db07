"""Queries on whole texts, with what stands behind the beginning of a text."""

from __future__ import annotations

from marktide.plans import reports, texts


def test_options_on_all_lines(spark, tmp_path):
    rows = [(17, "A question?\nA. one\n\n b) two\nand no option"), (34, None), (51, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): r.is_option for r in reports.option_lines_all(spark, str(tmp_path)).collect()}
    assert got == {(17, 0): False, (17, 1): True, (17, 2): False, (17, 3): True, (17, 4): False, (51, 0): False}


def test_whole_phrases_are_grounded(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five"), (2, "one two three seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, "so one two three four and five") for k in (1, 2)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.item_id: (r.exact, r.loose) for r in texts.phrase_ground(spark, str(tmp_path)).collect()}
    assert got == {1: (False, True), 2: (False, False)}
