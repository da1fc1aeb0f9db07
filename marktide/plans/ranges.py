"""Ordered queries that spread a key over many tasks, with the SQL of those that fold it in one."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktide.functions.values import clock
from marktide.operators import ordered, scoring
from marktide.plans import analytics, state, texts
from marktide.sources.tables import reviews, table


def coin_balance_ranges(spark, d):
    return ordered.clamped_balance(state._ops(spark, d), "student_id", ["at", "event_id"], "delta").select("event_id", "student_id", "balance")


def srs_schedule_ranges(spark, d):
    rows = reviews(spark, d).withColumn("remembered", F.col("value") >= 50)
    return ordered.card_boxes(rows, ["student_id", "event_type"], ["at", "event_id"], "remembered", "at").select("event_id", "box", "due")


def transcript_blocks_ranges(spark, d):
    blocks = ordered.transcript_blocks(texts._segments(spark, d), "conv_id", "turn", "s", "e", "text")
    return blocks.select("conv_id", "block_no", F.concat(F.lit("("), clock(F.col("start_s")), F.lit(" - "), clock(F.col("end_s")), F.lit(")")).alias("mark"), F.length("block_text").alias("n_chars"))


def band_as_of(spark, d):
    """Bands from a table of thresholds: the last one not above a score."""
    rows = analytics._scored(spark, d).drop("band").withColumn("norm", F.try_divide(F.col("score") * F.lit(1.0), F.col("total")) * 40)
    bands = spark.createDataFrame([("Listening", *x) for x in scoring.LISTENING_BANDS] + [("Reading", *x) for x in scoring.READING_BANDS], "skill string, least int, band double")
    return ordered.as_of(rows, bands, ["skill"], F.col("norm"), F.col("least"), F.col("band"), name="band").drop("norm")


def nearest_cited(spark, d):
    """For each turn a second that it cites, and the start of a turn of its conversation that is nearest to it."""
    cited = (F.length("text") * 7 % 60).cast("double")
    cites = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").alias("from_turn"), cited.alias("cited"))
    found = ordered.nearest(cites, texts._segments(spark, d), ["conv_id"], "cited", "s", "turn")
    return found.select("conv_id", "from_turn", "cited", "nearest")


QUERIES = {f.__name__: f for f in (coin_balance_ranges, srs_schedule_ranges, transcript_blocks_ranges, band_as_of, nearest_cited)}
ORACLE_SQL = {
    "coin_balance_ranges": state.ORACLE_SQL["coin_balance"],
    "srs_schedule_ranges": state.ORACLE_SQL["srs_schedule"],
    "transcript_blocks_ranges": texts.ORACLE_SQL["transcript_blocks"],
    "band_as_of": analytics.ORACLE_SQL["band_lookup"],
    "nearest_cited": """
        WITH c AS (SELECT conv_id, turn AS from_turn, (length(text) * 7 % 60)::DOUBLE AS cited FROM conversations WHERE text IS NOT NULL)
        SELECT c.conv_id, c.from_turn, c.cited, arg_min(m.turn * 3, (abs(m.turn * 3 - c.cited), m.turn))::DOUBLE AS nearest FROM c JOIN conversations m ON m.conv_id = c.conv_id GROUP BY ALL
    """,
}
