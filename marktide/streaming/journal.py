"""Results that learners keep until the server has confirmed them, as a join of two streams.

Both sides have a watermark, and a confirmation counts for a bounded time, so Spark can forget a result once it is settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(results: DataFrame, acks: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """results (result_id, at) and acks (ack_id, acked_id, at), streams: what became of each.

    Rows (result_id, ack_id, what, at): confirmed for each result once, with the time of the result and ack_id null; pending, once
    and only when no confirmation can come within its time any more: it is to be sent again; late for a confirmation that
    belongs to no result within its time. A confirmation at the very time of its result counts. Rows without an id match nothing.
    """
    kept = results.select(F.col("result_id"), F.col("at").alias("sent")).withWatermark("sent", late)
    said = acks.select(F.col("ack_id"), F.col("acked_id"), F.col("at").alias("heard")).withWatermark("heard", late)
    both = F.expr(f"acked_id = result_id AND heard >= sent AND heard <= sent + INTERVAL {within}")
    found = kept.join(said, both, "full_outer")
    what = F.when(F.col("sent").isNull(), "late").when(F.col("heard").isNull(), "pending").otherwise("confirmed")
    rows = found.select("result_id", F.when(what == "late", F.col("ack_id")).alias("ack_id"), what.alias("what"), F.coalesce("sent", "heard").alias("at"))
    return rows


def once(outcomes: DataFrame) -> DataFrame:
    """What settled() has written, each result once: several confirmations of one result are one outcome."""
    return outcomes.distinct()
