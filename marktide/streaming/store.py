"""A log of changes as a streaming sink, and the tables that are read from it.

The sink writes each micro-batch into a folder of its own, which a batch that is run again replaces: each change is in the
log once. Readers fold the log; owners are partitions, so one owner's cards are read without the others'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktide.operators import stores


def change_sink(path: str, owner: str):
    """A foreachBatch function that writes changes under path, partitioned by batch and owner."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.partitionBy(owner).mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def changes(spark: SparkSession, path: str, owner: str | None = None, value=None) -> DataFrame:
    """The log, of one owner if value is given (a partition filter)."""
    rows = spark.read.parquet(path)
    return rows if value is None else rows.where(F.col(owner) == F.lit(value))


def run_change_log(changes_stream: DataFrame, path: str, owner: str) -> None:
    """Writes what a stream holds now to the log."""
    query = changes_stream.writeStream.foreachBatch(change_sink(path, owner)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()


def cards(spark: SparkSession, path: str, owner: str, value=None) -> dict[str, DataFrame]:
    """Live cards and tombstones of all owners, or of one. Empty cached reads don't occur: the log is the state."""
    return stores.latest_state(changes(spark, path, owner, value), [owner, "card_id"], ["at", "change_id"], "deleted")


def folded(log: DataFrame, key: str, order: str) -> DataFrame:
    """The keyed table that a log of writes leaves: of each field the newest value that is not null.

    A plain aggregate, so tasks combine a key's writes before the shuffle; a write that is in the log twice changes
    nothing. Rows without a key are left out.
    """
    fields = [c for c in log.columns if c not in (key, order)]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(*newest)
