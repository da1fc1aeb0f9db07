"""Live activity and the coin ledger as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marktide.operators import merging
from marktide.sources.shared import new_path


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events with event time as a timestamp (stored times have no zone; they are read as UTC)."""
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file by a pattern only
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Hourly activity by type; repeated event ids within the watermark count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.floor(F.max("value")).alias("top"))


def activity_windows(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over what is there and returns its windows.

    Update mode: a batch writes the windows that it changed, keyed by its number, and the state of windows older than the
    watermark goes. Readers take the last version of each window.
    """
    out = new_path(spark, "activity")

    def put(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "top").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = windowed(heartbeats(spark, path)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return merging.newest(spark.read.parquet(out), ["hour", "event_type"], [F.desc("batch")]).drop("batch")


def sessions(events: DataFrame, who: list[str], gap, late: str = "30 seconds") -> DataFrame:
    """events (who, at), a stream: the stretches in which someone was there, once they have closed: who, began, ended, n.

    Each event keeps its stretch open for the time gap (a text, or a column: by activity); an event with a gap of zero
    counts for nothing. In append mode a stretch comes out when the watermark has passed its end, and its state goes.
    """
    w = F.session_window("at", gap)
    found = events.withWatermark("at", late).groupBy(*who, w.alias("w")).agg(F.count("*").alias("n"))
    return found.select(*who, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def present(stretches: DataFrame, as_of: Column) -> DataFrame:
    """Who was there at a time: stretches that had begun and had not yet ended."""
    return stretches.where((F.col("began") <= as_of) & (as_of < F.col("ended")))


def ledger_sink(spark: SparkSession, table: str):
    """A foreachBatch function that appends operations (op_id, ...) once: those already in the table, or earlier in the batch, are left out.

    A batch that is run again after a failure finds its own rows and adds none.
    """

    def put(batch: DataFrame, number: int) -> None:
        fresh = merging.newest(batch, ["op_id"], [F.asc("ts")])
        if spark.catalog.tableExists(table):
            fresh = fresh.join(spark.table(table).select("op_id"), "op_id", "left_anti")
        fresh.write.mode("append").saveAsTable(table)

    return put
