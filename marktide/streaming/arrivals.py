"""Runs a stream over what has arrived so far, as often as something arrives; each run goes on from the last one's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktide.sources.shared import new_path

#: RocksDB without a count of its rows, which costs a lookup before each write; a join keeps its state in one store instead of four.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def land(rows: DataFrame, folder: str, number: int) -> None:
    """Writes one arrival; run again it replaces its own files."""
    rows.write.mode("overwrite").parquet(f"{folder}/arrival={number}")


def landed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The stream of all arrivals of a folder."""
    return spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/arrival=*").drop("arrival")


def run(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream in append mode over what is there, into path, and reads all that it has written by now.

    Its checkpoint lies beside path: the next run, in this process or another, takes the state up from there.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(path)


def in_arrivals(rows: dict[str, DataFrame], at: str, parts: int, make: Callable[..., DataFrame]) -> DataFrame:
    """Lets tables arrive in parts by time (at, equal spans) and runs make(**streams) after each arrival, as after a restart."""
    spark = next(iter(rows.values())).sparkSession
    folder = new_path(spark, "arrivals")
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    spans = [df.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first() for df in rows.values()]
    begin, end = min((s.a for s in spans if s.a is not None), default=0), max((s.b for s in spans if s.b is not None), default=0)
    step = (end - begin) // parts + 1
    out = None
    for k in range(parts):
        for name, df in rows.items():
            land(df.where(F.floor((seconds - begin) / step) == k), f"{folder}/{name}", k)
        out = run(make(**{name: landed(spark, f"{folder}/{name}", df.schema) for name, df in rows.items()}), f"{folder}/out")
    return out
