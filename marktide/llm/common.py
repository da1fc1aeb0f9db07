"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.abspath(tempfile.gettempdir())}/marktide-shared"
    return base.rstrip("/")


_MADE: list[str] = []


def workspace(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/marktide/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables and files that this process made; to be called once results are written. How many there were."""
    done = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, workspace(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body) -> Column:
    """Binds value once and evaluates body on it, so that a costly expression is not evaluated again in each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
