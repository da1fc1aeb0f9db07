"""The driver tables, read under the roles that learning data has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktide.functions.values import cents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows in a few partitions for each core: for work that is heavy by the row, as a small file is one or two tasks."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts and lessons."""
    seconds = (F.col("o_orderkey") * 37) % 9000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("student_id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 50).alias("exam_id"), cents(F.col("o_totalprice")).alias("amount_cents"), seconds.alias("seconds"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as graded items; ITEM_ORDER puts those of an attempt in order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("attempt_id"), F.col("l_returnflag").alias("label"), (F.col("l_quantity") >= 25).alias("correct"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        (F.col("l_linestatus") == "O").alias("multiple"), (F.col("l_quantity").cast("int") % 4).alias("answer"), (F.col("l_partkey") % 5).cast("int").alias("mark"),
    )


ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what learners do."""
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("student_id"), F.col("ts").alias("at"), "event_type", F.floor("value").alias("points"), F.col("value"))
