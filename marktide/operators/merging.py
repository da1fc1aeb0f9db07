"""Merges of two versions of a keyed table, as joins.

Keys are not null where nothing else is said: a null key matches no other. newest() and keep_first() need a total order for a
defined result. An empty side leaves the other as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def keep_first(rows: DataFrame, order: list[Column], n: int, key: list[str] | None = None) -> DataFrame:
    """The first n rows in order: of each key, or of all."""
    if not key:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def overlay(server: DataFrame, local: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """All keys of both; a local value that is not null covers the server's; keys in gone are left out.

    Of rows with one key on the same side the largest counts (by all columns in order), so keys are unique in the result;
    rows without a key are left out.
    """
    one = lambda df: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[c for c in df.columns if c != key])).alias("_r")).select(key, "_r.*")
    s, t = one(server).alias("s"), one(local).alias("t")
    cols = [c for c in server.columns if c != key]
    both = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    out = both.select(F.coalesce(f"t.{key}", f"s.{key}").alias(key), *[F.coalesce(f"t.{c}", f"s.{c}").alias(c) for c in cols])
    return out if gone is None else out.join(gone.select(key).distinct(), key, "left_anti")


def local_first(server: DataFrame, local: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Local rows, then the server's other rows, less those in gone."""
    out = local.unionByName(server.join(local.select(key), key, "left_anti"))
    return out.join(gone.select(key).distinct(), key, "left_anti")


def write_members(server: DataFrame, local: DataFrame, key: str, rules: dict[str, str], ledger: DataFrame | None = None) -> DataFrame:
    """Local membership decides; rules name how each column is joined: max, union, server, local, overlay or ledger.

    server and overlay take the other side where theirs is null; ledger takes the server's value for keys that ledger
    lists and the larger one otherwise. A key stands once on each side.
    """
    s, t = server.alias("s"), local.alias("t")
    kinds = dict(local.dtypes)
    empty = lambda c: F.array().cast(kinds[c])
    how = {
        "max": lambda c: F.greatest(f"t.{c}", f"s.{c}"),
        "union": lambda c: F.array_union(F.coalesce(f"s.{c}", empty(c)), F.coalesce(f"t.{c}", empty(c))),
        "server": lambda c: F.coalesce(f"s.{c}", f"t.{c}"),
        "overlay": lambda c: F.coalesce(f"t.{c}", f"s.{c}"),
        "local": lambda c: F.col(f"t.{c}"),
        "ledger": lambda c: F.when(F.col("_l").isNotNull() & F.col(f"s.{key}").isNotNull(), F.coalesce(F.col(f"s.{c}"), F.lit(0))).otherwise(F.greatest(f"t.{c}", f"s.{c}")),
    }
    rows = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "left")
    if ledger is not None:
        rows = rows.join(ledger.select(F.col(key).alias("_l")).distinct(), F.col(f"t.{key}") == F.col("_l"), "left")
    return rows.select(F.col(f"t.{key}").alias(key), *[how[r](c).alias(c) for c, r in rules.items()])


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that are not in old as they are: key and whether the key is new. Nulls equal each other and nothing else."""
    cols = [c for c in new.columns if c != key]
    o = old.select(F.col(key).alias("_k"), F.struct(*cols).alias("_h"))
    n = new.select(key, F.struct(*cols).alias("_g"))
    return n.join(o, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~F.col("_h").eqNullSafe(F.col("_g"))).select(key, F.col("_k").isNull().alias("is_new"))


def set_where(rows: DataFrame, ids: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """Sets column name to value in rows whose key is listed."""
    listed = ids.select(F.col(key).alias("_k")).distinct()
    return rows.join(listed, F.col(key) == F.col("_k"), "left").withColumn(name, F.when(F.col("_k").isNotNull(), value).otherwise(F.col(name))).drop("_k")
