"""Exact duplicates by content sort.

Splitters are sampled from the table, by the start of a normalised text and a hash where texts start alike; they deal the
texts into ranges, Spark's external sort places equal texts next to each other, and a comparison of neighbours (on full
texts) finds the groups; the smallest identifier of a group stays.

A text that many rows share is combined inside each task before the shuffle (smallest id and count), so a group that
holds a third of all rows sends one row per task. Rows are then labelled through a join on the SHA-256 of the normalised
text, which adaptive execution can split where one digest is frequent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: A run of these code points counts as one space.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of repeated texts that one task keeps to combine them over several batches.
COMBINE_BYTES = 32 << 20
#: Characters of a text that a splitter holds, and rows that are sampled for each range.
HEAD, SAMPLES = 64, 20

_LOCAL = "text string, low long, n_rows long, part int"


def normalised(text):
    """Null is the empty text; each run of white space is one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _splitters(rows: DataFrame, n: int) -> list[tuple[str, int]]:
    """n - 1 ascending (start, hash) that part the texts of rows about evenly. The sample is about SAMPLES short rows for each range."""
    size = rows.count()
    head = F.substring(normalised(F.substring("text", 1, 4 * HEAD)), 1, HEAD)
    picked = rows.where(F.rand(42) < SAMPLES * n / max(1, size)).select(head.alias("head"), F.xxhash64("text").alias("mark")).collect()
    found = sorted({(r.head, r.mark) for r in picked})
    return [found[len(found) * k // n] for k in range(1, n)] if found else []


def _combine(splitters: list[tuple[str, int]]):
    """Rows (id, text) to one row for each different text of a batch, with its range; frequent texts once for the whole task."""
    spaces, schema = re.compile(SPACES), pa.schema([("text", pa.string()), ("low", pa.int64()), ("n_rows", pa.int64()), ("part", pa.int32())])

    def part(text: str) -> int:
        h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
        return bisect_right(splitters, (text[:HEAD], h - (1 << 64) if h >> 63 else h))

    def add(groups: dict[str, list], text: str, low) -> None:
        g = groups.setdefault(text, [low, 0])
        if g[0] is None or (low is not None and low < g[0]):
            g[0] = low
        g[1] += 1

    def out(groups: dict[str, list]) -> pa.RecordBatch:
        cols = list(zip(*groups.values(), strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.string()), *(pa.array(c, pa.int64()) for c in cols), pa.array(map(part, groups), pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        room = COMBINE_BYTES
        for batch in batches:
            groups: dict[str, list] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = spaces.sub(" ", text or "")
                add(held if text in held else groups, text, i)
            for text in [t for t, g in groups.items() if g[1] > 1]:
                if (n := len(text.encode())) <= room:
                    room -= n
                    held[text] = groups.pop(text)
            yield out(groups)
        yield out(held)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more rows with equal normalised text: text_sha256, keep_id, group_size."""
    rows, n = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), partitions(docs.sparkSession)
    local = rows.mapInArrow(_combine(_splitters(rows, n)), _LOCAL)
    ordered = local.repartitionById(n, F.col("part"))
    same = Window.partitionBy("part", "text")
    near = same.orderBy(F.col("low").asc_nulls_last())
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ordered.select("text", F.min("low").over(whole).alias("keep_id"), F.sum("n_rows").over(whole).alias("group_size"), F.row_number().over(near).alias("place"))
        .where("place = 1 and group_size > 1")
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("class_sha"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and so equal each other and the empty text. A null id is larger than any other. Of repeated
    rows (same id and text) exactly one is kept. An empty table gives an empty result; other input columns are ignored.
    """
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.count("*").alias("repeats"))
    )
    found = rows.join(classes(docs, id_col, text_col), F.col("text_sha256") == F.col("class_sha"), "left")
    alone = F.col("class_sha").isNull()
    return (
        found.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
