"""Ordered computations in which one key may hold a large share of all rows.

Rows are dealt into ranges of (key, order) of equal size and written once, so that a key spans as many ranges as it needs.
Each range is folded by itself, its folds are summed up in a row for each key, and what a range takes over from those
before it comes from these rows alone. At most one key of a range goes on from the range before, so what is carried is
no more than one row a range and goes to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.operators.progress import BOX_DAYS
from marktide.sources.shared import new_path


def written(df: DataFrame, label: str) -> DataFrame:
    """df from the shared folder: its lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with _part, the number of their range. The order must be total within a key, else equal rows may part."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *key, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _within(key: list[str], order: list[str]):
    return Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _over_parts(key: list[str]):
    return Window.partitionBy(*key).orderBy("_part")


def _before(key: list[str]):
    return _over_parts(key).rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, carry: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """rows with what their range takes over; carry: at most one key a range, so its size is that of the list of ranges."""
    c = F.broadcast(carry.select(F.col("_part").alias("_p"), F.lit(True).alias("_goes_on"), *[F.col(k).alias(f"_c{i}") for i, k in enumerate(key)], *names))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    return rows.join(c, same, "left").drop("_p", "_goes_on", *[f"_c{i}" for i in range(len(key))])


def clamped_balance(ops: DataFrame, who: str, order: list[str], delta: str, name: str = "balance", parts: int | None = None) -> DataFrame:
    """progress.clamped_balance() with accounts of any size: a range is summed up as its sum and its lowest partial sum."""
    rows = in_ranges(ops, [who], order, parts)
    w = _within([who], order)
    local = rows.withColumn("_sum", F.sum(F.coalesce(delta, F.lit(0))).over(w)).withColumn("_low", F.min("_sum").over(w))
    per = local.groupBy("_part", who).agg(F.sum(F.coalesce(delta, F.lit(0))).alias("_all"), F.min("_sum").alias("_lowest"))
    ahead = per.withColumn("_base", F.sum("_all").over(_before([who])))
    ahead = ahead.withColumn("_floor", F.min(F.coalesce("_base", F.lit(0)) + F.col("_lowest")).over(_before([who]))).where("_base IS NOT NULL")
    full = _carried(local, ahead, [who], ["_base", "_floor"])
    base = F.coalesce("_base", F.lit(0))
    return full.withColumn(name, base + F.col("_sum") - F.least(F.lit(0), "_floor", base + F.col("_low"))).drop("_sum", "_low", "_base", "_floor", "_part")


def card_boxes(reviews: DataFrame, card: list[str], order: list[str], remembered: str, at: str, parts: int | None = None) -> DataFrame:
    """progress.card_boxes() with cards of any size. A range is a map of boxes: either it adds to the box it begins
    with, or, once something is forgotten, it ends in the same box whatever it began with."""
    rows = in_ranges(reviews, card, order, parts)
    w = _within(card, order)
    local = rows.withColumn("_lost", F.sum((~F.col(remembered)).cast("int")).over(w))
    w2 = Window.partitionBy("_part", *card, "_lost").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = local.withColumn("_more", F.sum(F.col(remembered).cast("int")).over(w2))
    per = local.groupBy("_part", *card).agg(F.max(F.when(F.col("_lost") > 0, 1).otherwise(0)).alias("_resets"), F.max_by("_more", F.struct(*order)).alias("_end"))
    per = per.withColumn("_group", F.sum("_resets").over(_over_parts(card)))
    per = per.withColumn("_held", F.sum("_end").over(Window.partitionBy(*card, "_group").orderBy("_part")))
    ahead = per.withColumn("_base", F.lag("_held").over(_over_parts(card))).where("_base IS NOT NULL")
    full = _carried(local, ahead, card, ["_base"])
    box = F.least(F.lit(5), F.lit(1) + F.col("_more") + F.when(F.col("_lost") == 0, F.coalesce("_base", F.lit(0))).otherwise(0)).cast("int")
    days = F.element_at(F.array(*map(F.lit, BOX_DAYS)), F.col("box") + 1)
    wait = F.when(F.col(remembered), F.make_dt_interval(days)).otherwise(F.expr("INTERVAL '10' MINUTE"))
    return full.withColumn("box", box).withColumn("due", F.col(at) + wait).drop("_lost", "_more", "_base", "_part")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "pos", parts: int | None = None) -> DataFrame:
    """rows with their place among those of their key, from 0."""
    ranged = in_ranges(rows, key, order, parts)
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *key).orderBy(*order)))
    per = local.groupBy("_part", *key).agg(F.count("*").alias("_all"))
    ahead = per.withColumn("_base", F.sum("_all").over(_before(key))).where("_base IS NOT NULL")
    return _carried(local, ahead, key, ["_base"]).withColumn(name, F.col("_n") - 1 + F.coalesce("_base", F.lit(0))).drop("_n", "_base", "_part")


def running_max(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """rows with the largest value so far."""
    ranged = in_ranges(rows, key, order, parts)
    local = ranged.withColumn("_top", F.max(value).over(_within(key, order)))
    per = local.groupBy("_part", *key).agg(F.max(value).alias("_all"))
    ahead = per.withColumn("_base", F.max("_all").over(_before(key))).where("_base IS NOT NULL")
    return _carried(local, ahead, key, ["_base"]).withColumn(name, F.greatest("_top", "_base")).drop("_top", "_base", "_part")


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_at: Column, right_at: Column, found: Column, tie: Column | None = None, exact: bool = True, name: str = "found", parts: int | None = None) -> DataFrame:
    """left with found of the last row of right with the same key whose place is not after theirs (exact), or before it.

    Both are laid into one line and swept: no left row meets a right row but in passing. Of right rows at the same place
    the last by tie counts. Null places are never found and find nothing. left keeps all its rows.
    """
    side = F.struct(*left.columns)
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    t = F.lit(0) if tie is None else tie
    a = left.select(*keys, left_at.cast("double").alias("_at"), F.lit(1 if exact else 0).alias("_kind"), none(t, right).alias("_tie"), side.alias("_left"), none(found, right).alias("_found"), F.monotonically_increasing_id().alias("_row"))
    b = right.where(right_at.isNotNull()).select(*keys, right_at.cast("double").alias("_at"), F.lit(0 if exact else 1).alias("_kind"), t.alias("_tie"), none(side, left).alias("_left"), found.alias("_found"), F.lit(0).cast("long").alias("_row"))
    names = [f"_k{i}" for i in range(len(key))]
    order = ["_at", "_kind", "_tie", "_row"]
    rows = in_ranges(a.unionByName(b).withColumn("_hit", F.when(F.col("_left").isNull(), F.struct("_found"))), names, order, parts)
    swept = rows.withColumn("_last", F.last("_hit", ignorenulls=True).over(_within(names, order)))
    per = rows.groupBy("_part", *names).agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.struct(*order))).alias("_end"))
    ahead = per.withColumn("_base", F.last("_end", ignorenulls=True).over(_before(names))).where("_base IS NOT NULL")
    full = _carried(swept, ahead, names, ["_base"]).where("_left IS NOT NULL")
    hit = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_base")["_found"])
    return full.select("_left.*", hit.alias(name))


def nearest(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, tie: str, parts: int | None = None) -> DataFrame:
    """left with nearest, the place of right's row that is nearest to theirs; of two as near the smaller by tie."""
    row = F.struct(F.col(right_at).alias("place"), F.col(tie).alias("tie"))
    back = as_of(left, right, key, F.col(left_at), F.col(right_at), row, -F.col(tie), True, "_back", parts)
    both = as_of(back, right, key, -F.col(left_at), -F.col(right_at), row, -F.col(tie), True, "_on", parts)
    rated = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.place") - F.col(left_at)).alias("off"), F.col(f"{c}.tie"), F.col(f"{c}.place")))
    return both.withColumn("nearest", F.least(rated("_back"), rated("_on"))["place"]).drop("_back", "_on")


def orbit(steps: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """steps (key, pos, next), starts (key, pos): all places that one comes by from a start, going on from place to next.

    Pointer doubling: after n rounds the places within 2 to the n steps are known, and each place knows the one so many steps
    on. Every round is written.
    """
    jump, seen = steps.where("next IS NOT NULL"), starts.select(*key, "pos")
    while True:
        far = seen.join(jump, [*key, "pos"]).select(*key, F.col("next").alias("pos"))
        if (new := written(far, "orbit")).isEmpty():
            return seen
        seen = written(seen.unionByName(new).distinct(), "orbit")
        on = jump.select(*key, F.col("pos").alias("next"), F.col("next").alias("_then"))
        jump = written(jump.join(on, [*key, "next"]).select(*key, "pos", F.col("_then").alias("next")), "jumps")


def transcript_blocks(segments: DataFrame, key: str, order: str, start: str, end: str, text: str, block: float = 8.0, parts: int | None = None) -> DataFrame:
    """alignment.transcript_blocks() for recordings of any length: key, block_no, start_s, end_s, block_text.

    A segment knows where the block would end that begins with it: the first later one that ends over block seconds after its
    start, where the running maximum of the ends crosses that time. The blocks are the orbit of the first segment.
    order must be total. Where a segment ends after that time itself and the next one doesn't, ends run back; such recordings
    are folded in their order by one task each.
    """
    from marktide.operators import alignment

    rows = segments.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.trim(F.coalesce(text, F.lit(""))).alias("t")).where("t <> ''")
    rows = written(running_max(numbered(rows, ["key"], ["o"], "pos", parts), ["key"], ["pos"], "e", "top", parts), "segments")
    after = rows.select("key", (F.col("pos") - 1).alias("pos"), F.col("e").alias("e2"))
    limit = F.col("s") + F.lit(block)
    odd = written(rows.join(after, ["key", "pos"]).where((F.col("top") > limit) & (F.col("e2") <= limit)).select("key").distinct(), "odd")
    plain = rows.join(odd, "key", "left_anti")
    met = as_of(plain.select("key", "pos", limit.alias("limit")), plain, ["key"], -F.col("limit"), -F.col("top"), F.col("pos"), -F.col("pos"), False, "cross", parts)
    last = plain.groupBy("key").agg(F.max("pos").alias("_end"))
    step = F.greatest(F.col("pos") + 1, "cross")
    steps = written(met.join(last, "key").select("key", "pos", F.when(F.col("cross").isNotNull() & (step <= F.col("_end")), step).alias("next")), "steps")
    begins = numbered(orbit(steps, plain.where("pos = 0"), ["key"]), ["key"], ["pos"], "block_no", parts)
    told = as_of(plain, begins, ["key"], F.col("pos"), F.col("pos"), F.struct("block_no"), None, True, "block", parts)
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ")  # of one block
    out = told.groupBy("key", F.col("block.block_no").alias("block_no")).agg(F.min_by("s", "pos").alias("start_s"), F.max_by("e", "pos").alias("end_s"), words.alias("block_text"))
    out = out.select(F.col("key").alias(key), F.col("block_no").cast("int").alias("block_no"), "start_s", "end_s", "block_text")
    rest = rows.join(odd, "key", "left_semi").select(F.col("key").alias(key), F.col("pos"), "s", "e", "t")
    return out.unionByName(alignment.transcript_blocks(rest, key, "pos", "s", "e", "t", block))
