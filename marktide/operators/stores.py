"""Keyed stores: snapshots of a workspace, cards with tombstones, catalogs, and what a write of one role does to each table.

Keys are not null; of rows with the same key on one side the one that the docstring names counts, so nothing multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.operators import merging

# Tombstones and ledger rows that are kept, entries of a log.
CARD_TOMBSTONES, EXAM_TOMBSTONES, LEDGER_ROWS, LOG_ROWS = 800, 1000, 2000, 50
#: Columns of a learner that only teachers change.
TEACHER_OWNED = ("name", "phone", "rate", "target", "cefr", "debt_message")


def snapshot_tables(snapshots: DataFrame, arrays: list[str], version: str = "version") -> dict[str, DataFrame]:
    """The newest snapshot (one row with array columns) as one table per array; null arrays are empty, null elements go."""
    newest = snapshots.orderBy(F.desc(version)).limit(1)
    return {name: newest.select(F.explode(F.filter(F.col(name), lambda x: x.isNotNull())).alias("x")).select("x.*") for name in arrays}


def usable_snapshots(snapshots: DataFrame, last_write: Column, quiet_ms: int = 800) -> DataFrame:
    """snapshots (version, read_at, pending, from_cache, n_rows) that may be applied.

    Not while own writes are pending or within quiet_ms of the last one, and not an empty one that comes from a cache.
    """
    busy = F.coalesce(F.col("pending"), F.lit(False)) | F.coalesce(F.col("read_at") - last_write < quiet_ms, F.lit(False))
    empty = F.coalesce(F.col("from_cache"), F.lit(False)) & (F.coalesce(F.col("n_rows"), F.lit(0)) == 0)
    return snapshots.where(~busy & ~empty)


def created_ms(created: Column, card_id: Column) -> Column:
    """When a card was made: its own time, else the digits after the prefix of its id (at least ten), else 0."""
    own = F.coalesce(F.nanvl(created.cast("double"), F.lit(0.0)), F.lit(0.0))
    digits = F.regexp_extract(F.coalesce(card_id, F.lit("")), r"^vocab_(\d{10,})", 1).try_cast("long")
    return F.when(own > 0, own.cast("long")).otherwise(F.coalesce(digits, F.lit(0)))


def newest_cards(cards: DataFrame, n: int) -> DataFrame:
    """The n newest cards (card_id, created_at), the larger id first of equals: a top-n, so tasks send n rows each."""
    return cards.orderBy(F.desc(created_ms(F.col("created_at"), F.col("card_id"))), F.desc("card_id")).limit(n)


def latest_state(changes: DataFrame, key: list[str], order: list[str], deleted: str) -> dict[str, DataFrame]:
    """A log of changes as the live rows and the tombstones: the last change of each key decides."""
    last = merging.newest(changes, key, [F.desc(c) for c in order])
    gone = F.coalesce(F.col(deleted), F.lit(False))
    return {"live": last.where(~gone).drop(deleted), "tombstones": last.where(gone).select(*key, *order)}


def deletion(rows: DataFrame, key: list[str], at: Column, deleted: str = "deleted") -> DataFrame:
    """Tombstones for rows, to be appended to a log of changes: their key and time alone, all else null."""
    keep = {*key, "at"}
    return rows.withColumns({"at": at, deleted: F.lit(True)}).select(*[F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("at", deleted)], "at", deleted)


def capped_tombstones(tombstones: DataFrame, owner: list[str], order: list[Column], n: int = CARD_TOMBSTONES) -> DataFrame:
    """The last n tombstones of each owner. A row whose tombstone was let go can come back; that is what a cap means."""
    return merging.keep_first(tombstones, order, n, owner)


def notebook(server: DataFrame, local: DataFrame, tombstones: DataFrame, owner: str, order: list[Column], n: int = CARD_TOMBSTONES) -> DataFrame:
    """Cards (owner, card_id, ...) of both sides, local values over the server's, less the last n tombstones (owner, card_id) of each owner."""
    key = F.struct(owner, "card_id")
    both = merging.overlay(server.withColumn("_key", key).drop(owner, "card_id"), local.withColumn("_key", key).drop(owner, "card_id"), "_key").select("_key.*", "*").drop("_key")
    gone = capped_tombstones(tombstones.select(owner, "card_id", *[c for c in tombstones.columns if c not in (owner, "card_id")]), [owner], order, n).select(owner, "card_id").distinct()
    return both.join(gone, [owner, "card_id"], "left_anti")


def own_write(server: DataFrame, local: DataFrame, me: Column, ledger: DataFrame) -> DataFrame:
    """A learner's write of the table of learners: only the own row changes, where email is me (case aside).

    Columns of TEACHER_OWNED stay the server's; exp and level only grow; coins are the server's if ledger (student_id) has
    the learner, else the larger; arrays are joined; of all else local values that are not null cover the server's. A
    local row of someone else changes nothing.
    """
    mine = local.where(F.lower(F.coalesce("email", F.lit(""))) == F.lower(me)).alias("t")
    led = ledger.select(F.col("student_id").alias("_l")).distinct()
    s = server.join(led, F.col("student_id") == F.col("_l"), "left").alias("s")
    rows = s.join(mine, F.lower(F.coalesce("s.email", F.lit(""))) == F.lower(F.coalesce("t.email", F.lit(""))), "left")
    hit = F.col("t.student_id").isNotNull()
    out = []
    for name, kind in server.dtypes:
        old, new = F.col(f"s.{name}"), F.col(f"t.{name}")
        if name in TEACHER_OWNED or name in ("student_id", "email"):
            value = old
        elif name in ("exp", "level"):
            value = F.greatest(old, new)
        elif name == "coins":
            value = F.when(F.col("_l").isNotNull(), old).otherwise(F.greatest(old, new))
        elif kind.startswith("array"):
            value = F.array_union(F.coalesce(old, F.array().cast(kind)), F.coalesce(new, F.array().cast(kind)))
        else:
            value = F.coalesce(new, old)
        out.append(F.when(hit, value).otherwise(old).alias(name))
    return rows.select(*out)


def keyed_upsert(server: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Rows of both by key for any role (results, live sessions, logs, reward codes): local values that are not null cover the server's."""
    return merging.overlay(server, local, key)


def role_write(server: DataFrame, local: DataFrame, teacher: bool) -> DataFrame:
    """Any other table: a teacher's write replaces it, a learner's is ignored."""
    return local if teacher else server


#: How a write changes a table that is not the learners': by key for any role, or as the role says.
KEYED = {"results": "result_id", "live_sessions": "session_id", "system_logs": "log_id", "reward_codes": "code"}


def synced(server: dict[str, DataFrame], local: dict[str, DataFrame], teacher: bool, me: Column, ledger: DataFrame, rules: dict[str, str]) -> dict[str, DataFrame]:
    """All tables of a workspace after one write of some of them: what was not written stays.

    students follow rules (teacher) or own_write(); tables of KEYED are joined by key; of any other a teacher's write
    replaces the table and a learner's is ignored.
    """
    out = dict(server)
    for name, rows in local.items():
        if name not in server:
            out[name] = rows
        elif name == "students":
            out[name] = merging.write_members(server[name], rows, "student_id", rules, ledger) if teacher else own_write(server[name], rows, me, ledger)
        elif name in KEYED:
            out[name] = keyed_upsert(server[name], rows, KEYED[name])
        else:
            out[name] = role_write(server[name], rows, teacher)
    return out


def inventory_after(ops: DataFrame, stock: DataFrame) -> DataFrame:
    """ops (student_id, consumables map, permanents array, reviewed_quiz) put into stock (student_id, consumables, permanents, reviewed).

    Counts are floored, those below 1 and empty names are left out and the rest is added; permanents and reviewed exams
    are sets. Learners without an operation stay; operations of unknown learners go.
    """
    none, counts = F.array().cast("array<string>"), "map<string,bigint>"
    given = ops.select("student_id", F.explode_outer(F.coalesce("consumables", F.create_map().cast(counts))).alias("name", "n"))
    given = given.withColumn("n", F.floor("n")).where((F.col("n") > 0) & (F.col("name") != "")).groupBy("student_id", "name").agg(F.sum("n").alias("n"))
    grants = given.groupBy(F.col("student_id").alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("_c"))
    names = lambda a: F.filter(F.transform(F.coalesce(a, none), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    sets = ops.groupBy(F.col("student_id").alias("_h")).agg(F.array_distinct(F.flatten(F.collect_list(names("permanents")))).alias("_p"), F.collect_set("reviewed_quiz").alias("_r"))
    rows = stock.join(grants, F.col("student_id") == F.col("_g"), "left").join(sets, F.col("student_id") == F.col("_h"), "left")
    have = F.coalesce("consumables", F.create_map().cast(counts))
    added = F.map_zip_with(have, F.coalesce("_c", F.create_map().cast(counts)), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    union = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none))
    return rows.select("student_id", added.alias("consumables"), union("permanents", "_p").alias("permanents"), union("reviewed", "_r").alias("reviewed"))


def union_all(*arrays: Column) -> Column:
    """The different elements of text arrays, first come first; null counts as an empty array."""
    out = F.array().cast("array<string>")
    for a in arrays:
        out = F.array_union(out, F.coalesce(a, F.array().cast("array<string>")))
    return out


def normalised_attempts(attempts: DataFrame) -> DataFrame:
    """attempts (who, node, attempt_id, score, total, percentage, passed, at, place): one row of each id.

    The last row of an id (by place) counts, passed if any of them did; score and total are at least 0, a percentage is
    computed where none is given and held between 0 and 100. A null id is an attempt of its own.
    """
    own = F.coalesce(F.col("attempt_id").cast("string"), F.concat_ws("_", "node", "at", "score", "place"))
    rows = attempts.withColumns({"attempt_id": own, "score": F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0)).cast("double")), "total": F.greatest(F.lit(0.0), F.coalesce("total", F.lit(0)).cast("double"))})
    share = F.coalesce(F.col("percentage").cast("double"), F.when(F.col("total") > 0, F.floor(F.try_divide(F.col("score"), F.col("total")) * 10_000 + F.lit(0.5)) / 100).otherwise(0.0))
    rows = rows.withColumn("percentage", F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))
    cols = ("score", "total", "percentage", "at", "place")
    last = F.max_by(F.struct(*cols), F.col("place"))
    out = rows.groupBy("who", "node", "attempt_id").agg(last.alias("_l"), F.bool_or(F.coalesce("passed", F.lit(False))).alias("passed"))
    return out.select("who", "node", "attempt_id", *[F.col(f"_l.{c}").alias(c) for c in cols], "passed")


def merged_attempts(server: DataFrame, local: DataFrame) -> DataFrame:
    """Both sides' attempts as normalised_attempts() makes them, local rows after the server's."""
    high = server.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_h"))
    after = local.crossJoin(F.broadcast(high)).withColumn("place", F.col("place") + F.col("_h") + 1).drop("_h")  # one row
    return normalised_attempts(server.unionByName(after))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt of each learner at each node: by time, number and id."""
    return merging.newest(attempts, ["who", "node"], [F.desc("at"), F.desc("place"), F.desc("attempt_id")])


def replay_until_failure(journal: DataFrame, failed: DataFrame, owner: str, order: list[str], entry: str) -> DataFrame:
    """The entries of each owner that are replayed: those before the first that fails (failed: entry)."""
    bad = failed.select(F.col(entry).alias("_f")).distinct()
    rows = journal.join(bad, F.col(entry) == F.col("_f"), "left")
    w = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_n", F.count("_f").over(w)).where("_n = 0").drop("_f", "_n")
