"""Changes to the records of learners, and what is detected in the events of an exam.

Changes of unknown or null learners have no effect but where a function adds new ones. Repeated changes count each, of edits
the largest row of a key. Empty tables of changes change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.functions.values import half_up, title_case
from marktide.operators import merging


def lesson_coins(seconds: Column) -> Column:
    return F.when(seconds >= 7200, 60).when(seconds >= 3600, 25).when(seconds >= 1800, 10).otherwise(0)


def after_lessons(students: DataFrame, lessons: DataFrame) -> DataFrame:
    """students (student_id, exp, coins, ...) with exp, level and coins after lessons (student_id, seconds); none changes nothing."""
    per = lessons.where("seconds > 0").groupBy(F.col("student_id").alias("_s")).agg(F.sum(half_up(F.col("seconds") / 60)).alias("_x"), F.sum(lesson_coins(F.col("seconds"))).alias("_c"))
    rows = students.join(per, F.col("student_id") == F.col("_s"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumns({"exp": zero("exp") + zero("_x"), "coins": zero("coins") + zero("_c")})
    return rows.withColumn("level", F.floor(F.col("exp") / 500) + 1).drop("_s", "_x", "_c")


def lesson_operations(lessons: DataFrame, reason: str = "LESSON") -> DataFrame:
    """Ledger operations of the lessons that earn coins: lesson_id, student_id, delta, reason."""
    coins = lesson_coins(F.col("seconds"))
    return lessons.select("lesson_id", "student_id", coins.alias("delta"), F.lit(reason).alias("reason")).where("delta > 0")


def edit_students(students: DataFrame, edits: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """students with edits (same columns, null: unchanged) applied; new ids are added with the defaults. Names are title case."""
    done = merging.overlay(students, edits, "student_id")
    return done.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}).withColumn("name", title_case(F.trim("name")))


def balance_operations(students: DataFrame, edits: DataFrame) -> DataFrame:
    """Ledger operations for edits that change a known student's coins: student_id, delta."""
    new = edits.where("coins is not null").select(F.col("student_id").alias("_s"), F.col("coins").alias("_c"))
    delta = F.col("_c") - F.coalesce("coins", F.lit(0))
    return students.join(new, F.col("student_id") == F.col("_s")).select("student_id", delta.alias("delta")).where("delta <> 0")


def prepended(rows: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """new before rows, both in order; is_new tells them apart."""
    both = new.withColumn("is_new", F.lit(True)).unionByName(rows.withColumn("is_new", F.lit(False)))
    return both.orderBy(F.desc("is_new"), *order)


def newest_entries(log: DataFrame, new: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The n first entries of log and new in order: a top-n, so tasks send n rows each."""
    return merging.keep_first(log.unionByName(new), order, n)


def notified(students: DataFrame, notes: DataFrame) -> DataFrame:
    """students with notes (student_id, at, note) appended to their array notifications, in order of time."""
    per = notes.groupBy(F.col("student_id").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("at", "note"))).alias("_n"))
    added = F.coalesce(F.transform("_n", lambda x: x["note"]), F.array().cast("array<string>"))
    have = F.coalesce("notifications", F.array().cast("array<string>"))
    return students.join(per, F.col("student_id") == F.col("_s"), "left").withColumn("notifications", F.concat(have, added)).drop("_s", "_n")


def quest_settings(questions: Column, minutes: Column, asked: Column, node_minutes: Column, mode: Column) -> dict[str, Column]:
    """How an exam starts as a quest step: its number of questions and time limit are clamped, a practice step needs no guard."""
    wanted = F.when(F.coalesce(asked, F.lit(0)) == 0, questions).otherwise(asked)
    limit = F.when(F.coalesce(node_minutes, F.lit(0)) != 0, node_minutes).when(F.coalesce(minutes, F.lit(0)) != 0, minutes).otherwise(1)
    return {
        "n_questions": F.greatest(F.lit(1), F.least(wanted, questions)),
        "time_limit": F.greatest(F.lit(1), limit),
        "practice": F.coalesce(mode == "practice", F.lit(False)),
        "locked": F.lit(False),
    }


def incidents(signals: DataFrame, who: list[str], at: str, tie: str, positive: str, in_a_row: int = 2, quiet: int = 12) -> DataFrame:
    """signals (who, at, tie, positive): the incidents (who, at), where the last signals were all positive.

    After an incident none counts for so many seconds. Candidates that follow another by at least that long always count,
    so they begin islands; only inside an island the choice is a fold, over its own short array.
    """
    w = Window.partitionBy(*who).orderBy(at, tie)
    recent = w.rowsBetween(-(in_a_row - 1), 0)
    full = (F.min(F.col(positive).cast("int")).over(recent) == 1) & (F.count("*").over(recent) == in_a_row)
    found = signals.withColumn("_full", full).where("_full").select(*who, F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).distinct()
    w = Window.partitionBy(*who).orderBy("_t")
    step = quiet * 1_000_000
    fresh = F.coalesce(F.col("_t") - F.lag("_t").over(w) >= step, F.lit(True))
    islands = found.withColumn("_f", fresh.cast("int")).withColumn("_i", F.sum("_f").over(w))
    times = F.sort_array(F.collect_list(F.struct("_t", "at")))
    first = F.array().cast("array<struct<_t:bigint,at:timestamp>>")
    put = lambda a, x: F.when((F.size(a) == 0) | (x["_t"] - F.element_at(a, -1)["_t"] >= step), F.concat(a, F.array(x))).otherwise(a)
    per = islands.withColumn("at", F.col("at").cast("timestamp")).groupBy(*who, "_i").agg(times.alias("_all"))
    return per.select(*who, F.explode(F.aggregate("_all", first, put)).alias("_x")).select(*who, F.col("_x.at").alias("at"))


def seconds_left(limit_minutes: Column, started: Column, now: Column) -> Column:
    """Seconds until an exam ends; 0 or less if it has."""
    return limit_minutes * 60 - (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(started.cast("timestamp")))
