"""Filters, small projections and joins of the roster: lessons, results, links, catalog, attendance.

Null in a column that a filter names matches nothing unless said otherwise. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktide.functions.values import half_up, or_zero
from marktide.operators.records import lesson_coins

# Steps of taught hours; beyond the last one each thousand is a step.
HOUR_STEPS = (10, 25, 50, 100, 200, 350, 500, 750, 1000, 1500, 2000, 3000, 5000)


def equal_if_given(rows: DataFrame, **wanted) -> DataFrame:
    """The rows whose columns have the wanted values; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def results_shown(rows: DataFrame, student=None, exam=None, band: str | None = None, name: str | None = None) -> DataFrame:
    """rows (student_id, exam_id, band, name) that all given filters let pass. band: ">=7.0" or "<6.0".

    A band that is no number is neither below 7 nor at least 6, so it passes both. Names are compared in lower case.
    """
    rows = equal_if_given(rows, student_id=student, exam_id=exam)
    value = F.col("band")
    number = value.isNotNull() & ~F.isnan(value)
    if band == ">=7.0":
        rows = rows.where(~(number & F.coalesce(value < 7, F.lit(False))))
    elif band == "<6.0":
        rows = rows.where(~(number & F.coalesce(value >= 6, F.lit(False))))
    return rows.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(name.lower()))) if name else rows


def lesson_totals(lessons: DataFrame, student=None) -> DataFrame:
    """One row: n_lessons, seconds and earned of the lessons of a student, or of all."""
    return equal_if_given(lessons, student_id=student).agg(F.count("*").alias("n_lessons"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"), F.coalesce(F.sum("earned"), F.lit(0)).alias("earned"))


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows less those whose key is listed; a null key is never listed."""
    return rows.join(ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def is_practice(kind: Column, audio_mode: Column, practice_mode: Column) -> Column:
    """Whether an exam is for practice: its flag says so, or it has audio that may be replayed."""
    audio = F.coalesce(kind, F.lit("")).rlike("(?i)listen|integrated") & F.coalesce(audio_mode == "practice", F.lit(False))
    return F.coalesce(practice_mode, F.lit(False)) | audio


def ends_with_domain(email: Column, domain: str) -> Column:
    """Whether a trimmed address ends with the domain, case aside; null does not."""
    return F.endswith(F.lower(F.trim(F.coalesce(email, F.lit("")))), F.lit(domain.lower()))


def listed_names(rows: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """The rows whose trimmed name stands in catalog (name)."""
    known = catalog.select(F.col("name").alias("_k")).distinct()
    return rows.join(known, F.trim(F.coalesce(F.col(name), F.lit(""))) == F.col("_k"), "left_semi")


def month_days(spark_rows: DataFrame, date: str, month: str) -> DataFrame:
    """All days of a month (yyyy-MM): date, day, weekday (0 is Sunday), has_any, whether a row has that date."""
    first = F.to_date(F.lit(f"{month}-01"))
    days = spark_rows.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    seen = spark_rows.select(F.to_date(date).alias("_d")).distinct()
    found = days.join(seen, F.col("date") == F.col("_d"), "left")
    return found.select("date", F.dayofmonth("date").alias("day"), (F.dayofweek("date") - 1).alias("weekday"), F.col("_d").isNotNull().alias("has_any"))


def next_step(x: Column, steps: tuple[int, ...] = HOUR_STEPS) -> Column:
    """The first step above x, beyond the last one the next full thousand."""
    above = F.get(F.filter(F.array(*map(F.lit, steps)), lambda s: s > x), F.lit(0))
    return F.coalesce(above, (F.ceil((x + 1) / 1000) * 1000).cast("int"))


def share_of(part: Column, other: Column) -> Column:
    """part in percent of both; 50 where both are 0."""
    a, b = or_zero(part), or_zero(other)
    return F.when(a + b == 0, F.lit(50.0)).otherwise(F.try_divide(a, a + b) * 100)


def age(born: Column, today: Column) -> Column:
    """Difference of the years alone; null without a date of birth."""
    return F.year(today) - F.year(born)


def exam_coins(ends: Column, finished: Column) -> Column:
    """50 for an exam, 150 more if it is done a day before its end, or 100 more half a day before; no end, no bonus."""
    hours = (F.unix_micros(ends.cast("timestamp")) - F.unix_micros(finished.cast("timestamp"))) / F.lit(3_600_000_000)
    return F.lit(50) + F.when(hours >= 24, 150).when(hours >= 12, 100).otherwise(0)


def attendance(schedules: DataFrame, students: DataFrame, present: str) -> DataFrame:
    """schedules (schedule_id, student_id, minutes, billed, present) marked: status, billed, seconds, earned, xp, coins, refused.

    Who is absent is not billed. A lesson that is billed already, or whose student is unknown, is refused (reason in
    refused) and stays as it was. Without minutes a lesson lasts 90. students: student_id, rate; one row each.
    """
    known = students.select(F.col("student_id").alias("_s"), "rate")
    rows = schedules.join(known, F.col("student_id") == F.col("_s"), "left")
    here = F.coalesce(F.col(present), F.lit(False))
    billed = F.coalesce("billed", F.lit(False))
    refused = F.when(here & billed, "billed").when(here & F.col("_s").isNull(), "no_student")
    done = here & refused.isNull()
    minutes = F.when(F.coalesce("minutes", F.lit(0)) == 0, 90).otherwise(F.col("minutes"))
    seconds = minutes * 60
    return rows.select(
        "schedule_id", "student_id",
        F.when(~here, "ABSENT").when(done, "DONE").otherwise(F.when(billed, "DONE").otherwise("PENDING")).alias("status"),
        F.when(here, done | billed).otherwise(False).alias("billed"),
        F.when(done, seconds).alias("seconds"),
        F.when(done, half_up(F.ceil(seconds / 60) / 60 * or_zero(F.col("rate")))).alias("earned"),
        F.when(done, half_up(seconds / 60)).alias("xp"),
        F.when(done, lesson_coins(seconds)).alias("coins"),
        refused.alias("refused"),
    )


def duplicated(exams: DataFrame, ids: DataFrame, new_id: Column, key: str = "exam_id") -> DataFrame:
    """exams and, before them, copies of those listed: new id, title marked, inactive and locked; is_copy tells them apart."""
    copies = exams.join(ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
    copies = copies.withColumns({key: new_id, "title": F.concat(F.coalesce("title", F.lit("")), F.lit(" (Copy)")), "active": F.lit(False), "locked": F.lit(True), "is_copy": F.lit(True)})
    return copies.unionByName(exams.withColumn("is_copy", F.lit(False)))


def own_row(users: DataFrame, students: DataFrame) -> DataFrame:
    """users (email) with the student whose address is the same but for case, the one with the smallest id; null if there is none."""
    key = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    first = students.where(key("email") != "").groupBy(key("email").alias("_e")).agg(F.min("student_id").alias("student_id"))
    return users.join(first, key("email") == F.col("_e"), "left").drop("_e")


def gate_reason(banned: Column, opens: Column, closes: Column, now: Column, browser: Column, passcode: Column, given: Column, used: Column, allowed: Column) -> Column:
    """Why an attempt may not start, the first that holds: banned, not_open, closed, browser, passcode, attempts; else open.

    banned and browser (a secure browser is required and is not used) are booleans; null counts as false. Null limits
    ask for nothing, nor does an empty passcode.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    wrong = (F.coalesce(passcode, F.lit("")) != "") & (F.trim(F.coalesce(given, F.lit(""))) != F.coalesce(passcode, F.lit("")))
    return F.when(yes(banned), "banned").when(yes(now < opens), "not_open").when(yes(now > closes), "closed").when(yes(browser), "browser").when(wrong, "passcode").when(yes(used >= allowed), "attempts").otherwise("open")
