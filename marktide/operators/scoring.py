"""Exam scoring: answer sets, question groups, bands, error analysis.

A null answer is skipped, a null key counts as an empty text. Repeated rows count each, null groups are groups of their own,
and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.functions.values import percent

# Least score out of 40, and its band.
READING_BANDS = ((39, 9.0), (37, 8.5), (35, 8.0), (33, 7.5), (30, 7.0), (27, 6.5), (23, 6.0), (19, 5.5), (15, 5.0), (13, 4.5), (10, 4.0), (8, 3.5), (6, 3.0), (4, 2.5))
LISTENING_BANDS = ((39, 9.0), (37, 8.5), (35, 8.0), (32, 7.5), (30, 7.0), (26, 6.5), (23, 6.0), (18, 5.5), (16, 5.0), (13, 4.5), (10, 4.0), (6, 3.5), (4, 3.0))


def band(score: Column, total: Column, skill: Column) -> Column:
    """The band of a score; null where there is none (no questions, or below the table)."""
    norm = F.try_divide(F.coalesce(score, F.lit(0)) * F.lit(1.0), total) * 40

    def look_up(table) -> Column:
        out = F.lit(None).cast("double")
        for least, value in reversed(table):
            out = F.when(norm >= least, F.lit(value)).otherwise(out)
        return out

    return F.when(F.lower(F.coalesce(skill, F.lit(""))).contains("listen"), look_up(LISTENING_BANDS)).otherwise(look_up(READING_BANDS))


def single_correct(kind: Column, key: Column, answer: Column) -> Column:
    """CHOICE and MATCHING compare strictly; other keys list alternatives with a slash, compared trimmed in lower case."""
    options = F.transform(F.split(F.coalesce(key, F.lit("")), "/"), lambda x: F.lower(F.trim(x)))
    return F.when(kind.isin("CHOICE", "MATCHING"), answer.eqNullSafe(key)).otherwise(F.array_contains(options, F.lower(F.trim(F.coalesce(answer, F.lit(""))))))


def multiple_outcome(correct: Column, selected: Column) -> dict[str, Column]:
    """Score, total and skipped of one answer set; more selections than correct answers score nothing."""
    key, marked = F.array_distinct(F.array_compact(correct)), F.array_distinct(F.array_compact(selected))
    total = F.greatest(F.lit(1), F.size(key))
    hits = F.size(F.array_intersect(key, marked))
    score = F.when(F.size(marked) > total, F.lit(0)).otherwise(hits)
    return {"score": score, "total": total, "skipped": F.greatest(F.lit(0), total - F.size(marked)), "full": (score == total) & (F.size(F.array_except(marked, key)) == 0)}


def question_groups(items: DataFrame, attempt: str, order: list[str], multiple: Column, same: list[str]) -> DataFrame:
    """items with group_no: consecutive multiple-choice items with equal columns same are one group, others their own."""
    w = Window.partitionBy(attempt).orderBy(*order)
    key = F.when(multiple, F.struct(*same))
    fresh = (~multiple) | ~F.coalesce(F.lag(key).over(w).eqNullSafe(key), F.lit(False))
    return items.withColumn("_new", fresh.cast("int")).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def attempt_scores(grouped: DataFrame, attempt: str, multiple: str, correct: str, selected: str) -> DataFrame:
    """One row per attempt: score, total, skipped, incorrect. A null selection is skipped."""
    groups = grouped.groupBy(attempt, "group_no").agg(F.bool_or(multiple).alias("m"), F.collect_set(correct).alias("key"), F.collect_set(selected).alias("marked"))
    found = multiple_outcome(F.col("key"), F.col("marked"))
    per = groups.select(attempt, *[found[c].alias(c) for c in ("score", "total", "skipped")])
    out = per.groupBy(attempt).agg(*[F.sum(c).alias(c) for c in ("score", "total", "skipped")])
    return out.withColumn("incorrect", F.greatest(F.lit(0), F.col("total") - F.col("score") - F.col("skipped")))


def numbered(items: DataFrame, attempt: str, order: list[str], points: Column) -> DataFrame:
    """items with first_no and label: an item of several points takes several numbers."""
    w = Window.partitionBy(attempt).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(points).over(w), F.lit(0)) + 1
    return items.withColumn("first_no", first).withColumn("label", F.when(points > 1, F.concat_ws("-", F.col("first_no").cast("string"), (F.col("first_no") + points - 1).cast("string"))).otherwise(F.col("first_no").cast("string")))


def error_rates(graded: DataFrame, by: list[str]) -> DataFrame:
    """graded (by, correct boolean): n_correct, total and the rounded rate of each combination."""
    out = graded.groupBy(*by).agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("total"))
    return out.withColumn("rate", percent(F.col("n_correct"), F.col("total")))


def weakest_labels(rates: DataFrame, who: str, label: str, least: int = 2, below: int = 60) -> DataFrame:
    """Each learner's worst label with enough items, if its rate is below the bound; ties by label."""
    w = Window.partitionBy(who).orderBy("rate", label)
    return rates.where(F.col("total") >= least).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("rate") < below)).drop("_n")


def mean_bands(results: DataFrame, exam: str, band: Column) -> DataFrame:
    """Per exam the mean of its bands in tenths, -1 without any, and their number n. band: a number; NaN (no number) doesn't count."""
    rows = results.select(exam, F.when(~F.isnan(band), band).alias("_b"))
    return rows.groupBy(exam).agg(F.coalesce(F.floor(F.avg("_b") * 10 + F.lit(0.5)), F.lit(-1)).alias("tenths"), F.count("_b").alias("n"))
