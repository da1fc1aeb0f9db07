"""Quests, streaks, coins, spaced repetition: what depends on the order of a learner's events.

The order that callers give must be total for a defined result; repeated rows count each (days of login once). Rows of a null
learner are those of one more learner. Null amounts add nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days until a card of box k is due.
BOX_DAYS = (0, 1, 3, 7, 16, 35)


def login_streaks(days: DataFrame, who: str, day: str) -> DataFrame:
    """days: one row per login. One row per learner and day with streak, the number of days in a row up to it."""
    once = days.select(who, day).distinct()
    place = F.row_number().over(Window.partitionBy(who).orderBy(day))
    runs = once.withColumn("_run", F.date_sub(F.col(day), place))
    return runs.withColumn("streak", F.row_number().over(Window.partitionBy(who, "_run").orderBy(day))).drop("_run")


def daily_bonus(streak: Column) -> Column:
    return F.lit(20) + F.when(streak % 7 == 0, F.lit(300)).otherwise(F.lit(0))


def clamped_balance(ops: DataFrame, who: str, order: list[str], delta: str, name: str = "balance") -> DataFrame:
    """The running balance that each operation leaves at 0 or more: sums less their lowest value below 0 so far."""
    w = Window.partitionBy(who).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ops.withColumn("_sum", F.sum(delta).over(w))
    return summed.withColumn(name, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def new_operations(ops: DataFrame, done: DataFrame, op_id: str, order: list[str], review: Column | None = None, review_key: list[str] | None = None) -> DataFrame:
    """Operations whose id is not done, the first of each id; of review rewards the first of each key only."""
    first = ops.withColumn("_n", F.row_number().over(Window.partitionBy(op_id).orderBy(*order))).where("_n = 1").drop("_n")
    fresh = first.join(done.select(op_id).distinct(), op_id, "left_anti")
    if review is None:
        return fresh
    w = Window.partitionBy(*review_key).orderBy(*order)
    paid = fresh.where(review).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return fresh.where(~F.coalesce(review, F.lit(False))).unionByName(paid)


def card_boxes(reviews: DataFrame, card: list[str], order: list[str], remembered: str, at: str) -> DataFrame:
    """box and due after each review: box grows to 5 while remembered and falls to 1; a forgotten card is due in ten minutes."""
    w = Window.partitionBy(*card).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lost = reviews.withColumn("_lost", F.sum((~F.col(remembered)).cast("int")).over(w))
    w2 = Window.partitionBy(*card, "_lost").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    box = F.least(F.lit(5), F.lit(1) + F.sum(F.col(remembered).cast("int")).over(w2)).cast("int")
    days = F.element_at(F.array(*map(F.lit, BOX_DAYS)), F.col("box") + 1)
    wait = F.when(F.col(remembered), F.make_dt_interval(days)).otherwise(F.expr("INTERVAL '10' MINUTE"))
    return lost.withColumn("box", box).withColumn("due", F.col(at) + wait).drop("_lost")


def node_summary(attempts: DataFrame, who: str, node: str, order: list[str]) -> DataFrame:
    """attempts (who, node, score, passed): one row per learner and node: n_attempts, best, first_passed, passed."""
    first = F.min_by("passed", F.struct(*order))
    return attempts.groupBy(who, node).agg(F.count("*").alias("n_attempts"), F.max(F.greatest("score", F.lit(0))).alias("best"), first.alias("first_passed"), F.bool_or("passed").alias("passed"))


def quest_progress(summary: DataFrame, who: str, node: str, n_nodes: int) -> DataFrame:
    """summary as of node_summary(), node numbered from 0: completed, total_score, current_index, streak."""
    gap = lambda ok: F.min(F.when(~ok, F.col(node)))
    every = summary.select(who).distinct().withColumn(node, F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1)))).join(summary, [who, node], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return every.groupBy(who).agg(
        F.count_if(yes("passed")).alias("completed"),
        F.sum(F.coalesce("best", F.lit(0))).alias("total_score"),
        F.coalesce(gap(yes("passed")), F.lit(n_nodes)).alias("current_index"),
        F.coalesce(gap(yes("first_passed")), F.lit(n_nodes)).alias("streak"),
    )


def node_state(passed: Column, opens: Column, closes: Column, prior_passed: Column, n_attempts: Column, now: Column) -> Column:
    """completed, scheduled, closed, locked, retry or available, the first that holds."""
    return (
        F.when(F.coalesce(passed, F.lit(False)), "completed").when(now < opens, "scheduled").when(now > closes, "closed")
        .when(~F.coalesce(prior_passed, F.lit(False)), "locked").when(n_attempts > 0, "retry").otherwise("available")
    )


def rewards_due(progress: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """rules (key, reward_id, kind milestone/total_score/streak, target, ...): those of its key that each row of progress has reached."""
    rows = progress.join(rules, key)
    value = F.when(F.col("kind") == "milestone", F.col("completed")).when(F.col("kind") == "total_score", F.col("total_score")).otherwise(F.col("streak"))
    return rows.where(value >= F.greatest(F.lit(0), F.col("target")))
