"""What a handed-in exam brings about: marks, thresholds, rewards, ledger operations; and how exams are put together.

An exam's questions and one learner's rewards are few, so folds over them may hold them in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marktide.functions.values import coin_amount, or_zero, places, plain_key, squeeze, strip_tags
from marktide.operators import progress, scoring

# Violations at which an exam is handed in by itself, wrong answers that feedback lists, characters of an answer in it.
STRIKES, WRONG_LINES, ANSWER_CHARS = 3, 30, 70


def pass_mark(score: Column, total: Column, threshold: Column) -> dict[str, Column]:
    """percentage to two places (0 without questions) and whether it reaches the threshold, held between 0 and 100."""
    share = F.when(total > 0, places(F.try_divide(score.cast("double"), total) * 100, 2)).otherwise(0.0)
    return {"percentage": share, "passed": share >= F.greatest(F.lit(0.0), F.least(F.lit(100.0), or_zero(threshold)))}


def recalculated(results: DataFrame, scores: DataFrame, exam, skill: Column) -> DataFrame:
    """results (attempt_id, exam_id, score, total, band) with the scores (attempt_id, score, total) of one exam put in, and its bands."""
    new = scores.select(F.col("attempt_id").alias("_a"), F.col("score").alias("_s"), F.col("total").alias("_t"))
    rows = results.join(new, (F.col("attempt_id") == F.col("_a")) & (F.col("exam_id") == F.lit(exam)), "left")
    hit = F.col("_a").isNotNull()
    fresh = scoring.band(F.col("_s"), F.col("_t"), skill)
    return rows.withColumns({"score": F.when(hit, F.col("_s")).otherwise(F.col("score")), "total": F.when(hit, F.col("_t")).otherwise(F.col("total")), "band": F.when(hit, fresh).otherwise(F.col("band"))}).drop("_a", "_s", "_t")


def reward_quantity(kind: Column, quantity: Column) -> Column:
    """1 for a permanent gift, else the whole part of the quantity, at least 1."""
    return F.when(kind == "permanent_gift", 1).otherwise(F.greatest(F.lit(1), F.floor(or_zero(quantity)))).cast("long")


def reward_totals(rewards: DataFrame, who: list[str], permanents: DataFrame, consumables: DataFrame) -> DataFrame:
    """rewards (who, reward_id, kind, value, quantity): one row each with coins, permanents, consumables (name to count) and op_id.

    Gifts that their catalog (name) does not list are left out; op_id is made of the sorted reward ids, so a reward that
    is handed in twice is the same operation.
    """
    name = F.trim(F.coalesce("value", F.lit("")))
    listed = lambda c, n: c.select(F.col("name").alias(n)).distinct()
    rows = rewards.withColumn("_v", name).join(listed(permanents, "_p"), (F.col("_v") == F.col("_p")) & (F.col("kind") == "permanent_gift"), "left").join(listed(consumables, "_c"), (F.col("_v") == F.col("_c")) & (F.col("kind") == "consumable_gift"), "left")
    per_name = rows.groupBy(*who, F.col("_c").alias("_c")).agg(
        F.sum(F.when(F.col("kind") == "coins", coin_amount(F.col("value"))).otherwise(0)).alias("coins"), F.collect_set("_p").alias("p"), F.sum(reward_quantity(F.col("kind"), F.col("quantity"))).alias("n"), F.collect_set(F.col("reward_id").cast("string")).alias("ids")
    )
    gift = F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("name"), F.col("n").alias("count")))
    out = per_name.groupBy(*who).agg(F.sum("coins").alias("coins"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("permanents"), F.map_from_entries(F.array_sort(F.collect_list(gift))).alias("consumables"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("_i"))
    return out.withColumn("op_id", F.concat_ws("_", F.lit("quest_reward"), *[F.col(c).cast("string") for c in who], F.array_join("_i", "_"))).drop("_i")


def submitted(attempts: DataFrame, nodes: DataFrame, rules: DataFrame, unlocked: DataFrame, n_nodes: int, permanents: DataFrame, consumables: DataFrame) -> dict[str, DataFrame]:
    """attempts (attempt_id, student_id, topic_id, node, score, total, at) handed in, as tables:

    results: attempts with percentage, passed and attempt_no; progress: one row per learner and topic; unlocked: rewards
    reached now and not before (unlocked: student_id, reward_id); operations: one ledger operation per learner and topic.
    nodes: topic_id, node, threshold; rules: topic_id, reward_id, kind, target, reward_kind, value, quantity.
    """
    found = pass_mark(F.col("score"), F.col("total"), F.col("threshold"))
    place = F.row_number().over(Window.partitionBy("student_id", "topic_id", "node").orderBy("at", "attempt_id"))
    results = attempts.join(nodes, ["topic_id", "node"]).withColumns(found).withColumn("attempt_no", place)
    who = ["student_id", "topic_id"]
    summary = progress.node_summary(results.withColumn("_w", F.struct(*who)), "_w", "node", ["at", "attempt_id"])
    after = progress.quest_progress(summary, "_w", "node", n_nodes).select("_w.*", "completed", "total_score", "current_index", "streak")
    due = progress.rewards_due(after, rules, "topic_id")
    fresh = due.join(unlocked.select("student_id", "reward_id").distinct(), ["student_id", "reward_id"], "left_anti")
    gifts = fresh.select(*who, "reward_id", F.col("reward_kind").alias("kind"), "value", "quantity")
    operations = reward_totals(gifts, who, permanents, consumables).where((F.col("coins") > 0) | (F.size("permanents") > 0) | (F.size("consumables") > 0))
    return {"results": results, "progress": after, "unlocked": fresh, "operations": operations}


def integrity(events: DataFrame, attempt: str, order: list[str], violation: Column, resume: Column, practice: Column) -> DataFrame:
    """events with strikes so far: a violation is one, coming back to an exam another; in practice none counts.

    submits is true for the event that reaches STRIKES; later events change nothing and are left out.
    """
    one = F.when(~F.coalesce(practice, F.lit(False)) & (F.coalesce(violation, F.lit(False)) | F.coalesce(resume, F.lit(False))), 1).otherwise(0)
    w = Window.partitionBy(attempt).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_one", one).withColumn("strikes", F.sum("_one").over(w))
    submits = (F.col("strikes") == STRIKES) & (F.col("_one") == 1)
    return rows.where((F.col("strikes") < STRIKES) | submits).withColumns({"submits": submits, "locked": (F.col("_one") == 1) & ~submits}).drop("_one")


def feedback(groups: DataFrame, attempt: str, order: str) -> DataFrame:
    """groups (attempt, order, label, number, score, total, given, right): weak, n_wrong and details of each attempt.

    weak lists each label with its right and all points; details the first WRONG_LINES groups that are not fully right.
    """
    per = groups.groupBy(attempt, "label").agg(F.sum("score").alias("c"), F.sum("total").alias("t"), F.min(order).alias("o"))
    weak = per.groupBy(attempt).agg(F.array_sort(F.collect_list(F.struct("o", F.concat(F.col("label"), F.lit(": "), F.col("c").cast("string"), F.lit("/"), F.col("t").cast("string")).alias("x")))).alias("w"))
    wrong = groups.where(F.col("score") < F.col("total"))
    n = F.row_number().over(Window.partitionBy(attempt).orderBy(order))
    cut = lambda c: F.substring(strip_tags(F.coalesce(F.col(c).cast("string"), F.lit("")), ""), 1, ANSWER_CHARS)
    line = F.concat(F.lit("#"), F.col("number"), F.lit(" ["), F.col("label"), F.lit('] given: "'), cut("given"), F.lit('" | right: "'), cut("right"), F.lit('"'))
    lines = wrong.withColumn("_n", n).groupBy(attempt).agg(F.sum(F.col("total") - F.col("score")).alias("n_wrong"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= WRONG_LINES, F.struct("_n", line.alias("x"))))), lambda x: x["x"]), "\n").alias("details"))
    return weak.join(lines, attempt, "left").select(attempt, F.array_join(F.transform("w", lambda x: x["x"]), ", ").alias("weak"), F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"), F.coalesce("details", F.lit("")).alias("details"))


def as_places(value: Column) -> Column:
    """An answer as JSON text, one number or a list of them, as the different whole numbers in it; null and empty text as none."""
    t = F.trim(F.coalesce(value, F.lit("")))
    numbers = F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), "array<double>")
    whole = F.filter(F.coalesce(numbers, F.array().cast("array<double>")), lambda x: x.isNotNull() & (x == F.floor(x)))
    return F.array_distinct(F.transform(whole, lambda x: x.cast("int")))


def carried_groups(questions: DataFrame, exam: str, order: str, context: str, instruction: str) -> DataFrame:
    """questions with group_no and the group's context and instruction.

    A question joins the open group while it has no context of its own or the group's, and no instruction of its own or
    the group's. Without a context a new group keeps the last one's.
    """
    rows = questions.groupBy(exam).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(context, F.lit("")).alias("c"), F.coalesce(instruction, F.lit("")).alias("i")))).alias("q"))
    kind = "array<struct<c:string,i:string,first:int,size:int>>"
    none = F.array().cast(kind)

    def step(a: Column, q: Column) -> Column:
        last = F.element_at(a, F.greatest(F.size(a), F.lit(1)))
        joins = (F.size(a) > 0) & ((q["c"] == "") | (q["c"] == last["c"])) & ((q["i"] == last["i"]) | ((q["i"] == "") & (last["i"] != "")))
        grown = F.struct(last["c"].alias("c"), last["i"].alias("i"), last["first"].alias("first"), (last["size"] + 1).alias("size"))
        begin = F.when(F.size(a) > 0, last["first"] + last["size"]).otherwise(0)
        fresh = F.struct(F.when(q["c"] != "", q["c"]).when(F.size(a) > 0, last["c"]).otherwise("").alias("c"), q["i"].alias("i"), begin.alias("first"), F.lit(1).alias("size"))
        return F.when(joins, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(fresh))).cast(kind)

    found = rows.select(exam, F.posexplode(F.aggregate("q", none, step)).alias("group_no", "g"))
    return found.select(exam, "group_no", F.col("g.c").alias("context"), F.col("g.i").alias("instruction"), F.col("g.first").alias("start_index"), F.col("g.size").alias("n_questions"))


def shared_options(questions: DataFrame, block: str, order: str, kind: str = "kind", options: str = "options") -> DataFrame:
    """questions of choice whose options are missing or empty take the last ones before them in their block."""
    own = F.when(F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0, F.col(options))
    w = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = questions.withColumn("_last", F.last(own, ignorenulls=True).over(w))
    takes = own.isNull() & F.col(kind).isin("CHOICE", "CHOICE_MULTIPLE", "MATCHING", "DRAG")
    return rows.withColumn(options, F.when(takes, F.col("_last")).otherwise(F.col(options))).drop("_last")


def placed(questions: DataFrame, sections: DataFrame, members: DataFrame) -> DataFrame:
    """questions (exam_id, question_id, passage_index) with section: their passage, else the section that lists them, else the last.

    sections: exam_id, n_sections; members: exam_id, question_id, section, of several the largest counts.
    """
    listed = members.groupBy(F.col("exam_id").alias("_e"), F.col("question_id").alias("_q")).agg(F.max("section").alias("_m"))
    rows = questions.join(sections.select("exam_id", "n_sections"), "exam_id").join(listed, (F.col("exam_id") == F.col("_e")) & (F.col("question_id") == F.col("_q")), "left")
    want = F.coalesce("passage_index", "_m")
    inside = F.coalesce((want >= 0) & (want < F.col("n_sections")), F.lit(False))
    return rows.withColumn("section", F.when(inside, want).otherwise(F.col("n_sections") - 1)).drop("_e", "_q", "_m", "n_sections")


def last_number(text: Column) -> Column:
    """The last run of digits in a text; null if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^.*?(\d+)\D*$", 1).try_cast("long")


def found_in_catalog(old: DataFrame, catalog: DataFrame) -> DataFrame:
    """old (exam_id, question_id, text, answer) with place, where the question stands in the catalog now (exam_id, question_id, text, answer, place), and how it was found.

    By id, else by text and answer, else by the last number of its id; of several the first place counts.
    """
    print_ = lambda: F.concat(F.lower(squeeze(strip_tags(F.coalesce("text", F.lit("")), ""))), F.lit("|"), F.lower(squeeze(strip_tags(F.coalesce(F.col("answer").cast("string"), F.lit("")), ""))))
    rows = old.withColumns({"_p": print_(), "_n": last_number(F.col("question_id").cast("string"))})
    known = catalog.withColumns({"_p": print_(), "_n": last_number(F.col("question_id").cast("string"))})
    ways = {"id": ("question_id", "question_id"), "text": ("_p", "_p"), "number": ("_n", "_n")}
    for way, (mine, theirs) in ways.items():
        first = known.where(F.col(theirs).isNotNull()).groupBy(F.col("exam_id").alias("_e"), F.col(theirs).alias("_k")).agg(F.min("place").alias(f"_{way}"))
        rows = rows.join(first, (F.col("exam_id") == F.col("_e")) & (F.col(mine) == F.col("_k")), "left").drop("_e", "_k")
    how = F.when(F.col("_id").isNotNull(), "id").when(F.col("_text").isNotNull(), "text").when(F.col("_number").isNotNull(), "number").otherwise("none")
    return rows.withColumns({"place": F.coalesce("_id", "_text", "_number"), "found_by": how}).drop("_p", "_n", "_id", "_text", "_number")


def shared_edit(questions: DataFrame, edits: DataFrame, field: str) -> DataFrame:
    """questions (exam_id, question_id, kind, options, ...) after edits (exam_id, question_id, value, option_index) of one field.

    A context or an instruction changes in all questions of the exam that had the same one; an option in all matching or
    multiple questions of the same kind and options; any other field in that question alone. One edit of an exam at a time.
    """
    own = questions.select(F.col("exam_id").alias("_e"), F.col("question_id").alias("_q"), F.col(field).alias("_old"), F.col("kind").alias("_kind"))
    e = edits.select(F.col("exam_id").alias("_x"), F.col("question_id").alias("_y"), F.col("value").alias("_v"), "option_index")
    target = e.join(own, (F.col("_x") == F.col("_e")) & (F.col("_y") == F.col("_q"))).drop("_e", "_q")
    rows = questions.join(target, F.col("exam_id") == F.col("_x"), "left")
    same = F.coalesce(F.col("question_id") == F.col("_y"), F.lit(False))
    if field == "options":
        shares = F.coalesce(F.col("_kind").isin("CHOICE_MULTIPLE", "MATCHING") & (F.col("kind") == F.col("_kind")) & F.col("options").eqNullSafe(F.col("_old")), F.lit(False))
        changed = F.transform("options", lambda o, i: F.when(i == F.col("option_index"), F.col("_v")).otherwise(o))
    else:
        shares = F.coalesce((F.lit(field).isin("context", "instruction")) & (F.col("_old") != "") & (F.col(field) == F.col("_old")), F.lit(False))
        changed = F.col("_v")
    return rows.withColumn(field, F.when(same | shares, changed).otherwise(F.col(field))).select(*questions.columns)


def mean_option_chars(questions: DataFrame, group: list[str], order: str, default: float = 12.0) -> DataFrame:
    """Per group: the mean length of the options of its first question that has any, else the default."""
    own = F.when(F.size(F.coalesce("options", F.array().cast("array<string>"))) > 0, F.col("options"))
    first = questions.withColumn("_o", own).groupBy(*group).agg(F.min_by("_o", F.when(F.col("_o").isNotNull(), F.col(order))).alias("_o"))
    total = F.aggregate("_o", F.lit(0), lambda a, x: a + F.length(F.coalesce(x, F.lit(""))))
    return first.withColumn("mean_chars", F.coalesce(F.try_divide(total.cast("double"), F.size("_o")), F.lit(default))).drop("_o")


def first_questions(questions: DataFrame, exam: str, order: str, wanted: Column) -> DataFrame:
    """The first questions of each exam, as many as wanted (a column), at least one."""
    n = F.row_number().over(Window.partitionBy(exam).orderBy(order))
    return questions.withColumn("_n", n).where(F.col("_n") <= F.greatest(F.lit(1), F.coalesce(wanted, F.lit(1)))).drop("_n")


def new_by_key(items: DataFrame, taken: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first item of each plain key, in order, whose key is not taken (text); items without a key are left out."""
    rows = items.withColumn("_k", plain_key(F.coalesce(text, F.lit("")))).where(F.col("_k") != "")
    old = taken.select(plain_key(F.coalesce(text, F.lit(""))).alias("_t")).distinct()
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_n = 1")
    return first.join(old, F.col("_k") == F.col("_t"), "left_anti").drop("_k", "_n")


def written_new(items: DataFrame, taken: DataFrame, text: str, order: list[str], path: str) -> DataFrame:
    """Writes new_by_key() to path and gives requested, blank, returned and dropped: one row, counted while the rows went by.

    No pass is made for the counts. A task that is run again may be counted in an attempt of its own; the write decides
    which attempt counts, so that the figures are those of the rows written.
    """
    if items.isEmpty():  # Spark leaves out what has no rows, and its counts with it
        new_by_key(items, taken, text, order).write.parquet(path)
        return items.sparkSession.createDataFrame([(0, 0, 0, 0)], "requested long, blank long, returned long, dropped long")
    asked, found = Observation(), Observation()
    blank = F.count_if(plain_key(F.coalesce(text, F.lit(""))) == "")
    seen = items.observe(asked, F.count(F.lit(1)).alias("requested"), blank.alias("blank"))
    new_by_key(seen, taken, text, order).observe(found, F.count(F.lit(1)).alias("returned")).write.parquet(path)
    a, f = asked.get, found.get
    row = (a.get("requested", 0), a.get("blank", 0), f.get("returned", 0), a.get("requested", 0) - f.get("returned", 0))
    return items.sparkSession.createDataFrame([row], "requested long, blank long, returned long, dropped long")


def shortfalls(items: DataFrame, group: str, key: Column, asked: int) -> DataFrame:
    """Per group of items: different ones by key that are returned of those asked for, how many are missing, how many were repeats."""
    n, wanted = F.count_distinct("_k"), F.lit(asked)
    counts = items.withColumn("_k", key).groupBy(group)
    return counts.agg(F.least(n, wanted).alias("returned"), F.greatest(F.lit(0), wanted - n).alias("shortfall"), (F.count("*") - n).alias("dropped"))


def different_texts(values: Column) -> Column:
    """The different texts of an array that are not empty, trimmed, in order; null counts as an empty array."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
