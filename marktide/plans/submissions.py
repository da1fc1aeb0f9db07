"""Queries on handed-in exams, exam structure and keyed stores, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from marktide.functions.values import number, plain_key
from marktide.operators import ordered, filters, merging, scoring, stores, submission
from marktide.plans import state
from marktide.plans.analytics import _BANDS_SQL, _GROUPED, _scored
from marktide.sources import docx, docx_format
from marktide.sources.shared import new_path
from marktide.sources.tables import ITEM_ORDER, attempts, items, reviews, table
from marktide.streaming import stateful, store
from marktide.streaming.presence import heartbeats

NODES = ["click", "view", "signup", "purchase", "error"]
_THRESHOLDS = [("t0", 0, 25.0), ("t0", 1, 40.0), ("t0", 2, -5.0), ("t0", 3, 120.0), ("t0", 4, 60.0), ("t1", 0, 10.0), ("t1", 1, 30.0), ("t1", 2, 50.0), ("t1", 3, 20.0), ("t1", 4, None)]
_RULES = [
    ("t0", "r1", "milestone", 2, "coins", "+ 1,000", 1.0), ("t0", "r2", "total_score", 100, "permanent_gift", " Crown ", 3.0), ("t0", "r3", "streak", 1, "consumable_gift", "Potion", 2.0),
    ("t1", "r4", "milestone", 1, "coins", "50 xu", None), ("t1", "r5", "milestone", 3, "consumable_gift", "Potion", 1.9), ("t1", "r6", "total_score", 90, "consumable_gift", "Nothing", 1.0), ("t1", "r7", "total_score", 120, "consumable_gift", "Shield", None),
]


def _quest_attempts(spark, d):
    node = F.array_position(F.array(*map(F.lit, NODES)), F.col("event_type")).cast("int") - 1
    return reviews(spark, d).select(F.col("event_id").alias("attempt_id"), "student_id", F.concat(F.lit("t"), (F.col("student_id") % 2).cast("string")).alias("topic_id"), node.alias("node"), (F.col("points") % 41).alias("score"), F.when(F.col("event_id") % 17 == 0, 0).otherwise(40).alias("total"), "at").where("node >= 0")


def _submitted(spark, d):
    nodes = spark.createDataFrame(_THRESHOLDS, "topic_id string, node int, threshold double")
    rules = spark.createDataFrame(_RULES, "topic_id string, reward_id string, kind string, target long, reward_kind string, value string, quantity double")
    old = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("student_id"), F.explode(F.array(F.lit("r1"), F.lit("r5"))).alias("reward_id"))
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    return submission.submitted(_quest_attempts(spark, d), nodes, rules, old, len(NODES), names("Crown"), names("Potion", "Shield"))


def submission_results(spark, d):
    return _submitted(spark, d)["results"].select("attempt_id", "percentage", "passed", "attempt_no")


def submission_progress(spark, d):
    return _submitted(spark, d)["progress"]


def submission_unlocked(spark, d):
    return _submitted(spark, d)["unlocked"].select("student_id", "topic_id", "reward_id")


def submission_operations(spark, d):
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("consumables")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return _submitted(spark, d)["operations"].select("student_id", "topic_id", "coins", F.array_join("permanents", ",").alias("permanents"), counts.alias("consumables"), "op_id")


def recalculated_scores(spark, d):
    """One exam's attempts scored by other answers: an item is right from 20 on."""
    exams = attempts(spark, d).select("attempt_id", "exam_id", "student_id")
    old = _scored(spark, d).select("attempt_id", "score", "total", "band").join(exams, "attempt_id")
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.count_if(F.col("l_quantity") >= 20).alias("score"), F.count("*").alias("total"))
    skill = F.when(F.col("student_id") % 2 == 0, "Listening").otherwise("Reading")
    return submission.recalculated(old, new, 7, skill).select("attempt_id", "score", "total", "band")


def integrity_strikes(spark, d):
    e = reviews(spark, d)
    rows = submission.integrity(e, "student_id", ["at", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup", F.col("student_id") % 5 == 0)
    return rows.select("event_id", "strikes", "submits", "locked")


def _graded_groups(spark, d):
    rows = scoring.question_groups(items(spark, d), "attempt_id", ITEM_ORDER, F.col("multiple"), ["label"])
    rows = scoring.numbered(rows.withColumn("kind", F.col("label")), "attempt_id", ITEM_ORDER, F.lit(1))
    groups = rows.groupBy("attempt_id", "group_no").agg(F.min("kind").alias("label"), F.min("first_no").cast("string").alias("number"), F.collect_set("answer").alias("key"), F.collect_set("mark").alias("marked"))
    found = scoring.multiple_outcome(F.col("key"), F.col("marked"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: F.concat(F.lit("<b>"), x.cast("string"), F.lit("</b>"))), " / ")
    return groups.select("attempt_id", "group_no", "label", "number", found["score"].alias("score"), found["total"].alias("total"), joined("marked").alias("given"), joined("key").alias("right"))


def attempt_feedback(spark, d):
    return submission.feedback(_graded_groups(spark, d), "attempt_id", "group_no")


def answer_places(spark, d):
    n = F.col("p_partkey")
    text = F.when(n % 6 == 0, F.concat(F.lit("[2, "), (n % 4).cast("string"), F.lit(", 2, 1.5, null]"))).when(n % 6 == 1, (n % 9).cast("string")).when(n % 6 == 2, "").when(n % 6 == 3, " 3 ").when(n % 6 == 4, "[]")
    return table(spark, d, "part").select(n, F.array_join(F.transform(submission.as_places(text), lambda x: x.cast("string")), ",").alias("places"))


def _questions(spark, d):
    """Parts as the questions of exams: twelve each, some without context, instruction or options of their own."""
    n = F.col("p_partkey")
    own = F.when(n % 5 < 2, F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    return table(spark, d, "part").select(
        F.floor(n / 12).alias("exam_id"), n.alias("place"), F.concat(F.lit("q"), F.floor(n / 12).cast("string"), F.lit("_"), (n % 12).cast("string")).alias("question_id"), F.element_at(F.array(*map(F.lit, ("CHOICE", "BLANK", "MATCHING", "CHOICE_MULTIPLE"))), (F.floor(n / 3) % 4 + 1).cast("int")).alias("kind"),
        F.when(n % 4 == 0, F.concat(F.lit("c"), F.floor(n / 8).cast("string"))).when(n % 4 == 1, "").alias("context"), F.when(n % 3 < 2, F.concat(F.lit("i"), F.floor(n / 6).cast("string"))).otherwise("").alias("instruction"), own.alias("options"), F.col("p_name").alias("text"), (n % 7).cast("string").alias("answer"),
        F.when(n % 5 > 0, (n % 5 - 1).cast("int")).alias("passage_index"),
    )


def exam_groups(spark, d):
    return submission.carried_groups(_questions(spark, d), "exam_id", "place", "context", "instruction")


def options_shared(spark, d):
    return submission.shared_options(_questions(spark, d), "exam_id", "place").select("place", F.coalesce(F.array_join("options", "|"), F.lit("none")).alias("options"))


def sections_placed(spark, d):
    q = _questions(spark, d)
    sections = q.select("exam_id").distinct().withColumn("n_sections", (F.col("exam_id") % 3 + 1).cast("int"))
    members = q.where("place % 2 = 0").select("exam_id", "question_id", (F.col("place") % 4).cast("int").alias("section"))
    return submission.placed(q, sections, members).select("place", "section")


def catalog_match(spark, d):
    """Old questions, some renamed and some reworded, in the exam as it is now."""
    now = _questions(spark, d).select("exam_id", "question_id", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("text"), "answer", "place")
    n = F.col("place")
    old = _questions(spark, d).select("exam_id", n.alias("old_place"), F.when(n % 4 == 0, F.col("question_id")).when(n % 4 == 1, F.concat(F.lit("old"), (n % 12 + 50).cast("string"))).otherwise(F.concat(F.lit("x"), ((n + 1) % 12).cast("string"), F.lit("a"))).alias("question_id"), F.when(n % 4 < 2, F.upper("text")).otherwise("reworded").alias("text"), "answer")
    return submission.found_in_catalog(old, now).select("old_place", F.coalesce("place", F.lit(-1)).alias("place"), "found_by")


def edits_shared(spark, d):
    """The fifth question of each exam gets a new context, then its options' second entry changes."""
    q = _questions(spark, d)
    pick = q.where("place % 12 = 4").select("exam_id", "question_id")
    context = submission.shared_edit(q, pick.withColumns({"value": F.lit("new"), "option_index": F.lit(None).cast("int")}), "context")
    options = submission.shared_edit(context, q.where("place % 12 = 6").select("exam_id", "question_id", F.lit("edited").alias("value"), F.lit(1).alias("option_index")), "options")
    return options.select("place", F.coalesce("context", F.lit("null")).alias("context"), F.coalesce(F.array_join("options", "|"), F.lit("none")).alias("options"))


def option_lengths(spark, d):
    rows = _questions(spark, d).withColumn("options", F.when(F.col("exam_id") % 4 > 0, F.col("options")))
    return submission.mean_option_chars(rows, ["exam_id"], "place").select("exam_id", F.floor(F.col("mean_chars") * 100).alias("hundredths"))


def first_questions(spark, d):
    rows = submission.first_questions(_questions(spark, d), "exam_id", "place", (F.col("exam_id") % 15).cast("int"))
    return rows.groupBy("exam_id").agg(F.count("*").alias("n"), F.max("place").alias("last"))


def trimmed_names(spark, d):
    n = F.col("p_partkey")
    values = F.when(n % 9 > 0, F.array(F.concat(F.lit(" "), F.col("p_name")), F.lit(""), F.col("p_name"), F.when(n % 2 == 0, F.lit("b ")), F.lit("b"), F.lit("  ")))
    return table(spark, d, "part").select(n, F.array_join(submission.different_texts(values), "|").alias("names"))


def attempt_order(spark, d):
    """Attempts in order of time, number and id; learners' progress in order of learner and topic."""
    rows = _quest_attempts(spark, d)
    w = Window.partitionBy("student_id", "node").orderBy("at", "total", "attempt_id")
    return rows.select("attempt_id", F.row_number().over(w).alias("place"), F.dense_rank().over(Window.partitionBy("topic_id").orderBy("student_id")).alias("who_place"))


# stores


def workspace_tables(spark, d):
    """A workspace in three snapshots, each with arrays of learners and lessons: the tables of the newest one."""
    people = table(spark, d, "supplier").agg(F.collect_list(F.when(F.col("s_suppkey") % 4 > 0, F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))).alias("x"))  # a workspace is one small document
    snaps = people.select(F.explode(F.array(*map(F.lit, (1, 3, 2)))).alias("version"), "x").select("version", F.filter("x", lambda r: r["id"] % F.col("version") == 0).alias("students"), F.when(F.col("version") < 3, F.col("x")).alias("lessons"))
    found = stores.snapshot_tables(snaps, ["students", "lessons"])
    return found["students"].withColumn("source", F.lit("students")).unionByName(found["lessons"].withColumn("source", F.lit("lessons")))


def usable_reads(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(n.alias("version"), (n * 100).alias("read_at"), F.when(n % 7 > 0, n % 7 == 1).alias("pending"), (n % 3 == 0).alias("from_cache"), F.when(n % 5 > 0, n % 4).alias("n_rows"), (F.floor(n / 10) * 1000).alias("last_write"))
    return stores.usable_snapshots(rows, F.col("last_write")).select("version")


def _card_changes(rows):
    n = F.col("event_id")
    return rows.select((F.col("user_id") % 20).alias("owner"), (n % 60).alias("card_id"), F.col("event_type").alias("word"), F.col("ts").alias("at"), n.alias("change_id"), (n % 5 == 0).alias("deleted"))


def vocab_store(spark, d):
    """Changes of cards as a stream into the log, and what the log holds then: live cards and tombstones of all owners."""
    path = new_path(spark, "cards")
    store.run_change_log(_card_changes(heartbeats(spark, f"{d}/events.parquet")), path, "owner")
    found = store.cards(spark, path, "owner")
    live = found["live"].select("owner", "card_id", "word", F.lit("live").alias("state"))
    return live.unionByName(found["tombstones"].select("owner", "card_id", F.lit(None).cast("string").alias("word"), F.lit("gone").alias("state")))


def owner_cards(spark, d):
    """The log with deletions appended: one owner's cards, newest first."""
    path = new_path(spark, "cards")
    changes = _card_changes(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    put = store.change_sink(path, "owner")
    put(changes, 0)
    put(changes, 0)  # a batch that is run again adds nothing
    gone = changes.where("owner = 3 and card_id % 2 = 1").groupBy("owner", "card_id").agg(F.max("word").alias("word"), F.max("change_id").alias("change_id"))
    put(stores.deletion(gone.withColumns({"at": F.lit("2030-01-01").cast("timestamp"), "deleted": F.lit(False)}), ["owner", "card_id"], F.lit("2030-01-01").cast("timestamp")).select("owner", "card_id", "word", "at", "change_id", "deleted"), 1)
    return store.cards(spark, path, "owner", 3)["live"].select("card_id", "word", "change_id")


def newest_vocab(spark, d):
    n = F.col("event_id")
    made = F.when(n % 3 > 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("double")).when(n % 2 == 0, float("nan"))
    cards = table(spark, d, "events").select(F.concat(F.lit("vocab_"), F.when(n % 7 > 0, F.unix_millis(F.col("ts").cast("timestamp")) - n * 1000).otherwise(n).cast("string"), F.lit("_"), n.cast("string")).alias("card_id"), made.alias("created_at"))
    return stores.newest_cards(cards, 40).select("card_id", stores.created_ms(F.col("created_at"), F.col("card_id")).alias("made"))


def notebook_merge(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("owner"), (n % 300).alias("card_id")).agg(F.max("event_type").alias("word"), F.max(n).alias("box"))
    server, local = rows.where("card_id % 2 = 0"), rows.where("card_id % 3 = 0").withColumns({"word": F.when(F.col("box") % 2 == 0, F.upper("word")), "box": F.col("box") + 1})
    gone = rows.where("card_id % 5 = 0").select("owner", "card_id", F.col("box").alias("at"))
    return stores.notebook(server, local, gone, "owner", [F.desc("at"), F.desc("card_id")], 8)


def _people(spark, d):
    n = F.col("c_custkey")
    return table(spark, d, "customer").select(n.alias("student_id"), F.concat(F.lit("S"), n.cast("string"), F.lit("@x.org")).alias("email"), F.col("c_name").alias("name"), F.lit("1").alias("phone"), F.lit(10.0).alias("rate"), (n % 900).alias("exp"), (n % 900 / 500 + 1).cast("int").alias("level"), (n % 70).alias("coins"), F.array(F.lit("a"), (n % 3).cast("string")).alias("rewards"), F.when(n % 2 == 0, "old").alias("note"), F.lit("owes").alias("debt_message"))


def _changed_people(spark, d):
    n = F.col("student_id")
    rows = _people(spark, d).withColumns({"email": F.lower("email"), "name": F.lit("Mine"), "rate": F.lit(0.0), "exp": F.col("exp") + n % 5 - 2, "coins": F.col("coins") + n % 3 - 1, "rewards": F.when(n % 4 > 0, F.array(F.lit("b"), F.lit("a"))), "note": F.when(n % 3 == 0, "new"), "debt_message": F.lit(None).cast("string")})
    return rows.where("student_id % 6 <> 5")


def own_write(spark, d):
    """Each learner writes the table as its device has it; every write changes the own row alone."""
    ledger = _people(spark, d).where("student_id % 10 < 4").select("student_id")
    out = stores.own_write(_people(spark, d), _changed_people(spark, d), F.when(F.col("student_id") % 2 == 0, F.col("email")), ledger)
    return out.withColumn("rewards", F.array_join("rewards", ","))


def teacher_write(spark, d):
    ledger = _people(spark, d).where("student_id % 10 < 4").select("student_id")
    rules = {"name": "overlay", "exp": "max", "level": "max", "coins": "ledger", "rewards": "union", "note": "server", "debt_message": "overlay"}
    return merging.write_members(_people(spark, d).where("student_id % 4 > 0"), _changed_people(spark, d), "student_id", rules, ledger).withColumn("rewards", F.array_join("rewards", ","))


def debt_cleared(spark, d):
    """A learner clears the debt message; the write leaves the server's, which only teachers change."""
    cleared = merging.set_where(_people(spark, d), _people(spark, d).where("student_id = 8").select("student_id"), "student_id", "debt_message", F.lit(""))
    out = stores.own_write(_people(spark, d), cleared, F.lit("s8@x.org"), _people(spark, d).where("false").select("student_id"))
    return cleared.select("student_id", F.col("debt_message").alias("here")).join(out.select("student_id", F.col("debt_message").alias("there")), "student_id")


def reward_codes(spark, d):
    n = F.col("event_id")
    codes = table(spark, d, "events").select((n % 400).alias("code"), n.alias("made"), F.when(n % 2 == 0, F.col("user_id")).alias("redeemed_by"))
    server = codes.where("made % 3 = 0").groupBy("code").agg(F.max("made").alias("made"), F.max("redeemed_by").alias("redeemed_by"))
    local = codes.where("made % 5 = 0").groupBy("code").agg(F.lit(None).cast("long").alias("made"), F.max("redeemed_by").alias("redeemed_by"))
    return stores.keyed_upsert(server, local, "code").select("code", F.coalesce("made", F.lit(-1)).alias("made"), F.coalesce("redeemed_by", F.lit(-1)).alias("redeemed_by"))


def role_writes(spark, d):
    """A table that belongs to teachers, as a teacher's write and as a learner's leave it."""
    server, local = attempts(spark, d).where("attempt_id % 2 = 0").select("attempt_id"), attempts(spark, d).where("attempt_id % 3 = 0").select("attempt_id")
    out = [stores.role_write(server, local, t).withColumn("role", F.lit(r)) for t, r in ((True, "teacher"), (False, "student"))]
    return out[0].unionByName(out[1])


def workspace_sync(spark, d):
    """One learner's write of learners, results and exams, and a teacher's, on the same workspace: what each leaves."""
    results = table(spark, d, "events").select((F.col("event_id") % 900).alias("result_id"), F.col("event_id").alias("score"))
    last = lambda rows: rows.groupBy("result_id").agg(F.max("score").alias("score"))
    server = {"students": _people(spark, d), "results": last(results.where("score % 2 = 0")), "exams": table(spark, d, "part").select("p_partkey").where("p_partkey % 2 = 0"), "links": table(spark, d, "supplier").select("s_suppkey")}
    local = {"students": _changed_people(spark, d), "results": last(results.where("score % 3 = 0")), "exams": table(spark, d, "part").select("p_partkey").where("p_partkey % 5 = 0")}
    none = _people(spark, d).where("false").select("student_id")
    rules = {"name": "overlay", "coins": "ledger"}
    out = None
    for role in ("student", "teacher"):
        got = stores.synced(server, local, role == "teacher", F.lit("S6@X.ORG"), none, rules)
        parts = [got["students"].select(F.col("student_id").alias("key"), F.concat_ws(":", "name", F.col("coins").cast("string")).alias("value")).withColumn("name", F.lit("students")), got["results"].select(F.col("result_id").alias("key"), F.col("score").cast("string").alias("value")).withColumn("name", F.lit("results"))]
        parts += [got[n].select(F.col(c).alias("key"), F.lit("").alias("value")).withColumn("name", F.lit(n)) for n, c in (("exams", "p_partkey"), ("links", "s_suppkey"))]
        for part in parts:
            part = part.withColumn("role", F.lit(role))
            out = part if out is None else out.unionByName(part)
    return out


def inventory(spark, d):
    n = F.col("event_id")
    ops = table(spark, d, "events").select(F.col("user_id").alias("student_id"), F.when(n % 3 > 0, F.create_map(F.col("event_type"), (n % 4).cast("double") - 0.5)).alias("consumables"), F.when(n % 7 == 0, F.array(F.concat(F.lit(" p"), (n % 3).cast("string")), F.lit(""))).alias("permanents"), F.when(n % 11 == 0, F.concat(F.lit("z"), (n % 4).cast("string"))).alias("reviewed_quiz"))
    stock = table(spark, d, "customer").where("c_custkey < 200").select(F.col("c_custkey").alias("student_id"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("view"), F.lit(5).cast("long"))).alias("consumables"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("p1"))).alias("permanents"), F.array().cast("array<string>").alias("reviewed"))
    out = stores.inventory_after(ops, stock)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("consumables")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return out.select("student_id", counts.alias("consumables"), F.array_join(F.sort_array("permanents"), ",").alias("permanents"), F.array_join(F.sort_array("reviewed"), ",").alias("reviewed"))


def _raw_attempts(spark, d):
    n = F.col("event_id")
    return reviews(spark, d).select(F.col("student_id").alias("who"), (n % 4).alias("node"), F.when(n % 13 > 0, n % 3000).alias("attempt_id"), (F.col("points") - 20).alias("score"), F.when(n % 9 > 0, 40).alias("total"), F.when(n % 2 == 0, F.col("value") - 100).alias("percentage"), F.when(n % 5 > 0, n % 3 == 0).alias("passed"), "at", n.alias("place"))


def _shown_attempts(rows):
    return rows.select("who", "node", "attempt_id", "score", "total", F.floor(F.col("percentage") * 100 + 0.001).alias("hundredths"), "passed", "place")


def attempts_normalised(spark, d):
    return _shown_attempts(stores.normalised_attempts(_raw_attempts(spark, d)))


def attempts_merged(spark, d):
    rows = _raw_attempts(spark, d)
    return _shown_attempts(stores.merged_attempts(rows.where("place % 3 < 2"), rows.where("place % 3 > 0").withColumn("score", F.col("score") + 1)))


def latest_attempt(spark, d):
    return stores.latest_attempts(stores.normalised_attempts(_raw_attempts(spark, d))).select("who", "node", "attempt_id")


def journal_replay(spark, d):
    """Each learner's waiting results in order of time, up to the first that fails."""
    rows = attempts(spark, d).select("attempt_id", "student_id", "at")
    return stores.replay_until_failure(rows, rows.where("attempt_id % 7 = 3").select("attempt_id"), "student_id", ["at", "attempt_id"], "attempt_id").select("attempt_id")


def exam_store(spark, d):
    """The catalog after a write that sets some exams and deletes others."""
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    changes = rows.where("p_partkey % 3 = 0").withColumn("p_name", F.upper("p_name"))
    kept = filters.without(merging.overlay(rows, changes, "p_partkey"), rows.where("p_partkey % 10 = 0").select("p_partkey"), "p_partkey")
    return kept


def _exam_lines(spark, d):
    """Twelve parts as a tagged document: three blocks of four questions, each with a context."""
    n = F.col("p_partkey")
    k, block = n % 12, F.floor(n / 4) % 3
    lits = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    head = F.when(k == 0, lits(F.concat(F.lit("[TITLE] Exam "), F.floor(n / 12).cast("string")), "[TIME] 35", "[PASSAGE]", "A passage.", "[QUESTIONS]")).otherwise(none)
    tag = F.when(block == 0, "[CHOICE]").when(block == 1, "[MATCHING]").otherwise("[SHORT_ANSWER]")
    opening = F.when(n % 4 == 0, F.concat(lits(tag, "[CONTEXT]", F.concat(F.lit("About "), F.col("p_name")), "[/CONTEXT]", "Answer them all."), F.when(block == 1, lits("A. river", "B. wheel", "C. stone")).otherwise(none))).otherwise(none)
    ask = F.concat((k + 1).cast("string"), F.when(n % 2 == 0, ". ").otherwise(") "), F.col("p_name"), F.lit("?"))
    own = F.when(block == 0, lits(F.concat(F.lit("A. "), F.col("p_name")), F.concat(F.lit("B) "), F.col("p_type")))).otherwise(none)
    answer = F.when(n % 5 == 0, "*b").when(n % 5 == 1, F.concat(F.lit("* "), F.upper("p_name"))).when(n % 5 == 2, "*A").when(n % 5 == 3, "*nowhere")
    lines = table(spark, d, "part").select(F.floor(n / 12).alias("path"), n, F.posexplode(F.array_compact(F.concat(head, opening, lits(ask), own, F.array(answer)))).alias("j", "text"))
    return lines.select("path", (n * 100 + F.col("j")).cast("int").alias("line_no"), F.col("text").alias("html"), "text")


def _questions_of(rows):
    q = docx.exam_questions(rows).join(docx.exam_heads(rows).select(F.col("path").alias("_p"), "title", "minutes"), F.col("path") == F.col("_p"))
    return q.select("path", "title", "minutes", "number", "passage_index", "kind", "subtype", "instruction", "context", "text", F.array_join("options", "|").alias("options"), "answer", F.coalesce("place", F.lit(-1)).alias("place"), "unmatched")


def exam_documents(spark, d):
    """The questions of the tagged documents, from their lines."""
    return _questions_of(_exam_lines(spark, d))


def exam_files(spark, d):
    """The same documents written as Word files and read back by their format."""
    folder = new_path(spark, "exams")
    docx_format.write_documents(_exam_lines(spark, d).withColumn("path", F.col("path").cast("string")), folder)
    rows = docx_format.read_documents(spark, folder).where("error IS NULL")
    rows = ordered.written(rows.withColumn("path", F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long")), "exam-lines")  # read once
    return _questions_of(rows)


def results_sync(spark, d):
    """Results of learners in two writes to the log of changes; the second write comes twice."""
    n = F.col("event_id")
    rows = table(spark, d, "events").groupBy((n % 700).alias("result_id"), (n % 2).cast("int").alias("write")).agg(F.max(n).alias("score"), F.max(F.when(n % 3 == 0, F.col("event_type"))).alias("feedback"))
    path = new_path(spark, "results")
    put = store.change_sink(path, "write")
    for write in (0, 1, 1):
        put(rows.where(F.col("write") == write), write)
    return store.folded(store.changes(spark, path).drop("batch"), "result_id", "write").select("result_id", "score", F.coalesce("feedback", F.lit("")).alias("feedback"))


def srs_stream(spark, d):
    rows = heartbeats(spark, f"{d}/events.parquet").select(F.col("user_id").alias("student_id"), "event_type", "event_id", F.col("ts").alias("at"), (F.col("value") >= 50).alias("remembered"))
    out = stateful.collected(stateful.card_stream(rows, ["student_id", "event_type"]), new_path(spark, "card-stream"))
    return out.where("NOT late").select("event_id", "box", F.col("due").cast("timestamp_ntz").alias("due"))


def balance_stream(spark, d):
    e = heartbeats(spark, f"{d}/events.parquet")
    delta = F.when(F.col("event_type") == "purchase", -F.floor("value")).otherwise(F.floor(F.floor("value") / 10))
    rows = e.select(F.col("user_id").alias("student_id"), "event_id", F.col("ts").alias("at"), delta.alias("delta"))
    out = stateful.collected(stateful.balance_stream(rows, "student_id"), new_path(spark, "balance-stream"))
    return out.where("NOT late").select("event_id", "student_id", "balance")


def exam_average(spark, d):
    """The mean band of each exam over bands that are text: none and an empty one count as 0, what is no number not at all."""
    n = F.col("attempt_id")
    text = F.when(n % 9 == 0, "N/A").when(n % 9 == 1, "").when(n % 9 > 2, F.format_string("%.1f", F.col("band")))
    band = number(F.when(F.col("band").isNull() & (n % 9 > 2), "N/A").otherwise(text))
    return scoring.mean_bands(_scored(spark, d).withColumn("exam_id", n % 50), "exam_id", band)


def single_answers(spark, d):
    n = F.col("p_partkey")
    kind = F.when(n % 3 == 0, "CHOICE").when(n % 3 == 1, "BLANK").otherwise("MATCHING")
    key = F.when(n % 4 == 0, F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" / other"))).otherwise(F.col("p_name"))
    given = F.when(n % 5 == 0, F.upper("p_name")).when(n % 5 == 1, "OTHER ").when(n % 5 < 4, F.col("p_name"))
    return table(spark, d, "part").select(n, F.coalesce(scoring.single_correct(kind, key, given), F.lit(False)).alias("correct"))


def permanents_merge(spark, d):
    """Permanent gifts of a device's backup, of the last state and of a new one: none is lost."""
    n = F.col("c_custkey")
    three = [F.when(n % 2 == 0, F.array(F.lit("crown"), F.lit("hat"))), F.array(F.lit("hat"), F.concat(F.lit("p"), (n % 4).cast("string"))), F.when(n % 3 == 0, F.array(F.lit("p1")))]
    return table(spark, d, "customer").select(n, F.array_join(stores.union_all(*three), ",").alias("permanents"))


def vocab_counts(spark, d):
    """Per brand: items asked for, different ones returned, how many are missing and how many were repeats."""
    return submission.shortfalls(table(spark, d, "part"), "p_brand", plain_key(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 3).cast("string"))), 15)


QUERIES = {
    f.__name__: f
    for f in (
        submission_results, submission_progress, submission_unlocked, submission_operations, recalculated_scores, integrity_strikes, attempt_feedback, answer_places, exam_groups, options_shared, sections_placed, catalog_match, edits_shared, option_lengths, first_questions, trimmed_names, attempt_order,
        workspace_tables, usable_reads, vocab_store, owner_cards, newest_vocab, notebook_merge, own_write, teacher_write, debt_cleared, reward_codes, role_writes, workspace_sync, inventory, attempts_normalised, attempts_merged, latest_attempt, journal_replay, exam_store, exam_documents, exam_files, results_sync, srs_stream, balance_stream, exam_average, single_answers, permanents_merge, vocab_counts,
    )
}

_T = "CASE WHEN user_id % 2 = 0 THEN 't0' ELSE 't1' END"
_NODE = "list_position(['click', 'view', 'signup', 'purchase', 'error'], event_type)::INT - 1"


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


_SUBMITTED = f"""
    WITH th(topic_id, node, threshold) AS (VALUES {_rows(_THRESHOLDS)}), rules(topic_id, reward_id, kind, target, reward_kind, value, quantity) AS (VALUES {_rows(_RULES)}),
    a AS (SELECT event_id AS attempt_id, user_id AS student_id, {_T} AS topic_id, {_NODE} AS node, floor(value)::BIGINT % 41 AS score, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 40 END AS total, ts FROM events),
    r AS (SELECT a.*, CASE WHEN total > 0 THEN floor(score::DOUBLE / total * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100 ELSE 0 END::DOUBLE AS percentage, row_number() OVER (PARTITION BY student_id, topic_id, node ORDER BY ts, attempt_id) AS attempt_no, greatest(0, least(100, coalesce(threshold, 0))) AS need FROM a JOIN th USING (topic_id, node)),
    n AS (SELECT student_id, topic_id, node, max(score) AS best, arg_min(percentage >= need, (ts, attempt_id)) AS first_passed, bool_or(percentage >= need) AS passed FROM r GROUP BY 1, 2, 3),
    g AS (SELECT s.student_id, s.topic_id, k AS node, best, coalesce(first_passed, false) AS f, coalesce(passed, false) AS p FROM (SELECT DISTINCT student_id, topic_id FROM n) s CROSS JOIN range(5) t(k) LEFT JOIN n ON n.student_id = s.student_id AND n.topic_id = s.topic_id AND n.node = k),
    pr AS (SELECT student_id, topic_id, count(*) FILTER (p) AS completed, coalesce(sum(best), 0)::BIGINT AS total_score, coalesce(min(node) FILTER (NOT p), 5)::INT AS current_index, coalesce(min(node) FILTER (NOT f), 5)::INT AS streak FROM g GROUP BY 1, 2),
    due AS (SELECT student_id, topic_id, reward_id, reward_kind, value, quantity FROM pr JOIN rules USING (topic_id) WHERE CASE kind WHEN 'milestone' THEN completed WHEN 'total_score' THEN total_score ELSE streak END >= greatest(0, target)),
    fresh AS (SELECT * FROM due WHERE NOT (reward_id IN ('r1', 'r5') AND student_id % 3 = 0 AND student_id IN (SELECT c_custkey FROM customer)))
"""
_QUESTIONS = """
    SELECT p_partkey // 12 AS exam_id, p_partkey AS place, 'q' || p_partkey // 12 || '_' || p_partkey % 12 AS question_id, (['CHOICE', 'BLANK', 'MATCHING', 'CHOICE_MULTIPLE'])[p_partkey // 3 % 4 + 1] AS kind,
        CASE p_partkey % 4 WHEN 0 THEN 'c' || p_partkey // 8 WHEN 1 THEN '' END AS context, CASE WHEN p_partkey % 3 < 2 THEN 'i' || p_partkey // 6 ELSE '' END AS instruction, CASE WHEN p_partkey % 5 < 2 THEN string_split(concat_ws(' ', p_name, p_type), ' ') END AS options,
        p_name AS text, (p_partkey % 7)::VARCHAR AS answer, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 - 1 END AS passage_index FROM part
"""
_PEOPLE = "SELECT c_custkey AS n, 'S' || c_custkey || '@x.org' AS email, c_name AS name, '1' AS phone, 10.0::DOUBLE AS rate, c_custkey % 900 AS exp, (c_custkey % 900 / 500 + 1)::DOUBLE AS lv, c_custkey % 70 AS coins, ['a', (c_custkey % 3)::VARCHAR] AS rewards, CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS note, 'owes' AS debt FROM customer"
_RAW = """
    SELECT user_id AS who, event_id % 4 AS node, CASE WHEN event_id % 13 > 0 THEN (event_id % 3000)::VARCHAR ELSE concat_ws('_', event_id % 4, strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.'), floor(value)::BIGINT - 20{0}, event_id{1}) END AS attempt_id,
        floor(value) - 20{0} AS score, CASE WHEN event_id % 9 > 0 THEN 40 ELSE 0 END AS total, CASE WHEN event_id % 2 = 0 THEN value - 100 END AS percentage, coalesce(event_id % 5 > 0 AND event_id % 3 = 0, false) AS passed, event_id{1} AS place FROM events
"""
_NORMAL = """
    x AS (SELECT who, node, attempt_id, greatest(0, score)::DOUBLE AS score, total::DOUBLE AS total, greatest(0, least(100, coalesce(percentage, CASE WHEN total > 0 THEN floor(greatest(0, score) / total * 10000 + 0.5) / 100 ELSE 0 END)))::DOUBLE AS percentage, passed, place FROM raw),
    l AS (SELECT who, node, attempt_id, arg_max((score, total, percentage, place), place) AS r, bool_or(passed) AS passed FROM x GROUP BY 1, 2, 3)
    SELECT who, node, attempt_id, r[1] AS score, r[2] AS total, floor(r[3] * 100 + 0.001)::BIGINT AS hundredths, passed, r[4]::BIGINT AS place FROM l
"""
ORACLE_SQL = {
    "submission_results": f"{_SUBMITTED} SELECT attempt_id, percentage, percentage >= need AS passed, attempt_no::INT AS attempt_no FROM r",
    "submission_progress": f"{_SUBMITTED} SELECT * FROM pr",
    "submission_unlocked": f"{_SUBMITTED} SELECT student_id, topic_id, reward_id FROM fresh",
    "submission_operations": f"""{_SUBMITTED},
        v AS (SELECT *, trim(value) AS v, CASE WHEN reward_kind = 'permanent_gift' THEN 1 ELSE greatest(1, floor(coalesce(quantity, 0)))::BIGINT END AS q FROM fresh),
        o AS (SELECT student_id, topic_id, coalesce(sum(CASE value WHEN '+ 1,000' THEN 1000 WHEN '50 xu' THEN 50 END) FILTER (reward_kind = 'coins'), 0)::BIGINT AS coins, coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (reward_kind = 'permanent_gift' AND v = 'Crown'), '') AS permanents,
            array_to_string(list_concat(CASE WHEN bool_or(v = 'Potion' AND reward_kind = 'consumable_gift') THEN ['Potion:' || (sum(q) FILTER (v = 'Potion'))::BIGINT] ELSE [] END, CASE WHEN bool_or(v = 'Shield') THEN ['Shield:' || (sum(q) FILTER (v = 'Shield'))::BIGINT] ELSE [] END), ',') AS consumables,
            'quest_reward_' || student_id || '_' || topic_id || '_' || string_agg(reward_id, '_' ORDER BY reward_id) AS op_id FROM v GROUP BY student_id, topic_id)
        SELECT * FROM o WHERE coins > 0 OR permanents <> '' OR consumables <> ''
    """,
    "recalculated_scores": f"""
        WITH o AS ({_BANDS_SQL}), x AS (SELECT l_orderkey AS k, count(*) FILTER (l_quantity >= 20) AS score, count(*) AS total FROM lineitem GROUP BY 1),
        y AS ({_BANDS_SQL.replace('l_quantity >= 25', 'l_quantity >= 20')})
        SELECT attempt_id, CASE WHEN attempt_id % 50 = 7 THEN y.score ELSE o.score END AS score, o.total AS total, CASE WHEN attempt_id % 50 = 7 THEN y.band ELSE o.band END AS band FROM o JOIN y USING (attempt_id)
    """,
    "integrity_strikes": """
        WITH s AS (SELECT event_id, user_id, ts, CASE WHEN user_id % 5 > 0 AND event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS one FROM events),
        t AS (SELECT *, (sum(one) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS strikes FROM s)
        SELECT event_id, strikes, strikes = 3 AND one = 1 AS submits, one = 1 AND strikes < 3 AS locked FROM t WHERE strikes < 3 OR (strikes = 3 AND one = 1)
    """,
    "attempt_feedback": f"""
        WITH q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS no FROM ({_GROUPED})),
        g AS (SELECT l_orderkey AS a, group_no, min(l_returnflag) AS label, min(no) AS no, list_sort(list_distinct(list(l_quantity::INT % 4))) AS k, list_sort(list_distinct(list(l_partkey % 5))) AS m FROM q GROUP BY 1, 2),
        s AS (SELECT *, len(k) AS total, CASE WHEN len(m) > len(k) THEN 0 ELSE len(list_intersect(k, m)) END AS score FROM g),
        w AS (SELECT a, string_agg(label || ': ' || c || '/' || t, ', ' ORDER BY o) AS weak FROM (SELECT a, label, sum(score)::BIGINT AS c, sum(total)::BIGINT AS t, min(group_no) AS o FROM s GROUP BY 1, 2) GROUP BY 1),
        l AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY group_no) AS i, '#' || no || ' [' || label || '] given: "' || substr(array_to_string(m, ' / '), 1, 70) || '" | right: "' || substr(array_to_string(k, ' / '), 1, 70) || '"' AS line FROM s WHERE score < total),
        d AS (SELECT a, sum(total - score)::BIGINT AS n_wrong, string_agg(line, chr(10) ORDER BY i) FILTER (i <= 30) AS details FROM l GROUP BY 1)
        SELECT a AS attempt_id, weak, coalesce(n_wrong, 0)::BIGINT AS n_wrong, coalesce(details, '') AS details FROM w LEFT JOIN d USING (a)
    """,
    "answer_places": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN array_to_string(CASE WHEN p_partkey % 4 = 2 THEN [2] ELSE [2, p_partkey % 4] END, ',') WHEN 1 THEN (p_partkey % 9)::VARCHAR WHEN 3 THEN '3' ELSE '' END AS places FROM part",
    "exam_groups": f"""
        WITH RECURSIVE q AS (SELECT exam_id, row_number() OVER (PARTITION BY exam_id ORDER BY place) - 1 AS k, coalesce(context, '') AS c, instruction AS i FROM ({_QUESTIONS})),
        f AS (SELECT exam_id, k, 0 AS g, c, i FROM q WHERE k = 0
            UNION ALL SELECT q.exam_id, q.k, CASE WHEN (q.c = '' OR q.c = f.c) AND (q.i = f.i OR q.i = '' AND f.i <> '') THEN f.g ELSE f.g + 1 END, CASE WHEN (q.c = '' OR q.c = f.c) AND (q.i = f.i OR q.i = '' AND f.i <> '') THEN f.c WHEN q.c <> '' THEN q.c ELSE f.c END,
                CASE WHEN (q.c = '' OR q.c = f.c) AND (q.i = f.i OR q.i = '' AND f.i <> '') THEN f.i ELSE q.i END FROM f JOIN q ON q.exam_id = f.exam_id AND q.k = f.k + 1)
        SELECT exam_id, g::INT AS group_no, min(c) AS context, min(i) AS instruction, min(k)::INT AS start_index, count(*)::INT AS n_questions FROM f GROUP BY exam_id, g
    """,
    "options_shared": f"SELECT place, coalesce(array_to_string(CASE WHEN options IS NULL AND kind <> 'BLANK' THEN last_value(options IGNORE NULLS) OVER (PARTITION BY exam_id ORDER BY place) ELSE options END, '|'), 'none') AS options FROM ({_QUESTIONS})",
    "sections_placed": f"WITH q AS (SELECT *, exam_id % 3 + 1 AS n, coalesce(passage_index, CASE WHEN place % 2 = 0 THEN place % 4 END) AS want FROM ({_QUESTIONS})) SELECT place, CASE WHEN want < n THEN want ELSE n - 1 END::INT AS section FROM q",
    "catalog_match": f"""
        WITH k AS (SELECT *, (place % 12) AS num FROM ({_QUESTIONS})),
        o AS (SELECT exam_id, place AS p, CASE place % 4 WHEN 0 THEN question_id WHEN 1 THEN 'old' || place % 12 + 50 ELSE 'x' || (place + 1) % 12 || 'a' END AS id, CASE WHEN place % 4 < 2 THEN lower(text) ELSE 'reworded' END || '|' || answer AS fp, CASE place % 4 WHEN 0 THEN place % 12 WHEN 1 THEN place % 12 + 50 ELSE (place + 1) % 12 END AS num FROM k),
        m AS (SELECT p, (SELECT min(place) FROM k WHERE k.exam_id = o.exam_id AND question_id = id) AS a, (SELECT min(place) FROM k WHERE k.exam_id = o.exam_id AND lower(text) || '|' || answer = fp) AS b, (SELECT min(place) FROM k WHERE k.exam_id = o.exam_id AND k.num = o.num) AS c FROM o)
        SELECT p AS old_place, coalesce(a, b, c, -1) AS place, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'text' WHEN c IS NOT NULL THEN 'number' ELSE 'none' END AS found_by FROM m
    """,
    "edits_shared": f"""
        WITH q AS ({_QUESTIONS}), e AS (SELECT exam_id AS x, place AS y, context AS oc FROM q WHERE place % 12 = 4), o AS (SELECT exam_id AS x2, place AS y2, kind AS ok, options AS oo FROM q WHERE place % 12 = 6)
        SELECT place, coalesce(CASE WHEN place = y OR (oc <> '' AND context = oc) THEN 'new' ELSE context END, 'null') AS context,
            coalesce(array_to_string(CASE WHEN place = y2 OR (ok IN ('MATCHING', 'CHOICE_MULTIPLE') AND kind = ok AND options IS NOT DISTINCT FROM oo) THEN list_transform(options, lambda v, i: CASE WHEN i = 2 THEN 'edited' ELSE v END) ELSE options END, '|'), 'none') AS options
        FROM q LEFT JOIN e ON x = exam_id LEFT JOIN o ON x2 = exam_id
    """,
    "option_lengths": f"WITH q AS (SELECT exam_id, arg_min(options, place) FILTER (options IS NOT NULL AND exam_id % 4 > 0) AS o FROM ({_QUESTIONS}) GROUP BY 1) SELECT exam_id, floor(coalesce(list_sum(list_transform(o, lambda x: length(x)))::DOUBLE / len(o), 12) * 100)::BIGINT AS hundredths FROM q",
    "first_questions": f"SELECT exam_id, count(*) AS n, max(place) AS last FROM (SELECT *, row_number() OVER (PARTITION BY exam_id ORDER BY place) AS k FROM ({_QUESTIONS})) WHERE k <= greatest(1, exam_id % 15) GROUP BY 1",
    "trimmed_names": "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name || '|b' END AS names FROM part",
    "attempt_order": f"SELECT event_id AS attempt_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 40 END, event_id))::INT AS place, (dense_rank() OVER (PARTITION BY user_id % 2 ORDER BY user_id))::INT AS who_place FROM events",
    "workspace_tables": "SELECT s_suppkey AS id, s_name AS name, 'students' AS source FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 3 = 0",
    "usable_reads": "SELECT event_id AS version FROM events WHERE NOT (event_id % 7 = 1 OR event_id % 10 < 8) AND NOT (event_id % 3 = 0 AND (event_id % 5 = 0 OR event_id % 4 = 0))",
    "vocab_store": "WITH l AS (SELECT user_id % 20 AS owner, event_id % 60 AS card_id, event_type AS word, event_id % 5 = 0 AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20, event_id % 60 ORDER BY ts DESC, event_id DESC) = 1) SELECT owner, card_id, CASE WHEN NOT gone THEN word END AS word, CASE WHEN gone THEN 'gone' ELSE 'live' END AS state FROM l",
    "owner_cards": "WITH l AS (SELECT event_id % 60 AS card_id, event_type AS word, event_id AS change_id FROM events WHERE user_id % 20 = 3 QUALIFY row_number() OVER (PARTITION BY event_id % 60 ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM l WHERE change_id % 5 > 0 AND card_id % 2 = 0",
    "newest_vocab": """
        WITH m AS (SELECT event_id AS n, epoch_us(ts) // 1000 AS ms FROM events), c AS (SELECT 'vocab_' || CASE WHEN n % 7 > 0 THEN ms - n * 1000 ELSE n END || '_' || n AS card_id, CASE WHEN n % 3 > 0 THEN ms WHEN n % 7 > 0 THEN ms - n * 1000 ELSE 0 END AS made FROM m)
        SELECT * FROM c ORDER BY made DESC, card_id DESC LIMIT 40
    """,
    "notebook_merge": """
        WITH r AS (SELECT user_id % 10 AS owner, event_id % 300 AS card_id, max(event_type) AS word, max(event_id) AS box FROM events GROUP BY 1, 2),
        g AS (SELECT owner, card_id FROM r WHERE card_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY box DESC, card_id DESC) <= 8),
        b AS (SELECT owner, card_id, CASE WHEN card_id % 3 = 0 THEN CASE WHEN box % 2 = 0 THEN upper(word) WHEN card_id % 2 = 0 THEN word END ELSE word END AS word, CASE WHEN card_id % 3 = 0 THEN box + 1 ELSE box END AS box FROM r WHERE card_id % 2 = 0 OR card_id % 3 = 0)
        SELECT b.* FROM b ANTI JOIN g USING (owner, card_id)
    """,
    "own_write": f"""
        WITH p AS ({_PEOPLE}), x AS (SELECT *, n % 2 = 0 AND n % 6 <> 5 AS mine, exp + n % 5 - 2 AS e2, coins + n % 3 - 1 AS c2 FROM p)
        SELECT n AS student_id, email, name, phone, rate, CASE WHEN mine THEN greatest(exp, e2) ELSE exp END AS exp, floor(lv)::INT AS level, CASE WHEN mine AND n % 10 >= 4 THEN greatest(coins, c2) ELSE coins END AS coins,
            CASE WHEN mine AND n % 4 > 0 THEN array_to_string(list_concat(rewards, ['b']), ',') ELSE array_to_string(rewards, ',') END AS rewards, CASE WHEN mine AND n % 3 = 0 THEN 'new' ELSE note END AS note, debt AS debt_message FROM x
    """,
    "teacher_write": f"""
        WITH p AS ({_PEOPLE}), x AS (SELECT *, n % 4 > 0 AS known, exp + n % 5 - 2 AS e2, coins + n % 3 - 1 AS c2 FROM p WHERE n % 6 <> 5)
        SELECT n AS student_id, 'Mine' AS name, CASE WHEN known THEN greatest(exp, e2) ELSE e2 END AS exp, floor(lv)::INT AS level, CASE WHEN NOT known THEN c2 WHEN n % 10 < 4 THEN coins ELSE greatest(coins, c2) END AS coins,
            array_to_string(CASE WHEN known THEN CASE WHEN n % 4 > 0 THEN list_concat(rewards, ['b']) ELSE rewards END ELSE CASE WHEN n % 4 > 0 THEN ['b', 'a'] ELSE [] END END, ',') AS rewards, CASE WHEN known THEN coalesce(note, CASE WHEN n % 3 = 0 THEN 'new' END) WHEN n % 3 = 0 THEN 'new' END AS note, CASE WHEN known THEN debt END AS debt_message FROM x
    """,
    "debt_cleared": "SELECT c_custkey AS student_id, CASE WHEN c_custkey = 8 THEN '' ELSE 'owes' END AS here, 'owes' AS there FROM customer",
    "reward_codes": """
        WITH c AS (SELECT event_id % 400 AS code, event_id AS made, CASE WHEN event_id % 2 = 0 THEN user_id END AS who FROM events), s AS (SELECT code, max(made) AS made, max(who) AS who FROM c WHERE made % 3 = 0 GROUP BY 1), l AS (SELECT code, max(who) AS who FROM c WHERE made % 5 = 0 GROUP BY 1)
        SELECT code, coalesce(made, -1) AS made, coalesce(l.who, s.who, -1) AS redeemed_by FROM s FULL JOIN l USING (code)
    """,
    "role_writes": "SELECT o_orderkey AS attempt_id, 'teacher' AS role FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'student' FROM orders WHERE o_orderkey % 2 = 0",
    "workspace_sync": f"""
        WITH p AS ({_PEOPLE}), r AS (SELECT event_id % 900 AS k, max(event_id) FILTER (event_id % 2 = 0) AS s, max(event_id) FILTER (event_id % 3 = 0) AS l FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY 1), b(role) AS (VALUES ('student'), ('teacher'))
        SELECT role, 'results' AS name, k AS key, coalesce(l, s)::VARCHAR AS value FROM r CROSS JOIN b
        UNION ALL SELECT role, 'links', s_suppkey, '' FROM supplier CROSS JOIN b
        UNION ALL SELECT role, 'exams', p_partkey, '' FROM part CROSS JOIN b WHERE CASE role WHEN 'teacher' THEN p_partkey % 5 = 0 ELSE p_partkey % 2 = 0 END
        UNION ALL SELECT 'student', 'students', n, name || ':' || CASE WHEN n = 6 THEN greatest(coins, coins + n % 3 - 1) ELSE coins END FROM p
        UNION ALL SELECT 'teacher', 'students', n, 'Mine:' || greatest(coins, coins + n % 3 - 1) FROM p WHERE n % 6 <> 5
    """,
    "inventory": """
        WITH g AS (SELECT user_id, event_type AS k, sum(floor(event_id % 4 - 0.5))::BIGINT AS n FROM events WHERE event_id % 3 > 0 AND floor(event_id % 4 - 0.5) > 0 GROUP BY 1, 2),
        h AS (SELECT c_custkey AS s, 'view' AS k, 5::BIGINT AS n FROM customer WHERE c_custkey < 200 AND c_custkey % 2 = 0), u AS (SELECT s, k, sum(n)::BIGINT AS n FROM (SELECT * FROM h UNION ALL SELECT user_id, k, n FROM g) GROUP BY 1, 2),
        c AS (SELECT s, string_agg(k || ':' || n, ',' ORDER BY k) AS consumables FROM u GROUP BY 1),
        p AS (SELECT s, string_agg(p, ',' ORDER BY p) AS permanents FROM (SELECT user_id AS s, 'p' || event_id % 3 AS p FROM events WHERE event_id % 7 = 0 UNION SELECT c_custkey, 'p1' FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1),
        r AS (SELECT user_id AS s, string_agg(DISTINCT 'z' || event_id % 4, ',' ORDER BY 'z' || event_id % 4) AS reviewed FROM events WHERE event_id % 11 = 0 GROUP BY 1)
        SELECT c_custkey AS student_id, coalesce(consumables, '') AS consumables, coalesce(permanents, '') AS permanents, coalesce(reviewed, '') AS reviewed FROM customer LEFT JOIN c ON c.s = c_custkey LEFT JOIN p ON p.s = c_custkey LEFT JOIN r ON r.s = c_custkey WHERE c_custkey < 200
    """,
    "attempts_normalised": f"WITH raw AS ({_RAW.format('', '')}), {_NORMAL}",
    "attempts_merged": f"WITH h AS (SELECT coalesce(max(event_id), -1) + 1 AS h FROM events WHERE event_id % 3 < 2), raw AS ({_RAW.format('', '')} WHERE event_id % 3 < 2 UNION ALL {_RAW.format(' + 1', ' + (SELECT h FROM h)')} WHERE event_id % 3 > 0), {_NORMAL}",
    "latest_attempt": f"WITH raw AS ({_RAW.format('', '')}), z AS (WITH {_NORMAL}) SELECT who, node, attempt_id FROM z QUALIFY row_number() OVER (PARTITION BY who, node ORDER BY place DESC) = 1",
    "journal_replay": "SELECT attempt_id FROM (SELECT o_orderkey AS attempt_id, count(*) FILTER (o_orderkey % 7 = 3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders) WHERE n = 0",
    "exam_store": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 10 <> 0",
    "exam_documents": """
        WITH q AS (SELECT p_partkey AS n, p_partkey // 12 AS path, p_partkey % 12 + 1 AS k, p_partkey // 4 % 3 AS b, p_name, p_type, first_value(p_name) OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS about,
            CASE p_partkey % 5 WHEN 0 THEN 'b' WHEN 1 THEN upper(p_name) WHEN 2 THEN 'A' WHEN 3 THEN 'nowhere' END AS answer FROM part),
        o AS (SELECT *, CASE b WHEN 0 THEN ['A. ' || p_name, 'B) ' || p_type] WHEN 1 THEN ['A. river', 'B. wheel', 'C. stone'] ELSE [] END AS options, CASE WHEN b < 2 AND n % 5 = 0 THEN 1 WHEN b < 2 AND n % 5 = 2 THEN 0 ELSE -1 END AS place FROM q)
        SELECT path, 'Exam ' || path AS title, 35 AS minutes, k::INT AS number, 0 AS passage_index, (['CHOICE', 'MATCHING', 'BLANK'])[b + 1] AS kind, 'SENTENCE' AS subtype, 'Answer them all.' AS instruction, '<div>About ' || about || '</div>' AS context, p_name || '?' AS text,
            array_to_string(options, '|') AS options, coalesce(answer, '') AS answer, place, answer IS NULL OR (b < 2 AND place < 0) AS unmatched FROM o
    """,
    "results_sync": """
        WITH r AS (SELECT event_id % 700 AS id, event_id % 2 AS w, max(event_id) AS score, max(event_type) FILTER (event_id % 3 = 0) AS f FROM events GROUP BY 1, 2)
        SELECT id AS result_id, arg_max(score, w) AS score, coalesce(max(f) FILTER (w = 1), max(f) FILTER (w = 0), '') AS feedback FROM r GROUP BY 1
    """,
    "srs_stream": state.ORACLE_SQL["srs_schedule"],
    "balance_stream": state.ORACLE_SQL["coin_balance"],
    "exam_average": f"""
        WITH t AS (SELECT attempt_id AS n, CASE WHEN attempt_id % 9 = 0 THEN NULL WHEN attempt_id % 9 < 3 THEN 0 ELSE band END AS b FROM ({_BANDS_SQL}))
        SELECT n % 50 AS exam_id, coalesce(floor(avg(b) * 10 + 0.5)::BIGINT, -1) AS tenths, count(b) AS n FROM t GROUP BY 1
    """,
    "single_answers": """
        WITH t AS (SELECT p_partkey AS n, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN 'OTHER ' WHEN p_partkey % 5 < 4 THEN p_name END AS given FROM part)
        SELECT n AS p_partkey, coalesce(CASE WHEN n % 3 = 1 THEN lower(trim(coalesce(given, ''))) = name OR n % 4 = 0 AND lower(trim(coalesce(given, ''))) = 'other' ELSE n % 4 > 0 AND given = name END, false) AS correct FROM t
    """,
    "permanents_merge": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'crown,' ELSE '' END || 'hat,p' || c_custkey % 4 || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 1 THEN ',p1' ELSE '' END AS permanents FROM customer",
    "vocab_counts": "WITH k AS (SELECT p_brand, count(*) AS n, count(DISTINCT p_name || ' ' || p_partkey % 3) AS u FROM part GROUP BY 1) SELECT p_brand, least(u, 15) AS returned, greatest(0, 15 - u) AS shortfall, n - u AS dropped FROM k",
}
ORACLE_SQL["exam_files"] = ORACLE_SQL["exam_documents"]
