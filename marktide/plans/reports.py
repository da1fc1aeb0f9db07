"""Reports, record changes, exam texts and vocabulary as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktide.functions import exams
from marktide.functions.values import cents, half_up, let
from marktide.operators import merging, records, scoring, vocabulary
from marktide.plans.analytics import _BANDS_SQL, _GROUPED, _scored
from marktide.sources.shared import new_path
from marktide.sources.tables import ITEM_ORDER, attempts, dealt, items, reviews, table
from marktide.sources.xlsx import write_xlsx


def _students(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cefr"), cents(F.col("c_acctbal")).alias("coins"), (F.col("c_custkey") % 900).alias("exp"))


def _lessons(spark, d):
    return attempts(spark, d).select(F.col("attempt_id").alias("lesson_id"), "student_id", "seconds", "status", "at", "amount_cents")


def report_lessons(spark, d):
    """The lesson report: one row per lesson with its skills in one cell."""
    skills = items(spark, d).groupBy("attempt_id").agg(F.concat_ws(" - ", F.sort_array(F.collect_set("label"))).alias("skills"))
    rows = _lessons(spark, d).join(skills, F.col("lesson_id") == F.col("attempt_id"), "left").join(_students(spark, d).select("student_id", "name"), "student_id", "left")
    paid = F.when(F.col("status") == "F", "paid").otherwise("unpaid")
    return rows.select("lesson_id", "at", "name", F.coalesce("skills", F.lit("")).alias("skills"), half_up(F.col("seconds") / 60).alias("minutes"), "amount_cents", paid.alias("paid"))


def report_students(spark, d):
    owed = _lessons(spark, d).where("status <> 'F'").groupBy("student_id").agg(F.sum("amount_cents").alias("debt_cents"))
    return _students(spark, d).join(owed, "student_id", "left").select("student_id", "name", "cefr", F.coalesce("debt_cents", F.lit(0)).alias("debt_cents"))


def report_results(spark, d):
    shown = F.concat_ws("/", F.col("score").cast("string"), F.col("total").cast("string"))
    return _scored(spark, d).select("attempt_id", "student_id", "at", shown.alias("score"), F.when(F.col("band").isNull(), "N/A").otherwise(F.format_string("%.1f", "band")).alias("band"))


def report_answers(spark, d):
    """One row per scoring group of an attempt: right, partly right with its score, or wrong."""
    rows = scoring.question_groups(items(spark, d), "attempt_id", ITEM_ORDER, F.col("multiple"), ["label"])
    groups = rows.groupBy("attempt_id", "group_no").agg(F.collect_set("answer").alias("key"), F.collect_set("mark").alias("marked"), F.count("*").alias("n"))
    found = scoring.multiple_outcome(F.col("key"), F.col("marked"))
    partly = F.concat(F.lit("partly right ("), found["score"].cast("string"), F.lit("/"), found["total"].cast("string"), F.lit(")"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), " / ")
    return groups.select("attempt_id", "group_no", "n", joined("key").alias("answers"), joined("marked").alias("given"), F.when(found["full"], "right").when(found["score"] > 0, partly).otherwise("wrong").alias("result"))


def student_kpis(spark, d):
    """Per learner: hours and mean band to one decimal, lessons and results; a band of -1 is none."""
    lessons = _lessons(spark, d).groupBy("student_id").agg(F.count("*").alias("n_lessons"), half_up(F.sum("seconds") / 360).alias("tenth_hours"))
    results = _scored(spark, d).groupBy("student_id").agg(F.count("*").alias("n_results"), half_up(F.avg(F.col("band") * 10)).alias("tenth_band"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = _students(spark, d).join(lessons, "student_id", "left").join(results, "student_id", "left")
    return rows.select("student_id", zero("n_lessons"), zero("tenth_hours"), zero("n_results"), F.coalesce("tenth_band", F.lit(-1)).alias("tenth_band"))


def answer_keys(spark, d):
    """The answer key of each exam as text, questions numbered from 1; an exam's questions are few, so they fit one group."""
    options = F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma")])
    shown = F.coalesce(F.try_element_at(options, F.col("answer") + 1), F.col("answer").cast("string"))
    rows = items(spark, d).groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct(*ITEM_ORDER, shown.alias("shown")))).alias("q"))
    lines = F.transform("q", lambda x, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": "), x["shown"], F.lit("\n")))
    return rows.select("attempt_id", F.array_join(lines, "").alias("content"))


def xlsx_export(spark, d):
    """The student report as workbooks: their names and numbers of rows."""
    return write_xlsx(report_students(spark, d), new_path(spark, "students-xlsx"), "Students", header=["id", "name", "level", "debt"])


def lesson_insert(spark, d):
    rows = records.after_lessons(_students(spark, d), _lessons(spark, d))
    return rows.select("student_id", "exp", "level", "coins")


def lesson_operations(spark, d):
    return records.lesson_operations(_lessons(spark, d))


def _edits(spark, d):
    rows = _students(spark, d).where("student_id % 4 = 0")
    return rows.select((F.when(F.col("student_id") % 8 == 0, F.col("student_id")).otherwise(F.col("student_id") + 10_000_000)).alias("student_id"), F.lower("name").alias("name"), F.lit(None).cast("string").alias("cefr"), F.when(F.col("student_id") % 16 == 0, F.col("coins") + 7).alias("coins"), F.lit(None).cast("long").alias("exp"))


def student_upsert(spark, d):
    return records.edit_students(_students(spark, d), _edits(spark, d), {"cefr": "B2", "exp": 0, "coins": 0})


def balance_operations(spark, d):
    return records.balance_operations(_students(spark, d), _edits(spark, d))


def schedule_prepend(spark, d):
    rows = attempts(spark, d).select("attempt_id", "at")
    return records.prepended(rows.where("attempt_id % 5 > 0"), rows.where("attempt_id % 5 = 0"), [F.desc("at"), F.asc("attempt_id")])


def log_newest(spark, d):
    rows = reviews(spark, d).select("event_id", "at", "event_type")
    return records.newest_entries(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), [F.desc("at"), F.desc("event_id")])


def notifications(spark, d):
    people = _students(spark, d).select("student_id", F.when(F.col("student_id") % 2 == 0, F.array(F.lit("hello"))).alias("notifications"))
    notes = reviews(spark, d).where("event_type = 'error'").select("student_id", F.struct("at", "event_id").alias("at"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("note"))
    return records.notified(people, notes).select("student_id", F.array_join("notifications", ",").alias("notifications"))


def quest_launch(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    s = records.quest_settings(size, (key % 60).cast("int"), (key % 40 - 3).cast("int"), (key % 5).cast("int"), F.when(key % 2 == 0, F.lit("practice")))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in s.items()])


def signal_incidents(spark, d):
    """With hours for the quiet time: events of a learner are far apart."""
    rows = reviews(spark, d).withColumn("positive", F.col("value") >= 40)
    return records.incidents(rows, ["student_id"], "at", "event_id", "positive", quiet=6 * 3600).select("student_id", F.col("at").cast("timestamp_ntz").alias("at"))


def exam_time_left(spark, d):
    rows = reviews(spark, d)
    left = records.seconds_left((F.col("event_id") % 90).cast("int"), F.date_trunc("hour", F.col("at").cast("timestamp")), F.col("at"))
    return rows.select("event_id", left.alias("seconds_left"), (left <= 0).alias("expired"))


def _questions(spark, d):
    """Orders and documents give no questions; parts stand in for them."""
    n = F.col("p_partkey")
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")), " ")
    options = F.when(n % 4 < 3, F.transform(words, lambda w, i: F.when(n % 2 == 0, F.concat(F.char(i + 65), F.lit(". "), w)).otherwise(w)))
    ask = F.array(*[F.lit(x) for x in ("Label the map below. ", "Complete the flow-chart. ", "Complete the summary. ", "Complete the notes. ", "Do these agree? TRUE, FALSE or NOT GIVEN. ", "Write yes/no/not given. ", "Answer. ")])
    return table(spark, d, "part").select("p_partkey", F.concat(F.get(ask, (n % 7).cast("int")), F.col("p_name")).alias("text"), options.alias("options"), F.when(n % 3 == 0, F.char(65 + n % 6)).when(n % 3 == 1, F.upper(F.get(words, F.lit(1)))).otherwise("none").alias("answer"), F.when(n % 5 == 0, F.lit("DRAG")).otherwise("BLANK").alias("kind"), F.concat(F.when(n % 2 == 0, F.lit("so ")).otherwise(""), F.lit("[1] and\n[2] or")).alias("context"))


def option_lines(spark, d):
    words = F.split("text", " ")
    line = F.concat(F.element_at(F.array(*map(F.lit, ("A. ", "b) ", "A ", "I ", "iv. ", ""))), (F.col("doc_id") % 6 + 1).cast("int")), F.array_join(F.slice(words, 1, (F.col("doc_id") % 17).cast("int")), " "))
    return table(spark, d, "documents").where("text is not null").select("doc_id", exams.is_option(line).alias("is_option"))


def option_lines_all(spark, d):
    """Every line of every text; a null text has none."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", exams.is_option(F.col("line")).alias("is_option"))


def question_kinds(spark, d):
    rows = _questions(spark, d)
    return rows.select("p_partkey", exams.question_subtype(F.col("text"), F.col("kind"), F.col("context")).alias("subtype"), F.array_join(exams.stated_options(F.col("text"), F.col("options")), "|").alias("options"))


def answer_map(spark, d):
    place = exams.answer_place(F.col("options"), F.col("answer"))
    return _questions(spark, d).where("options is not null").select("p_partkey", F.coalesce(place, F.lit(-1)).alias("place"), place.isNull().alias("unmatched"), exams.bank_word(F.col("options"), F.col("answer")).alias("bank"))


def audio_links(spark, d):
    key = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://drive.google.com/file/d/f"), key, F.lit("/view"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://drive.google.com/open?id=q"), key, F.lit("&x=1"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", exams.audio_link(url).alias("link"))


def audio_keys(spark, d):
    n = F.col("p_partkey")
    raw = F.concat(F.when(n % 3 == 0, F.lit("other/")).otherwise("exam-audio/"), F.col("p_name"), F.when(n % 5 == 0, F.lit("")).otherwise("|"), F.when(n % 7 > 0, n.cast("string")).otherwise(""))
    key = F.translate(F.rtrim(F.base64(raw.cast("binary")), F.lit("=")), "+/", "-_")
    got = exams.audio_key(key)
    return table(spark, d, "part").select("p_partkey", got["path"].alias("path"), got["token"].alias("token"))


def json_items(spark, d):
    """Five ways of writing a list around the properties of events; two hold none."""
    p, n = F.col("props"), F.col("event_id") % 7
    text = (
        F.when(n == 0, F.concat(F.lit("["), p, F.lit(", 1]"))).when(n == 1, F.concat(F.lit('```json\n{"items": ['), p, F.lit("]}\n```")))
        .when(n == 2, F.concat(F.lit('{"a": 1, "rows": ['), p, F.lit("], \"z\": [2]}"))).when(n == 3, F.concat(F.lit("Here: ["), p, F.lit("] as asked")))
        .when(n == 4, F.concat(F.lit('{"items": [], "b": 2}'))).when(n == 5, p).otherwise("no list [ here")
    )
    shown = lambda got: F.struct(F.coalesce(F.size(got), F.lit(-1)).alias("n_items"), F.coalesce(F.get_json_object(F.get(got, F.lit(0)), "$.k").cast("long"), F.lit(-1)).alias("k"))
    rows = dealt(table(spark, d, "events").select("event_id", "props"), "event_id").select("event_id", let(exams.json_items(text), shown).alias("x"))
    return rows.select("event_id", "x.n_items", "x.k")


def masked_text(spark, d):
    """Learners see how long a page is, not what it says: what is left of tags and numbers."""
    text = exams.masked(F.col("html"))
    bare = F.regexp_replace(text, "█+", "")
    return table(spark, d, "pages").select("page_id", F.length(bare).alias("n_left"), F.md5(bare.cast("binary")).alias("digest"))


def example_gap(spark, d):
    words = F.split("text", " ")
    word = F.regexp_replace(F.get(words, (F.col("item_id") % 9).cast("int")), "[^a-zA-Z]", "")
    return table(spark, d, "benchmark").select("item_id", vocabulary.gapped(word, F.col("text")).alias("gapped"))


def vocab_wave(spark, d):
    cards = table(spark, d, "part").select(F.col("p_brand").alias("pool"), F.col("p_partkey").alias("card_id"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 30).cast("string")).alias("word"))
    return vocabulary.game_round(cards, "pool", ante=5, flood=True, seed=7).groupBy("pool", "role").agg(F.count("*").alias("n"), F.countDistinct(F.lower("word")).alias("n_words"))


def act_reward(spark, d):
    n = F.col("event_id")
    factor = F.element_at(F.array(*map(F.lit, (1.0, 1.4, 1.6, 1.5, 1.3))), (n % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", vocabulary.act_reward(n % 12, factor, n % 4, n % 3 == 0, F.lit(1.5)).alias("reward"))


def answer_chain(spark, d):
    rows = reviews(spark, d).withColumn("right", F.col("value") >= 30)
    return vocabulary.answer_chains(rows, ["student_id"], ["at", "event_id"], "right").select("event_id", "chain")


def result_queue(spark, d):
    """Results that wait to be sent: the last of each id, less those that were sent."""
    rows = reviews(spark, d).select((F.col("event_id") % 4000).alias("result_id"), "event_id", "at")
    last = merging.newest(rows, ["result_id"], [F.desc("at"), F.desc("event_id")])
    return last.join(rows.where("event_id % 11 = 0").select("result_id").distinct(), "result_id", "left_anti")


QUERIES = {f.__name__: f for f in (report_lessons, report_students, report_results, report_answers, student_kpis, answer_keys, xlsx_export, lesson_insert, lesson_operations, student_upsert, balance_operations, schedule_prepend, log_newest, notifications, quest_launch, signal_incidents, exam_time_left, option_lines, option_lines_all, question_kinds, answer_map, audio_links, audio_keys, json_items, masked_text, example_gap, vocab_wave, act_reward, answer_chain, result_queue)}

_LESSON = "(o_orderkey * 37) % 9000"
_COINS = "CASE WHEN s >= 7200 THEN 60 WHEN s >= 3600 THEN 25 WHEN s >= 1800 THEN 10 ELSE 0 END"
_CENTS = "floor({} * 100 + 0.5)::BIGINT"
_EDITS = f"SELECT CASE WHEN c_custkey % 8 = 0 THEN c_custkey ELSE c_custkey + 10000000 END AS id, lower(c_name) AS name, CASE WHEN c_custkey % 16 = 0 THEN {_CENTS.format('c_acctbal')} + 7 END AS coins FROM customer WHERE c_custkey % 4 = 0"
_TITLE = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_MASK = r"regexp_replace(regexp_replace(html, '(<[^>]+>|\[\d+\]|\(\d+\)|\b\d+\b\.|_{2,}|\.{4,})|[a-zA-Z0-9À-ỹ]+', '\1', 'g'), '█+', '', 'g')"
_QUESTION = r"""
    SELECT *, (['Label the map below. ', 'Complete the flow-chart. ', 'Complete the summary. ', 'Complete the notes. ', 'Do these agree? TRUE, FALSE or NOT GIVEN. ', 'Write yes/no/not given. ', 'Answer. '])[p_partkey % 7 + 1] || p_name AS text,
        CASE WHEN p_partkey % 4 < 3 THEN list_transform(w, lambda x, i: CASE WHEN p_partkey % 2 = 0 THEN chr((i + 64)::INT) || '. ' || x ELSE x END) END AS options,
        CASE p_partkey % 3 WHEN 0 THEN chr((65 + p_partkey % 6)::INT) WHEN 1 THEN upper(w[2]) ELSE 'none' END AS answer
    FROM (SELECT *, string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), ' ') AS w FROM part)
"""
ORACLE_SQL = {
    "report_lessons": f"SELECT o_orderkey AS lesson_id, o_orderdate AS at, c_name AS name, coalesce(skills, '') AS skills, floor({_LESSON} / 60 + 0.5)::BIGINT AS minutes, {_CENTS.format('o_totalprice')} AS amount_cents, CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'unpaid' END AS paid FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ' - ' ORDER BY l_returnflag) AS skills FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "report_students": f"SELECT c_custkey AS student_id, c_name AS name, c_mktsegment AS cefr, coalesce(debt, 0)::BIGINT AS debt_cents FROM customer LEFT JOIN (SELECT o_custkey, sum({_CENTS.format('o_totalprice')}) AS debt FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) ON o_custkey = c_custkey",
    "report_results": f"SELECT attempt_id, student_id, \"at\", score || '/' || total AS score, coalesce(band::DECIMAL(4, 1)::VARCHAR, 'N/A') AS band FROM ({_BANDS_SQL})",
    "report_answers": f"""
        WITH g AS (SELECT l_orderkey, group_no, list_sort(list_distinct(list(l_quantity::INT % 4))) AS k, list_sort(list_distinct(list(l_partkey % 5))) AS m, count(*) AS n FROM ({_GROUPED}) GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN len(m) > len(k) THEN 0 ELSE len(list_intersect(k, m)) END AS score FROM g)
        SELECT l_orderkey AS attempt_id, group_no::BIGINT AS group_no, n, array_to_string(k, ' / ') AS answers, array_to_string(m, ' / ') AS given, CASE WHEN score = len(k) AND len(m) = len(list_intersect(k, m)) THEN 'right' WHEN score > 0 THEN 'partly right (' || score || '/' || len(k) || ')' ELSE 'wrong' END AS result FROM s
    """,
    "student_kpis": f"""
        WITH l AS (SELECT o_custkey, count(*) AS n, floor(sum({_LESSON}) / 360 + 0.5)::BIGINT AS h FROM orders GROUP BY 1), r AS (SELECT student_id, count(*) AS n, floor(avg(band * 10) + 0.5)::BIGINT AS b FROM ({_BANDS_SQL}) GROUP BY 1)
        SELECT c_custkey AS student_id, coalesce(l.n, 0) AS n_lessons, coalesce(h, 0) AS tenth_hours, coalesce(r.n, 0) AS n_results, coalesce(b, -1) AS tenth_band FROM customer LEFT JOIN l ON o_custkey = c_custkey LEFT JOIN r ON r.student_id = c_custkey
    """,
    "answer_keys": """
        WITH q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i, coalesce((['alpha', 'beta', 'gamma'])[l_quantity::INT % 4 + 1], (l_quantity::INT % 4)::VARCHAR) AS a FROM lineitem)
        SELECT l_orderkey AS attempt_id, string_agg('Question ' || i || ': ' || a || chr(10), '' ORDER BY i) AS content FROM q GROUP BY 1
    """,
    "lesson_insert": f"""
        WITH x AS (SELECT o_custkey, {_LESSON} AS s FROM orders), p AS (SELECT o_custkey, sum(floor(s / 60 + 0.5)) AS x, sum({_COINS}) AS c FROM x WHERE s > 0 GROUP BY 1),
        t AS (SELECT c_custkey, (c_custkey % 900 + coalesce(x, 0))::BIGINT AS exp, ({_CENTS.format('c_acctbal')} + coalesce(c, 0))::BIGINT AS coins FROM customer LEFT JOIN p ON o_custkey = c_custkey)
        SELECT c_custkey AS student_id, exp, (exp // 500 + 1)::BIGINT AS level, coins FROM t
    """,
    "lesson_operations": f"SELECT lesson_id, student_id, ({_COINS})::INT AS delta, 'LESSON' AS reason FROM (SELECT o_orderkey AS lesson_id, o_custkey AS student_id, {_LESSON} AS s FROM orders) WHERE s >= 1800",
    "student_upsert": f"""
        WITH e AS ({_EDITS}), s AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS cefr, {_CENTS.format('c_acctbal')} AS coins, c_custkey % 900 AS exp FROM customer),
        b AS (SELECT coalesce(e.id, s.id) AS id, coalesce(e.name, s.name) AS name, coalesce(cefr, 'B2') AS cefr, coalesce(e.coins, s.coins, 0)::BIGINT AS coins, coalesce(exp, 0)::BIGINT AS exp FROM s FULL JOIN e ON e.id = s.id)
        SELECT id AS student_id, {_TITLE.format('name')} AS name, cefr, coins, exp FROM b
    """,
    "balance_operations": f"SELECT c_custkey AS student_id, 7::BIGINT AS delta FROM customer WHERE c_custkey % 16 = 0 AND c_acctbal IS NOT NULL",
    "schedule_prepend": "SELECT o_orderkey AS attempt_id, o_orderdate AS at, o_orderkey % 5 = 0 AS is_new FROM orders",
    "log_newest": "SELECT event_id, ts AS at, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "notifications": "SELECT c_custkey AS student_id, array_to_string(list_concat(CASE WHEN c_custkey % 2 = 0 THEN ['hello'] ELSE [] END, coalesce(n, [])), ',') AS notifications FROM customer LEFT JOIN (SELECT user_id, list('event ' || event_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error' GROUP BY 1) ON user_id = c_custkey",
    "quest_launch": "SELECT p_partkey, greatest(1, least(CASE WHEN p_partkey % 40 = 3 THEN p_size ELSE p_partkey % 40 - 3 END, p_size))::INT AS n_questions, greatest(1, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 5 WHEN p_partkey % 60 <> 0 THEN p_partkey % 60 ELSE 1 END)::INT AS time_limit, p_partkey % 2 = 0 AS practice, false AS locked FROM part",
    "signal_incidents": """
        WITH RECURSIVE s AS (SELECT user_id, ts, value >= 40 AND coalesce(lag(value >= 40) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS hit FROM events),
        c AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT DISTINCT user_id, ts FROM s WHERE hit)),
        f AS (SELECT user_id, k, ts, ts AS last, true AS took FROM c WHERE k = 1
            UNION ALL SELECT c.user_id, c.k, c.ts, CASE WHEN c.ts - f.last >= INTERVAL 6 HOUR THEN c.ts ELSE f.last END, c.ts - f.last >= INTERVAL 6 HOUR FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1)
        SELECT user_id AS student_id, ts AS at FROM f WHERE took
    """,
    "exam_time_left": "SELECT event_id, (event_id % 90 * 60 - (epoch_us(ts) // 1000000 - epoch_us(date_trunc('hour', ts)) // 1000000))::BIGINT AS seconds_left, event_id % 90 * 60 - (epoch_us(ts) // 1000000 - epoch_us(date_trunc('hour', ts)) // 1000000) <= 0 AS expired FROM events",
    "option_lines": r"""
        WITH l AS (SELECT doc_id, regexp_replace((['A. ', 'b) ', 'A ', 'I ', 'iv. ', ''])[doc_id % 6 + 1] || array_to_string(list_slice(string_split(text, ' '), 1, doc_id % 17), ' '), '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, regexp_matches(t, '^[A-Za-z][.)][ \t\n\f\r]+|^[A-Za-z]$|^[ivxlcdmIVXLCDM]+\.\)?[ \t\n\f\r]+[^ \t\n\f\r]') OR (regexp_matches(t, '^[A-K][ \t\n\f\r]+[^ \t\n\f\r]') AND length(t) < 80 AND NOT regexp_matches(t, '^A[ \t\n\f\r]+[a-z]|^I[ \t\n\f\r]+(?i:am|have|was) ')) AS is_option FROM l
    """,
    "option_lines_all": r"""
        WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, line_no::INT AS line_no, regexp_replace(line, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') AS t FROM x)
        SELECT doc_id, line_no, regexp_matches(t, '^[A-Za-z][.)][ \t\n\f\r]+|^[A-Za-z]$|^[ivxlcdmIVXLCDM]+\.\)?[ \t\n\f\r]+[^ \t\n\f\r]') OR (regexp_matches(t, '^[A-K][ \t\n\f\r]+[^ \t\n\f\r]') AND length(t) < 80 AND NOT regexp_matches(t, '^A[ \t\n\f\r]+[a-z]|^I[ \t\n\f\r]+(?i:am|have|was) ')) AS is_option FROM l
    """,
    "question_kinds": f"""
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'SUMMARY_DRAG' ELSE 'COLUMN_DRAG' END ELSE
            CASE WHEN (lower(text) LIKE '%map%' OR lower(text) LIKE '%plan%') AND lower(text) LIKE '%label%' THEN 'MAP_LABELLING' WHEN lower(text) LIKE '%flow-chart%' THEN 'FLOWCHART' WHEN lower(text) LIKE '%summary%' THEN 'SUMMARY' WHEN lower(text) LIKE '%note%' THEN 'NOTES' ELSE 'SENTENCE' END END AS subtype,
            array_to_string(coalesce(options, CASE p_partkey % 7 WHEN 4 THEN ['TRUE', 'FALSE', 'NOT GIVEN'] WHEN 5 THEN ['YES', 'NO', 'NOT GIVEN'] ELSE [] END), '|') AS options FROM ({_QUESTION})
    """,
    "answer_map": rf"""
        WITH q AS (SELECT *, list_transform(options, lambda o, i: coalesce(nullif(upper(regexp_extract(trim(o), '^([A-Za-z])(?:[.)]\s+|\s+|$)', 1)), ''), chr((i + 64)::INT)) = upper(trim(answer)) OR upper(trim(o)) = upper(trim(answer))) AS hit, list_transform(options, lambda o: trim(regexp_replace(o, '^\s*[A-Za-z][.)]\s*', ''))) AS bank FROM ({_QUESTION}) WHERE options IS NOT NULL)
        SELECT p_partkey, (coalesce(list_position(hit, true), 0) - 1)::INT AS place, list_position(hit, true) IS NULL AS unmatched, CASE WHEN regexp_matches(answer, '^[A-Za-z]$') THEN coalesce(bank[ascii(upper(answer)) - 64], answer) ELSE answer END AS bank FROM q
    """,
    "audio_links": """
        WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://drive.google.com/file/d/f' || page_id || '/view' WHEN 1 THEN 'https://drive.google.com/open?id=q' || page_id || '&x=1' ELSE url END AS url FROM pages),
        i AS (SELECT *, coalesce(nullif(regexp_extract(url, 'drive\\.google\\.com/file/d/([^/]+)', 1), ''), nullif(regexp_extract(url, 'drive\\.google\\.com/open\\?id=([^&]+)', 1), '')) AS id FROM u)
        SELECT page_id, CASE WHEN id IS NULL THEN url ELSE 'https://drive.google.com/uc?export=download&id=' || id END AS link FROM i
    """,
    "audio_keys": """
        WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'other/' ELSE 'exam-audio/' END || p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '|' END || CASE WHEN p_partkey % 7 > 0 THEN p_partkey::VARCHAR ELSE '' END AS raw FROM part),
        k AS (SELECT p_partkey, replace(replace(rtrim(base64(encode(raw)), '='), '+', '-'), '/', '_') AS key FROM r),
        d AS (SELECT p_partkey, decode(from_base64(rpad(replace(replace(key, '-', '+'), '_', '/'), ((length(key) + 3) // 4 * 4)::INT, '='))) AS t FROM k),
        s AS (SELECT p_partkey, strpos(t, '|') AS bar, t FROM d)
        SELECT p_partkey, CASE WHEN ok THEN substr(t, 1, bar - 1) END AS path, CASE WHEN ok THEN substr(t, bar + 1) END AS token FROM (SELECT *, bar > 0 AND starts_with(t, 'exam-audio/') AND bar < length(t) AS ok FROM s)
    """,
    "json_items": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN -1 WHEN 6 THEN -1 ELSE 1 END::INT AS n_items, CASE WHEN event_id % 7 < 4 THEN (props ->> 'k')::BIGINT ELSE -1 END AS k FROM events",
    "masked_text": f"SELECT page_id, length(t)::INT AS n_left, md5(t) AS digest FROM (SELECT page_id, {_MASK} AS t FROM pages)",
    "act_reward": "SELECT event_id, floor((floor((5 + event_id % 12 * 3) * (([1.0, 1.4, 1.6, 1.5, 1.3])[event_id % 5 + 1])::DOUBLE + 0.5) + event_id % 4) * (CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) * 1.5::DOUBLE + 0.5)::BIGINT AS reward FROM events",
    "answer_chain": "SELECT event_id, (sum((value >= 30)::INT) OVER (PARTITION BY user_id, lost ORDER BY ts, event_id))::BIGINT AS chain FROM (SELECT *, sum((value < 30)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lost FROM events)",
    "result_queue": "SELECT event_id % 4000 AS result_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS at FROM events GROUP BY 1 HAVING NOT bool_or(event_id % 11 = 0)",
}
# vocab_wave draws cards by a hash and example_gap quotes patterns, which SQL does not have; tests check their rules
