"""Queries on the roster: filters, calendars, attendance, copies of exams, gates; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marktide.functions.values import cents, clock_long, half_up, money
from marktide.operators import filters
from marktide.plans.analytics import _BANDS_SQL, _scored
from marktide.sources.tables import attempts, table


def _results(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"))
    exams = attempts(spark, d).select("attempt_id", "exam_id")
    return _scored(spark, d).join(names, "student_id").join(exams, "attempt_id").select("attempt_id", "student_id", "exam_id", "band", "name")


def results_high(spark, d):
    return filters.results_shown(_results(spark, d), exam=7, band=">=7.0", name="CUSTOMER#0000001").select("attempt_id", "band")


def results_low(spark, d):
    return filters.results_shown(_results(spark, d), student=10, band="<6.0").select("attempt_id", "band")


def _earned(spark, d):
    rate = F.col("student_id") % 50 + 10
    return attempts(spark, d).select("student_id", "seconds", half_up(F.ceil(F.col("seconds") / 60) / 60 * rate).alias("earned"))


def lesson_totals(spark, d):
    one = filters.lesson_totals(_earned(spark, d), student=7).withColumn("whose", F.lit("student 7"))
    return filters.lesson_totals(_earned(spark, d)).withColumn("whose", F.lit("all")).unionByName(one)


def lessons_on_date(spark, d):
    rows = attempts(spark, d).withColumn("date", F.date_format("at", "yyyy-MM-dd"))
    return filters.equal_if_given(rows, date="1996-02-10").select("attempt_id", "date")


def links_by_audience(spark, d):
    """Events as shared links: those for all, for learners and for teachers."""
    audience = F.when(F.col("event_type") == "view", "ALL").when(F.col("event_type") == "click", "STUDENTS").otherwise("TEACHERS")
    links = table(spark, d, "events").select("event_id", audience.alias("audience"))
    lists = [filters.equal_if_given(links, audience=a).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).withColumn("audience", F.lit(a)) for a in ("ALL", "STUDENTS", "TEACHERS")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def bulk_delete(spark, d):
    rows = attempts(spark, d).select("attempt_id", "student_id")
    return filters.without(rows, rows.where("student_id % 5 = 0").select("attempt_id"), "attempt_id")


def practice_exams(spark, d):
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Listening", "reading", "INTEGRATED", ""))), (n % 4 + 1).cast("int"))
    flag = filters.is_practice(F.when(n % 9 > 0, kind), F.when(n % 2 == 0, "practice").when(n % 3 == 0, "exam"), F.when(n % 7 == 0, n % 14 == 0))
    return table(spark, d, "part").select("p_partkey", flag.alias("practice"))


def teacher_addresses(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ("@Staff.Example ", "@staff.example.org", "@pupils.example", " "))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", filters.ends_with_domain(F.when(F.col("s_suppkey") % 13 > 0, F.concat("s_name", tail)), "@staff.example").alias("teacher"))


def listed_gifts(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("gift"))
    catalog = table(spark, d, "part").where("p_size <= 2").select(F.col("p_name").alias("name"))
    return filters.listed_names(rows, catalog, "gift").select("p_partkey")


def calendar_month(spark, d):
    return filters.month_days(attempts(spark, d).where("student_id = 11"), "at", "1996-02").withColumn("date", F.col("date").cast("string"))


def hours_milestone(spark, d):
    hours = F.floor(F.sum("seconds") / 3600)
    return attempts(spark, d).groupBy("exam_id").agg(hours.alias("hours")).select("exam_id", "hours", filters.next_step(F.col("hours")).cast("long").alias("target"))


def revenue_share(spark, d):
    by = lambda s: F.sum(F.when(F.col("status") == s, F.col("amount_cents")))
    rows = attempts(spark, d).groupBy("exam_id").agg(by("F").alias("a"), by("P").alias("b"))
    return rows.select("exam_id", half_up(filters.share_of(F.when(F.col("exam_id") % 5 > 0, F.col("a")), F.when(F.col("exam_id") % 5 > 0, F.col("b"))) * 1000).alias("permille_100"))


def ages(spark, d):
    born = F.when(F.col("c_custkey") % 10 > 0, F.date_add(F.lit("1980-01-01").cast("date"), (F.col("c_custkey") * 3 % 9000).cast("int")))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(filters.age(born, F.lit("2024-06-30").cast("date")), F.lit(-1)).alias("age"))


def exam_coins(spark, d):
    n = F.col("attempt_id")
    ends = F.when(n % 7 > 0, F.col("at") + F.make_dt_interval(F.lit(0), (n % 40 - 2).cast("int")))
    return attempts(spark, d).select("attempt_id", filters.exam_coins(ends, F.col("at")).alias("coins"))


def attendance(spark, d):
    n = F.col("attempt_id")
    rows = attempts(spark, d).select(n.alias("schedule_id"), (F.col("student_id") + F.when(n % 11 == 0, 10_000_000).otherwise(0)).alias("student_id"), F.when(n % 3 == 0, F.lit(None)).otherwise(n % 4 * 40).cast("int").alias("minutes"), (n % 5 == 0).alias("billed"), (n % 4 > 0).alias("present"))
    students = table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), (F.col("c_custkey") % 50 + 10).cast("double").alias("rate"))
    out = filters.attendance(rows, students, "present")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("seconds", "earned", "xp", "coins")}).withColumn("refused", F.coalesce("refused", F.lit("")))


def exam_copies(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("exam_id"), F.col("p_name").alias("title"), (F.col("p_size") > 20).alias("active"), (F.col("p_size") > 40).alias("locked"))
    return filters.duplicated(rows, rows.where("exam_id % 9 = 0").select("exam_id"), F.col("exam_id") + 1_000_000)


def own_student(spark, d):
    users = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 > 0, F.concat(F.lit("U"), (F.col("s_suppkey") % 40).cast("string"), F.lit("@Mail.Example"))).alias("email"))
    students = table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("u"), (F.col("c_custkey") % 100).cast("string"), F.lit("@mail.example"))).alias("email"))
    return filters.own_row(users, students).select("s_suppkey", F.coalesce("student_id", F.lit(-1)).alias("student_id"))


def attempt_gate(spark, d):
    """The first reason that keeps an attempt from starting."""
    used = F.row_number().over(Window.partitionBy("student_id", "exam_id").orderBy("at", "attempt_id")) - 1
    hour, day, e = F.col("attempt_id") % 24, F.date_trunc("day", "at"), F.col("exam_id")
    reason = filters.gate_reason(
        banned=F.col("student_id") % 97 == 0, opens=F.when(e % 2 == 0, 6).otherwise(4), closes=F.when(e % 3 > 0, 21), now=hour, browser=(e % 11 == 0) & (F.col("attempt_id") % 3 != 0),
        passcode=F.when(e % 7 == 0, "k7").otherwise(""), given=F.when(F.col("attempt_id") % 5 > 0, " k7 "), used=F.col("used"), allowed=F.when(e % 4 > 0, 2),
    )
    return attempts(spark, d).withColumn("used", used).select("attempt_id", reason.alias("reason"))


def money_and_time(spark, d):
    return attempts(spark, d).select("attempt_id", money(F.col("amount_cents")).alias("money"), clock_long(F.col("seconds") * 7).alias("clock"))


QUERIES = {f.__name__: f for f in (results_high, results_low, lesson_totals, lessons_on_date, links_by_audience, bulk_delete, practice_exams, teacher_addresses, listed_gifts, calendar_month, hours_milestone, revenue_share, ages, exam_coins, attendance, exam_copies, own_student, attempt_gate, money_and_time)}

_SECONDS = "(o_orderkey * 37) % 9000"
_EARNED = f"SELECT o_custkey AS student_id, {_SECONDS} AS seconds, floor(ceil({_SECONDS} / 60) / 60 * (o_custkey % 50 + 10) + 0.5)::BIGINT AS earned FROM orders"
_CENTS = "floor(o_totalprice * 100 + 0.5)::BIGINT"
_STEPS = "[" + ", ".join(map(str, filters.HOUR_STEPS)) + "]"
ORACLE_SQL = {
    "results_high": f"SELECT attempt_id, band FROM ({_BANDS_SQL}) JOIN customer ON c_custkey = student_id WHERE attempt_id % 50 = 7 AND coalesce(band >= 7, true) AND lower(c_name) LIKE '%customer#0000001%'",
    "results_low": f"SELECT attempt_id, band FROM ({_BANDS_SQL}) WHERE student_id = 10 AND coalesce(band < 6, true)",
    "lesson_totals": f"WITH e AS ({_EARNED}) SELECT 'all' AS whose, count(*) AS n_lessons, sum(seconds)::BIGINT AS seconds, sum(earned)::BIGINT AS earned FROM e UNION ALL SELECT 'student 7', count(*), coalesce(sum(seconds), 0)::BIGINT, coalesce(sum(earned), 0)::BIGINT FROM e WHERE student_id = 7",
    "lessons_on_date": "SELECT o_orderkey AS attempt_id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderdate::DATE = DATE '1996-02-10'",
    "links_by_audience": "SELECT audience, count(event_id) AS n, min(event_id) AS first_id FROM (VALUES ('ALL'), ('STUDENTS'), ('TEACHERS')) v(audience) LEFT JOIN (SELECT event_id, CASE event_type WHEN 'view' THEN 'ALL' WHEN 'click' THEN 'STUDENTS' ELSE 'TEACHERS' END AS a FROM events) ON a = audience GROUP BY 1",
    "bulk_delete": "SELECT o_orderkey AS attempt_id, o_custkey AS student_id FROM orders WHERE o_custkey % 5 <> 0",
    "practice_exams": "SELECT p_partkey, p_partkey % 14 = 0 OR (p_partkey % 9 > 0 AND p_partkey % 4 IN (0, 2) AND p_partkey % 2 = 0) AS practice FROM part",
    "teacher_addresses": "SELECT s_suppkey, s_suppkey % 13 > 0 AND s_suppkey % 4 = 0 AS teacher FROM supplier",
    "listed_gifts": "SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size <= 2)",
    "calendar_month": "WITH t AS (SELECT unnest(generate_series(DATE '1996-02-01', DATE '1996-02-29', INTERVAL 1 DAY))::DATE AS x) SELECT x::VARCHAR AS date, day(x)::INT AS day, dayofweek(x)::INT AS weekday, x IN (SELECT o_orderdate::DATE FROM orders WHERE o_custkey = 11) AS has_any FROM t",
    "hours_milestone": f"WITH h AS (SELECT o_orderkey % 50 AS exam_id, sum({_SECONDS})::BIGINT // 3600 AS hours FROM orders GROUP BY 1) SELECT exam_id, hours, coalesce(list_filter({_STEPS}, lambda s: s > hours)[1], ceil((hours + 1) / 1000) * 1000)::BIGINT AS target FROM h",
    "revenue_share": f"WITH s AS (SELECT o_orderkey % 50 AS exam_id, coalesce(sum({_CENTS}) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS a, coalesce(sum({_CENTS}) FILTER (o_orderstatus = 'P'), 0)::DOUBLE AS b FROM orders GROUP BY 1) SELECT exam_id, floor(CASE WHEN exam_id % 5 = 0 OR a + b = 0 THEN 50 ELSE a / (a + b) * 100 END * 1000 + 0.5)::BIGINT AS permille_100 FROM s",
    "ages": "SELECT c_custkey, coalesce(2024 - year(CASE WHEN c_custkey % 10 > 0 THEN DATE '1980-01-01' + (c_custkey * 3 % 9000)::INT END), -1)::INT AS age FROM customer",
    "exam_coins": "SELECT o_orderkey AS attempt_id, (50 + CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 40 - 2 >= 24 THEN 150 WHEN o_orderkey % 40 - 2 >= 12 THEN 100 ELSE 0 END)::INT AS coins FROM orders",
    "attendance": """
        WITH s AS (SELECT o_orderkey AS n, o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END AS student_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 90 ELSE o_orderkey % 4 * 40 END AS m, o_orderkey % 4 > 0 AS here, o_orderkey % 5 = 0 AS billed FROM orders),
        r AS (SELECT s.*, c_custkey % 50 + 10 AS rate, CASE WHEN here AND billed THEN 'billed' WHEN here AND c_custkey IS NULL THEN 'no_student' END AS refused FROM s LEFT JOIN customer ON c_custkey = student_id),
        t AS (SELECT *, here AND refused IS NULL AS done FROM r)
        SELECT n AS schedule_id, student_id, CASE WHEN NOT here THEN 'ABSENT' WHEN done OR billed THEN 'DONE' ELSE 'PENDING' END AS status, here AND (done OR billed) AS billed, CASE WHEN done THEN m * 60 ELSE -1 END::INT AS seconds,
            CASE WHEN done THEN floor(m / 60 * rate + 0.5)::BIGINT ELSE -1 END AS earned, CASE WHEN done THEN m ELSE -1 END::BIGINT AS xp, CASE WHEN NOT done THEN -1 WHEN m >= 120 THEN 60 WHEN m >= 60 THEN 25 WHEN m >= 30 THEN 10 ELSE 0 END::INT AS coins, coalesce(refused, '') AS refused FROM t
    """,
    "exam_copies": "SELECT p_partkey AS exam_id, p_name AS title, p_size > 20 AS active, p_size > 40 AS locked, false AS is_copy FROM part UNION ALL SELECT p_partkey + 1000000, p_name || ' (Copy)', false, true, true FROM part WHERE p_partkey % 9 = 0",
    "own_student": "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 9 > 0 THEN (SELECT min(c_custkey) FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 100 = s_suppkey % 40) END, -1) AS student_id FROM supplier",
    "attempt_gate": """
        WITH t AS (SELECT o_orderkey AS a, o_custkey AS s, o_orderkey % 50 AS e, o_orderkey % 24 AS h, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 50 ORDER BY o_orderdate, o_orderkey) - 1 AS used FROM orders)
        SELECT a AS attempt_id, CASE WHEN s % 97 = 0 THEN 'banned' WHEN h < CASE WHEN e % 2 = 0 THEN 6 ELSE 4 END THEN 'not_open' WHEN e % 3 > 0 AND h > 21 THEN 'closed' WHEN e % 11 = 0 AND a % 3 <> 0 THEN 'browser'
            WHEN e % 7 = 0 AND a % 5 = 0 THEN 'passcode' WHEN e % 4 > 0 AND used >= 2 THEN 'attempts' ELSE 'open' END AS reason FROM t
    """,
    "money_and_time": f"SELECT o_orderkey AS attempt_id, replace(format('{{:,}}', {_CENTS}), ',', '.') || 'đ' AS money, lpad(({_SECONDS} * 7 // 3600)::VARCHAR, 2, '0') || ':' || lpad(({_SECONDS} * 7 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({_SECONDS} * 7 % 60)::VARCHAR, 2, '0') AS clock FROM orders",
}
