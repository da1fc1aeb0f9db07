"""Queries on attempts, lessons and money, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from marktide.functions.values import half_up, percent, places
from marktide.operators import merging, scoring
from marktide.sources.tables import ITEM_ORDER, attempts, items, table

_PER_ATTEMPT = "SELECT l_orderkey AS attempt_id, count(*) FILTER (l_quantity >= 25) AS score, count(*) AS total FROM lineitem GROUP BY 1"
_NORM = "(40.0 * score / total)"


def _band_sql(skill: str) -> str:
    case = lambda t: "CASE " + " ".join(f"WHEN {_NORM} >= {n} THEN {b}::DOUBLE" for n, b in t) + " END"
    return f"CASE WHEN {skill} THEN {case(scoring.LISTENING_BANDS)} ELSE {case(scoring.READING_BANDS)} END"


_BANDS_SQL = f"SELECT o_orderkey AS attempt_id, o_custkey AS student_id, o_orderdate AS at, CASE WHEN o_custkey % 2 = 0 THEN 'Listening' ELSE 'Reading' END AS skill, score, total, {_band_sql('o_custkey % 2 = 0')} AS band FROM orders JOIN ({_PER_ATTEMPT}) ON attempt_id = o_orderkey"


def _scored(spark, d):
    per = items(spark, d).groupBy("attempt_id").agg(F.count_if("correct").alias("score"), F.count("*").alias("total"))
    skill = F.when(F.col("student_id") % 2 == 0, "Listening").otherwise("Reading")
    rows = attempts(spark, d).join(per, "attempt_id").withColumn("skill", skill)
    return rows.select("attempt_id", "student_id", "at", "skill", "score", "total", scoring.band(F.col("score"), F.col("total"), F.col("skill")).alias("band"))


def error_by_type(spark, d):
    known = items(spark, d).join(attempts(spark, d).select("attempt_id"), "attempt_id")
    return scoring.error_rates(known, ["label"])


def _student_rates(spark, d):
    return scoring.error_rates(items(spark, d).join(attempts(spark, d).select("attempt_id", "student_id"), "attempt_id"), ["student_id", "label"])


def weak_students_top6(spark, d):
    return scoring.weakest_labels(_student_rates(spark, d), "student_id", "label").orderBy("rate", "student_id").limit(6)


def student_type_profile(spark, d):
    w = F.sort_array(F.collect_list(F.struct("rate", "label", "total")))
    shown = F.array_join(F.transform(w, lambda x: F.concat_ws(":", x["label"], x["rate"].cast("string"), x["total"].cast("string"))), " ")
    return _student_rates(spark, d).groupBy("student_id").agg(shown.alias("profile"))


_RATES = "SELECT o_custkey AS student_id, l_returnflag AS label, count(*) FILTER (l_quantity >= 25) AS n_correct, count(*) AS total, floor(100.0 * count(*) FILTER (l_quantity >= 25) / count(*) + 0.5)::BIGINT AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


def finance_stats(spark, d):
    by = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("amount_cents"))), F.lit(0)) / 100
    out = attempts(spark, d).agg(by("F").alias("revenue"), by("P").alias("expense"), by("O").alias("unpaid"))
    return out.withColumn("net", places(F.col("revenue") - F.col("expense"), 2))


def unpaid_by_student(spark, d):
    owed = attempts(spark, d).where("status <> 'F'").groupBy("student_id").agg((F.sum("amount_cents") / 100).alias("debt"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"))
    return people.join(owed, "student_id", "left").select("student_id", "name", F.coalesce("debt", F.lit(0.0)).alias("debt"))


def roster_totals(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("hours"), (F.sum(F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5))) / 100).alias("earnings"))
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(per, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("hours", F.lit(0)).alias("hours"), F.coalesce("earnings", F.lit(0.0)).alias("earnings"))


def lesson_earnings(spark, d):
    s, rate = F.col("seconds"), F.col("student_id") % 50 + 10
    w = Window.partitionBy("student_id").orderBy("at", "attempt_id").rowsBetween(Window.unboundedPreceding, 0)
    coins = F.when(s >= 7200, 60).when(s >= 3600, 25).when(s >= 1800, 10).otherwise(0)
    rows = attempts(spark, d).select("attempt_id", half_up(F.ceil(s / 60) / 60 * rate).alias("earned"), half_up(s / 60).alias("xp"), coins.alias("coins"), F.sum(half_up(s / 60)).over(w).alias("xp_so_far"))
    level = F.floor(F.col("xp_so_far") / 500) + 1
    return rows.select("attempt_id", "earned", "xp", "coins", level.alias("level"), F.when(level >= 10, "Master").when(level >= 5, "Elite").otherwise("Novice").alias("badge"))


def skill_time_split(spark, d):
    skills = items(spark, d).groupBy("attempt_id").agg(F.collect_set("label").alias("skills"))
    rows = attempts(spark, d).join(skills, "attempt_id").select(F.explode("skills").alias("skill"), (F.col("seconds") / F.size("skills")).alias("part"))
    return rows.groupBy("skill").agg(half_up(F.sum("part") * 10 + F.lit(0.001)).alias("tenths"))


def band_lookup(spark, d):
    return _scored(spark, d)


def band_histogram(spark, d):
    return _scored(spark, d).where("band is not null").groupBy("band").agg(F.count("*").alias("n"))


def band_filter(spark, d):
    """A result without a band passes a filter for high bands and one for low bands."""
    rows = _scored(spark, d)
    return rows.select("attempt_id", (~F.coalesce(F.col("band") < 7, F.lit(False))).alias("high"), (~F.coalesce(F.col("band") >= 6, F.lit(False))).alias("low")).where("high or low")


def avg_band(spark, d):
    return _scored(spark, d).groupBy("skill").agg(places(F.avg("band"), 4).alias("avg_band"), F.count("*").alias("n"))


def band_series(spark, d):
    w = Window.partitionBy("student_id").orderBy("at", "attempt_id")
    return _scored(spark, d).where("band is not null").select("student_id", "attempt_id", F.row_number().over(w).alias("place"), "band", (F.col("band") - F.lag("band").over(w)).alias("change"))


def recent_distinct_tests(spark, d):
    last = attempts(spark, d).groupBy("student_id", "exam_id").agg(F.max("at").alias("last_at"))
    return merging.keep_first(last, [F.desc("last_at"), F.asc("exam_id")], 5, ["student_id"])


def scoring_groups(spark, d):
    rows = scoring.question_groups(items(spark, d), "attempt_id", ITEM_ORDER, F.col("multiple"), ["label"])
    return rows.groupBy("attempt_id").agg(F.max("group_no").alias("n_groups"), F.count("*").alias("n_items"), F.sum(F.col("group_no") * F.col("l_linenumber")).alias("check"))


def attempt_score(spark, d):
    rows = scoring.question_groups(items(spark, d), "attempt_id", ITEM_ORDER, F.col("multiple"), ["label"])
    return scoring.attempt_scores(rows.withColumn("mark", F.when(F.col("mark") < 4, F.col("mark"))), "attempt_id", "multiple", "answer", "mark")


def question_numbers(spark, d):
    rows = scoring.numbered(items(spark, d), "attempt_id", ITEM_ORDER, F.greatest(F.lit(1), F.col("answer")))
    return rows.groupBy("attempt_id").agg(F.max("first_no").alias("last_first"), F.sum("first_no").alias("sum_first"), F.max("label").alias("top_label"))


def attempt_cap(spark, d):
    n = attempts(spark, d).groupBy("student_id", "exam_id").agg(F.count("*").alias("n_attempts"))
    return n.withColumn("allowed", F.col("n_attempts") < 3)


def category_shortfall(spark, d):
    target = spark.createDataFrame([("A", 20_000), ("N", 30_000), ("R", 10_000), ("X", 5)], "label string, wanted long")
    have = items(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return target.join(have, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), F.col("wanted") - F.coalesce("n", F.lit(0))).alias("short"))


def rolling_cap(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return merging.keep_first(rows, [F.desc("ts"), F.desc("event_id")], 50, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


def answer_percent(spark, d):
    return items(spark, d).groupBy("attempt_id").agg(percent(F.count_if(F.col("mark") < 4), F.count("*")).alias("progress"))


QUERIES = {f.__name__: f for f in (error_by_type, weak_students_top6, student_type_profile, finance_stats, unpaid_by_student, roster_totals, lesson_earnings, skill_time_split, band_lookup, band_histogram, band_filter, avg_band, band_series, recent_distinct_tests, scoring_groups, attempt_score, question_numbers, attempt_cap, category_shortfall, rolling_cap, answer_percent)}

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_GROUPED = f"""
    SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS group_no FROM (
        SELECT *, CASE WHEN l_linestatus = 'O' AND lag(l_linestatus) OVER w = 'O' AND lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS fresh
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER}))
"""
ORACLE_SQL = {
    "error_by_type": "SELECT label, sum(n_correct)::BIGINT AS n_correct, sum(total)::BIGINT AS total, floor(100.0 * sum(n_correct) / sum(total) + 0.5)::BIGINT AS rate FROM (" + _RATES + ") GROUP BY label",
    "weak_students_top6": f"SELECT * FROM ({_RATES}) WHERE total >= 2 QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY rate, label) = 1 AND rate < 60 ORDER BY rate, student_id LIMIT 6",
    "student_type_profile": f"SELECT student_id, string_agg(label || ':' || rate || ':' || total, ' ' ORDER BY rate, label) AS profile FROM ({_RATES}) GROUP BY 1",
    "finance_stats": "SELECT revenue, expense, unpaid, floor((revenue - expense) * 100 + 0.5) / 100 AS net FROM (SELECT " + ", ".join(f"coalesce(sum(floor(o_totalprice * 100 + 0.5)::BIGINT) FILTER (o_orderstatus = '{s}'), 0)::BIGINT / 100 AS {n}" for s, n in (("F", "revenue"), ("P", "expense"), ("O", "unpaid"))) + " FROM orders)",
    "unpaid_by_student": "SELECT c_custkey AS student_id, c_name AS name, coalesce(sum(floor(o_totalprice * 100 + 0.5)::BIGINT), 0)::BIGINT / 100 AS debt FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY 1, 2",
    "roster_totals": "SELECT s_suppkey, s_name, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS hours, coalesce(sum(floor(l_extendedprice * 100 + 0.5)::BIGINT), 0)::BIGINT / 100 AS earnings FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "lesson_earnings": """
        WITH t AS (SELECT *, (o_orderkey * 37) % 9000 AS s FROM orders),
        x AS (SELECT *, floor(s / 60 + 0.5)::BIGINT AS xp, (sum(floor(s / 60 + 0.5)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT // 500 + 1 AS level FROM t)
        SELECT o_orderkey AS attempt_id, floor(ceil(s / 60) / 60 * (o_custkey % 50 + 10) + 0.5)::BIGINT AS earned, xp, CASE WHEN s >= 7200 THEN 60 WHEN s >= 3600 THEN 25 WHEN s >= 1800 THEN 10 ELSE 0 END AS coins,
            level, CASE WHEN level >= 10 THEN 'Master' WHEN level >= 5 THEN 'Elite' ELSE 'Novice' END AS badge FROM x
    """,
    "skill_time_split": """
        WITH k AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM k GROUP BY 1)
        SELECT l_returnflag AS skill, floor(sum(((o_orderkey * 37) % 9000) * (6 // n))::BIGINT / 6 * 10 + 0.001 + 0.5)::BIGINT AS tenths FROM k JOIN n USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
    """,
    "band_lookup": _BANDS_SQL,
    "band_histogram": f"SELECT band, count(*) AS n FROM ({_BANDS_SQL}) WHERE band IS NOT NULL GROUP BY 1",
    "band_filter": f"SELECT attempt_id, coalesce(NOT band < 7, true) AS high, coalesce(NOT band >= 6, true) AS low FROM ({_BANDS_SQL}) WHERE coalesce(NOT band < 7, true) OR coalesce(NOT band >= 6, true)",
    "avg_band": f"SELECT skill, floor(avg(band) * 10000 + 0.5) / 10000 AS avg_band, count(*) AS n FROM ({_BANDS_SQL}) GROUP BY 1",
    "band_series": f"SELECT student_id, attempt_id, (row_number() OVER w)::INT AS place, band, band - lag(band) OVER w AS change FROM ({_BANDS_SQL}) WHERE band IS NOT NULL WINDOW w AS (PARTITION BY student_id ORDER BY \"at\", attempt_id)",
    "recent_distinct_tests": "SELECT o_custkey AS student_id, o_orderkey % 50 AS exam_id, max(o_orderdate) AS last_at FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY max(o_orderdate) DESC, o_orderkey % 50) <= 5",
    "scoring_groups": f'SELECT l_orderkey AS attempt_id, max(group_no)::BIGINT AS n_groups, count(*) AS n_items, sum(group_no * l_linenumber)::BIGINT AS "check" FROM ({_GROUPED}) GROUP BY 1',
    "attempt_score": f"""
        WITH g AS (SELECT l_orderkey, group_no, list_distinct(list(l_quantity::INT % 4)) AS k, list_distinct(coalesce(list(l_partkey % 5) FILTER (l_partkey % 5 < 4), [])) AS m FROM ({_GROUPED}) GROUP BY 1, 2),
        s AS (SELECT l_orderkey, greatest(1, len(k)) AS total, CASE WHEN len(m) > greatest(1, len(k)) THEN 0 ELSE len(list_intersect(k, m)) END AS score, greatest(0, greatest(1, len(k)) - len(m)) AS skipped FROM g)
        SELECT l_orderkey AS attempt_id, sum(score)::BIGINT AS score, sum(total)::BIGINT AS total, sum(skipped)::BIGINT AS skipped, greatest(0, sum(total) - sum(score) - sum(skipped))::BIGINT AS incorrect FROM s GROUP BY 1
    """,
    "question_numbers": f"""
        WITH p AS (SELECT *, greatest(1, l_quantity::INT % 4) AS pts FROM lineitem),
        f AS (SELECT l_orderkey, pts, coalesce(sum(pts) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS first_no FROM p)
        SELECT l_orderkey AS attempt_id, max(first_no) AS last_first, sum(first_no)::BIGINT AS sum_first, max(CASE WHEN pts > 1 THEN first_no || '-' || (first_no + pts - 1) ELSE first_no::VARCHAR END) AS top_label FROM f GROUP BY 1
    """,
    "attempt_cap": "SELECT o_custkey AS student_id, o_orderkey % 50 AS exam_id, count(*) AS n_attempts, count(*) < 3 AS allowed FROM orders GROUP BY 1, 2",
    "category_shortfall": "SELECT label, count(l_orderkey) AS n, greatest(0, wanted - count(l_orderkey))::BIGINT AS short FROM (VALUES ('A', 20000), ('N', 30000), ('R', 10000), ('X', 5)) t(label, wanted) LEFT JOIN lineitem ON l_returnflag = label GROUP BY label, wanted",
    "rolling_cap": "SELECT user_id, count(*) AS n, min(ts) AS oldest FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) GROUP BY 1",
    "answer_percent": "SELECT l_orderkey AS attempt_id, floor(100.0 * count(*) FILTER (l_partkey % 5 < 4) / count(*) + 0.5)::BIGINT AS progress FROM lineitem GROUP BY 1",
}
