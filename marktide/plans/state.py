"""Queries on merges, ledgers, quests and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marktide.functions.values import cents, coin_amount
from marktide.operators import merging, progress
from marktide.sources.tables import attempts, reviews, table
from marktide.streaming.presence import activity_windows

NODES = ["click", "view", "signup", "purchase", "error"]


def _nodes(spark, d):
    node = F.array_position(F.array(*map(F.lit, NODES)), F.col("event_type")).cast("int") - 1
    rows = reviews(spark, d).select("student_id", node.alias("node"), F.col("points").alias("score"), (F.col("value") >= 100).alias("passed"), "at", "event_id").where("node >= 0")
    return progress.node_summary(rows, "student_id", "node", ["at", "event_id"])


def quest_progress(spark, d):
    return progress.quest_progress(_nodes(spark, d), "student_id", "node", len(NODES))


def quest_node_state(spark, d):
    w = Window.partitionBy("student_id").orderBy("node")
    base = F.lit("2024-01-01").cast("date")
    prior = F.when(F.col("node") == 0, F.lit(True)).otherwise(F.lag(F.coalesce("passed", F.lit(False))).over(w))
    grid = _nodes(spark, d)
    grid = grid.select("student_id").distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(len(NODES) - 1)))).join(grid, ["student_id", "node"], "left")
    state = progress.node_state(F.col("passed"), F.date_add(base, F.col("node") * 7), F.date_add(base, F.col("node") * 7 + 18), F.col("prior"), F.coalesce("n_attempts", F.lit(0)), F.lit("2024-01-25").cast("date"))
    return grid.withColumn("prior", prior).select("student_id", "node", state.alias("state"))


def quest_rewards(spark, d):
    rules = spark.createDataFrame([("t", "m3", "milestone", 3), ("t", "s1500", "total_score", 1500), ("t", "k5", "streak", 5)], "topic_id string, reward_id string, kind string, target long")
    return progress.rewards_due(quest_progress(spark, d).withColumn("topic_id", F.lit("t")), rules, "topic_id").select("student_id", "reward_id")


def coin_rewards(spark, d):
    text = F.concat(F.lit("+ 1, 0"), F.col("c_custkey").cast("string"), F.lit(".7 coins"))
    return table(spark, d, "customer").select("c_custkey", coin_amount(text).alias("coins"), coin_amount(F.col("c_name")).alias("from_name"))


def login_streak(spark, d):
    days = reviews(spark, d).select("student_id", F.to_date("at").alias("day"))
    return progress.login_streaks(days, "student_id", "day").withColumn("bonus", progress.daily_bonus(F.col("streak")))


def daily_bonus(spark, d):
    return login_streak(spark, d).groupBy("student_id").agg(F.sum("bonus").alias("bonus"), F.max("streak").alias("longest"))


def _ops(spark, d):
    delta = F.when(F.col("event_type") == "purchase", -F.col("points")).otherwise(F.floor(F.col("points") / 10))
    return reviews(spark, d).select("event_id", "student_id", "at", "event_type", delta.alias("delta"))


def coin_balance(spark, d):
    return progress.clamped_balance(_ops(spark, d), "student_id", ["at", "event_id"], "delta").select("event_id", "student_id", "balance")


def ledger_idempotent(spark, d):
    ops = _ops(spark, d).withColumn("op_id", F.col("event_id") % 5000).withColumn("quiz", F.col("event_id") % 3)
    done = ops.where("event_id % 5 = 0").select("op_id")
    fresh = progress.new_operations(ops, done, "op_id", ["at", "event_id"], F.col("event_type") == "view", ["student_id", "quiz"])
    return fresh.select("op_id", "event_id", "student_id", "delta")


def srs_schedule(spark, d):
    rows = reviews(spark, d).withColumn("remembered", F.col("value") >= 50)
    return progress.card_boxes(rows, ["student_id", "event_type"], ["at", "event_id"], "remembered", "at").select("event_id", "box", "due")


def presence_latest(spark, d):
    rows = merging.newest(reviews(spark, d), ["student_id"], [F.desc("at"), F.desc("event_id")])
    last = reviews(spark, d).agg(F.max("at").alias("now"))
    live = rows.join(F.broadcast(last), F.col("at") > F.col("now") - F.expr("INTERVAL '6' HOUR"))  # one row on the right
    return live.select("student_id", "event_id", "at", F.col("points").alias("progress")).orderBy(F.desc("progress"), "student_id")


def latest_claim(spark, d):
    claims = reviews(spark, d).groupBy("student_id", "event_type").agg(F.max("at").alias("claimed"))
    newest = claims.groupBy("student_id").agg(F.max(F.struct("claimed", "event_type"))["event_type"].alias("newer_type"))
    return claims.join(newest, "student_id").select("student_id", "event_type", "claimed", (F.col("newer_type") != F.col("event_type")).alias("gives_way"))


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", cents(F.col("p_retailprice")).alias("price"))


def merge_catalog(spark, d):
    server, local = _parts(spark, d).where("p_partkey % 2 = 0"), _parts(spark, d).where("p_partkey % 3 = 0").withColumn("price", F.col("price") + 100)
    return merging.local_first(server, local, "p_partkey", _parts(spark, d).where("p_partkey % 10 = 0"))


def merge_vocab(spark, d):
    server = _parts(spark, d).where("p_partkey % 2 = 0")
    local = _parts(spark, d).where("p_partkey % 3 = 0").withColumn("price", F.when(F.col("p_size") > 25, F.col("price") + 100))
    merged = merging.overlay(server, local, "p_partkey", _parts(spark, d).where("p_partkey % 7 = 0"))
    return merged.withColumn("price", F.coalesce("price", F.lit(0)))


def student_write_merge(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 900).alias("exp"), cents(F.col("c_acctbal")).alias("coins"))
    local = rows.where("student_id % 2 = 0").withColumn("exp", 450 + F.col("exp") * 0).withColumn("name", F.upper("name")).withColumn("coins", F.col("coins") + 5)
    return merging.write_members(rows.where("student_id % 3 = 0"), local, "student_id", {"name": "server", "exp": "max", "coins": "server"})


def journal_unacked(spark, d):
    rows = attempts(spark, d)
    return rows.where("attempt_id % 4 = 0").join(rows.where("status = 'F'").select("attempt_id"), "attempt_id", "left_anti").select("attempt_id", "at")


def changed_rows(spark, d):
    old = _parts(spark, d).where("p_partkey % 5 <> 0")
    return merging.changed(old, _parts(spark, d).withColumn("price", F.when(F.col("p_partkey") % 3 == 0, F.col("price") + 1).otherwise(F.col("price"))), "p_partkey")


def upsert_catalog(spark, d):
    rows = _parts(spark, d)
    new = rows.where("p_size < 10").withColumn("price", F.col("price") * 2)
    return new.unionByName(rows.where("p_partkey % 2 = 1").join(new.select("p_partkey"), "p_partkey", "left_anti"))


def redeem_once(spark, d):
    codes = reviews(spark, d).select("event_id", "student_id", "at", (F.col("event_id") % 700).alias("code"))
    n = F.row_number().over(Window.partitionBy("code").orderBy("at", "event_id"))
    return codes.select("event_id", "code", F.when(F.col("code") >= 600, "FAKE").when(n > 1, "USED").otherwise("VALID").alias("verdict"))


def bulk_lock(spark, d):
    rows = attempts(spark, d).select("attempt_id", "status")
    return merging.set_where(rows, rows.where("attempt_id % 6 = 0"), "attempt_id", "status", F.lit("LOCKED"))


def presence_stream(spark, d):
    return activity_windows(spark, f"{d}/events.parquet")


QUERIES = {f.__name__: f for f in (presence_stream, quest_progress, quest_node_state, quest_rewards, coin_rewards, login_streak, daily_bonus, coin_balance, ledger_idempotent, srs_schedule, presence_latest, latest_claim, merge_catalog, merge_vocab, student_write_merge, journal_unacked, changed_rows, upsert_catalog, redeem_once, bulk_lock)}

_SUMMARY = "SELECT user_id, node, count(*) AS n, max(greatest(floor(value), 0))::BIGINT AS best, arg_min(value >= 100, (ts, event_id)) AS first_passed, bool_or(value >= 100) AS passed FROM (SELECT *, list_position(['click', 'view', 'signup', 'purchase', 'error'], event_type) - 1 AS node FROM events) WHERE node >= 0 GROUP BY 1, 2"
_GRID = f"WITH s AS ({_SUMMARY}), g AS (SELECT u.user_id, k.node, n, best, coalesce(first_passed, false) AS first_passed, coalesce(passed, false) AS passed FROM (SELECT DISTINCT user_id FROM s) u CROSS JOIN (SELECT unnest(range(5))::INT AS node) k LEFT JOIN s ON s.user_id = u.user_id AND s.node = k.node)"
_PROGRESS = f"{_GRID} SELECT user_id AS student_id, count(*) FILTER (passed) AS completed, coalesce(sum(best), 0)::BIGINT AS total_score, coalesce(min(node) FILTER (NOT passed), 5)::INT AS current_index, coalesce(min(node) FILTER (NOT first_passed), 5)::INT AS streak FROM g GROUP BY 1"
_STREAK = "SELECT user_id AS student_id, day, row_number() OVER (PARTITION BY user_id, day - n ORDER BY day)::INT AS streak FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS n FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events))"
_DELTA = "(CASE WHEN event_type = 'purchase' THEN -floor(value) ELSE floor(floor(value) / 10) END)::BIGINT"
_PART = "SELECT p_partkey, p_name, p_size, floor(p_retailprice * 100 + 0.5)::BIGINT AS price FROM part"
ORACLE_SQL = {
    "presence_stream": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, floor(max(value))::BIGINT AS top FROM events GROUP BY 1, 2",
    "quest_progress": _PROGRESS,
    "quest_node_state": f"{_GRID}, p AS (SELECT *, CASE WHEN node = 0 THEN true ELSE lag(passed) OVER (PARTITION BY user_id ORDER BY node) END AS prior FROM g) SELECT user_id AS student_id, node, CASE WHEN passed THEN 'completed' WHEN DATE '2024-01-25' < DATE '2024-01-01' + node * 7 THEN 'scheduled' WHEN DATE '2024-01-25' > DATE '2024-01-01' + node * 7 + 18 THEN 'closed' WHEN NOT prior THEN 'locked' WHEN coalesce(n, 0) > 0 THEN 'retry' ELSE 'available' END AS state FROM p",
    "quest_rewards": f"SELECT student_id, reward_id FROM ({_PROGRESS}) JOIN (VALUES ('m3', 'milestone', 3), ('s1500', 'total_score', 1500), ('k5', 'streak', 5)) r(reward_id, kind, target) ON (CASE kind WHEN 'milestone' THEN completed WHEN 'total_score' THEN total_score ELSE streak END) >= target",
    "coin_rewards": "SELECT c_custkey, ('10' || c_custkey)::BIGINT AS coins, greatest(0, coalesce(floor(try_cast(regexp_extract(replace(c_name, ' ', ''), '-?\\d+(?:\\.\\d+)?') AS DOUBLE)), 0))::BIGINT AS from_name FROM customer",
    "login_streak": f"SELECT *, (20 + CASE WHEN streak % 7 = 0 THEN 300 ELSE 0 END)::INT AS bonus FROM ({_STREAK})",
    "daily_bonus": f"SELECT student_id, sum(20 + CASE WHEN streak % 7 = 0 THEN 300 ELSE 0 END)::BIGINT AS bonus, max(streak) AS longest FROM ({_STREAK}) GROUP BY 1",
    "coin_balance": f"SELECT event_id, user_id AS student_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS balance FROM (SELECT *, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)",
    "ledger_idempotent": f"""
        WITH o AS (SELECT *, event_id % 5000 AS op_id, event_id % 3 AS quiz, {_DELTA} AS delta FROM events),
        f AS (SELECT * FROM o WHERE true QUALIFY row_number() OVER (PARTITION BY op_id ORDER BY ts, event_id) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id, quiz, event_type = 'view' ORDER BY ts, event_id) AS k FROM f WHERE op_id NOT IN (SELECT op_id FROM o WHERE event_id % 5 = 0))
        SELECT op_id, event_id, user_id AS student_id, delta FROM n WHERE event_type <> 'view' OR k = 1
    """,
    "srs_schedule": """
        WITH t AS (SELECT *, value >= 50 AS r, sum(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS lost FROM events),
        b AS (SELECT *, least(5, 1 + sum(r::INT) OVER (PARTITION BY user_id, event_type, lost ORDER BY ts, event_id))::INT AS box FROM t)
        SELECT event_id, box, ts + CASE WHEN r THEN to_days(([0, 1, 3, 7, 16, 35])[box + 1]) ELSE INTERVAL 10 MINUTE END AS due FROM b
    """,
    "presence_latest": "SELECT user_id AS student_id, event_id, ts AS at, floor(value)::BIGINT AS progress FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR",
    "latest_claim": "SELECT user_id AS student_id, event_type, max(ts) AS claimed, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type DESC) > 1 AS gives_way FROM events GROUP BY 1, 2",
    "merge_catalog": f"WITH p AS ({_PART}) SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 3 = 0 THEN price + 100 ELSE price END AS price FROM p WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 10 <> 0",
    "merge_vocab": f"WITH p AS ({_PART}) SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 3 = 0 AND p_size > 25 THEN price + 100 WHEN p_partkey % 2 = 0 THEN price ELSE 0 END AS price FROM p WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 7 <> 0",
    "student_write_merge": "SELECT c_custkey AS student_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN greatest(450, c_custkey % 900) ELSE 450 END::BIGINT AS exp, floor(c_acctbal * 100 + 0.5)::BIGINT + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 5 END AS coins FROM customer WHERE c_custkey % 2 = 0",
    "journal_unacked": "SELECT o_orderkey AS attempt_id, o_orderdate AS at FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'F'",
    "changed_rows": "SELECT p_partkey, p_partkey % 5 = 0 AS is_new FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0",
    "upsert_catalog": f"SELECT p_partkey, p_name, p_size, CASE WHEN p_size < 10 THEN price * 2 ELSE price END AS price FROM ({_PART}) WHERE p_size < 10 OR p_partkey % 2 = 1",
    "redeem_once": "SELECT event_id, event_id % 700 AS code, CASE WHEN event_id % 700 >= 600 THEN 'FAKE' WHEN row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts, event_id) > 1 THEN 'USED' ELSE 'VALID' END AS verdict FROM events",
    "bulk_lock": "SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 6 = 0 THEN 'LOCKED' ELSE o_orderstatus END AS status FROM orders",
}
