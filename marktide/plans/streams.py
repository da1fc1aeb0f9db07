"""Queries on streams that run in several arrivals, with a restart before each, and their SQL on the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktide.sources.tables import table
from marktide.streaming import clock, journal, presence
from marktide.streaming.arrivals import in_arrivals

#: The clock of these exams runs 24 times slower than a real one: events of a learner are hours apart.
SLOW = 24


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def exam_clock(spark, d):
    """A learner's events of a day as the signs of one exam, which ends with the day."""
    e = _events(spark, d)
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), "submit").when(F.col("event_type") == "error", "resume").otherwise("beat")
    signs = e.select(F.col("user_id").alias("student_id"), F.to_date("at").alias("day"), "event_id", "at", kind.alias("kind"), F.date_trunc("day", "at").alias("started"), F.lit(60 * SLOW).alias("minutes"), (F.col("user_id") % 3 == 0).alias("practice"))
    marks = tuple(SLOW * s for s in clock.WARNINGS)
    found = in_arrivals({"events": signs}, "at", 3, lambda events: clock.exam_clock(events, ["student_id", "day"], "1 hour", marks, SLOW * clock.WINDOW))
    return found.select("student_id", F.col("day").cast("timestamp_ntz").alias("day"), "what", "mark", F.col("at").cast("timestamp_ntz").alias("at"))


def results_settled(spark, d):
    """Even events as results, odd ones as confirmations of a result a while before."""
    e, n = _events(spark, d), F.col("event_id")
    results = e.where(n % 2 == 0).select(n.alias("result_id"), "at")
    acks = e.where(n % 2 == 1).select(n.alias("ack_id"), (n - 1 - 2 * (F.floor("value") % 8)).alias("acked_id"), "at")
    found = in_arrivals({"results": results, "acks": acks}, "at", 3, lambda results, acks: journal.settled(results, acks, "20 MINUTES", "10 minutes"))
    known = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("result_id", "ack_id")]
    return journal.once(found).select(*known, "what", F.col("at").cast("timestamp_ntz").alias("at"))


def _stretches(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("student_id"), "at", "event_type")
    gap = F.when(F.col("event_type") == "error", F.lit("2 hours")).when(F.col("event_type") == "view", F.lit("12 hours")).otherwise(F.lit("6 hours"))
    return in_arrivals({"events": e}, "at", 3, lambda events: presence.sessions(events, ["student_id"], gap, "1 hour"))


def presence_sessions(spark, d):
    found = _stretches(spark, d)
    return found.select("student_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


def presence_as_of(spark, d):
    """Who was there at noon of the fifteenth day."""
    found = presence.present(_stretches(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return found.select("student_id", F.col("began").cast("timestamp_ntz").alias("began"))


QUERIES = {f.__name__: f for f in (exam_clock, results_settled, presence_sessions, presence_as_of)}

_STRETCHES = """
    WITH e AS (SELECT user_id, event_id, ts, ts + CASE event_type WHEN 'error' THEN INTERVAL 2 HOUR WHEN 'view' THEN INTERVAL 12 HOUR ELSE INTERVAL 6 HOUR END AS until FROM events),
    m AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
    i AS (SELECT *, count(*) FILTER (reach IS NULL OR ts > reach) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m),
    s AS (SELECT user_id AS student_id, min(ts) AS began, max(until) AS ended, count(*) AS n FROM i GROUP BY user_id, island),
    closed AS (SELECT * FROM s WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
"""
ORACLE_SQL = {
    "exam_clock": """
        WITH e AS (
            SELECT user_id, ts::DATE AS day, event_id, ts, user_id % 3 = 0 AS practice, (epoch_us(ts::DATE + INTERVAL 1 DAY) - epoch_us(ts)) // 1000000 AS seconds,
                   CASE WHEN event_type = 'purchase' AND value > 90 THEN 'submit' WHEN event_type = 'error' THEN 'resume' ELSE 'beat' END AS kind
            FROM events
        ),
        k AS (SELECT *, sum(CASE WHEN kind = 'resume' AND NOT practice THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS strikes FROM e),
        o AS (SELECT *, count(*) FILTER (kind = 'submit' OR strikes >= 3) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS over FROM k),
        w AS (SELECT DISTINCT user_id, day, mark FROM o, (VALUES (14400), (7200), (1440)) v(mark) WHERE over = 0 AND seconds <= mark AND seconds > mark - 240)
        SELECT user_id AS student_id, day::TIMESTAMP AS day, 'warning' AS what, mark::BIGINT AS mark, day + INTERVAL 1 DAY - to_seconds(mark) AS at FROM w
        UNION ALL SELECT user_id, day, CASE WHEN strikes >= 3 THEN 'forced' ELSE 'resumed' END, strikes::BIGINT, ts FROM o WHERE kind = 'resume' AND (over = 0 OR over = 1 AND strikes = 3 AND NOT practice)
        UNION ALL SELECT user_id, day, 'expired', 0, day + INTERVAL 1 DAY FROM o GROUP BY user_id, day HAVING max(over) = 0 AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
    "results_settled": """
        WITH r AS (SELECT event_id AS result_id, ts FROM events WHERE event_id % 2 = 0),
        a AS (SELECT event_id AS ack_id, event_id - 1 - 2 * (floor(value)::BIGINT % 8) AS acked_id, ts FROM events WHERE event_id % 2 = 1),
        edge AS (SELECT least((SELECT max(ts) FROM r), (SELECT max(ts) FROM a)) - INTERVAL 10 MINUTE AS known),
        p AS (SELECT r.*, EXISTS (SELECT 1 FROM a WHERE acked_id = result_id AND a.ts >= r.ts AND a.ts <= r.ts + INTERVAL 20 MINUTE) AS ok FROM r)
        SELECT result_id, -1::BIGINT AS ack_id, CASE WHEN ok THEN 'confirmed' ELSE 'pending' END AS what, ts AS at FROM p, edge WHERE ok OR ts + INTERVAL 20 MINUTE < known
        UNION ALL SELECT -1, ack_id, 'late', ts FROM a, edge WHERE ts < known AND NOT EXISTS (SELECT 1 FROM r WHERE acked_id = result_id AND a.ts >= r.ts AND a.ts <= r.ts + INTERVAL 20 MINUTE)
    """,
    "presence_sessions": f"{_STRETCHES} SELECT * FROM closed",
    "presence_as_of": f"{_STRETCHES} SELECT student_id, began FROM closed WHERE began <= TIMESTAMP '2024-01-15 12:00:00' AND ended > TIMESTAMP '2024-01-15 12:00:00'",
}
