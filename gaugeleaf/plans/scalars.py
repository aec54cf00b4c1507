"""Scalar rules one by one: rounding, calendars, text, JSON, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import documents as D
from ..sources.domain import Tables
from ..sources.store import fresh_path
from ..streaming import events as E
from .registry import query

# scores around zero, halves among them
SCORE = "(score - 10) / 8"


def scores(t: Tables):
    return t.submissions.where("score is not null").withColumn("x", (F.col("score") - 10) / 8)


@query("H2_js_round_n", f"SELECT submission_id, floor({SCORE} * 10 + 0.5) / 10 AS one, floor({SCORE} * 100 + 0.5) / 100 AS two FROM submissions WHERE score IS NOT NULL")
def h2(t: Tables):
    return scores(t).select("submission_id", N.js_round_n(F.col("x"), 1).alias("one"), N.js_round_n(F.col("x"), 2).alias("two"))


@query("H3_pg_round", f"SELECT submission_id, CAST(round(CAST({SCORE} AS DECIMAL(30,10)), 1) AS DOUBLE) AS one FROM submissions WHERE score IS NOT NULL")
def h3(t: Tables):
    return scores(t).select("submission_id", N.pg_round(F.col("x")).alias("one"))


@query("H4_py_round", f"SELECT submission_id, round_even({SCORE} * 4, 0) AS whole FROM submissions WHERE score IS NOT NULL")
def h4(t: Tables):
    return scores(t).select("submission_id", N.py_round(F.col("x") * 4).alias("whole"))


@query("H6_logistic", "SELECT student_id, floor(1 / (1 + exp(-(xp / 100.0::DOUBLE))) * 1e9 + 0.5) / 1e9 AS p FROM students")
def h6(t: Tables):
    return t.students.select("student_id", N.js_round_n(N.logistic(F.col("xp") / 100), 9).alias("p"))


@query("H7_floor_ceil", f"SELECT submission_id, CAST(floor({SCORE}) AS BIGINT) AS low, CAST(ceil({SCORE}) AS BIGINT) AS high FROM submissions WHERE score IS NOT NULL")
def h7(t: Tables):
    return scores(t).select("submission_id", F.floor("x").alias("low"), F.ceil("x").alias("high"))


@query("H8_floor_level", "SELECT student_id, CAST(floor(greatest(xp, 0) / 100.0) + 1 AS BIGINT) AS level, CAST(greatest(xp, 0) % 100 AS BIGINT) AS into_level FROM students")
def h8(t: Tables):
    xp = F.greatest(F.col("xp"), F.lit(0).cast("long"))
    return t.students.select("student_id", (F.floor(xp / 100) + 1).alias("level"), (xp % 100).alias("into_level"))


@query("H11_week_bounds", "SELECT DISTINCT CAST(answered_at AS DATE) AS day, CAST(date_trunc('week', answered_at) AS DATE) AS monday, CAST(date_trunc('week', answered_at) AS DATE) + 6 AS sunday FROM answers")
def h11(t: Tables):
    monday = F.to_date(F.date_trunc("week", "answered_at"))
    return t.answers.select(F.to_date("answered_at").alias("day"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday")).distinct()


@query("H12_month_bounds", "SELECT DISTINCT CAST(answered_at AS DATE) AS day, CAST(date_trunc('month', answered_at) AS DATE) AS first, CAST(date_trunc('month', answered_at) + INTERVAL 1 MONTH AS DATE) AS next FROM answers")
def h12(t: Tables):
    first = F.to_date(F.date_trunc("month", "answered_at"))
    return t.answers.select(F.to_date("answered_at").alias("day"), first.alias("first"), F.add_months(first, 1).alias("next")).distinct()


@query("H13_days_ago", "SELECT problem_id, DATE '2024-03-01' - CAST(difficulty * 10 AS INTEGER) AS since FROM problems")
def h13(t: Tables):
    return t.problems.select("problem_id", F.date_sub(F.lit("2024-03-01").cast("date"), F.col("difficulty") * 10).alias("since"))


@query("H14_local_day_bounds", "SELECT event_id, CAST(client_ts + INTERVAL 9 HOUR AS DATE) AS local_day, CAST(CAST(client_ts + INTERVAL 9 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 9 HOUR AS begins, CAST(CAST(client_ts + INTERVAL 9 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 15 HOUR AS ends FROM learning_events")
def h14(t: Tables):
    ahead = F.expr("interval 9 hours")
    day = F.to_date(F.col("client_ts") + ahead)
    begins = day.cast("timestamp") - ahead
    return t.learning_events.select("event_id", day.alias("local_day"), begins.cast("timestamp_ntz").alias("begins"), (begins + F.expr("interval 1 day")).cast("timestamp_ntz").alias("ends"))


@query("H16_age", "SELECT event_id, date_diff('second', client_ts, TIMESTAMP '2024-01-31') AS seconds, client_ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AS stuck FROM (SELECT event_id, date_trunc('second', client_ts) AS client_ts FROM learning_events)")
def h16(t: Tables):
    now, at = F.lit("2024-01-31").cast("timestamp"), F.date_trunc("second", F.col("client_ts").cast("timestamp"))
    return t.learning_events.select("event_id", F.timestamp_diff("SECOND", at, now).alias("seconds"), (at < now - F.expr("interval 10 days")).alias("stuck"))


@query("H18_circled_digits", "SELECT problem_id, CASE difficulty WHEN 6 THEN concat('x', stem) ELSE concat(difficulty, stem) END AS answer FROM problems")
def h18(t: Tables):
    mark = F.when(F.col("difficulty") == 6, "x").otherwise(F.substring(F.lit(D.CIRCLED), F.col("difficulty"), F.lit(1)))
    return t.problems.select("problem_id", N.circled_to_digit(F.concat(mark, "stem")).alias("answer"))


@query("H22_line_endings", "SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) ELSE text END AS text FROM documents)")
def h22(t: Tables):
    ending = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\r").otherwise("\n")
    mixed = F.replace(F.col("text"), F.lit("\n"), ending)
    return t.documents.select("doc_id", F.sha2(F.regexp_replace(mixed, r"\r\n?", "\n"), 256).alias("hash"))


@query("H23_leading_int", "SELECT problem_id, CASE difficulty WHEN 1 THEN NULL WHEN 2 THEN -CAST(time_sec AS INTEGER) ELSE CAST(time_sec AS INTEGER) END AS number FROM problems")
def h23(t: Tables):
    z = F.col("time_sec").cast("string")
    label = F.when(F.col("difficulty") == 1, F.concat(F.lit("no "), z)).when(F.col("difficulty") == 2, F.concat(F.lit(" -"), z, F.lit("px"))).otherwise(F.concat(z, F.lit(". item")))
    return t.problems.select("problem_id", N.leading_int(label).alias("number"))


@query("H27_truncate", "SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substring(text, 1, 40), '...') ELSE text END AS preview FROM documents")
def h27(t: Tables):
    return t.documents.select("doc_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


@query("H28_split_key", "SELECT problem_id, subject AS first, coalesce(unit, '') AS second FROM problems")
def h28(t: Tables):
    parts = F.split(F.concat_ws("::", "subject", F.coalesce("unit", F.lit(""))), "::", -1)
    return t.problems.select("problem_id", parts[0].alias("first"), parts[1].alias("second"))


@query("H29_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def h29(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("H32_json_typed_read", "SELECT event_id, CASE WHEN json_type(payload, '$.durationMs') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(payload, '$.durationMs') AS DOUBLE) END AS duration, coalesce(json_type(payload, '$.isCorrect') = 'BOOLEAN' AND json_extract_string(payload, '$.isCorrect') = 'true', false) AS right_answer FROM learning_events")
def h32(t: Tables):
    payload = F.col("payload")
    return t.learning_events.select("event_id", N.json_number(payload, "$.durationMs").alias("duration"), F.coalesce(N.json_boolean(payload, "$.isCorrect"), F.lit(False)).alias("right_answer"))


RULES = ", ".join(f"({a}, {b}, '{p}', {n}, '{f}')" for a, b, p, n, f in D.EXAM_RULES)


@query("H37_exam_rule_lookup", f"SELECT problem_id, r.position AS position_type, r.points AS point_value, r.form AS question_format FROM problems LEFT JOIN (VALUES {RULES}) r(low, high, position, points, form) ON problem_id % 34 BETWEEN r.low AND r.high")
def h37(t: Tables):
    number = (F.col("problem_id") % 34).cast("string")
    asked = t.problems.select("problem_id", F.lit(False).alias("is_textbook"), number.alias("problem_number"), *(F.lit(None).cast(k).alias(c) for c, k in (("difficulty", "double"), ("question_format", "string"), ("ai_answer", "string"), ("answer_text", "string"))))
    known = F.col("problem_id") % 34
    out = D.apply_exam_rules(asked)
    listed = known.between(1, 30)
    return out.select("problem_id", F.when(listed, F.col("position_type")).alias("position_type"), F.when(listed, F.col("point_value")).alias("point_value"), "question_format")


NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query("L1_event_window", f"SELECT event_type, count(*) FILTER (WHERE client_ts BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW} + INTERVAL 30 SECOND) AS accepted, count(*) FILTER (WHERE client_ts < {NOW} - INTERVAL 7 DAY) AS old, count(*) FILTER (WHERE client_ts > {NOW} + INTERVAL 30 SECOND) AS ahead FROM learning_events GROUP BY event_type")
def l1(t: Tables):
    now, at = F.lit("2024-01-20 12:00:00").cast("timestamp"), F.col("client_ts").cast("timestamp")
    taken = E.acceptable(at, now)
    return t.learning_events.groupBy("event_type").agg(F.count_if(taken).alias("accepted"), F.count_if(~taken & (at < now)).alias("old"), F.count_if(~taken & (at > now)).alias("ahead"))


@query("L4_idempotent_upsert", "SELECT student_id, CAST(client_ts AS DATE) AS day, max(value) AS best FROM learning_events GROUP BY 1, 2")
def l4(t: Tables):
    """Halves of the table come as batches, the first one twice; a key that comes again is replaced."""
    out = fresh_path(t.spark, "upserts")
    write = E.upsert_batches(out, "day", E.keyed_replacement(["student_id", "day"]))
    best = t.learning_events.groupBy("student_id", F.to_date("client_ts").alias("day")).agg(F.max("value").alias("best"))
    stale = best.withColumn("best", F.lit(-1.0))
    for number, batch in enumerate((stale.where("student_id % 2 = 0"), best.where("student_id % 2 = 0"), best.where("student_id % 2 = 0"), best.where("student_id % 2 = 1"))):
        write(batch, number)
    return E.current(t.spark, out).select("student_id", "day", "best")
