"""Aggregations: reports, item statistics, blends and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import aggregates as A
from ..sources.domain import Tables
from .registry import query


@query("D1_filtered_count", "SELECT problem_id, count(*) FILTER (WHERE is_correct) AS n_right, count(*) FILTER (WHERE is_correct IS NULL) AS n_open FROM answers GROUP BY problem_id")
def d1(t: Tables):
    return t.answers.groupBy("problem_id").agg(F.count_if("is_correct").alias("n_right"), F.count_if(F.col("is_correct").isNull()).alias("n_open"))


@query("D2_accuracy_by_unit", """SELECT s.student_id, coalesce(p.unit, 'unclassified') AS unit, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE a.is_correct) AS BIGINT) AS correct,
  CAST(floor(100.0 * count(*) FILTER (WHERE a.is_correct) / count(*) + 0.5) AS BIGINT) AS accuracy
  FROM answers a JOIN submissions s USING (submission_id) LEFT JOIN problems p USING (problem_id) WHERE a.is_correct IS NOT NULL AND s.status IN ('graded', 'returned') GROUP BY 1, 2""")
def d2(t: Tables):
    return A.accuracy_by_unit(t.answers, t.submissions, t.problems)


@query("D2_weak_units", """WITH u AS (SELECT s.student_id, coalesce(p.unit, 'unclassified') AS unit, count(*) AS total, count(*) FILTER (WHERE a.is_correct) AS correct
  FROM answers a JOIN submissions s USING (submission_id) LEFT JOIN problems p USING (problem_id) WHERE a.is_correct IS NOT NULL AND s.status IN ('graded', 'returned') GROUP BY 1, 2)
  SELECT student_id, unit, CAST(floor(100.0 * correct / total + 0.5) AS BIGINT) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY floor(100.0 * correct / total + 0.5), unit) AS n FROM u WHERE total >= 3) WHERE n <= 5""")
def d2b(t: Tables):
    return A.weak_units(A.accuracy_by_unit(t.answers, t.submissions, t.problems)).select("student_id", "unit", "accuracy")


@query("D3_rounded_average", "SELECT class_id, CAST(round(CAST(sum(score) AS DECIMAL(30,10)) / count(score), 1) AS DOUBLE) AS avg_score FROM submissions GROUP BY class_id")
def d3(t: Tables):
    return t.submissions.groupBy("class_id").agg(N.pg_round(F.avg(F.col("score").cast("decimal(20,6)"))).alias("avg_score"))


@query("D4_class_assignment_stats", "SELECT g.assignment_id, count(s.submission_id) AS n, CAST(round(CAST(sum(s.score) AS DECIMAL(30,10)) / count(s.score), 1) AS DOUBLE) AS avg_score FROM assignments g LEFT JOIN submissions s ON s.assignment_id = g.assignment_id AND s.status = 'graded' GROUP BY g.assignment_id")
def d4(t: Tables):
    graded = t.submissions.where("status = 'graded'").groupBy("assignment_id").agg(F.count("*").alias("n"), N.pg_round(F.avg(F.col("score").cast("decimal(20,6)"))).alias("avg_score"))
    return t.assignments.select("assignment_id").join(graded, "assignment_id", "left").na.fill(0, ["n"])


@query("D5_class_student_stats", """SELECT u.student_id, u.name, count(s.submission_id) AS n, CAST(round(CAST(sum(s.score) AS DECIMAL(30,10)) / count(s.score), 1) AS DOUBLE) AS avg_score
  FROM students u LEFT JOIN submissions s ON s.student_id = u.student_id AND s.status IN ('graded', 'returned') WHERE u.class_id = 7 GROUP BY u.student_id, u.name ORDER BY avg_score DESC NULLS LAST, u.name""")
def d5(t: Tables):
    graded = t.submissions.where("status in ('graded', 'returned')").select("student_id", "submission_id", "score")
    joined = t.students.where("class_id = 7").join(graded, "student_id", "left").groupBy("student_id", "name")
    return joined.agg(F.count("submission_id").alias("n"), N.pg_round(F.avg(F.col("score").cast("decimal(20,6)"))).alias("avg_score")).orderBy(F.desc_nulls_last("avg_score"), "name")


@query("D6_top_error_types", "SELECT json_extract_string(props, '$.k') AS error_type, count(*) AS n FROM learning_events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, error_type LIMIT 5")
def d6(t: Tables):
    kinds = t.learning_events.select(F.get_json_object("props", "$.k").alias("error_type")).where("error_type is not null")
    return kinds.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(5)


ROLL_UP = """SELECT student_id, CAST(client_ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'session_started') AS viewed,
  count(*) FILTER (WHERE event_type = 'answer_submitted' AND json_type(payload, '$.isCorrect') IS NOT NULL AND json_type(payload, '$.isCorrect') <> 'NULL') AS solved,
  count(*) FILTER (WHERE event_type = 'answer_submitted' AND json_type(payload, '$.isCorrect') = 'BOOLEAN' AND json_extract_string(payload, '$.isCorrect') = 'true') AS correct,
  CAST(coalesce(sum(CASE WHEN event_type = 'session_ended' AND CAST(json_extract_string(payload, '$.durationMs') AS DOUBLE) > 0 THEN floor(CAST(json_extract_string(payload, '$.durationMs') AS DOUBLE) + 0.5) END), 0) AS BIGINT) AS duration_ms,
  count(DISTINCT session_id) AS n_sessions FROM learning_events GROUP BY 1, 2"""


@query("L2_daily_roll_up", ROLL_UP)
def l2(t: Tables):
    return A.daily_roll_up(t.learning_events)


@query("D7_daily_summary", f"WITH daily AS ({ROLL_UP}) SELECT student_id, count(*) AS n_days, CAST(sum(solved) AS BIGINT) AS solved, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CASE WHEN sum(solved) > 0 THEN CAST(floor(100.0 * sum(correct) / sum(solved) + 0.5) AS BIGINT) ELSE 0 END AS accuracy FROM daily GROUP BY student_id")
def d7(t: Tables):
    totals = A.daily_roll_up(t.learning_events).groupBy("student_id").agg(F.count("*").alias("n_days"), *(F.sum(c).alias(c) for c in ("solved", "correct", "duration_ms")))
    return totals.withColumn("accuracy", F.when(F.col("solved") > 0, N.js_round(100 * F.col("correct") / F.col("solved"))).otherwise(0))


@query("D8_mean_of_case", "SELECT problem_id, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS mean_correct FROM answers GROUP BY problem_id")
def d8(t: Tables):
    return t.answers.groupBy("problem_id").agg(F.avg(F.when(F.col("is_correct"), 1.0).otherwise(0.0)).alias("mean_correct"))


@query("D9_item_p_value", "SELECT problem_id, count(*) AS attempts, count(*) FILTER (WHERE is_correct) AS correct, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS p_value, count(*) >= 30 AS sufficient FROM answers WHERE is_correct IS NOT NULL GROUP BY problem_id")
def d9(t: Tables):
    return A.item_p_values(t.answers)


DISCRIMINATION = """WITH rates AS (SELECT s.student_id, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS rate FROM answers a JOIN submissions s USING (submission_id) WHERE is_correct IS NOT NULL GROUP BY 1),
  per AS (SELECT a.problem_id, s.student_id, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS own FROM answers a JOIN submissions s USING (submission_id) WHERE is_correct IS NOT NULL GROUP BY 1, 2),
  ranked AS (SELECT problem_id, own, count(*) OVER (PARTITION BY problem_id) AS n, row_number() OVER (PARTITION BY problem_id ORDER BY rate DESC, student_id) AS hi, row_number() OVER (PARTITION BY problem_id ORDER BY rate, student_id DESC) AS lo FROM per JOIN rates USING (student_id))
  SELECT problem_id, max(n) AS n_students, CASE WHEN max(n) >= 4 THEN avg(own) FILTER (WHERE hi <= greatest(1, floor(n * 0.27))) - avg(own) FILTER (WHERE lo <= greatest(1, floor(n * 0.27))) END AS discrimination FROM ranked GROUP BY problem_id"""


@query("D10_discrimination_index", f"SELECT problem_id, n_students, floor(discrimination * 1000000 + 0.5) / 1000000 AS discrimination FROM ({DISCRIMINATION})")
def d10(t: Tables):
    return A.discrimination(t.answers, t.submissions).withColumn("discrimination", N.js_round_n(F.col("discrimination"), 6))


@query("D11_choice_distribution", """SELECT problem_id, CAST(regexp_extract(student_answer, '^\\s*([+-]?\\d+)', 1) AS INTEGER) AS choice, count(*) AS n, CAST(count(*) AS DOUBLE) / any_value(total) AS rate
  FROM (SELECT a.*, count(*) OVER (PARTITION BY problem_id) AS total FROM answers a JOIN problems p USING (problem_id) WHERE student_answer IS NOT NULL AND p.problem_type = 'multiple_choice') GROUP BY 1, 2""")
def d11(t: Tables):
    return A.choice_distribution(t.answers, t.problems.where("problem_type = 'multiple_choice'"))


@query("D12_quality_gate", f"""WITH p AS (SELECT problem_id, count(*) AS attempts, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS p_value FROM answers WHERE is_correct IS NOT NULL GROUP BY problem_id), d AS (SELECT problem_id, discrimination FROM ({DISCRIMINATION})),
  f AS (SELECT problem_id, concat_ws(',', CASE WHEN p_value < 0.1 THEN 'p_value_too_low' END, CASE WHEN p_value > 0.95 THEN 'p_value_too_high' END, CASE WHEN discrimination < 0.2 THEN 'low_discrimination' END) AS flags FROM p LEFT JOIN d USING (problem_id))
  SELECT problem_id, flags, CASE WHEN flags = '' THEN 'calibrated' ELSE 'flagged' END AS quality FROM f""")
def d12(t: Tables):
    return A.quality_gate(A.item_p_values(t.answers), A.discrimination(t.answers, t.submissions))


@query("D13_multi_status_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE review_status = 'approved') AS approved, count(*) FILTER (WHERE review_status = 'auto_approved') AS auto_approved, count(*) FILTER (WHERE review_status = 'pending') AS pending, count(*) FILTER (WHERE review_status = 'rejected') AS rejected, count(*) FILTER (WHERE unit IS NULL) AS unclassified FROM problems")
def d13(t: Tables):
    return t.problems.agg(F.count("*").alias("total"), *(F.count_if(F.col("review_status") == s).alias(s) for s in ("approved", "auto_approved", "pending", "rejected")), F.count_if(F.col("unit").isNull()).alias("unclassified"))


@query("D14_facets", "SELECT 'subject' AS facet, subject AS value FROM problems UNION SELECT 'problem_type', problem_type FROM problems UNION SELECT 'difficulty', CAST(difficulty AS VARCHAR) FROM problems")
def d14(t: Tables):
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("subject", "problem_type", "difficulty"))))
    return t.problems.select(pairs.alias("p")).select("p.facet", "p.value").distinct()


@query("D15_distinct_json_and_array", "SELECT DISTINCT CAST(json_extract_string(source_json, '$.year') AS INTEGER) AS year, unnest(string_split(stem, ' ')) AS tag FROM problems")
def d15(t: Tables):
    return t.problems.select(F.get_json_object("source_json", "$.year").cast("int").alias("year"), F.explode(F.split("stem", " ")).alias("tag")).distinct()


@query("D16_distinct_on", "SELECT student_id, min(submission_id) AS submission_id FROM submissions GROUP BY student_id")
def d16(t: Tables):
    return t.submissions.groupBy("student_id").agg(F.min("submission_id").alias("submission_id"))


@query("D17_count_distinct", "SELECT student_id, count(DISTINCT session_id) AS n_sessions FROM learning_events GROUP BY student_id")
def d17(t: Tables):
    return t.learning_events.groupBy("student_id").agg(F.countDistinct("session_id").alias("n_sessions"))


@query("D18_available_topics", "SELECT DISTINCT subject, unit FROM problems WHERE unit IS NOT NULL AND review_status = 'approved'")
def d18(t: Tables):
    return t.problems.where("unit is not null and review_status = 'approved'").select("subject", "unit").distinct()


@query("D19_attendance_pivot", "SELECT student_id, count(*) FILTER (WHERE status = 'graded') AS graded, count(*) FILTER (WHERE status = 'submitted') AS submitted, count(*) FILTER (WHERE status = 'returned') AS returned FROM submissions GROUP BY student_id")
def d19(t: Tables):
    names = ["graded", "submitted", "returned"]
    return t.submissions.groupBy("student_id").pivot("status", names).agg(F.count(F.lit(1))).na.fill(0, names)


@query("D20_billing_statement", "SELECT class_id, count(*) AS n, CAST(sum(CASE WHEN status = 'graded' THEN 30000 ELSE 20000 END) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN status = 'graded' THEN 30000 END), 0) AS BIGINT) AS paid, CAST(coalesce(sum(CASE WHEN status = 'submitted' THEN 20000 END), 0) AS BIGINT) AS pending FROM submissions GROUP BY class_id")
def d20(t: Tables):
    amount = F.when(F.col("status") == "graded", 30000).otherwise(20000)
    part = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, amount)), F.lit(0))
    return t.submissions.groupBy("class_id").agg(F.count("*").alias("n"), F.sum(amount).alias("total"), part("graded").alias("paid"), part("submitted").alias("pending"))


@query("D21_error_pattern_counts", "SELECT student_id, count(*) FILTER (WHERE k IN (0, 5)) AS concept, count(*) FILTER (WHERE k = 1) AS calculation, count(*) FILTER (WHERE k IN (2, 4)) AS careless, count(*) FILTER (WHERE k IN (3, 6)) AS pattern FROM (SELECT student_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS k FROM learning_events) GROUP BY student_id")
def d21(t: Tables):
    names = F.array(*map(F.lit, ("concept", "calculation", "careless", "pattern", "sign", "formula", "logic", "unknown")))
    events = t.learning_events.withColumn("error_type", F.element_at(names, F.get_json_object("props", "$.k").cast("int") % 8 + 1))
    return A.error_patterns(events, "student_id")


@query("D22_weighted_counts", "SELECT student_id, CAST(sum(CASE WHEN value >= 30 THEN 1.0 ELSE 0.5 END) AS DOUBLE) AS weight FROM learning_events GROUP BY student_id")
def d22(t: Tables):
    return t.learning_events.groupBy("student_id").agg(F.sum(F.when(F.col("value") >= 30, 1.0).otherwise(0.5)).alias("weight"))


@query("D23_unit_accuracy", "SELECT p.subject, p.unit, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS accuracy, count(*) AS attempts FROM answers a JOIN problems p USING (problem_id) WHERE is_correct IS NOT NULL AND p.unit IS NOT NULL GROUP BY 1, 2")
def d23(t: Tables):
    return A.unit_accuracy(t.answers, t.problems)


@query("D24_blended_accuracy", """WITH own AS (SELECT p.unit, count(*) FILTER (WHERE is_correct) AS c, count(*) AS n FROM answers a JOIN problems p USING (problem_id) WHERE is_correct IS NOT NULL AND p.unit IS NOT NULL AND difficulty = 6 GROUP BY 1),
  signals AS (SELECT unit, difficulty / 10.0::DOUBLE AS conf, problem_type = 'essay' AS worked FROM problems WHERE unit IS NOT NULL AND review_status = 'pending'),
  s AS (SELECT unit, sum(CASE WHEN worked THEN 2 * greatest(0.15, 0.42 - 0.2 * conf) ELSE greatest(0.25, 0.58 - 0.25 * conf) END) AS c, sum(CASE WHEN worked THEN 2 ELSE 1 END) AS n FROM signals GROUP BY 1)
  SELECT unit, floor((coalesce(own.c, 0) + coalesce(s.c, 0)) / (coalesce(own.n, 0) + coalesce(s.n, 0)) * 1000000 + 0.5) / 1000000 AS accuracy, CAST(coalesce(own.n, 0) + coalesce(s.n, 0) AS BIGINT) AS attempts FROM own FULL JOIN s USING (unit)""")
def d24(t: Tables):
    own = A.unit_accuracy(t.answers, t.problems.where("difficulty = 6").withColumn("subject", F.lit("all"))).select("unit", "accuracy", "attempts")
    signals = t.problems.where("unit is not null and review_status = 'pending'").select("unit", (F.col("difficulty") / 10).alias("confidence"), (F.col("problem_type") == "essay").alias("worked"))
    return A.blended_accuracy(own, signals).withColumn("accuracy", N.js_round_n(F.col("accuracy"), 6))


@query("D25_mode", "SELECT class_id, status FROM (SELECT class_id, status, row_number() OVER (PARTITION BY class_id ORDER BY count(*) DESC, status) AS n FROM submissions GROUP BY 1, 2) WHERE n = 1")
def d25(t: Tables):
    counts = t.submissions.groupBy("class_id", "status").agg(F.count("*").alias("n"))
    return counts.groupBy("class_id").agg(F.min_by("status", F.struct(-F.col("n"), "status")).alias("status"))


@query("D26_mean_of_means", """WITH s AS (SELECT class_id, student_id, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS acc FROM answers a JOIN submissions USING (submission_id) WHERE is_correct IS NOT NULL GROUP BY 1, 2)
  SELECT class_id, floor(avg(acc) * 1000000 + 0.5) / 1000000 AS mean_accuracy, count(*) AS n_students FROM s GROUP BY 1""")
def d26(t: Tables):
    joined = t.answers.where("is_correct is not null").join(t.submissions, "submission_id")
    each = joined.groupBy("class_id", "student_id").agg(F.avg(F.col("is_correct").cast("double")).alias("acc"))
    return each.groupBy("class_id").agg(N.js_round_n(F.avg("acc"), 6).alias("mean_accuracy"), F.count("*").alias("n_students"))


@query("D27_weekly_parent_report", """WITH sub AS (SELECT student_id, date_trunc('week', submitted_at) AS week, count(*) AS n, count(*) FILTER (WHERE status <> 'submitted') AS done, floor(sum(score) / count(score) * 10 + 0.5) / 10 AS avg_score FROM submissions GROUP BY 1, 2),
  ans AS (SELECT s.student_id, date_trunc('week', s.submitted_at) AS week, count(a.is_correct) AS solved, count(*) FILTER (WHERE a.is_correct) AS good FROM answers a JOIN submissions s USING (submission_id) GROUP BY 1, 2)
  SELECT student_id, CAST(week AS DATE) AS week, CAST(floor(100.0 * done / n + 0.5) AS BIGINT) AS completion, avg_score, coalesce(solved, 0) AS solved,
    CASE WHEN solved > 0 THEN CAST(floor(100.0 * good / solved + 0.5) AS BIGINT) END AS correct_rate, CASE WHEN coalesce(solved, 0) = 0 THEN NULL WHEN floor(100.0 * good / solved + 0.5) < 50 THEN 'red' WHEN floor(100.0 * good / solved + 0.5) < 75 THEN 'yellow' ELSE 'green' END AS color
  FROM sub LEFT JOIN ans USING (student_id, week)""")
def d27(t: Tables):
    return A.weekly_report(t.submissions, t.answers)


@query("D28_wrong_answer_stats", """SELECT s.student_id, count(*) AS total, count(*) FILTER (WHERE grader_id % 2 = 0) AS resolved, count(*) FILTER (WHERE answered_at >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY) AS recent FROM answers a JOIN submissions s USING (submission_id) WHERE is_correct = false GROUP BY 1""")
def d28(t: Tables):
    wrong = t.answers.where("is_correct = false").join(t.submissions.select("submission_id", "student_id"), "submission_id")
    since = F.lit("2000-01-01").cast("timestamp") - F.expr("interval 30 days")
    return wrong.groupBy("student_id").agg(F.count("*").alias("total"), F.count_if(F.col("grader_id") % 2 == 0).alias("resolved"), F.count_if(F.col("answered_at") >= since).alias("recent"))


@query("D29_review_stats", "SELECT student_id, count(*) FILTER (WHERE client_ts <= TIMESTAMP '2024-01-15') AS due, count(*) FILTER (WHERE client_ts > TIMESTAMP '2024-01-15' AND client_ts <= TIMESTAMP '2024-01-16') AS today, count(*) FILTER (WHERE client_ts > TIMESTAMP '2024-01-15' AND client_ts <= TIMESTAMP '2024-01-22') AS this_week, count(*) AS total FROM learning_events GROUP BY student_id")
def d29(t: Tables):
    until = lambda a, b: F.count_if((F.col("client_ts") > F.lit(a).cast("timestamp")) & (F.col("client_ts") <= F.lit(b).cast("timestamp")))
    return t.learning_events.groupBy("student_id").agg(until("1970-01-01", "2024-01-15").alias("due"), until("2024-01-15", "2024-01-16").alias("today"), until("2024-01-15", "2024-01-22").alias("this_week"), F.count("*").alias("total"))


@query("D30_mastery_dashboard", """WITH m AS (SELECT s.student_id, p.node_id, count(*) FILTER (WHERE is_correct) AS c, count(*) AS n FROM answers a JOIN submissions s USING (submission_id) JOIN problems p USING (problem_id) WHERE is_correct IS NOT NULL GROUP BY 1, 2)
  SELECT student_id, count(*) FILTER (WHERE c >= 3 AND c = n) AS mastered, count(*) FILTER (WHERE NOT (c >= 3 AND c = n)) AS started, 25 - count(*) AS not_started, CAST(floor(100.0 * count(*) FILTER (WHERE c >= 3 AND c = n) / 25 + 0.5) AS BIGINT) AS progress FROM m GROUP BY 1""")
def d30(t: Tables):
    joined = t.answers.where("is_correct is not null").join(t.submissions, "submission_id").join(t.problems, "problem_id")
    each = joined.groupBy("student_id", "node_id").agg(F.count_if("is_correct").alias("c"), F.count("*").alias("n"))
    done = F.count_if((F.col("c") >= 3) & (F.col("c") == F.col("n")))
    counts = each.groupBy("student_id").agg(done.alias("mastered"), F.count("*").alias("tracked"))
    return counts.select("student_id", "mastered", (F.col("tracked") - F.col("mastered")).alias("started"), (25 - F.col("tracked")).alias("not_started"), N.js_round(100 * F.col("mastered") / 25).alias("progress"))


@query("D31_grade_prediction", """WITH recent AS (SELECT student_id, submission_id, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, submission_id DESC) AS n FROM submissions WHERE status = 'graded'),
  w AS (SELECT r.student_id, count(*) AS n, CAST(sum(CASE WHEN is_correct THEN difficulty ELSE 0 END) AS DOUBLE) / sum(difficulty) AS acc FROM recent r JOIN answers a USING (submission_id) JOIN problems p USING (problem_id) WHERE r.n <= 50 AND is_correct IS NOT NULL GROUP BY 1)
  SELECT student_id, CAST(floor(acc * 100 + 0.5) AS BIGINT) AS predicted_score, CASE WHEN acc * 100 >= 91.5 THEN 1 WHEN acc * 100 >= 84.5 THEN 2 WHEN acc * 100 >= 75.5 THEN 3 WHEN acc * 100 >= 63.5 THEN 4 WHEN acc * 100 >= 49.5 THEN 5 WHEN acc * 100 >= 35.5 THEN 6 WHEN acc * 100 >= 23.5 THEN 7 WHEN acc * 100 >= 11.5 THEN 8 ELSE 9 END AS grade, least(1.0, n / 50.0)::DOUBLE AS confidence FROM w""")
def d31(t: Tables):
    return A.grade_prediction(t.submissions, t.answers, t.problems)


@query("D32_smart_score", """WITH a AS (SELECT n.submission_id, n.answer_no, n.is_correct, p.unit, p.difficulty FROM numbered_answers n JOIN problems p USING (problem_id) WHERE n.is_correct IS NOT NULL),
  base AS (SELECT submission_id, count(*) AS n, count(*) FILTER (WHERE is_correct) AS c, avg([0.6, 0.8, 1.0, 1.3, 1.6, 1.8][difficulty]::DOUBLE) AS d FROM a GROUP BY 1),
  topics AS (SELECT submission_id, count(*) AS k, max(acc) - min(acc) AS spread FROM (SELECT submission_id, coalesce(unit, '?') AS unit, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS acc FROM a GROUP BY 1, 2) GROUP BY 1),
  runs AS (SELECT submission_id, max(len) AS longest FROM (SELECT submission_id, g, count(*) AS len FROM (SELECT submission_id, is_correct, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY submission_id ORDER BY answer_no) AS g FROM a) WHERE is_correct GROUP BY 1, 2) GROUP BY 1)
  SELECT submission_id, floor(round(greatest(0, least(100, 100.0::DOUBLE * c / n * d * (1 + CASE WHEN k >= 2 AND spread < 0.15 THEN 0.05 ELSE 0 END + least(0.1, 0.005::DOUBLE * coalesce(longest, 0))))), 9) * 10 + 0.5) / 10 AS smart_score FROM base LEFT JOIN topics USING (submission_id) LEFT JOIN runs USING (submission_id)""")
def d32(t: Tables):
    return A.smart_scores(t.numbered_answers, t.problems)


@query("D33_auto_grade", """SELECT s.submission_id, CASE WHEN bool_or(p.problem_type = 'essay') THEN 'submitted' ELSE 'graded' END AS status, CASE WHEN NOT bool_or(p.problem_type = 'essay') THEN 100.0 * count(*) FILTER (WHERE lower(trim(a.student_answer)) = CAST(p.problem_id % 7 AS VARCHAR)) / count(*) END::DOUBLE AS score
  FROM answers a JOIN submissions s USING (submission_id) JOIN problems p USING (problem_id) GROUP BY 1""")
def d33(t: Tables):
    key = t.problems.select("problem_id", "problem_type", (F.col("problem_id") % 7).cast("string").alias("answer_key"))
    return A.auto_grade(t.answers, key, 100.0)


@query("D34_page_line_counts", "SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines FROM documents")
def d34(t: Tables):
    return t.documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))


@query("D35_batch_outcome_counts", "SELECT CAST(floor(problem_id / 50) AS BIGINT) AS batch, count(*) FILTER (WHERE review_status = 'auto_approved') AS auto, count(*) FILTER (WHERE review_status <> 'rejected') AS completed, count(*) FILTER (WHERE review_status = 'rejected') AS failed FROM problems GROUP BY 1")
def d35(t: Tables):
    status = F.col("review_status")
    return t.problems.groupBy(F.floor(F.col("problem_id") / 50).alias("batch")).agg(F.count_if(status == "auto_approved").alias("auto"), F.count_if(status != "rejected").alias("completed"), F.count_if(status == "rejected").alias("failed"))


@query("D36_score_histogram", "SELECT CAST(least(floor(score / max_score * 5), 4) AS BIGINT) AS bucket, count(*) AS n FROM submissions WHERE score IS NOT NULL GROUP BY 1")
def d36(t: Tables):
    bucket = F.least(F.floor(F.col("score") / F.col("max_score") * 5), F.lit(4).cast("long"))
    return t.submissions.where("score is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("D37_largest_remainder", """WITH w AS (SELECT subject, unit, count(*) AS pct FROM problems WHERE unit IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, 20.0 * pct / sum(pct) OVER (PARTITION BY subject) AS quota FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY floor((quota - floor(quota)) * 1e9 + 0.5) DESC, unit) AS k, 20 - sum(floor(quota)) OVER (PARTITION BY subject) AS rest FROM q)
  SELECT subject, unit, CAST(floor(quota) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r""")
def d37(t: Tables):
    weights = t.problems.where("unit is not null").groupBy("subject", "unit").agg(F.count("*").alias("percentage"))
    return A.largest_remainder(weights, ["subject"], "unit", "percentage", 20).select("subject", "unit", "seats")


@query("D38_rubric_apportion", "SELECT class_id, i + 1 AS step, CAST(10 // (1 + class_id % 6) + CASE WHEN i < 10 % (1 + class_id % 6) THEN 1 ELSE 0 END AS BIGINT) AS points FROM classes, unnest(range(0, 1 + class_id % 6)) u(i)")
def d38(t: Tables):
    steps = 1 + F.col("class_id") % 6
    each = t.classes.select("class_id", steps.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), (steps - 1).cast("long"))).alias("i"))
    return each.select("class_id", (F.col("i") + 1).alias("step"), (F.expr("10 div n") + F.when(F.col("i") < 10 % F.col("n"), 1).otherwise(0)).alias("points"))


@query("A9_event_validation", "SELECT event_type, count(*) FILTER (WHERE client_ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20' + INTERVAL 30 SECOND) AS accepted, count(*) FILTER (WHERE NOT client_ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20' + INTERVAL 30 SECOND) AS rejected FROM learning_events WHERE event_type IN ('session_started', 'answer_submitted', 'session_ended') GROUP BY event_type")
def a9(t: Tables):
    from ..streaming.events import acceptable

    now = F.lit("2024-01-20").cast("timestamp")
    typed = t.learning_events.where(F.col("event_type").isin("session_started", "answer_submitted", "session_ended"))
    return typed.groupBy("event_type").agg(F.count_if(acceptable(F.col("client_ts"), now)).alias("accepted"), F.count_if(~acceptable(F.col("client_ts"), now)).alias("rejected"))
