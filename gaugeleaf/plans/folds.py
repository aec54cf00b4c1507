"""Ordered state for each student."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import folds as K
from ..sources.domain import Tables
from .registry import query

ORDERED = "SELECT s.student_id, n.submission_id, n.answer_no, n.problem_id, n.is_correct, n.answered_at FROM numbered_answers n JOIN submissions s USING (submission_id) WHERE n.is_correct IS NOT NULL"


def ordered_answers(t: Tables):
    return t.numbered_answers.where("is_correct is not null").join(t.submissions.select("submission_id", "student_id"), "submission_id")


@query("K1_mastery", f"""WITH o AS ({ORDERED}), a AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY submission_id, answer_no) AS attempt FROM o),
  s AS (SELECT *, attempt - coalesce(max(CASE WHEN NOT is_correct THEN attempt END) OVER (PARTITION BY student_id ORDER BY attempt), 0) AS streak FROM a)
  SELECT submission_id, answer_no, CAST(attempt AS INTEGER) AS attempt, CAST(streak AS INTEGER) AS streak, CASE WHEN streak >= 3 THEN 'mastered' WHEN attempt >= 3 THEN 'practicing' ELSE 'learning' END AS state FROM s""")
def k1(t: Tables):
    return K.mastery(ordered_answers(t), ["student_id"], ["submission_id", "answer_no"]).select("submission_id", "answer_no", "attempt", "streak", "state")


@query("K2_sm2", """WITH RECURSIVE r AS (SELECT submission_id, answer_no, problem_id % 6 AS q FROM numbered_answers),
  f AS (SELECT submission_id, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS e, 0 AS n FROM (SELECT DISTINCT submission_id FROM r)
    UNION ALL SELECT f.submission_id, f.k + 1, CASE WHEN q >= 3 THEN CASE WHEN f.n = 0 THEN 1 WHEN f.n = 1 THEN 6 ELSE CAST(floor(f.i * f.e + 0.5) AS BIGINT) END ELSE 1 END,
      greatest(1.3::DOUBLE, f.e + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)), CASE WHEN q >= 3 THEN f.n + 1 ELSE 0 END FROM f JOIN r ON r.submission_id = f.submission_id AND r.answer_no = f.k + 1)
  SELECT submission_id, i AS "interval", floor(e * 1000000 + 0.5) / 1000000 AS ease_factor, n AS repetitions FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY k DESC) AS z FROM f) WHERE z = 1""")
def k2(t: Tables):
    reviews = t.numbered_answers.withColumn("quality", F.col("problem_id") % 6)
    return K.sm2(reviews, "submission_id", ["answer_no"], "quality").withColumn("ease_factor", N.js_round_n(F.col("ease_factor"), 6))


@query("K3_irt", """WITH RECURSIVE r AS (SELECT submission_id, CAST(row_number() OVER (PARTITION BY submission_id ORDER BY answer_no) AS BIGINT) AS z, is_correct, difficulty - 3.5::DOUBLE AS b FROM numbered_answers JOIN problems USING (problem_id) WHERE is_correct IS NOT NULL),
  f AS (SELECT submission_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS theta, CAST(1 AS DOUBLE) AS se FROM (SELECT DISTINCT submission_id FROM r)
    UNION ALL SELECT submission_id, n, theta, 1 / sqrt(n * greatest(1 / (1 + exp(b - was)) * (1 - 1 / (1 + exp(b - was))), 0.01::DOUBLE)) FROM (
      SELECT f.submission_id, f.n + 1 AS n, r.b, f.theta AS was, greatest(-3::DOUBLE, least(3::DOUBLE, f.theta + greatest(-1::DOUBLE, least(1::DOUBLE, (CASE WHEN r.is_correct THEN 1 ELSE 0 END - 1 / (1 + exp(r.b - f.theta))) / (1 / (1 + exp(r.b - f.theta)) * (1 - 1 / (1 + exp(r.b - f.theta)))))))) AS theta
      FROM f JOIN r ON r.submission_id = f.submission_id AND r.z = f.n + 1))
  SELECT submission_id, floor(theta * 1000000 + 0.5) / 1000000 AS theta, floor(se * 1000000 + 0.5) / 1000000 AS se, CAST(n AS INTEGER) AS responses FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY n DESC) AS y FROM f) WHERE y = 1""")
def k3(t: Tables):
    answers = t.numbered_answers.where("is_correct is not null").join(t.problems.select("problem_id", "difficulty"), "problem_id")
    out = K.irt(answers, "submission_id", ["answer_no"])
    return out.withColumns({c: N.js_round_n(F.col(c), 6) for c in ("theta", "se")})


@query("K4_ability_profile", """SELECT student_id, CAST(floor((theta + 3) / 6 * 100 + 0.5) AS BIGINT) AS score, CAST(least(5, floor(floor((theta + 3) / 6 * 100 + 0.5) / 20) + 1) AS BIGINT) AS level,
  CAST(greatest(1, floor(greatest(1, least(6, theta + 3.5)) - 0.5)) AS BIGINT) AS next_low, CAST(least(6, ceil(greatest(1, least(6, theta + 3.5)) + 0.5)) AS BIGINT) AS next_high, n >= 25 AS done
  FROM (SELECT student_id, count(*) AS n, 6.0::DOUBLE * count(*) FILTER (WHERE is_correct) / count(*) - 3 AS theta FROM answers JOIN submissions USING (submission_id) WHERE is_correct IS NOT NULL GROUP BY 1)""")
def k4(t: Tables):
    theta = 6 * F.count_if("is_correct") / F.count("*") - 3
    each = ordered_answers(t).groupBy("student_id").agg(F.count("*").alias("n"), theta.alias("theta"))
    return K.ability_profile(each).select("student_id", "score", "level", "next_low", "next_high", (F.col("n") >= 25).alias("done"))


STREAKS = """WITH d AS (SELECT DISTINCT student_id, CAST(client_ts AS DATE) AS day FROM learning_events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY student_id ORDER BY day) AS INTEGER) AS island FROM d),
  r AS (SELECT student_id, island, count(*) AS run, max(day) AS last FROM g GROUP BY 1, 2) SELECT student_id, max_by(run, last) AS current, max(run) AS longest FROM r GROUP BY 1"""


@query("K5_daily_streak", STREAKS)
def k5(t: Tables):
    return K.daily_streaks(t.learning_events.withColumn("day", F.to_date("client_ts")), "student_id", "day")


@query("K6_xp_level", "SELECT event_id, CAST(xp AS BIGINT) AS xp, xp // 100 + 1 AS level, xp // 100 > (xp - gain) // 100 AS leveled_up FROM (SELECT event_id, gain, CAST(sum(gain) OVER (PARTITION BY student_id ORDER BY client_ts, event_id) AS BIGINT) AS xp FROM (SELECT *, CASE event_type WHEN 'answer_submitted' THEN 10 ELSE 2 END AS gain FROM learning_events))")
def k6(t: Tables):
    gains = t.learning_events.withColumn("gain", F.when(F.col("event_type") == "answer_submitted", 10).otherwise(2))
    return K.xp_levels(gains, "student_id", ["client_ts", "event_id"]).select("event_id", "xp", "level", "leveled_up")


@query("K7_wrong_answer_lifecycle", f"SELECT student_id, problem_id, count(*) AS tries, count(*) FILTER (WHERE NOT is_correct) AS wrong, max_by(is_correct, (answered_at, submission_id, answer_no)) AS resolved FROM ({ORDERED}) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT is_correct) > 0")
def k7(t: Tables):
    return K.wrong_answer_states(ordered_answers(t), ["student_id", "problem_id"], ["answered_at", "submission_id", "answer_no"])


@query("K9_resume_point", "SELECT submission_id, max(answer_no) AS furthest, 7 - max(answer_no) AS remaining FROM numbered_answers WHERE is_correct AND answer_no <= 7 GROUP BY 1")
def k9(t: Tables):
    done = t.numbered_answers.where("is_correct and answer_no <= 7")
    return done.groupBy("submission_id").agg(F.max("answer_no").alias("furthest")).withColumn("remaining", 7 - F.col("furthest"))


@query("K11_result_routing", "SELECT e.event_id, coalesce(d.submission_id, p.submission_id) AS submission_id FROM (SELECT event_id, student_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS direct FROM learning_events) e LEFT JOIN submissions d ON d.submission_id = e.direct LEFT JOIN (SELECT student_id, min(submission_id) AS submission_id FROM submissions GROUP BY 1) p ON p.student_id = e.student_id")
def k11(t: Tables):
    events = t.learning_events.select("event_id", "student_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("direct"))
    direct = t.submissions.select(F.col("submission_id").alias("direct"), F.col("submission_id").alias("a"))
    first = t.submissions.groupBy("student_id").agg(F.min("submission_id").alias("b"))
    return events.join(direct, "direct", "left").join(first, "student_id", "left").select("event_id", F.coalesce("a", "b").alias("submission_id"))
