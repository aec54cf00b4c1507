"""Set-based reports: every student, class or problem in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from .tables import group_ranks

UNCLASSIFIED = "unclassified"


def graded_answers(answers: DataFrame, submissions: DataFrame) -> DataFrame:
    return answers.where("is_correct is not null").join(submissions.where("status in ('graded', 'returned')").select("submission_id", "student_id"), "submission_id")


def accuracy_by_unit(answers: DataFrame, submissions: DataFrame, problems: DataFrame) -> DataFrame:
    """student_id, unit, total, correct and accuracy (whole percent) of graded answers; ungraded ones do not count."""
    joined = graded_answers(answers, submissions).join(problems.select("problem_id", "unit"), "problem_id", "left")
    grouped = joined.groupBy("student_id", F.coalesce("unit", F.lit(UNCLASSIFIED)).alias("unit"))
    return grouped.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct")).withColumn("accuracy", N.js_round(100 * F.col("correct") / F.col("total")))


def weak_units(accuracy: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """The lowest units of each student, of those answered often enough."""
    w = Window.partitionBy("student_id").orderBy("accuracy", "unit")
    return accuracy.where(F.col("total") >= least).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def daily_roll_up(events: DataFrame, day: Column | None = None) -> DataFrame:
    """Counts of one student's UTC day.  Sessions count over all event types; only JSON booleans and numbers count as such."""
    answer = F.col("event_type") == "answer_submitted"
    given = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.isCorrect", "variant"))
    duration = N.json_number(F.col("payload"), "$.durationMs")
    grouped = events.groupBy("student_id", (day if day is not None else F.to_date("client_ts")).alias("day"))
    return grouped.agg(
        F.count_if(F.col("event_type") == "session_started").alias("viewed"),
        F.count_if(answer & (given != "VOID")).alias("solved"),
        F.count_if(answer & N.json_boolean(F.col("payload"), "$.isCorrect")).alias("correct"),
        F.coalesce(F.sum(F.when((F.col("event_type") == "session_ended") & (duration > 0), N.js_round(duration))), F.lit(0)).alias("duration_ms"),
        F.countDistinct("session_id").alias("n_sessions"),
    )


def item_p_values(answers: DataFrame, least: int = 30) -> DataFrame:
    grouped = answers.where("is_correct is not null").groupBy("problem_id").agg(F.count("*").alias("attempts"), F.count_if("is_correct").alias("correct"))
    return grouped.withColumns({"p_value": F.col("correct") / F.col("attempts"), "sufficient": F.col("attempts") >= least})


def discrimination(answers: DataFrame, submissions: DataFrame, share: float = 0.27, least: int = 4) -> DataFrame:
    """Mean correctness of the best share of a problem's students less that of the worst; ties by student_id."""
    joined = answers.where("is_correct is not null").join(submissions.select("submission_id", "student_id"), "submission_id")
    own = joined.groupBy("problem_id", "student_id").agg(F.count_if("is_correct").alias("c"), F.count("*").alias("n"))
    rates = own.groupBy("student_id").agg((F.sum("c") / F.sum("n")).alias("rate"))
    each = own.withColumn("own", F.col("c") / F.col("n")).join(rates, "student_id")
    ranked = group_ranks(each.select("problem_id", "student_id", "own", "rate"), ["problem_id"], [F.desc("rate"), F.col("student_id")], "hi", "n_students")
    # the worst are the last in the one order
    cut = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_students") * share))
    best, worst = F.col("hi") <= cut, F.col("hi") > F.col("n_students") - cut
    grouped = ranked.groupBy("problem_id", "n_students").agg((F.avg(F.when(best, F.col("own"))) - F.avg(F.when(worst, F.col("own")))).alias("d"))
    return grouped.select("problem_id", "n_students", F.when(F.col("n_students") >= least, F.col("d")).alias("discrimination"))


def choice_distribution(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """Share of each parsed choice among all answers that are not null, parseable or not."""
    given = answers.where("student_answer is not null").join(problems.select("problem_id"), "problem_id", "left_semi")
    counts = given.groupBy("problem_id", N.leading_int(F.col("student_answer")).alias("choice")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("problem_id"))
    return counts.withColumn("rate", F.col("n") / total).where("choice is not null")


# Limits of the quality gate.
LOW_P, HIGH_P, LOW_D = 0.10, 0.95, 0.20


def quality_gate(p_values: DataFrame, discriminations: DataFrame) -> DataFrame:
    joined = p_values.select("problem_id", "p_value").join(discriminations.select("problem_id", "discrimination"), "problem_id", "left")
    flags = F.concat_ws(",", F.when(F.col("p_value") < LOW_P, "p_value_too_low"), F.when(F.col("p_value") > HIGH_P, "p_value_too_high"), F.when(F.col("discrimination") < LOW_D, "low_discrimination"))
    return joined.select("problem_id", flags.alias("flags")).withColumn("quality", F.when(F.col("flags") == "", "calibrated").otherwise("flagged"))


# Which of four patterns a detailed error type belongs to.
ERROR_PATTERNS = {"concept": "concept", "calculation": "calculation", "careless": "careless", "pattern": "pattern", "sign": "careless", "formula": "concept", "logic": "pattern"}


def error_patterns(df: DataFrame, key: str) -> DataFrame:
    """Counts of the four patterns for each key; unknown types count nowhere."""
    names = ["concept", "calculation", "careless", "pattern"]
    return df.groupBy(key).agg(*(F.count_if(F.col("error_type").isin(*[k for k, v in ERROR_PATTERNS.items() if v == n])).alias(n) for n in names))


def unit_accuracy(answers: DataFrame, problems: DataFrame) -> DataFrame:
    joined = answers.where("is_correct is not null").join(problems.where("unit is not null and subject is not null").select("problem_id", "subject", "unit"), "problem_id")
    return joined.groupBy("subject", "unit").agg((F.count_if("is_correct") / F.count("*")).alias("accuracy"), F.count("*").alias("attempts"))


def blended_accuracy(own: DataFrame, signals: DataFrame) -> DataFrame:
    """unit, accuracy, attempts with the pseudo-attempts of tutor signals: two for a worked solution, one otherwise."""
    c = F.col("confidence")
    rate = F.when(F.col("worked"), F.greatest(F.lit(0.15), 0.42 - 0.2 * c)).otherwise(F.greatest(F.lit(0.25), 0.58 - 0.25 * c))
    weight = F.when(F.col("worked"), 2).otherwise(1)
    pseudo = signals.groupBy("unit").agg(F.sum(weight * rate).alias("c"), F.sum(weight).alias("n"))
    real = own.select("unit", (F.col("accuracy") * F.col("attempts")).alias("c"), F.col("attempts").alias("n"))
    both = real.unionByName(pseudo).groupBy("unit").agg(F.sum("c").alias("c"), F.sum("n").alias("attempts"))
    return both.select("unit", (F.col("c") / F.col("attempts")).alias("accuracy"), "attempts")


def weekly_report(submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each student and Monday week: completion, average, solved, correct rate and its colour."""
    week = F.date_trunc("week", "submitted_at")
    done = submissions.groupBy("student_id", week.alias("week")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "submitted").alias("done"), N.js_round_n(F.avg("score"), 1).alias("avg_score")
    )
    joined = answers.join(submissions.select("submission_id", "student_id", week.alias("week")), "submission_id")
    solved = joined.groupBy("student_id", "week").agg(F.count("is_correct").alias("solved"), F.count_if("is_correct").alias("good"))
    rate = F.when(F.col("solved") > 0, N.js_round(100 * F.col("good") / F.col("solved")))
    color = F.when(F.col("correct_rate") < 50, "red").when(F.col("correct_rate") < 75, "yellow").when(F.col("correct_rate").isNotNull(), "green")
    report = done.join(solved, ["student_id", "week"], "left").withColumn("correct_rate", rate)
    return report.select("student_id", F.to_date("week").alias("week"), N.js_round(100 * F.col("done") / F.col("n")).alias("completion"), "avg_score", F.coalesce("solved", F.lit(0)).alias("solved"), "correct_rate", color.alias("color"))


# Least score of the grades one to nine.
GRADE_CUTS = (92, 85, 76, 64, 50, 36, 24, 12, 0)


def grade_prediction(submissions: DataFrame, answers: DataFrame, problems: DataFrame, recent: int = 50) -> DataFrame:
    """Difficulty-weighted accuracy over a student's newest graded submissions, its grade and confidence."""
    newest = Window.partitionBy("student_id").orderBy(F.desc("submitted_at"), F.desc("submission_id"))
    chosen = submissions.where("status = 'graded'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= recent).select("submission_id", "student_id")
    joined = answers.where("is_correct is not null").join(chosen, "submission_id").join(problems.select("problem_id", "difficulty"), "problem_id")
    sums = joined.groupBy("student_id").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("is_correct"), F.col("difficulty")).otherwise(0)) / F.sum("difficulty")).alias("acc"))
    score = N.js_round(F.col("acc") * 100)
    grade = F.lit(len(GRADE_CUTS))
    for g, cut in reversed(list(enumerate(GRADE_CUTS, start=1))):
        grade = F.when(score >= cut, g).otherwise(grade)
    return sums.select("student_id", score.alias("predicted_score"), grade.alias("grade"), F.least(F.lit(1.0), F.col("n") / recent).alias("confidence"))


def longest_run(answers: DataFrame, key: str, order: str) -> DataFrame:
    """The longest run of correct answers of each key: every wrong answer opens a new island."""
    island = F.sum(F.when(F.col("is_correct"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy(order))
    runs = answers.withColumn("island", island).where("is_correct").groupBy(key, "island").agg(F.count("*").alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("longest"))


# Weight of the difficulties one to six.
DIFFICULTY_WEIGHTS = (0.6, 0.8, 1.0, 1.3, 1.6, 1.8)


def smart_scores(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """Accuracy weighted by difficulty, with bonuses for even topics and for a long run; 0 to 100, one decimal."""
    joined = answers.where("is_correct is not null").join(problems.select("problem_id", "unit", "difficulty"), "problem_id")
    weight = F.get(F.array(*map(F.lit, DIFFICULTY_WEIGHTS)), F.col("difficulty") - 1)
    base = joined.groupBy("submission_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.coalesce(F.avg(weight), F.lit(1.0)).alias("d"))
    topics = joined.groupBy("submission_id", F.coalesce("unit", F.lit(UNCLASSIFIED)).alias("unit")).agg((F.count_if("is_correct") / F.count("*")).alias("acc"))
    spread = topics.groupBy("submission_id").agg(F.count("*").alias("k"), (F.max("acc") - F.min("acc")).alias("spread"))
    runs = longest_run(joined, "submission_id", "answer_no")
    bonus = 1 + F.when((F.col("k") >= 2) & (F.col("spread") < 0.15), 0.05).otherwise(0) + F.least(F.lit(0.1), 0.005 * F.coalesce("longest", F.lit(0)))
    score = N.clamp(100 * F.col("c") / F.col("n") * F.col("d") * bonus, 0.0, 100.0)
    return base.join(spread, "submission_id", "left").join(runs, "submission_id", "left").select("submission_id", N.js_round_n(F.round(score, 9), 1).alias("smart_score"))


def auto_grade(answers: DataFrame, keys: DataFrame, max_score: float) -> DataFrame:
    """One answer that cannot be graded leaves its whole submission ungraded."""
    joined = answers.join(keys, "problem_id")
    right = F.count_if(N.normalized_answer(F.col("student_answer")) == N.normalized_answer(F.col("answer_key")))
    grouped = joined.groupBy("submission_id").agg(F.bool_or(F.col("problem_type") == "essay").alias("open"), right.alias("c"), F.count("*").alias("n"))
    return grouped.select("submission_id", F.when(F.col("open"), "submitted").otherwise("graded").alias("status"), F.when(~F.col("open"), max_score * F.col("c") / F.col("n")).alias("score"))


def largest_remainder(weights: DataFrame, keys: list[str], item: str, weight: str, seats: int) -> DataFrame:
    """Seats in proportion to weight; what flooring leaves goes to the largest fractions, ties in item order."""
    per = Window.partitionBy(*keys)
    total = F.sum(weight).over(per)
    quota = F.when(total > 0, seats * F.col(weight) / total).otherwise(F.lit(seats) / F.count("*").over(per))
    out = weights.withColumn("__quota", quota).withColumn("__whole", F.floor("__quota"))
    fraction = F.floor((F.col("__quota") - F.col("__whole")) * 1e9 + 0.5)
    out = out.withColumn("__place", F.row_number().over(per.orderBy(fraction.desc(), item))).withColumn("__rest", seats - F.sum("__whole").over(per))
    return out.withColumn("seats", F.col("__whole") + F.when(F.col("__place") <= F.col("__rest"), 1).otherwise(0)).drop("__quota", "__whole", "__place", "__rest")
