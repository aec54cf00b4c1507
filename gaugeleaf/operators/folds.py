"""Ordered state for each student: mastery, spaced repetition, ability, streaks, experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics as N


def mastery(answers: DataFrame, keys: list[str], order: list[str], run: int = 3) -> DataFrame:
    """State after each answer.  A run of right answers masters; the next wrong one loses it.

    The run's length is closed-form: rows since the last wrong answer.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = answers.withColumn("attempt", F.row_number().over(w))
    last_wrong = F.max(F.when(~F.col("is_correct"), F.col("attempt"))).over(w)
    streak = F.col("attempt") - F.coalesce(last_wrong, F.lit(0))
    out = numbered.withColumn("streak", streak)
    return out.withColumn("state", F.when(F.col("streak") >= run, "mastered").when(F.col("attempt") >= 3, "practicing").otherwise("learning"))


def mastered_at(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest change into mastery of each key."""
    w = Window.partitionBy(*keys).orderBy("attempt")
    entered = (F.col("state") == "mastered") & (F.coalesce(F.lag("state").over(w), F.lit("")) != "mastered")
    return states.withColumn("entered", entered).groupBy(*keys).agg(F.max(F.when(F.col("entered"), F.col(order))).alias("mastered_at"))


def ordered_values(value: str, *order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda r: r[value])


def sm2(reviews: DataFrame, key: str, order: list[str], quality: str) -> DataFrame:
    """interval, ease and repetitions after all reviews of each key.  The interval grows by the ease before the review."""

    def step(s: Column, q: Column) -> Column:
        passed = q >= 3
        ease = F.greatest(F.lit(1.3), s["ease"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        grown = F.when(s["reps"] == 0, 1).when(s["reps"] == 1, 6).otherwise(N.js_round(s["interval"] * s["ease"]))
        return F.struct(F.when(passed, grown).otherwise(1).cast("long").alias("interval"), ease.alias("ease"), F.when(passed, s["reps"] + 1).otherwise(0).cast("int").alias("reps"))

    start = F.struct(F.lit(1).cast("long").alias("interval"), F.lit(2.5).alias("ease"), F.lit(0).alias("reps"))
    folded = reviews.groupBy(key).agg(F.aggregate(ordered_values(quality, *order), start, step).alias("s"))
    return folded.select(key, "s.interval", F.col("s.ease").alias("ease_factor"), F.col("s.reps").alias("repetitions"))


def irt(answers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """theta and standard error after all answers of each key: one Newton step an answer, at most one unit wide."""

    def step(s: Column, a: Column) -> Column:
        b = a["difficulty"] - 3.5
        p = N.logistic(s["theta"] - b)
        info = p * (1 - p)
        right = F.when(a["is_correct"], 1.0).otherwise(0.0)
        move = F.when(info < 0.001, F.when(a["is_correct"], 0.5).otherwise(-0.5)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (right - p) / info)))
        theta = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), s["theta"] + move))
        n = s["n"] + 1
        se = F.when(info < 0.001, s["se"]).otherwise(1 / F.sqrt(n * F.greatest(info, F.lit(0.01))))
        return F.struct(theta.alias("theta"), se.alias("se"), n.alias("n"))

    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, "difficulty", "is_correct"))), lambda r: F.struct(r["difficulty"].alias("difficulty"), r["is_correct"].alias("is_correct")))
    start = F.struct(F.lit(0.0).alias("theta"), F.lit(1.0).alias("se"), F.lit(0).alias("n"))
    folded = answers.groupBy(key).agg(F.aggregate(rows, start, step).alias("s"))
    return folded.select(key, "s.theta", "s.se", F.col("s.n").alias("responses"))


def ability_profile(abilities: DataFrame) -> DataFrame:
    """Adds a 0-100 score, its level from 1 (lowest) to 5, and the difficulty band of the next item."""
    score = N.js_round(N.clamp((F.col("theta") + 3) / 6 * 100, 0.0, 100.0))
    aim = N.clamp(F.col("theta") + 3.5, 1.0, 6.0)
    return abilities.withColumns(
        {"score": score, "level": F.least(F.lit(5).cast("long"), F.floor(score / 20) + 1), "next_low": F.greatest(F.lit(1).cast("long"), F.floor(aim - 0.5)), "next_high": F.least(F.lit(6).cast("long"), F.ceil(aim + 0.5))}
    )


def daily_streaks(active_days: DataFrame, key: str, day: str) -> DataFrame:
    """current (the run that ends on the last active day) and longest run of days for each key."""
    days = active_days.select(key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(key).orderBy(day)))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("run"), F.max(day).alias("last"))
    return runs.groupBy(key).agg(F.max_by("run", "last").alias("current"), F.max("run").alias("longest"))


def xp_levels(gains: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Running experience, level and whether the gain changed it."""
    total = F.sum("gain").over(Window.partitionBy(key).orderBy(*order))
    level = lambda x: F.floor(x / 100) + 1
    return gains.withColumn("xp", total).withColumns({"level": level(F.col("xp")), "leveled_up": level(F.col("xp")) > level(F.col("xp") - F.col("gain"))})


def wrong_answer_states(answers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key ever answered wrong: tries, wrong tries, and whether the last answer resolved it."""
    last = F.max_by("is_correct", F.struct(*order))
    grouped = answers.where("is_correct is not null").groupBy(*keys).agg(F.count("*").alias("tries"), F.count_if(~F.col("is_correct")).alias("wrong"), last.alias("resolved"))
    return grouped.where("wrong > 0")
