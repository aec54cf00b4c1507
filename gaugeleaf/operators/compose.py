"""Exam composition: slots from distributions, scarcest slot first, relaxation, swaps, match score."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import largest_remainder

# What a problem's fit for a slot is made of.
UNIT, SUBJECT_ONLY, LEVEL, LEVEL_BY_ONE, LEVEL_BY_TWO, KIND, SOURCE, SAME_SOURCE = 0.4, 0.2, 0.25, 0.15, 0.05, 0.2, 0.1, 0.02
NO_LEVEL = 3
MOST_PASSES = 100
LEAST_GAIN = 0.01


def build_slots(weights: DataFrame, kinds: list[str], seats: int, low: int, high: int) -> DataFrame:
    """exam, slot, subject, unit, kind, low, high: seats of each exam apportioned to units, kinds dealt round by round."""
    planned = largest_remainder(weights, ["exam"], "unit", "percentage", seats).where("seats > 0")
    each = planned.select("exam", "subject", "unit", F.explode(F.sequence(F.lit(1), F.col("seats").cast("int"))).alias("k"))
    slot = F.row_number().over(Window.partitionBy("exam").orderBy("unit", "k")) - 1
    kind = F.get(F.array(*map(F.lit, kinds)), F.col("slot") % len(kinds))
    return each.withColumn("slot", slot).select("exam", "slot", "subject", "unit", kind.alias("kind"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def fit(c: dict, s: dict, used_sources: Counter | None = None) -> float:
    """How well candidate c fits slot s; problems of a source that is used already fit less."""
    if s["unit"]:
        score = UNIT if c["unit"] == s["unit"] else SUBJECT_ONLY if s["subject"] and c["subject"] == s["subject"] else 0.0
    else:
        score = UNIT if not s["subject"] or c["subject"] == s["subject"] else 0.0
    level = NO_LEVEL if c["difficulty"] is None else c["difficulty"]
    off = 0 if s["low"] <= level <= s["high"] else min(abs(level - s["low"]), abs(level - s["high"]))
    score += {0: LEVEL, 1: LEVEL_BY_ONE, 2: LEVEL_BY_TWO}.get(off, 0.0)
    score += KIND if not s["kind"] or c["kind"] == s["kind"] else 0.0
    return score + (SOURCE if used_sources is None or c["source"] is None else max(0.0, SOURCE - SAME_SOURCE * used_sources[c["source"]]))


def suits(c: dict, s: dict) -> bool:
    level = NO_LEVEL if c["difficulty"] is None else c["difficulty"]
    placed = c["unit"] == s["unit"] if s["unit"] else not s["subject"] or c["subject"] == s["subject"]
    return placed and s["low"] <= level <= s["high"] and (not s["kind"] or c["kind"] == s["kind"])


def relaxations(s: dict) -> list[tuple[str, dict]]:
    """The slot with less and less asked of it: difficulty, unit, subject, kind."""
    out = [("expand_difficulty", s | {"low": s["low"] - 1, "high": s["high"] + 1})]
    for name, field in (("expand_unit", "unit"), ("drop_subject", "subject"), ("relax_kind", "kind")):
        if s[field]:
            gone = {"unit": None} if field == "unit" else {"unit": None, "subject": None} if field == "subject" else {"unit": None, "subject": None, "kind": None}
            out.append((name, out[0][1] | gone))
    return out


def fill_slots(slots: list[dict], pool: list[dict]) -> tuple[list[tuple[dict, dict | None, str | None]], float]:
    """(slot, candidate or None, relaxation or None) for each slot in the order of filling, and the match score.

    slots have available (candidates that suit them) beside what build_slots gives; equal scores go to the smaller problem_id.
    """
    pool = sorted(pool, key=lambda c: c["problem_id"])
    used: set[int] = set()
    sources: Counter = Counter()

    def best(s: dict) -> dict | None:
        found = [c for c in pool if c["problem_id"] not in used and suits(c, s)]
        return max(found, key=lambda c: (round(fit(c, s, sources), 9), -c["problem_id"]), default=None)

    def take(c: dict, by: int = 1) -> None:
        (used.add if by > 0 else used.discard)(c["problem_id"])
        sources[c["source"]] += by

    filled: list[list] = []
    for s in sorted(slots, key=lambda s: (s["available"], s["slot"])):
        pick, name = best(s), None
        for name, looser in () if pick else relaxations(s):
            pick = best(looser)
            if pick:
                break
        if pick:
            take(pick)
        filled.append([s, pick, name if pick else None])
    for _ in range(MOST_PASSES):
        improved = False
        for entry in filled:
            s, now, _ = entry
            if now is None:
                continue
            least = fit(now, s, sources) + LEAST_GAIN
            other = next((c for c in pool if c["problem_id"] not in used and fit(c, s, sources) > least), None)
            if other:
                take(now, -1)
                take(other)
                entry[1], improved = other, True
        if not improved:
            break
    fits = [fit(c, s) for s, c, _ in filled if c]
    score = len(fits) / len(filled) * (sum(fits) / len(fits)) if fits else 0.0
    return [tuple(e) for e in filled], int(score * 100 + 0.5) / 100


CANDIDATE = ["problem_id", "subject", "unit", "kind", "difficulty", "source"]


def reachable(problems: DataFrame, cell: list[str], seats: int) -> DataFrame:
    """As many problems of each cell as an exam could take, one of each source before the second of any."""
    of_source = Window.partitionBy(*cell, "source").orderBy("problem_id")
    turn = problems.withColumn("__turn", F.row_number().over(of_source)).where(F.col("__turn") <= seats)
    return turn.withColumn("__n", F.row_number().over(Window.partitionBy(*cell).orderBy("__turn", "problem_id"))).where(F.col("__n") <= seats).select(CANDIDATE)


def with_available(slots: DataFrame, problems: DataFrame) -> DataFrame:
    """slots with available, the number of problems that suit each.

    Problems are counted for every place a slot can ask for (a unit, a subject, any), each kind and any, and
    each difficulty; a slot finds its counts by equality and adds up those of its difficulties.
    """
    level = F.coalesce("difficulty", F.lit(NO_LEVEL)).alias("level")
    place = lambda by, at: F.struct(F.lit(by).alias("by"), at.alias("place"))
    places = F.array(place("unit", F.col("unit")), place("subject", F.col("subject")), place("any", F.lit("")))
    kinds = F.array(*(F.struct(F.lit(asked).alias("asked"), of.alias("of")) for asked, of in ((True, F.col("kind")), (False, F.lit("")))))
    cells = problems.groupBy("unit", "subject", "kind", level).agg(F.count("*").alias("n"))
    cube = cells.select(F.explode(places).alias("p"), "kind", "level", "n").where("p.place is not null").select("p.by", "p.place", F.explode(kinds).alias("k"), "level", "n").where("k.of is not null").groupBy("by", "place", "k.asked", "k.of", "level").agg(F.sum("n").alias("n"))
    by = F.when(F.col("unit").isNotNull(), "unit").when(F.col("subject").isNotNull(), "subject").otherwise("any")
    wanted = slots.withColumns({"by": by, "place": F.coalesce("unit", "subject", F.lit("")), "asked": F.col("kind").isNotNull(), "of": F.coalesce("kind", F.lit(""))})
    fits = F.when(F.col("level").between(F.col("low"), F.col("high")), F.col("n"))
    return wanted.join(cube, ["by", "place", "asked", "of"], "left").groupBy(*slots.columns).agg(F.coalesce(F.sum(fits), F.lit(0)).alias("available"))


def compose_exam(slots: DataFrame, problems: DataFrame, seats: int) -> DataFrame:
    """exam, slot, problem_id (null if unfilled), relaxed, match_score.

    Each exam is filled in one task from what it could reach: of its own subjects ``seats`` problems for every
    unit, kind and difficulty, of all subjects ``seats`` for every kind and difficulty.  How many problems suit a
    slot is counted before the cut.
    """
    problems = problems.select(CANDIDATE)
    counted = with_available(slots, problems)
    own = reachable(problems, ["subject", "unit", "kind", "difficulty"], seats)
    anywhere = reachable(problems, ["kind", "difficulty"], seats)
    exams = slots.select("exam", "subject").distinct()
    same_unit = slots.where("unit is not null").select("exam", "unit").distinct().join(own, "unit")
    pools = exams.join(own, "subject").unionByName(same_unit).unionByName(slots.select("exam").distinct().join(F.broadcast(anywhere), how="cross")).distinct()  # seats for each kind and difficulty

    def fill(mine: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        plain = lambda df: df.astype(object).where(df.notna(), None).to_dict("records")
        filled, score = fill_slots(plain(mine), plain(pool))
        out = pd.DataFrame([(s["exam"], s["slot"], c["problem_id"] if c else None, name, score) for s, c, name in filled], columns=["exam", "slot", "problem_id", "relaxed", "match_score"])
        return out.astype({"problem_id": "Int64"})

    kind = slots.schema["exam"].dataType.simpleString()
    own_pools = pools.select(F.col("exam").alias("owner"), *(F.col(c).alias(c) for c in CANDIDATE))
    return counted.groupBy("exam").cogroup(own_pools.groupBy("owner")).applyInPandas(fill, f"exam {kind}, slot int, problem_id long, relaxed string, match_score double")
