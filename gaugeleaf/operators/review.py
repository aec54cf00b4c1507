"""Automatic review of analysed problems: factors, hard checks, weighted decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numerics as N
from .retrieval import REVIEWS


def _given(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def chapter_match(subject: Column, unit: Column, chapter: Column) -> Column:
    """How well a problem's labels fit the chapter it stands in; 0.5 without a chapter."""
    low = F.lower(chapter)
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 1)
    return (
        F.when(~_given(chapter), 0.5)
        .when(_given(subject) & low.contains(F.lower(subject)), 1.0)
        .when(_given(unit) & low.contains(F.lower(unit)), 0.9)
        .when(_given(unit) & F.exists(words, lambda w: unit.contains(w)), 0.8)
        .otherwise(0.3)
    )


def answer_cross_check(found: Column, key: Column, key_status: Column) -> Column:
    """1 or 0 as the answer agrees with a matched key, 0.5 without such a key; choice marks count as their digits."""
    plain = lambda x: N.circled_to_digit(F.trim(F.coalesce(x, F.lit(""))))
    keyed = (F.coalesce(key_status, F.lit("")) == "matched") & _given(key)
    return F.when(~keyed, 0.5).when(plain(found) == plain(key), 1.0).otherwise(0.0)


def subject_consistency(subject_known: Column, unit: Column, unit_known: Column, concepts: Column, keywords: Column) -> Column:
    """Half for the unit's place in the subject's curriculum, half for concepts that name the subject; 0 for an unknown subject."""
    by_unit = F.when(_given(unit) & unit_known, 0.5).when(~_given(unit), 0.25).otherwise(0.0)
    words = F.lower(F.array_join(concepts, " "))
    named = F.size(F.filter(keywords, lambda k: words.contains(k)))
    by_words = F.when(named >= 2, 0.5).when(named == 1, 0.3).otherwise(0.0)
    by_concept = F.when(F.coalesce(F.size(concepts), F.lit(0)) <= 0, 0.1).when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, 0.25).otherwise(by_words)
    return F.when(F.coalesce(subject_known, F.lit(False)), by_unit + by_concept).otherwise(0.0)


def review(kind: Column, factors: tuple[Column, ...], checks: dict[str, Column]) -> dict[str, Column]:
    """score, decision and failed (names of failed checks in order) of the hard checks and the weighted factors.

    kind names the weights and the threshold; a factor that its kind does not weigh may be null.
    """
    score, least = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (weights, threshold) in REVIEWS.items():
        own = sum((w * f for w, f in zip(weights, factors, strict=True) if w), F.lit(0.0))
        score, least = F.when(kind == name, own).otherwise(score), F.when(kind == name, threshold).otherwise(least)
    # sums of weights differ in their last bits
    all_checks = checks | {"confidence_above_threshold": F.round(score, 9) >= least}
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in all_checks.items())))
    return {"score": score, "decision": F.when(F.size(failed) == 0, "auto_approved").otherwise("pending_review"), "failed": failed}
