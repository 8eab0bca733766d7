"""Scores, grades and label rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchloom.functions.common import r1, switch

# --- fixed values: grade floors, stamina floors, alert keywords ---
GRADES = ((90, "A+"), (80, "A"), (70, "B+"), (60, "B"), (50, "C"), (35, "D"))
STAMINA_LABELS = ((80, "fresh"), (60, "good"), (40, "tired"), (20, "fatigued"))
DANGER_TYPES = ("passive_violation", "overload_danger", "goal_against")
CRITICAL_WORDS = ("substitute immediately", "switch now", "foul out", "red card")
WARNING_WORDS = ("substitute", "immediately", " now.", "switch to", "passive", "violation", "leaving open", "exposed")


def grade(score: Column) -> Column:
    return switch([(score >= s, g) for s, g in GRADES] + [(score > 0, "F")], "-")


def stamina_label(s: Column) -> Column:
    return switch([(s >= f, n) for f, n in STAMINA_LABELS], "exhausted")


def performance(
    goals: Column, shots: Column, metres: Column, top_ms: Column, breaks: Column, saves: Column, assists: Column,
    is_keeper: Column,
) -> Column:
    """Capped sum of seven parts, at most 100, one digit."""
    one = F.lit(1.0)
    total = (
        F.least(goals * 8.0, F.lit(25.0))
        + F.when(shots > 0, goals / shots * 20.0).otherwise(F.lit(0.0))
        + F.least(metres / 6000.0, one) * 15.0
        + F.least(top_ms / 9.0, one) * 10.0
        + F.least(breaks * 5.0, F.lit(10.0))
        + F.when(is_keeper, F.least(saves * 5.0, F.lit(20.0))).otherwise(F.lit(0.0))
        + F.least(assists * 4.0, F.lit(10.0))
    )
    return r1(F.least(total, F.lit(100.0)))


def norm_compare(value: Column, lo: Column, hi: Column) -> Column:
    return switch([(value > hi * 1.05, "above"), (value < lo * 0.90, "below")], "in range")


def severity(text: Column, kind: Column) -> Column:
    low = F.lower(text)

    def has(words):
        c = F.lit(False)
        for w in words:
            c = c | low.contains(w)
        return c

    return switch(
        [(kind.isin(*DANGER_TYPES), "DANGER"), (has(CRITICAL_WORDS), "CRITICAL"), (has(WARNING_WORDS), "WARNING")], "INFO"
    )
