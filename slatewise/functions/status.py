"""Contest status text as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words
FINAL_EXACT = ("game over", "completed early")
FINAL_CODES = ("F", "O")
NON_BLOCKING = ("postpon", "cancel", "suspend")
NOT_PLAYED = ("postpon", "cancel", "suspend", "resched", "scheduled")
TERMINAL = ("final", "completed", "game over", "cancelled", "canceled", "postponed", "suspended", "in progress", "live")


def has_any(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens])


def lowered(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def final_status(abstract: Column, detailed: Column, code: Column) -> Column:
    """FINAL, NON_BLOCKING (will not be played now) or BLOCKING (history must wait)."""
    word = lowered(detailed)
    postponed = has_any(F.concat_ws(" ", lowered(abstract), word), NON_BLOCKING)
    final = (lowered(abstract) == "final") | word.startswith("final") | word.isin(*FINAL_EXACT) | F.upper(code).isin(*FINAL_CODES)
    return F.when(postponed, "NON_BLOCKING").when(final, "FINAL").otherwise("BLOCKING")


def was_played(detailed: Column, code: Column) -> Column:
    """Completed with pitches thrown; abstract-final placeholders do not count."""
    word = lowered(detailed)
    done = word.startswith("final") | word.isin(*FINAL_EXACT) | F.upper(code).isin(*FINAL_CODES)
    return done & ~has_any(word, NOT_PLAYED)


def exclusion_reason(game_pk: Column, abstract: Column, detailed: Column, start: Column, captured: Column) -> Column:
    """Why a contest cannot be forecast any more; NULL when it can."""
    text = F.lower(F.concat_ws(" ", F.coalesce(abstract, F.lit("")), F.coalesce(detailed, F.lit(""))))
    return (
        F.when(game_pk.isNull(), "missing_game_pk")
        .when(has_any(text, TERMINAL), F.concat(F.lit("status:"), F.trim(text)))
        .when(start.isNull(), "missing_game_time")
        .when(captured >= start, "scheduled_start_reached")
    )


def status_rank(abstract: Column, detailed: Column) -> Column:
    """How far a schedule record has advanced."""
    a, d = lowered(abstract), lowered(detailed)
    return (
        F.when(F.contains(a, F.lit("final")) | has_any(d, ("final", "completed")), 4)
        .when(F.contains(a, F.lit("live")) | F.contains(d, F.lit("in progress")), 3)
        .when(F.contains(a, F.lit("preview")) | has_any(d, ("scheduled", "pre-game")), 2)
        .when(has_any(d, ("postpon", "suspend")), 1)
        .otherwise(0)
    )
