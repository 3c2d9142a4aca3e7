"""Scores and states as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.lexicons import (
    CHATTER, FUTURE_WORDS, INTERROGATIVES, NOT_PROBLEMS, PAST_WORDS, PROBLEM_WORDS, SECRETS, TYPE_BIAS, TYPE_TTL_SECONDS, TYPE_WORDS, VALUE_WORDS,
)
from engram.functions.text import any_of, how_many_of, let, starts_with_any


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_noise(text: Column, chatter: Sequence[str] = CHATTER, shortest: int = 8, longest: int = 8000) -> Column:
    """Too short or long in bytes, or opening with chatter that ends there or at a character that is no letter or digit."""
    t = trimmed(text)
    opening = F.lower(t).rlike("^(" + "|".join(sorted(chatter, key=len, reverse=True)) + r")([^\p{L}\p{N}]|$)")
    return F.coalesce((F.octet_length(t) < shortest) | (F.octet_length(t) > longest) | opening, F.lit(True))


def is_sensitive(text: Column, patterns: Sequence[str] = SECRETS) -> Column:
    return any_of(F.lower(text), [p.lower() for p in patterns])


def is_problem(text: Column, words: Sequence[str] = PROBLEM_WORDS, not_problems: Sequence[str] = NOT_PROBLEMS, shortest: int = 12) -> Column:
    t = trimmed(text)
    low = F.lower(t)
    return F.coalesce((F.octet_length(t) >= shortest) & ~starts_with_any(low, not_problems) & (any_of(low, words) | low.rlike("[?？]$")), F.lit(False))


def is_question(text: Column, words: Sequence[str] = INTERROGATIVES) -> Column:
    t = trimmed(text)
    return F.coalesce((t != "") & (t.rlike("[?？]$") | starts_with_any(F.lower(t), words)), F.lit(False))


def memory_type(low: Column, words: dict[str, Sequence[str]] = TYPE_WORDS) -> Column:
    """The type with the most of its words in the lower-case text, the first of equals; knowledge if none has any."""
    kinds = F.array(*map(F.lit, words))
    hits = F.array(*[how_many_of(low, ws) for ws in words.values()])
    return let(hits, lambda h: F.when(F.array_max(h) == 0, "knowledge").otherwise(F.element_at(kinds, F.array_position(h, F.array_max(h)).cast("int"))))


def length_score(n: Column) -> Column:
    """Of a length in bytes: up to .30 at 16, level to 400, down to 0 at 800."""
    return F.when(n < 16, n / 16.0 * 0.30).when(n <= 400, 0.30).when(n >= 800, 0.0).otherwise((1.0 - (n - 400) / 400.0) * 0.30)


def importance(low: Column, n_bytes: Column, kind: Column, words: Sequence[str] = VALUE_WORDS, bias: dict[str, float] = TYPE_BIAS) -> Column:
    known = F.least(how_many_of(low, words), F.lit(6)) * F.lit(0.08)
    weight = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), bias.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.10) + known + length_score(n_bytes) + F.lit(0.40) * weight))


def ttl_seconds(kind: Column, ttl: dict[str, int] = TYPE_TTL_SECONDS) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), ttl.items(), F.when(F.lit(False), 0)).cast("long")


def time_intent(query: Column, past: Sequence[str] = PAST_WORDS, future: Sequence[str] = FUTURE_WORDS) -> Column:
    low = F.lower(query)
    return F.when(any_of(low, past), "past").when(any_of(low, future), "future").otherwise("current")


def temporal_score(intent: Column, created: Column, expires: Column, now: Column, window: int = 90 * 86400) -> Column:
    """Freshness over the window, for the past its opposite, 0 once expired. Times are seconds."""
    fresh = 1.0 - F.greatest(F.lit(0), F.least(F.lit(window), now - created)) / F.lit(float(window))
    return F.when(F.coalesce(expires <= now, F.lit(False)), 0.0).when(intent == "past", 1.0 - fresh).otherwise(fresh)


def temporal_score_exponential(intent: Column, created: Column, expires: Column, now: Column, rate: float = 1.157e-7) -> Column:
    """exp(-rate * age), for the past its opposite, 0 once expired; a rate of 0 or less never fades."""
    fresh = F.exp(-F.lit(max(rate, 0.0)) * F.greatest(F.lit(0), now - created))
    return F.when(F.coalesce(expires <= now, F.lit(False)), 0.0).when(intent == "past", 1.0 - fresh).otherwise(fresh)


def stage(intimacy: Column) -> Column:
    return F.when(intimacy < 0.2, "stranger").when(intimacy < 0.5, "acquaintance").when(intimacy < 0.8, "companion").otherwise("partner")


def trend(delta: Column) -> Column:
    return F.when(delta > 0, "rising").when(delta < 0, "declining").otherwise("stable")


def evidence_score(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, 0.3).when(n <= 4, 0.5).when(n <= 9, 0.8).otherwise(1.0)


def participant_score(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n <= 2, 0.3).when(n <= 4, 0.6).when(n <= 7, 0.8).otherwise(1.0)


def event_importance(evidence: Column, participants: Column, turning: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * evidence_score(evidence) + 0.3 * participant_score(participants) + F.when(turning, 0.2).otherwise(0.0))


def decay_time(age: Column, ttl: float = 90 * 86400.0, factor: float = 0.5) -> Column:
    late = F.greatest(age - ttl, F.lit(0.0)) / F.greatest(F.lit(ttl / 2), F.lit(1.0))
    return F.when(age <= ttl, 1.0).otherwise(1.0 - (1.0 - F.pow(F.lit(0.5), late)) * (1 - factor))


def decay_importance(value: Column, least: float = 0.3, factor: float = 0.5) -> Column:
    return F.when(value >= least, 1.0).otherwise(1.0 - (1.0 - value / least) * (1 - factor))


def decay_access(count: Column, least: int = 5, factor: float = 0.5) -> Column:
    return F.when(count >= least, 1.0).otherwise(1.0 - (1.0 - count / float(least)) * (1 - factor))


def decay_weight(age: Column, value: Column, count: Column, strategy: str = "hybrid", **limits) -> Column:
    parts = {"time": decay_time(age), "importance": decay_importance(value), "access": decay_access(count)}
    return parts["time"] * parts["importance"] * parts["access"] if strategy == "hybrid" else parts[strategy]
