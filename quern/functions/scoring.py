"""Scores of records as column expressions: decay, importance, activation, tiers, confidence and trust."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that raise and lower the importance of a text.
HIGH_VALUE = ("decision", "decided", "chose", "approach", "architecture", "breaking change", "migration", "security", "vulnerability", "root cause", "root_cause", "fix", "resolved")
LOW_VALUE = ("debug", "tmp", "temporary", "wip", "todo", "test output")


def at(time: object) -> Column:
    return time if isinstance(time, Column) else F.lit(time).cast("timestamp_ntz")


def age_days(time: Column | str, now: object) -> Column:
    t = F.col(time) if isinstance(time, str) else time
    return (F.unix_micros(at(now).cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / 86_400_000_000.0


def contains_any(text: Column, words) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def recency_decay(time: Column | str, now: object, half_life_hours: float = 168.0) -> Column:
    """Halves every half life; times after now count as now."""
    return F.exp(F.lit(-math.log(2)) * F.greatest(F.lit(0.0), age_days(time, now) * 24) / half_life_hours)


def temporal_boost(time: Column | str, target: object, window_days: float) -> Column:
    """0.4 at the target, falling to 0 at the window's edge."""
    return F.greatest(F.lit(0.0), 0.40 * (1 - F.abs(age_days(time, target)) / window_days))


def importance(text: Column, n_entities: Column, n_fields: Column, kind: Column) -> Column:
    """0.5, more for entities, weighty words, length, fields and kind, less for passing matters; 0.05 to 1, and 0.5 without text."""
    low = F.lower(text)
    n = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    score = (
        F.lit(0.5)
        + F.least(n_entities * 0.05, F.lit(0.2))
        + F.when(contains_any(low, HIGH_VALUE), 0.15).otherwise(0.0)
        - F.when(contains_any(low, LOW_VALUE), 0.15).otherwise(0.0)
        + F.when(n >= 20, 0.1).when(n >= 10, 0.05).otherwise(0.0)
        + F.when(n_fields >= 4, 0.1).when(n_fields >= 2, 0.05).otherwise(0.0)
        + F.when(kind.isin("error", "decision", "architecture"), 0.1).otherwise(0.0)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 0.5).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score)))


def effective_importance(base: Column, days: Column, accesses: Column, pinned: Column, half_life_days: float = 90.0) -> Column:
    """The importance that is left after so many days, more for what is read often; pinned ones keep 1."""
    got = F.coalesce(base, F.lit(0.5)) * F.exp(-days * math.log(2) / half_life_days) * (1 + F.log(accesses + 1.0) * 0.1)
    return F.when(pinned, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), got)))


def activation(value: Column, days: Column) -> Column:
    """Halves every 30 days."""
    return value * F.pow(F.lit(0.5), days / 30.0)


def bumped(value: Column) -> Column:
    return F.least(F.lit(10.0), value + 0.1)


def tier(effective: Column, days: Column, active: Column, pinned: Column) -> Column:
    return F.when(pinned, "hot").when(effective < 0.1, "archived").when((days <= 7) & (active >= 0.5), "hot").when((days <= 30) & (active >= 0.1), "warm").otherwise("cold")


def confidence(mentions: Column, days: Column, contradictions: Column) -> Column:
    """From how often, how lately and how undisputed a fact was seen."""
    seen = F.least(F.log(mentions.cast("double")) + 1, F.lit(2.0)) / 2
    penalty = F.when(contradictions <= 0, 0.0).when(contradictions == 1, 0.2).when(contradictions == 2, 0.4).otherwise(0.6)
    return 0.3 * seen + 0.4 * F.exp(-days / 30.0) + 0.3 * (1 - penalty)


def procedure_confidence(now: Column, outcome: Column, boost: float = 0.1, penalty: float = 0.2) -> Column:
    return F.when(outcome == "success", F.least(F.lit(1.0), now + boost)).when(outcome == "failure", F.greatest(F.lit(0.0), now - penalty)).when(outcome == "partial", F.greatest(F.lit(0.0), now - penalty / 2)).otherwise(now)


def trust_tier(doubted: Column, superseded: Column, verified: Column, source: Column, derived: Column, sure: Column) -> Column:
    """observed, derived, suggested or doubted."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    source, sure = F.coalesce(source, F.lit("unknown")), F.coalesce(sure, F.lit(0.5))
    return (
        F.when(yes(doubted) | yes(superseded), "doubted")
        .when(yes(verified), "observed")
        .when((source == "inference") | yes(derived), F.when(sure >= 0.7, "derived").otherwise("suggested"))
        .when(source == "llm", F.when(sure >= 0.8, "derived").otherwise("suggested"))
        .when((source == "unknown") & (sure < 0.5), "suggested")
        .otherwise("observed")
    )


def saturated(score: Column) -> Column:
    """s / (s + 1): an open-ended score brought to 0..1."""
    return score / (score + 1)


def feedback_boost(similarity: Column, days: Column, uses: Column) -> Column:
    """What one matching entry adds; entries are added up and capped at 1."""
    return F.when(similarity > 0.80, similarity * F.exp(-days / 30.0) * F.least(F.greatest(F.log(uses.cast("double")), F.lit(1.0)) / 5, F.lit(1.0))).otherwise(0.0)
