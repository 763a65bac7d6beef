"""Decay, trust and confidence as column expressions of an explicit reference time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def age_in_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(float(DAY_MICROS))


def relevance(importance: Column, decay: Column, created: Column, accessed: Column, as_of: Column) -> Column:
    """Importance fading with age; an access halves the age that counts from it."""
    age = age_in_days(created, as_of)
    return importance * F.exp(-decay * F.least(age, F.coalesce(age_in_days(accessed, as_of), age) * 0.5))


def strength(importance: Column, decay: Column, created: Column, reinforced: Column, as_of: Column) -> Column:
    idle = F.greatest(age_in_days(F.coalesce(reinforced, created), as_of), F.lit(0.0))
    return clamp(F.coalesce(importance, F.lit(0.5)) * F.exp(-F.greatest(F.coalesce(decay, F.lit(0.01)), F.lit(0.0)) * idle))


def felt_intensity(encoded: Column, valence: Column, created: Column, reinforced: Column, as_of: Column, ember: float = 0.5, decay: float = 0.02, rekindle: float = 0.5, negative: float = 0.4) -> Column:
    """Fades towards a floor that only positive memories keep; recall stirs it up
    for a while, less so for negative ones."""
    peak, mood = clamp(F.coalesce(encoded, F.lit(0.0))), F.coalesce(valence, F.lit(0.0))
    floor = F.greatest(mood, F.lit(0.0)) * peak * ember
    fading = lambda rate, since: F.exp(F.greatest(F.lit(-700.0), -rate * F.greatest(age_in_days(since, as_of), F.lit(0.0))))
    base = floor + (peak - floor) * fading(decay, created)
    stirred = F.when(mood >= 0, F.lit(1.0)).otherwise(F.lit(negative)) * (peak - base) * fading(rekindle, F.coalesce(reinforced, created))
    return F.least(peak, F.greatest(floor, base + stirred))


def source_support(n_sources: Column, mean_trust: Column) -> Column:
    """Saturating weight of independent sources."""
    return 1 - F.exp(F.lit(-0.8) * n_sources * mean_trust)


def semantic_trust(confidence: Column, support: Column, alignment: Column) -> Column:
    """Disagreement with held views scales trust down; agreement adds up to the
    confidence. No confidence counts as one half, no alignment as none."""
    sure, agreed = clamp(F.coalesce(confidence, F.lit(0.5))), clamp(F.coalesce(alignment, F.lit(0.0)), -1.0, 1.0)
    trust = sure * (F.lit(0.15) + F.lit(0.85) * support)
    return clamp(F.when(agreed < 0, trust * (1 + agreed)).otherwise(F.least(sure, trust + F.lit(0.1) * agreed)))


def revised_confidence(prior: Column, stance: Column, trust: Column, rate: float = 0.35) -> Column:
    """One piece of evidence moves a share of what is left to certainty or doubt."""
    return (
        F.when(stance == "supports", F.least(F.lit(0.99), prior + (1 - prior) * rate * trust))
        .when(stance == "contradicts", F.greatest(F.lit(0.05), prior * (1 - rate * trust)))
        .otherwise(prior)
    )


def decay_for_intensity(intensity: Column, base: float = 0.01) -> Column:
    return F.when(intensity < 0.1, F.lit(3 * base)).when(intensity < 0.3, F.lit(1.5 * base)).when(intensity > 0.6, F.lit(0.5 * base)).otherwise(F.lit(base))


def backoff_seconds(base: float, attempts: Column) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))


def noisy_or(weight: Column) -> Column:
    """Aggregate: the chance that one of independent weights holds."""
    return 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.least(F.lit(1.0), weight)))))


def recall_score(similarity: Column, strength: Column, felt: Column, association: Column, graph: Column, age_days: Column, trust: Column, boost: Column, invalid: Column, mood: Column, in_episode: Column | None = None) -> Column:
    """Similarity, dimmed by fading, plus what context, recency, trust and mood add."""
    lively = similarity * (0.5 + 0.5 * F.greatest(strength, 0.5 * felt))
    episode = F.lit(0.0) if in_episode is None else F.when(in_episode, 0.15).otherwise(0.0)
    fresh = F.exp(-F.log(F.lit(2.0)) * age_days / 7.0)
    total = lively + 0.2 * association + episode + 0.12 * graph + 0.1 * fresh + 0.1 * trust + 0.3 * boost - F.when(invalid, 0.35).otherwise(0.0) + 0.05 * mood
    return F.greatest(F.lit(0.001), total)


def mood_match(valence: Column, arousal: Column, primary: Column, now_valence: float, now_arousal: float, now_primary: str) -> Column:
    """How near a memory's mood is to the present one; a missing part counts half."""
    parts = ((0.6, 1 - F.abs(valence - now_valence) / 2), (0.3, 1 - F.abs(arousal - now_arousal)), (0.1, (primary == now_primary).cast("double")))
    return sum((F.lit(w) * F.coalesce(p, F.lit(0.5)) for w, p in parts), F.lit(0.0))


def drive_level(level: Column, baseline: Column, satisfied: Column, as_of: Column, cooldown_seconds: int, gain: float, loss: float) -> Column:
    """A drive grows unless satisfied within the cooldown; then it moves to its baseline."""
    calm = F.unix_micros(satisfied) >= F.unix_micros(as_of) - cooldown_seconds * 1_000_000
    towards = F.when(level > baseline, F.greatest(baseline, level - loss)).when(level < baseline, F.least(baseline, level + loss)).otherwise(level)
    return F.when(F.coalesce(calm, F.lit(False)), towards).otherwise(F.least(F.lit(1.0), level + gain))


def energy(before: Column, hours: Column, reserve: float, capacity: float, half_life: float, regain: Column) -> Column:
    """What is above the reserve halves with time; then energy is regained, up to the capacity."""
    hours = F.greatest(hours, F.lit(0.0))
    have = clamp(before, 0.0, capacity)
    surplus = F.greatest(have - reserve, F.lit(0.0)) * F.pow(F.lit(0.5), hours / half_life)
    return F.least(F.lit(capacity), F.least(have, F.lit(reserve)) + surplus + regain * hours)


def cadence_minutes(urgency: Column, base: float = 60.0, least: float = 15.0, most: float = 120.0, idle: float = 1.5, slope: float = 0.75) -> Column:
    """The more urgent, the shorter the interval, within limits that hold the base."""
    low, high = min(base, max(least, 1.0)), max(base, most)
    raw = base * F.greatest(F.lit(low / base), idle - F.least(F.greatest(F.coalesce(urgency, F.lit(0.0)), F.lit(0.0)), F.lit(2.0)) * slope)
    return clamp(raw, low, high)


def grown_importance(importance: Column, accesses: Column) -> Column:
    return clamp(importance * (1 + 0.1 * F.log(accesses + 1.0)))


def drifted(tonic: Column, rate: float = 0.02) -> Column:
    return clamp(tonic + (0.5 - tonic) * rate)


def decay_multiplier(tonic: Column) -> Column:
    return clamp(1 - 0.7 * F.coalesce(tonic, F.lit(0.5)), 0.3, 1.0)
