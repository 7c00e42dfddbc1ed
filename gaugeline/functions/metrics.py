"""Efficiency buckets and the weighted overall score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions.basics import let, rounded
from gaugeline.functions.text import word_count

METRICS = ("accuracy", "consistency", "efficiency")


def blended_tokens(completion: Column, total: Column, prompt: Column, share: float = 0.75) -> Column:
    """Q1: completion-weighted token count."""
    share = min(1.0, max(0.0, share))
    mixed = (share * F.greatest(completion, F.lit(0)) + (1.0 - share) * F.greatest(total, F.lit(0))).cast("long")
    return F.when(mixed > 0, mixed).otherwise(F.greatest(total - prompt, F.lit(0)).cast("long"))


def time_score(seconds: Column) -> Column:
    """Q2."""
    return (
        F.when(seconds == 0, 0.5).when(seconds < 1, 0.6).when(seconds <= 3, 1.0).when(seconds <= 8, 0.9)
        .when(seconds <= 15, 0.7).when(seconds <= 30, 0.5).otherwise(0.3)
    )


def token_score(used: Column, words: Column) -> Column:
    """Q3: token count bucket averaged with the tokens-per-word bucket."""
    volume = F.when(used <= 100, 1.0).when(used <= 300, 0.9).when(used <= 500, 0.7).when(used <= 1000, 0.5).otherwise(0.3)
    ratio = F.try_divide(used, words)
    density = (
        F.when(words == 0, 0.5).when(ratio.between(1.0, 2.0), 1.0).when(ratio.between(0.8, 2.5), 0.8).otherwise(0.6)
    )
    return F.when(used == 0, 0.5).otherwise((volume + density) / 2)


def conciseness_score(words: Column) -> Column:
    """Q4."""
    return (
        F.when(words.between(30, 100), 1.0).when(words.between(20, 29) | words.between(101, 150), 0.9)
        .when(words.between(10, 19) | words.between(151, 250), 0.7).otherwise(0.5)
    )


def efficiency(response: Column, seconds: Column, total: Column, prompt: Column, completion: Column, share: float = 0.75) -> Column:
    """Q5: .4 time + .3 tokens + .3 conciseness."""
    used = blended_tokens(completion, total, prompt, share)
    # every bucket asks for the words, so they are counted once
    score = let(word_count(response), lambda words: time_score(seconds) * 0.4 + token_score(used, words) * 0.3 + conciseness_score(words) * 0.3)
    return rounded(score, 3)


def normalise_weights(accuracy: float = 1.0, consistency: float = 1.0, efficiency: float = 1.0, **change: float) -> dict[str, float]:
    """Q22: finite, non-negative weights scaled to sum to one; ``change`` overrides single ones."""
    weights = {"accuracy": accuracy, "consistency": consistency, "efficiency": efficiency, **change}
    for name, value in weights.items():
        if name not in METRICS:
            raise ValueError(f"unknown metric {name!r}")
        if value is None or not math.isfinite(float(value)) or float(value) < 0:
            raise ValueError(f"weight {name!r} must be a finite number >= 0")
    total = sum(float(v) for v in weights.values())
    if total <= 0:
        raise ValueError("at least one weight must be greater than 0")
    return {name: float(v) / total for name, v in weights.items()}


def run_count(value: object) -> int:
    """Q22: number of runs per technique, an integer of at least one."""
    try:
        count = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        raise ValueError("runs per technique must be an integer") from None
    if count < 1:
        raise ValueError("runs per technique must be >= 1")
    return count


def overall(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Q21: weighted mean of the scores that are present; plain mean when their weights are all zero."""
    present = {n: F.when(c.isNotNull(), 1.0).otherwise(0.0) for n, c in scores.items()}
    value = {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in scores.items()}
    mass = sum((present[n] * weights.get(n, 0.0) for n in scores), F.lit(0.0))
    total = sum((value[n] * present[n] * weights.get(n, 0.0) for n in scores), F.lit(0.0))
    count = sum(present.values(), F.lit(0.0))
    return F.when(mass > 0, F.try_divide(total, mass)).otherwise(F.try_divide(sum(value.values(), F.lit(0.0)), F.greatest(count, F.lit(1.0))))
