"""Which technique to run or to trust, from history.

Gates are Columns over the first two rows of a ranking, so all targets are
decided in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.basics import rounded
from gaugeline.functions.text import run_mode


def ranking_samples(samples: Column, unweighted: Column, effective: Column) -> Column:
    """Sample count of a ranking row: plain, else unweighted, else effective, as a whole number."""
    return F.greatest(F.coalesce(samples, unweighted, effective, F.lit(0)).cast("double").cast("long"), F.lit(0))


def gate(prefix: str, min_samples: Column, min_gap: Column, top_only: bool) -> Column:
    """(ok, reason) of a ranking summary whose columns start with ``prefix``."""
    ranked = F.coalesce(F.col(f"{prefix}ranked"), F.lit(0))
    top_n = F.coalesce(F.col(f"{prefix}top_samples"), F.lit(0.0)).cast("long")
    second_n = F.coalesce(F.col(f"{prefix}second_samples"), F.lit(0.0)).cast("long")
    gap = rounded(F.coalesce(F.col(f"{prefix}top_average"), F.lit(0.0)) - F.coalesce(F.col(f"{prefix}second_average"), F.lit(0.0)), 8)
    low = F.lower(F.coalesce(F.col(f"{prefix}top_confidence"), F.lit(""))) == "low"
    seen = F.greatest(top_n, second_n)
    factor = F.when(seen >= 10, 0.5).when(seen >= 5, 0.75).otherwise(1.0)
    zone = F.when(seen >= 10, 0.008).when(seen >= 5, 0.004).otherwise(0.003)
    narrow = gap < rounded(min_gap * factor, 8)
    few = top_n < min_samples if top_only else F.least(top_n, second_n) < min_samples
    reason = (
        F.when(ranked == 0, "no_ranking")
        .when(top_n < min_samples, "insufficient_samples")
        .when(ranked < 2, "ok_single_technique")
        .when(few, "insufficient_samples")
        .when(narrow & (gap < zone) & ~low, "ok_indistinguishable")
        .when(narrow, "low_confidence_gap")
        .when(low, "low_technique_confidence")
        .otherwise("ok")
    )
    return reason


def gate_with_fallbacks(prefix: str, min_samples: Column, min_gap: Column, top_only: bool) -> Column:
    """Strict gap, then a quarter of it (at least .005), then accept on samples alone."""
    strict = gate(prefix, min_samples, min_gap, top_only)
    relaxed = gate(prefix, min_samples, F.greatest(F.lit(0.005), min_gap / 4), top_only)
    enough = F.coalesce(F.col(f"{prefix}top_samples"), F.lit(0.0)).cast("long") >= min_samples
    return (
        F.when(strict != "low_confidence_gap", strict)
        .when(relaxed.startswith("ok"), F.lit("ok_relaxed_gap"))
        .when((relaxed == "low_confidence_gap") & enough, F.lit("ok_indistinguishable"))
        .otherwise(relaxed)
    )


def matched_minimum(matched: Column, base: int) -> Column:
    """More similar problems found, more samples asked for."""
    return base + F.when(matched >= 20, 3).when(matched >= 10, 2).when(matched >= 5, 1).otherwise(0)


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def with_rankings(targets: DataFrame, profile: DataFrame, domain: DataFrame) -> DataFrame:
    """Targets with both ranking summaries: ``p_*`` by target_id, ``d_*`` by (domain, difficulty)."""
    block = ["domain", "difficulty"]
    return targets.join(_prefixed(profile, ["target_id"], "p_"), "target_id", "left").join(_prefixed(domain, block, "d_"), block, "left")


def _ok(reason: Column) -> Column:
    return reason.startswith("ok")


def _known(technique: Column, techniques: list[str] | None) -> Column:
    return F.lit(True) if techniques is None else F.coalesce(technique.isin(*techniques), F.lit(False))


def preselect(ranked: DataFrame, min_samples: int = 3, min_gap: float = 0.03, techniques: list[str] | None = None) -> DataFrame:
    """Before running: profile tier, then domain tier, else run everything.

    Rows whose ``run_mode`` is benchmark always run everything. ``techniques`` is the registry: with a single one there is
    nothing to choose, and a winner that is not in it counts for nothing.
    """
    matched = F.coalesce(F.col("p_matched_documents"), F.lit(0))
    base = max(0.005, min_gap * 0.5)
    gap = F.lit(base) * F.when(matched >= 20, 0.3).when(matched >= 10, 0.5).when(matched >= 5, 0.75).otherwise(1.0)
    made = ranked.withColumns({
        "profile_reason": gate_with_fallbacks("p_", matched_minimum(matched, min_samples), gap, top_only=True),
        "domain_reason": gate_with_fallbacks("d_", F.lit(min_samples), F.lit(min_gap), top_only=False),
    })
    stop = F.lit("single_technique") if techniques is not None and len(techniques) < 2 else F.lit(None).cast("string")
    if "run_mode" in ranked.columns:
        stop = F.coalesce(stop, F.when(run_mode(F.col("run_mode")) == "benchmark", "benchmark_mode_runs_all"))
    made = made.withColumn("_stop", stop)
    for name in ("profile_reason", "domain_reason"):
        made = made.withColumn(name, F.when(F.col("_stop").isNull(), F.col(name)))
    by_profile = F.coalesce(_ok(F.col("profile_reason")) & _known(F.col("p_top_technique"), techniques), F.lit(False))
    found = F.coalesce(_ok(F.col("domain_reason")), F.lit(False))
    by_domain = found & _known(F.col("d_top_technique"), techniques)
    return made.withColumns({
        "history_source": F.when(by_profile, "db_profile_rules").when(by_domain, "db_history"),
        "best_technique": F.when(by_profile, F.col("p_top_technique")).when(by_domain, F.col("d_top_technique")),
        "reason": F.when(by_profile, "preselected_by_profile_history").when(by_domain, "preselected_by_domain_history").when(found, "invalid_best_technique").otherwise(F.coalesce("_stop", "domain_reason")),
    }).drop("_stop")


def run_plan(preselected: DataFrame, techniques: list[str]) -> DataFrame:
    """What :func:`preselect` means for the registry, in its order: techniques to run and techniques skipped.

    Without a chosen technique all run. ``skipped_technique`` names the skipped one where it is the only one.
    """
    registry = F.array(*[F.lit(t) for t in techniques])
    chosen = F.col("best_technique")
    run = F.when(chosen.isNull(), registry).otherwise(F.array(chosen))
    return preselected.withColumns({"techniques_to_run": run, "skipped_techniques": F.array_except(registry, run)}).withColumn(
        "skipped_technique", F.when(F.size("skipped_techniques") == 1, F.get("skipped_techniques", F.lit(0)))
    )


def exploration_draw(key: Column) -> Column:
    """Deterministic number in [0, 1] of a key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def select_after_run(
    ranked: DataFrame,
    min_samples: int = 3,
    min_gap: float = 0.05,
    profile_min_samples: int = 3,
    profile_min_gap: float = 0.005,
    exploration_rate: float = 0.0,
) -> DataFrame:
    """After running: profile tier, domain tier, else the best runtime score.

    Needs ``runtime_technique``, ``problem`` and, for exploration, ``intent``. Where ``available`` lists the techniques
    that ran, a tier whose winner is not among them is passed over.
    Only the domain tier has the relaxed and dead-zone steps here, and it asks
    for samples of the top technique only.
    """
    matched = F.coalesce(F.col("p_matched_documents"), F.lit(0))
    made = ranked.withColumns({
        "profile_reason": gate("p_", matched_minimum(matched, profile_min_samples), F.lit(profile_min_gap), top_only=True),
        "domain_reason": gate_with_fallbacks("d_", F.lit(min_samples), F.lit(min_gap), top_only=True),
    })
    if exploration_rate > 0:
        intent = F.coalesce(F.col("intent"), F.lit("")) if "intent" in ranked.columns else F.lit("")
        profile_draw = exploration_draw(F.concat_ws("|", F.lit("profile"), "domain", "difficulty", intent, "problem"))
        domain_draw = exploration_draw(F.concat_ws("|", "domain", "problem"))
        for name, draw in (("profile_reason", profile_draw), ("domain_reason", domain_draw)):
            made = made.withColumn(name, F.when(_ok(F.col(name)) & (draw < exploration_rate), "exploration_runtime").otherwise(F.col(name)))
    by_profile, by_domain = _ok(F.col("profile_reason")), _ok(F.col("domain_reason"))
    if "available" in ranked.columns:
        ran = lambda top: F.coalesce(F.array_contains("available", F.col(top)), F.lit(False))
        made = made.withColumn("profile_reason", F.when(by_profile & ~ran("p_top_technique"), "profile_best_missing_result").otherwise(F.col("profile_reason")))
        by_domain = by_domain & ran("d_top_technique")
    return made.withColumns({
        "selection_source": F.when(by_profile, "db_profile_rules").when(by_domain, "db_history").otherwise("runtime_scores"),
        "best_technique": F.when(by_profile, F.col("p_top_technique")).when(by_domain, F.col("d_top_technique")).otherwise(F.col("runtime_technique")),
    })


def limit_comparison(compared: DataFrame, selected: DataFrame) -> DataFrame:
    """Once history decides, only the chosen technique's comparison row stays."""
    chosen = selected.where(F.col("selection_source") != "runtime_scores").select("problem_id", F.col("best_technique").alias("_chosen"))
    joined = compared.join(chosen, "problem_id", "left")
    return joined.where(F.col("_chosen").isNull() | (F.col("_chosen") == F.col("technique"))).drop("_chosen")


def decision_trace(selected: DataFrame) -> DataFrame:
    """One row per tier: passed, failed or skipped, with its reason."""

    def tier(number: int, name: str, source: str, attempted: Column, reason: Column) -> Column:
        passed = F.col("selection_source") == source
        missed = "failed" if number < 3 else "skipped"
        return F.struct(
            F.lit(number).alias("tier"), F.lit(name).alias("name"),
            F.when(passed, "passed").when(attempted, missed).otherwise("skipped").alias("result"),
            reason.alias("reason"),
        )

    tiers = F.array(
        tier(1, "profile", "db_profile_rules", F.lit(True), F.col("profile_reason")),
        tier(2, "domain", "db_history", F.col("selection_source") != "db_profile_rules", F.col("domain_reason")),
        tier(3, "runtime", "runtime_scores", F.lit(True), F.lit("best runtime score")),
    )
    return selected.select("target_id", F.inline(tiers))
