"""Aggregation of scored runs.

Every aggregate is partial before it shuffles, so a hot (problem, technique)
reaches its reducer as one row per map task. Score sums run in DECIMAL, which
makes results independent of the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import metrics as mx
from gaugeline.functions.basics import exact_mean, exact_sum, rounded
from gaugeline.operators.sequences import running_share

KEYS = ["problem_id", "technique"]
COUNTERS = ["elapsed_time", "total_tokens", "prompt_tokens", "completion_tokens"]


def running_scores(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Consistency and overall after each run of a (problem, technique)."""
    seen = running_share(runs, KEYS, "run_index", "normalized_output")
    first = F.col("position") < 2
    consistency = F.when(~first, F.col("matching") / F.col("position"))
    scores = {"accuracy": F.col("accuracy"), "efficiency": F.col("efficiency"), "consistency": consistency}
    return seen.withColumns({
        "consistency": rounded(consistency, 3),
        "consistency_runs_used": F.col("position"),
        "consistency_matching_runs": F.when(~first, F.col("matching")),
        "overall": rounded(mx.overall(scores, weights), 3),
        "overall_is_provisional": first,
    }).drop("position", "matching")


def output_counts(runs: DataFrame) -> DataFrame:
    """A3: how often each answer key occurred, as rows (never collected into one value)."""
    return runs.groupBy(*KEYS, "normalized_output").agg(F.count("*").alias("n"), F.min("run_index").alias("first_run"))


def consistency(counts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A3: share of the most frequent key; ties go to the key seen first; null below two runs."""
    best = F.max(F.struct("n", (-F.col("first_run")).alias("earliest"), "normalized_output"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("runs_used"), best.alias("best"))
    single = F.col("runs_used") < 2
    return totals.select(
        *keys,
        "runs_used",
        F.when(~single, F.col("best.n") / F.col("runs_used")).alias("consistency"),
        F.when(~single, F.col("best.n")).alias("matching_runs"),
        F.col("best.normalized_output").alias("canonical_output"),
        single.alias("is_provisional"),
    )


def _mean_of(total: str, count: str, digits: int) -> Column:
    return rounded(F.coalesce(F.try_divide(F.col(total), F.col(count)), F.lit(0.0)), digits)


def technique_results(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A1-A4: one row per (problem, technique).

    Runs are first combined per answer key and then per technique; both steps
    combine on the map side. The response of the last successful run stays in
    the run table (see :func:`with_last_response`), so no text is shuffled.
    """
    ok = F.col("success")
    number = {c: F.col(c).try_cast("double") for c in COUNTERS}
    per_key = runs.groupBy(*KEYS, "normalized_output").agg(
        F.count("*").alias("n"),
        F.min("run_index").alias("first_run"),
        F.count_if(ok).alias("ok"),
        F.max(F.when(ok, F.col("run_index"))).alias("last_ok"),
        F.max("run_index").alias("last_run"),
        *[F.sum(F.when(ok, number[c]).cast("decimal(28,10)")).alias(c) for c in COUNTERS],
        *[F.sum(F.when(ok, F.col(c)).cast("decimal(18,10)")).alias(c) for c in ("accuracy", "efficiency")],
    )
    best = F.max(F.struct("n", (-F.col("first_run")).alias("earliest"), "normalized_output"))
    whole = per_key.groupBy(*KEYS).agg(
        F.sum("n").alias("runs_recorded"),
        F.sum("ok").alias("runs_succeeded"),
        F.max("last_ok").alias("last_success_run"),
        F.max("last_run").alias("last_run"),
        best.alias("best"),
        *[F.sum(c).cast("double").alias(f"sum_{c}") for c in [*COUNTERS, "accuracy", "efficiency"]],
    )
    means = whole.withColumns({
        "success": F.col("runs_succeeded") > 0,
        "raw_accuracy": F.coalesce(F.try_divide("sum_accuracy", "runs_succeeded"), F.lit(0.0)),
        "raw_efficiency": F.coalesce(F.try_divide("sum_efficiency", "runs_succeeded"), F.lit(0.0)),
        "raw_consistency": F.when(F.col("runs_recorded") >= 2, F.col("best.n") / F.col("runs_recorded")),
    })
    scores = {m: F.col(f"raw_{m}") for m in ("accuracy", "efficiency", "consistency")}
    return means.select(
        *KEYS,
        "success",
        rounded(F.col("raw_accuracy"), 3).alias("accuracy"),
        rounded(F.col("raw_consistency"), 3).alias("consistency"),
        rounded(F.col("raw_efficiency"), 3).alias("efficiency"),
        rounded(mx.overall(scores, weights), 3).alias("overall"),
        F.col("raw_consistency").isNull().alias("consistency_is_provisional"),
        F.col("runs_recorded").alias("consistency_runs_used"),
        F.when(F.col("runs_recorded") >= 2, F.col("best.n")).alias("consistency_matching_runs"),
        F.col("best.normalized_output").alias("canonical_output"),
        _mean_of("sum_elapsed_time", "runs_succeeded", 4).alias("elapsed_time"),
        *[_mean_of(f"sum_{c}", "runs_succeeded", 0).cast("long").alias(c) for c in COUNTERS[1:]],
        "runs_recorded",
        "runs_succeeded",
        (F.col("runs_recorded") - F.col("runs_succeeded")).alias("runs_failed"),
        "last_success_run",
        "last_run",
    )


def with_last_response(results: DataFrame, runs: DataFrame) -> DataFrame:
    """A2: response of the last successful run, or the error of the last run when none succeeded."""
    texts = runs.select(
        *KEYS, F.col("run_index").alias("_run"), F.col("response").alias("_response"),
        (F.col("error") if "error" in runs.columns else F.lit(None).cast("string")).alias("_error"),
    )
    wanted = results.withColumn("_run", F.coalesce("last_success_run", "last_run"))
    joined = wanted.join(texts, [*KEYS, "_run"], "left")
    return joined.withColumns({
        "response": F.when(F.col("success"), F.coalesce("_response", F.lit(""))).otherwise(""),
        "error": F.when(~F.col("success"), F.coalesce("_error", F.lit("All runs failed"))),
    }).drop("_run", "_response", "_error")


def failed_results(expected: DataFrame, results: DataFrame, runs_configured: int) -> DataFrame:
    """A4: the failed row of every expected (problem, technique) without recorded runs."""
    missing = expected.select(*KEYS).distinct().join(results, KEYS, "left_anti")
    zero = {"success": F.lit(False), "accuracy": F.lit(0.0), "efficiency": F.lit(0.0), "overall": F.lit(0.0),
            "consistency_is_provisional": F.lit(True), "elapsed_time": F.lit(0.0), "runs_failed": F.lit(runs_configured).cast("long")}
    zero |= {c: F.lit(0).cast("long") for c in [*COUNTERS[1:], "runs_recorded", "runs_succeeded", "consistency_runs_used"]}
    return results.unionByName(missing.withColumns(zero), allowMissingColumns=True)


def comparison(results: DataFrame) -> DataFrame:
    """A5: successful techniques of each problem with their place by overall score."""
    place = Window.partitionBy("problem_id").orderBy(F.desc("overall"), "technique")
    return (
        results.where("success")
        .withColumn("place", F.row_number().over(place))
        .select(
            "problem_id", "place", "technique", "accuracy", "consistency", "efficiency", "overall",
            "consistency_is_provisional", "consistency_runs_used", "consistency_matching_runs",
            F.col("elapsed_time").alias("latency"), F.col("total_tokens").alias("tokens"),
        )
    )


def greedy_winner(results: DataFrame, text: str = "problem_id") -> DataFrame:
    """Best technique per problem.

    Highest overall among the successful ones, then the larger hash of
    ``problem|technique``; without a success the first name.
    """
    digest = F.sha2(F.concat_ws("|", F.col(text).cast("string"), F.col("technique")), 256)
    ok = F.col("success")
    best = F.max(F.when(ok, F.struct("overall", digest.alias("digest"), "technique")))
    grouped = results.groupBy("problem_id").agg(best.alias("best"), F.min("technique").alias("first"), F.count_if(ok).alias("successful"))
    return grouped.select(
        "problem_id",
        F.coalesce("best.technique", "first").alias("best_technique"),
        F.col("best.overall").alias("best_overall"),
        (F.col("successful") > 0).alias("any_success"),
    )


def display_order(results: DataFrame) -> DataFrame:
    """Successful first, then overall, then name; nulls shown as zero."""
    order = Window.partitionBy("problem_id").orderBy(F.desc("success"), F.desc(F.coalesce("overall", F.lit(0.0))), "technique")
    shown = {c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in ("accuracy", "consistency", "efficiency", "overall")}
    return results.withColumn("display_rank", F.row_number().over(order)).withColumns(shown)


def execution_summary(results: DataFrame) -> DataFrame:
    """Attempted techniques and successes per problem (technique names are a small registry)."""
    return results.groupBy("problem_id").agg(
        F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("attempted_techniques"),
        F.count_distinct("technique").alias("attempted_count"),
        F.count_if("success").alias("successful_count"),
    )


def finalise(results: DataFrame, winners: DataFrame, mode: str = "benchmark") -> DataFrame:
    """The winner's row with its source label; a failed winner gives status ``failed``."""
    chosen = winners.select("problem_id", F.col("best_technique").alias("technique"))
    note = f"{mode}_mode_runtime_only" if mode == "benchmark" else "normal_mode_decided_pre_execution"
    return (
        results.join(chosen, KEYS, "inner")
        .join(execution_summary(results), "problem_id")
        .withColumns({
            "selection_source": F.lit("runtime_scores"),
            "decision_reason": F.lit(note),
            "run_mode": F.lit(mode),
            "status": F.when(F.col("success"), "ok").otherwise("failed"),
        })
    )


# --- baseline runs ---------------------------------------------------------------------

def baseline(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per problem means, consistency over successful runs and composite; null scores when all failed."""
    ok = F.col("success")
    per_key = runs.groupBy("problem_id", F.when(ok, F.col("normalized_output")).alias("normalized_output")).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.min("run_index").alias("first_run"),
        *[F.sum(F.when(ok, F.col(c).try_cast("double")).cast("decimal(28,10)")).alias(c) for c in [*COUNTERS, "accuracy", "efficiency"]],
    )
    whole = per_key.groupBy("problem_id").agg(
        F.sum("n").alias("runs_requested"), F.sum("ok").alias("runs_succeeded"), F.max("ok").alias("matching"),
        *[F.sum(c).cast("double").alias(c) for c in [*COUNTERS, "accuracy", "efficiency"]],
    )
    done = F.nullif(F.col("runs_succeeded"), F.lit(0))
    accuracy, efficiency = F.col("accuracy") / done, F.col("efficiency") / done
    steady = F.when(F.col("runs_succeeded") >= 2, F.col("matching") / F.col("runs_succeeded"))
    w = weights
    full = accuracy * w["accuracy"] + steady * w["consistency"] + efficiency * w["efficiency"]
    part = w["accuracy"] + w["efficiency"]
    without = (accuracy * w["accuracy"] + efficiency * w["efficiency"]) / part if part > 0 else F.lit(0.0)
    return whole.select(
        "problem_id", "runs_requested", "runs_succeeded",
        rounded(accuracy, 4).alias("accuracy"),
        rounded(steady, 4).alias("consistency"),
        rounded(efficiency, 4).alias("efficiency"),
        rounded(F.when(done.isNotNull(), F.coalesce(full, without)), 4).alias("overall"),
        rounded(F.col("elapsed_time") / done, 3).alias("elapsed_time"),
        *[rounded(F.col(c) / done, 0).cast("long").alias(c) for c in COUNTERS[1:]],
        F.when(done.isNull(), "all_runs_failed").alias("error"),
    )


def best_baseline_run(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """First run with the highest un-normalised accuracy/efficiency score."""
    score = rounded(F.col("accuracy") * weights["accuracy"] + F.col("efficiency") * weights["efficiency"], 6)
    best = F.max(F.struct(score.alias("score"), (-F.col("run_index")).alias("earliest")))
    return runs.where("success").groupBy("problem_id").agg(best.alias("best")).select(
        "problem_id", (-F.col("best.earliest")).alias("best_run_index"), F.col("best.score").alias("best_score")
    )


def round_totals(rounds: DataFrame, key: str = "call_id") -> DataFrame:
    """Token and time totals over the continuation rounds of a call."""
    return rounds.groupBy(key).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        rounded(exact_sum(F.col("eval_time")), 6).alias("eval_time"),
        (F.count("*") - 1).alias("continuation_rounds"),
    )


# --- batch report ------------------------------------------------------------------------

def win_table(winners: DataFrame) -> DataFrame:
    """Wins and share of all problems per technique."""
    wins = winners.groupBy(F.col("best_technique").alias("technique")).agg(F.count("*").alias("wins"))
    # one row per technique by now, so the window over all of them is tiny
    return wins.withColumn("problems", F.sum("wins").over(Window.partitionBy(F.lit(1)))).withColumn(
        "win_percent", rounded(F.col("wins") * 100.0 / F.col("problems"), 1)
    )


def metric_summary(compared: DataFrame, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """Mean, population deviation, min and max per technique and metric.

    The deviation comes from exact sums of the scores and of their squares. A rollup adds ``level``, the number of keys
    that are totalled, which tells a subtotal from a key that is null.
    """
    keys = [*(by or []), "technique"]
    long = compared.select(*keys, "accuracy", "consistency", "efficiency", "overall").unpivot(
        keys, ["accuracy", "consistency", "efficiency", "overall"], "metric", "value"
    ).where("value is not null")
    grouped = long.rollup("metric", *keys) if rollup else long.groupBy(*keys, "metric")
    stats = grouped.agg(
        F.count("*").alias("n"),
        exact_mean(F.col("value")).alias("_mean"),
        (exact_sum(F.col("value") * F.col("value")) / F.count("*")).alias("_square"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        *([F.bit_count(F.grouping_id()).cast("int").alias("level")] if rollup else []),
    )
    spread = F.sqrt(F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))
    return stats.select(*keys, "metric", "n", rounded(F.col("_mean"), 3).alias("mean"), rounded(spread, 3).alias("std"), "low", "high", *(["level"] if rollup else []))


def category_wins(winners: DataFrame, categories: DataFrame) -> DataFrame:
    """Wins per category and technique."""
    return winners.join(categories, "problem_id").groupBy("category", F.col("best_technique").alias("technique")).agg(F.count("*").alias("wins"))
