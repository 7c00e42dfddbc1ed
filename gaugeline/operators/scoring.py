"""Scoring of recorded runs: one projection per run, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import answers as an
from gaugeline.functions import metrics as mx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import rounded

Scorer = Callable[[Column, Column], Column]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Add a score column built from (response, ground_truth) to every scored run."""
    _SCORERS[name] = scorer


def unregister_scorer(name: str) -> None:
    _SCORERS.pop(name, None)


def with_ground_truth(runs: DataFrame, problems: DataFrame, keys: bool = False) -> DataFrame:
    """Attach the problem's text and answer; runs of unknown problems keep nulls.

    With ``keys`` the answer comes with ``truth_keys``, read once per problem for ``score_runs``; a problem without an answer
    that asks for plain arithmetic gets those of its result.

    A hot problem only makes its run side heavy; the problem side has one row
    per key, so AQE can split the run partition.
    """
    facts = problems.select("problem_id", "problem", tx.ground_truth_text(F.col("answer")).alias("ground_truth"))
    if keys:
        truth = F.coalesce(F.col("ground_truth"), an.simple_arithmetic(F.col("problem")))
        facts = facts.withColumn("truth_keys", an.expected_keys(truth))
    return runs.join(facts, "problem_id", "left")


def score_runs(runs: DataFrame, final_only: bool = False, share: float = 0.75) -> DataFrame:
    """Q20: accuracy, efficiency and comparison key of each run.

    Needs problem_id, technique, run_index, success, response, ground_truth,
    elapsed_time, prompt_tokens, completion_tokens, total_tokens; ``problem``
    is optional and lets plain arithmetic questions supply their own answer, as
    is ``truth_keys`` (``with_ground_truth``), which saves reading the answer per run.
    """
    metric = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("elapsed_time", "prompt_tokens", "completion_tokens", "total_tokens")}
    success = F.coalesce(F.col("success"), F.lit(False))
    response = F.coalesce(F.col("response"), F.lit(""))
    truth = F.col("ground_truth")
    if "problem" in runs.columns:
        truth = F.coalesce(truth, an.simple_arithmetic(F.col("problem")))
    based = runs.withColumns({**metric, "success": success, "response": response, "_truth": truth})
    truth, response, success = F.col("_truth"), F.col("response"), F.col("success")
    efficiency = mx.efficiency(response, F.col("elapsed_time"), F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens"), share)
    keys = F.col("truth_keys") if "truth_keys" in runs.columns else None
    failed_key = F.concat(F.lit("error:run_"), F.col("run_index").cast("string"))
    scored = based.withColumns({
        "accuracy": F.when(success, rounded(an.accuracy(response, truth, final_only, keys), 3)).otherwise(0.0),
        "efficiency": F.when(success, efficiency).otherwise(0.0),
        "normalized_output": F.when(success, an.output_key(response)).otherwise(failed_key),
        **{name: scorer(response, truth) for name, scorer in _SCORERS.items()},
    })
    return scored.drop("_truth", "truth_keys")


def normalise_payloads(df: DataFrame) -> DataFrame:
    """Provider counters as clean run metrics: nanoseconds to seconds, counts at least zero."""

    def count(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(name).cast("string").try_cast("double").try_cast("long"), F.lit(0)), F.lit(0))

    def seconds(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0)) / 1e9

    prompt, completion = count("prompt_eval_count"), count("eval_count")
    return df.withColumns({
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "total_tokens": prompt + completion,
        "load_time": seconds("load_duration"),
        "prompt_eval_time": seconds("prompt_eval_duration"),
        "eval_time": seconds("eval_duration"),
    }).drop("prompt_eval_count", "eval_count", "load_duration", "prompt_eval_duration", "eval_duration")
