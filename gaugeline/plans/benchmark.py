"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import text as tx
from gaugeline.operators import history as hs
from gaugeline.operators import routing as rt
from gaugeline.operators import runs as rn
from gaugeline.operators import scoring as sc
from gaugeline.operators import similarity as sm
from gaugeline.session import durable, shuffle_width


def benchmark(runs: DataFrame, problems: DataFrame, weights: dict[str, float]) -> dict[str, DataFrame]:
    """Recorded runs to scored runs, technique results, winners and comparison.

    The scored runs are the costly step and feed everything else, so they are
    stored once. The joined rows are few bytes but much work each: they are dealt
    out evenly before they are scored, as AQE merges partitions by their bytes.
    """
    joined = sc.with_ground_truth(runs, problems, keys=True)
    scored = durable(sc.score_runs(joined.repartition(shuffle_width(joined.sparkSession))))
    results = durable(rn.technique_results(scored, weights))
    return {"runs": scored, "results": results, "winners": rn.greedy_winner(results), "comparison": rn.comparison(results)}


def history_tables(results: DataFrame, winners: DataFrame, problems: DataFrame, mode: str = "benchmark") -> tuple[DataFrame, DataFrame]:
    """(problems, scores) rows of benchmark results, ready for the history store.

    ``problems``: problem_id, problem, domain (null when out of scope), difficulty, answer.
    """
    facts = problems.select("problem_id", "problem", "domain", "difficulty", tx.ground_truth_text(F.col("answer")).isNotNull().alias("has_ground_truth"))
    kept = hs.persistable(facts.withColumn("run_mode", F.lit(mode))).drop("run_mode")
    stored = kept.join(winners.select("problem_id", F.col("best_technique").alias("winner_technique")), "problem_id")
    scores = results.where("success").select("problem_id", "technique", "overall").join(kept.select("problem_id", "domain", "difficulty"), "problem_id")
    return stored, scores


def rankings_for(
    targets: DataFrame,
    documents: DataFrame,
    scores: DataFrame,
    techniques: list[str] | None = None,
    require_ground_truth: bool = True,
    allow_unknown: bool = False,
) -> DataFrame:
    """Targets with the summaries of their profile and domain rankings (input of D2 and D3).

    ``documents``: doc_id, domain, difficulty, problem, winner_technique, has_ground_truth; ``scores``: doc_id, technique,
    overall. In both tiers only documents with a ground truth count, unless that is switched off; documents of unknown
    quality count only if they are allowed.
    """
    quality = {"require_ground_truth": require_ground_truth, "allow_unknown": allow_unknown}
    found = durable(sm.match_history(targets, documents, scores, techniques, **quality))
    profile = hs.ranking_summary(sm.profile_ranking(found), ["target_id"])
    profile = profile.join(sm.match_summary(found).select("target_id", "matched_documents"), "target_id", "right")
    flag = ["has_ground_truth"] if "has_ground_truth" in documents.columns else []
    block = documents.select("domain", "difficulty", F.col("doc_id").alias("problem_id"), "winner_technique", *flag)
    placed = scores.withColumnRenamed("doc_id", "problem_id").join(block.drop("winner_technique", *flag), "problem_id")
    domain = hs.ranking_summary(hs.domain_ranking(block, placed, techniques, **quality), hs.BLOCK)
    return rt.with_rankings(targets, profile, domain)


def route(targets: DataFrame, documents: DataFrame, scores: DataFrame, min_samples: int = 3, min_gap: float = 0.03) -> DataFrame:
    """D2 over a whole table of new problems: which technique to run, or null to run them all (benchmark mode always does)."""
    return rt.preselect(rankings_for(targets, documents, scores), min_samples, min_gap)
