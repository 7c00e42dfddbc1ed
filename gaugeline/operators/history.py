"""Stored benchmark history: building, ranking and coverage.

Two tables describe history: ``problems`` (domain, difficulty, problem_id,
problem, has_ground_truth, winner_technique) and ``scores`` (domain,
difficulty, problem_id, technique, overall), both partitioned by domain and
difficulty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import text as tx
from gaugeline.functions.basics import exact_mean, rounded
from gaugeline.operators.routing import ranking_samples

BLOCK = ["domain", "difficulty"]
METRICS = ["accuracy", "consistency", "efficiency", "overall"]


def last_runs(runs: DataFrame, keys: list[str], count: int = 3) -> DataFrame:
    """The last runs of each group with their slot 1..count, oldest first.

    Ranking keeps ``count`` rows per group on the map side already, so a hot
    group does not travel.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("run_index"), *[F.desc(c) for c in ("technique",) if c in runs.columns and c not in keys])
    kept = runs.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= count)
    total = F.max("_back").over(Window.partitionBy(*keys))
    return kept.withColumn("slot", total - F.col("_back") + 1).drop("_back")


def run_entries(runs: DataFrame, best: DataFrame) -> DataFrame:
    """Up to three run entries per problem, one made-up entry when no run is stored.

    ``best`` holds problem_id, technique and the final scores of the winner.
    """
    kept = last_runs(runs.join(best.select("problem_id", "technique"), ["problem_id", "technique"], "left_semi"), ["problem_id"])
    entries = kept.select("problem_id", "slot", "run_index", *METRICS)
    made = best.join(entries.select("problem_id").distinct(), "problem_id", "left_anti").select(
        "problem_id", F.lit(1).alias("slot"), F.lit(1).alias("run_index"), *METRICS
    )
    return entries.unionByName(made)


def pivot_runs(entries: DataFrame) -> DataFrame:
    """Fixed slots run1..run3, empty ones null."""
    cells = entries.groupBy("problem_id").pivot("slot", [1, 2, 3]).agg(F.max(F.struct("run_index", *METRICS)))
    empty = {i: F.struct(F.lit(i).alias("run_index"), *[F.lit(None).cast("double").alias(m) for m in METRICS]) for i in (1, 2, 3)}
    return cells.select("problem_id", *[
        F.struct(
            F.coalesce(F.col(f"`{i}`.run_index"), F.lit(i)).cast("int").alias("run_index"),
            *[F.col(f"`{i}`.{m}").alias(m) for m in METRICS],
        ).alias(f"run{i}") for i in empty
    ])


def unpivot_runs(documents: DataFrame) -> DataFrame:
    """Runs from the slots run1..run3; legacy documents with a ``runs`` array give its last three."""
    slots = documents.select("problem_id", F.expr("stack(3, 1, run1, 2, run2, 3, run3) as (slot, run)")).where("run is not null")
    named = slots.select("problem_id", "slot", "run.*")
    if "runs" not in documents.columns:
        return named
    legacy = documents.where("run1 is null and runs is not null").select(
        "problem_id", F.posexplode(F.slice("runs", F.greatest(F.size("runs") - 2, F.lit(1)), 3)).alias("slot", "run")
    )
    return named.unionByName(legacy.select("problem_id", (F.col("slot") + 1).alias("slot"), "run.*"))


def last_three_average(entries: DataFrame) -> DataFrame:
    """Averages of the stored runs of a problem; missing values are skipped."""
    return entries.groupBy("problem_id").agg(
        *[rounded(exact_mean(F.col(m)), 4).alias(m) for m in METRICS],
        rounded(exact_mean(F.col("overall")), 4).alias("avg_performance_score"),
        F.count("*").alias("sample_count"),
    )


def technique_averages(entries: DataFrame) -> DataFrame:
    """Averages per technique over the stored comparison rows of a problem."""
    return entries.groupBy("problem_id", "technique").agg(
        *[rounded(exact_mean(F.col(m)), 4).alias(m) for m in METRICS], F.min("position").alias("position")
    )


def winners(averages: DataFrame) -> DataFrame:
    """Technique with the highest average overall; the first listed one on a tie."""
    best = F.max(F.when(F.col("overall") > -1, F.struct("overall", (-F.col("position")).alias("first"), "technique")))
    return averages.groupBy("problem_id").agg(best.alias("best")).select(
        "problem_id", F.col("best.technique").alias("winner_technique"), F.col("best.overall").alias("winner_overall")
    )


def to_history_row(results: DataFrame) -> DataFrame:
    """Compact stored row from a result and its metadata columns."""
    flag, quality = tx.stored_quality(F.col("ground_truth_flag"), F.col("ground_truth"))
    text = F.coalesce(F.nullif(F.trim("problem"), F.lit("")), F.lit("unknown_problem"))
    return results.select(
        tx.first_filled(F.col("domain"), F.col("subject"), F.col("category"), default="general").alias("domain"),
        tx.first_filled(F.col("difficulty"), default="basic").alias("difficulty"),
        tx.problem_id(text).alias("problem_id"),
        text.alias("problem"),
        tx.key(F.col("run_mode"), "normal").alias("run_mode"),
        flag.alias("has_ground_truth"),
        quality.alias("evaluation_quality"),
        F.col("overall").alias("performance_score"),
    )


def persistable(results: DataFrame) -> DataFrame:
    """Only benchmark-mode rows of a resolved domain are stored."""
    return results.where((tx.run_mode(F.col("run_mode")) == "benchmark") & F.col("domain").isNotNull())


def baseline_row(averages: DataFrame, composite: DataFrame) -> DataFrame:
    """The composite overall and consistency replace the run averages where known."""
    extra = composite.select("problem_id", F.col("overall").alias("_overall"), F.col("consistency").alias("_consistency"))
    overall = F.coalesce(rounded(F.col("_overall"), 4), F.col("overall"))
    return averages.join(extra, "problem_id", "left").withColumns({
        "overall": overall,
        "avg_performance_score": F.coalesce(rounded(F.col("_overall"), 4), F.col("avg_performance_score")),
        "consistency": F.coalesce(rounded(F.col("_consistency"), 4), F.col("consistency")),
        "technique": F.lit("raw_baseline"),
    }).drop("_overall", "_consistency")


def usable(problems: DataFrame, require_ground_truth: bool, allow_unknown: bool = False) -> DataFrame:
    """Rows that may count: with ground truth when that is required."""
    if not require_ground_truth:
        return problems
    return problems.where(F.coalesce(F.col("has_ground_truth"), F.lit(allow_unknown)))


def domain_ranking(
    problems: DataFrame,
    scores: DataFrame,
    techniques: list[str] | None = None,
    require_ground_truth: bool = False,
    allow_unknown: bool = False,
) -> DataFrame:
    """Techniques of each (domain, difficulty) by average overall.

    The win rate divides by all problems that have a winner, allowed or not.
    After aggregation a block holds one row per technique, so the ranking
    window is as small as the technique registry.
    """
    kept = usable(problems, require_ground_truth, allow_unknown)
    wins = kept.where("winner_technique is not null").groupBy(*BLOCK, F.col("winner_technique").alias("technique")).agg(F.count("*").alias("wins"))
    counted = scores.where(F.col("overall").isNotNull())
    if techniques:
        counted = counted.where(F.col("technique").isin(*techniques))
    if require_ground_truth:
        counted = counted.join(kept.select(*BLOCK, "problem_id"), [*BLOCK, "problem_id"], "left_semi")
    averages = counted.groupBy(*BLOCK, "technique").agg(
        rounded(exact_mean(F.col("overall")), 4).alias("average_overall"), F.count("*").alias("samples")
    )
    return _placed(averages, wins)


def _placed(averages: DataFrame, wins: DataFrame) -> DataFrame:
    """Averages and wins per (domain, difficulty, technique) as a ranking of each block."""
    totals = wins.groupBy(*BLOCK).agg(F.sum("wins").alias("total_problems"))
    ranked = (
        averages.join(wins, [*BLOCK, "technique"], "left")
        .join(totals, BLOCK, "left")
        .withColumn("wins", F.coalesce("wins", F.lit(0)))
    )
    place = Window.partitionBy(*BLOCK).orderBy(F.desc("average_overall"), F.desc("samples"), "technique")
    return ranked.select(
        *BLOCK, "technique", "average_overall", "samples", "wins",
        rounded(F.coalesce(F.try_divide(F.col("wins"), F.col("total_problems")), F.lit(0.0)), 4).alias("win_rate"),
        F.row_number().over(place).alias("rank"),
    )


def ranking_from_totals(
    totals: DataFrame,
    techniques: list[str] | None = None,
    require_ground_truth: bool = False,
    allow_unknown: bool = False,
) -> DataFrame:
    """A9 from stored totals (``history_totals.read_totals``): the rows of :func:`domain_ranking` without reading scores."""
    allowed = ["yes", "unknown"] if allow_unknown else ["yes"]
    kept = totals.where(F.col("truth").isin(*allowed)) if require_ground_truth else totals
    wins = kept.where("technique is not null").groupBy(*BLOCK, "technique").agg(F.sum("problems").alias("wins")).where("wins > 0")
    counted = kept.where(F.col("technique").isin(*techniques)) if techniques else kept
    averages = counted.groupBy(*BLOCK, "technique").agg(F.sum("score_sum").cast("double").alias("_sum"), F.sum("samples").alias("samples"))
    averages = averages.where("samples > 0").select(*BLOCK, "technique", rounded(F.col("_sum") / F.col("samples"), 4).alias("average_overall"), "samples")
    return _placed(averages, wins)


def coverage_from_totals(totals: DataFrame) -> DataFrame:
    """A11 from stored totals: the rows of :func:`coverage`."""
    per = totals.groupBy(*BLOCK, "technique").agg(
        F.sum("problems").alias("n"), F.sum("tested").alias("tested"), F.sum(F.when(F.col("truth") == "yes", F.col("problems"))).alias("truths")
    )
    won = F.col("technique").isNotNull() & (F.col("n") > 0)

    def listed(condition: Column, value: Column) -> Column:
        names = F.collect_list(F.when(condition, value))
        return F.when(F.size(names) > 0, F.array_join(F.array_sort(names), ","))

    # a block has one row per technique here
    return per.groupBy(*BLOCK).agg(
        F.sum("n").alias("problem_count"),
        F.coalesce(F.sum("truths"), F.lit(0)).alias("ground_truth_count"),
        F.coalesce(F.sum(F.when(won, F.col("n"))), F.lit(0)).alias("total_with_winner"),
        listed(F.col("tested") > 0, F.col("technique")).alias("techniques_tested"),
        listed(won, F.concat_ws("=", "technique", "n")).alias("win_counts"),
    ).where("problem_count > 0")


def coverage(problems: DataFrame, scores: DataFrame) -> DataFrame:
    """Problems, problems with ground truth, techniques seen and win counts per block."""
    counts = problems.groupBy(*BLOCK).agg(
        F.count("*").alias("problem_count"),
        F.count_if(F.coalesce("has_ground_truth", F.lit(False))).alias("ground_truth_count"),
        F.count("winner_technique").alias("total_with_winner"),
    )
    seen = scores.select(*BLOCK, "technique").distinct().groupBy(*BLOCK).agg(
        F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques_tested")
    )
    wins = problems.where("winner_technique is not null").groupBy(*BLOCK, "winner_technique").agg(F.count("*").alias("n"))
    listed = wins.groupBy(*BLOCK).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "winner_technique", "n"))), ",").alias("win_counts")
    )
    return counts.join(seen, BLOCK, "left").join(listed, BLOCK, "left")


def ranking_summary(ranking: DataFrame, keys: list[str], average: str = "average_overall") -> DataFrame:
    """First and second of each ranking in one row, for the gates and headlines."""

    def given(column: str) -> Column:
        return F.col(column) if column in ranking.columns else F.lit(None)

    def at(place: int, column: str | Column, kind: str) -> Column:
        value = given(column) if isinstance(column, str) else column
        return F.max(F.when(F.col("rank") == place, value)).cast(kind)

    samples = ranking_samples(given("samples"), given("unweighted_samples"), given("effective_samples"))

    return ranking.groupBy(*keys).agg(
        F.max("rank").alias("ranked"),
        at(1, "technique", "string").alias("top_technique"),
        at(1, average, "double").alias("top_average"),
        at(1, samples, "double").alias("top_samples"),
        at(1, "confidence", "string").alias("top_confidence"),
        at(1, "win_rate", "double").alias("top_win_rate"),
        at(2, "technique", "string").alias("second_technique"),
        at(2, average, "double").alias("second_average"),
        at(2, samples, "double").alias("second_samples"),
    )


def headline(ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate, average, samples and lead of the top technique."""
    s = ranking_summary(ranking, keys)
    return s.select(
        *keys, "top_technique", "top_win_rate", "top_average", F.col("top_samples").cast("long").alias("samples"),
        rounded(F.when(F.col("ranked") > 1, F.col("top_average") - F.col("second_average")), 4).alias("lead"),
    )
