import re

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import answers as an
from gaugeline.functions import metrics as mx
from gaugeline.operators import history as hs
from gaugeline.operators import routing as rt
from gaugeline.operators import runs as rn
from gaugeline.operators.sequences import running_share, sequence_numbers, with_ids

W = mx.normalise_weights()
RUN = "problem_id string, technique string, run_index int, success boolean, normalized_output string, accuracy double, efficiency double, elapsed_time double, total_tokens int, prompt_tokens int, completion_tokens int"


def run(p, t, i, ok, key, acc=1.0, eff=0.5):
    return (p, t, i, ok, key, acc, eff, 2.0, 10 * i, 5, 5)


def test_running_consistency(spark):
    texts = ["Ans: 1/2", "The answer is 0.5", "Final answer: 0.6"]
    df = spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)], "r string, run_index int")
    df = df.select(F.lit("p").alias("problem_id"), F.lit("t").alias("technique"), "run_index", an.output_key(F.col("r")).alias("normalized_output"), F.lit(1.0).alias("accuracy"), F.lit(1.0).alias("efficiency"))
    got = [r.consistency for r in rn.running_scores(df, W).orderBy("run_index").collect()]
    assert got == [None, 1.0, 0.667]


@pytest.mark.parametrize("width", [1, 2, 7])
def test_running_share_does_not_depend_on_ranges(spark, width):
    """A hot group, a hot stretch of the order, null keys and null values."""
    rows = [(None if i % 50 == 0 else "a" if i % 3 else "b", float(i) if i < 20 else 20 + i / 1e6, None if i % 7 == 0 else f"k{(i * i) % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i double, v string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = {(r.g, r.i): (r.position, r.matching) for r in running_share(df, ["g"], "i", "v").collect()}
        numbers = {(r.g, r.i): r.n for r in sequence_numbers(df, ["g"], ["i"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen = {}
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        own = seen.setdefault(g, [])
        own.append(v)
        assert got[(g, i)] == (len(own), max(own.count(x) for x in set(own))) and numbers[(g, i)] == len(own)


def test_running_share_scans_few_times(spark):
    df = spark.createDataFrame([("a", i, f"k{i % 3}") for i in range(50)], "g string, i int, v string")
    plan = running_share(df, ["g"], "i", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and len(re.findall(r"\bExchange\b", plan)) + plan.count("BroadcastExchange") <= 10


def test_sequence_numbers_and_ids(spark):
    df = spark.createDataFrame([("a", i * 7 % 50) for i in range(50)], "g string, x int")
    got = sequence_numbers(df, ["g"], ["x"], "n").collect()
    assert all(r.n == r.x + 1 for r in got)
    ids = with_ids(df, ["x"]).collect()
    assert sorted((r.x, r.id) for r in ids) == [(i, i) for i in range(50)]
    assert sequence_numbers(df.limit(0), ["g"], ["x"], "n").count() == 0


def test_technique_results(spark):
    df = spark.createDataFrame([
        run("p", "few", 1, True, "num:2"), run("p", "few", 2, True, "num:2", 0.0), run("p", "few", 3, False, "error:run_3"),
        run("p", "zero", 1, False, "error:run_1"), run("q", "zero", 1, True, "num:1"),
    ], RUN)
    got = {(r.problem_id, r.technique): r for r in rn.technique_results(df, W).collect()}
    few = got[("p", "few")]
    assert (few.accuracy, few.consistency, few.efficiency) == (0.5, 0.667, 0.5)
    assert (few.runs_recorded, few.runs_succeeded, few.runs_failed, few.last_success_run) == (3, 2, 1, 2)
    assert few.total_tokens == 15 and few.canonical_output == "num:2"
    zero = got[("p", "zero")]
    assert not zero.success and zero.accuracy == 0.0
    single = got[("q", "zero")]
    assert single.consistency is None and single.overall == 0.75
    won = {r.problem_id: r.best_technique for r in rn.greedy_winner(rn.technique_results(df, W)).collect()}
    assert won == {"p": "few", "q": "zero"}


def test_last_response(spark):
    df = spark.createDataFrame([("p", "t", 1, True, "a", None), ("p", "t", 2, False, "", "x")], "problem_id string, technique string, run_index int, success boolean, response string, error string")
    res = spark.createDataFrame([("p", "t", True, 1, 2), ("q", "t", False, None, 1)], "problem_id string, technique string, success boolean, last_success_run int, last_run int")
    got = {r.problem_id: (r.response, r.error) for r in rn.with_last_response(res, df).collect()}
    assert got == {"p": ("a", None), "q": ("", "All runs failed")}


def summary(spark, prefix, ranking):
    rows = [(1, t, a, float(n), i + 1) for i, (t, a, n) in enumerate(ranking)]
    df = spark.createDataFrame(rows, "target_id int, technique string, average_overall double, samples double, rank int")
    return hs.ranking_summary(df, ["target_id"])


CASES = [
    ([("few", 0.91, 6), ("zero", 0.82, 6)], [("zero", 0.89, 10), ("few", 0.86, 10)], dict(profile_min_samples=2, profile_min_gap=0.01), "db_profile_rules", "few"),
    ([("few", 0.811, 6), ("zero", 0.806, 6)], [("zero", 0.89, 12), ("few", 0.83, 12)], dict(profile_min_gap=0.03, min_samples=10), "db_history", "zero"),
    ([], [], {}, "runtime_scores", "few"),
    ([("few", 0.89, 4), ("zero", 0.81, 4)], [], dict(profile_min_samples=2, profile_min_gap=0.01), "db_profile_rules", "few"),
    ([("few", 0.90, 3.7), ("zero", 0.80, 3.2)], [], dict(profile_min_samples=2, profile_min_gap=0.01), "db_profile_rules", "few"),
]


@pytest.mark.parametrize("profile,domain,options,source,winner", CASES)
def test_after_run(spark, profile, domain, options, source, winner):
    targets = spark.createDataFrame([(1, "algebra", "basic", "x", "few")], "target_id int, domain string, difficulty string, problem string, runtime_technique string")
    p = summary(spark, "p_", profile).withColumn("matched_documents", F.lit(0))
    d = summary(spark, "d_", domain).withColumns({"domain": F.lit("algebra"), "difficulty": F.lit("basic")}).drop("target_id")
    got = rt.select_after_run(rt.with_rankings(targets, p, d), **options).first()
    assert (got.selection_source, got.best_technique) == (source, winner)
    if source == "db_history":
        assert got.profile_reason == "low_confidence_gap"
    trace = {r.tier: r.result for r in rt.decision_trace(rt.select_after_run(rt.with_rankings(targets, p, d), **options)).collect()}
    assert "passed" in trace.values()


@pytest.mark.parametrize("n,reason", [(15, "preselected_by_domain_history"), (2, "insufficient_samples")])
def test_before_run(spark, n, reason):
    targets = spark.createDataFrame([(1, "algebra", "basic")], "target_id int, domain string, difficulty string")
    p = summary(spark, "p_", []).withColumn("matched_documents", F.lit(0))
    d = summary(spark, "d_", [("few", 0.91, n), ("zero", 0.82, n)]).withColumns({"domain": F.lit("algebra"), "difficulty": F.lit("basic")}).drop("target_id")
    assert rt.preselect(rt.with_rankings(targets, p, d)).first().reason == reason


def test_before_run_bypass_and_registry(spark):
    targets = spark.createDataFrame([(1, "algebra", "basic", "benchmark"), (2, "algebra", "basic", "normal")], "target_id int, domain string, difficulty string, run_mode string")
    p = summary(spark, "p_", []).withColumn("matched_documents", F.lit(0))
    d = summary(spark, "d_", [("few", 0.91, 15), ("zero", 0.82, 15)]).withColumns({"domain": F.lit("algebra"), "difficulty": F.lit("basic")}).drop("target_id")
    ranked = rt.with_rankings(targets, p, d)
    rows = {r.target_id: (r.reason, r.best_technique) for r in rt.preselect(ranked, techniques=["few", "zero"]).collect()}
    assert rows == {1: ("benchmark_mode_runs_all", None), 2: ("preselected_by_domain_history", "few")}
    assert {r.reason for r in rt.preselect(ranked, techniques=["zero", "other"]).collect()} == {"benchmark_mode_runs_all", "invalid_best_technique"}
    assert {r.reason for r in rt.preselect(ranked, techniques=["few"]).collect()} == {"single_technique"}
    after = ranked.withColumns({"runtime_technique": F.lit("zero"), "problem": F.lit("x"), "available": F.array(F.lit("zero"))})
    assert {r.selection_source for r in rt.select_after_run(after).collect()} == {"runtime_scores"}


def test_samples_fall_back(spark):
    rows = [(1, "few", 0.9, None, 4, 1), (1, "zero", 0.5, None, None, 2)]
    df = spark.createDataFrame([(*r, 3.9) for r in rows], "target_id int, technique string, average_overall double, samples double, unweighted_samples int, rank int, effective_samples double")
    got = hs.ranking_summary(df, ["target_id"]).first()
    assert (got.top_samples, got.second_samples) == (4.0, 3.0)


def test_history_slots(spark):
    runs = spark.createDataFrame([("p", "t", i, 0.1 * i, None, 0.5, 0.1 * i) for i in range(1, 6)], "problem_id string, technique string, run_index int, accuracy double, consistency double, efficiency double, overall double")
    best = spark.createDataFrame([("p", "t", 1.0, None, 1.0, 1.0), ("q", "t", 0.5, None, 0.5, 0.5)], "problem_id string, technique string, accuracy double, consistency double, efficiency double, overall double")
    entries = hs.run_entries(runs, best)
    docs = {r.problem_id: r for r in hs.pivot_runs(entries).collect()}
    assert [docs["p"][f"run{i}"].run_index for i in (1, 2, 3)] == [3, 4, 5]
    assert docs["q"].run1.overall == 0.5 and docs["q"].run2.overall is None
    assert hs.unpivot_runs(hs.pivot_runs(entries)).count() == 6
    avg = {r.problem_id: r for r in hs.last_three_average(entries).collect()}
    assert avg["p"].overall == 0.4 and avg["p"].consistency is None and avg["p"].sample_count == 3


def test_run_plan_names_skipped_techniques(spark):
    chosen = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "target_id int, best_technique string")
    got = {r.target_id: (r.techniques_to_run, r.skipped_techniques, r.skipped_technique) for r in rt.run_plan(chosen, ["a", "b", "c"]).collect()}
    assert got == {1: (["b"], ["a", "c"], None), 2: (["a", "b", "c"], [], None), 3: (["a"], ["b", "c"], None)}
    assert [r.skipped_technique for r in rt.run_plan(chosen, ["a", "b"]).orderBy("target_id").collect()] == ["a", None, "b"]
