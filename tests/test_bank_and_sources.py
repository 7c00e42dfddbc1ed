import json
import random
import time

from pyspark.sql import functions as F

from gaugeline.functions import text as tx
from gaugeline.operators import bank as bk
from gaugeline.operators import scoring as sco
from gaugeline.session import scratch_path
from gaugeline.sources import history_store as st
from gaugeline.sources import problems as sp


def test_three_problem_file_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"problem": "p1", "answer": "1"}, {"problem": "", "answer": "x"}, 7]), encoding="utf-8")
    (tmp_path / "b.json").write_text("﻿" + json.dumps({"algebra": [{"problem": "p2", "solution": "2", "category": "own"}], "x": 3}), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"algebra": {"basic": [{"problem": "p3", "answer": "", "solution": "3"}, {"problem": "p4"}]}}), encoding="utf-8")
    got = {r.problem: (r.answer, r.category, r.difficulty) for r in sp.read_problems(spark, str(tmp_path)).collect()}
    assert got == {"p1": ("1", "general", None), "p2": ("2", "own", None), "p3": ("3", "algebra", "basic")}


def test_append_and_export(spark):
    path = scratch_path(spark, "set")
    df = spark.createDataFrame([("p", "1")], "problem string, answer string")
    sp.append_problems(df, path)
    sp.append_problems(df, path)
    assert spark.read.parquet(path).count() == 2
    out = scratch_path(spark, "json")
    sp.write_json(df, out)
    assert spark.read.json(out).first().problem == "p"


def test_user_examples_missing_or_broken(spark, tmp_path):
    assert sp.read_user_examples(spark, str(tmp_path / "nothing.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json", encoding="utf-8")
    assert sp.read_user_examples(spark, str(tmp_path / "bad.json")).count() == 0


def test_metadata_normalising(spark):
    entry = {"problem": "p", "solution": "s", "type": "substitution", "concept": "expression evaluation", "difficulty": "easy", "constraints": ["positive_value"], "format": {"Has Assignment": True}}
    df = spark.createDataFrame([(json.dumps({"algebra": [entry]}),)], "value string")
    row = sp.examples_from_json(df).first()
    assert (row.type, row.concept, row.difficulty, row.constraints) == ("evaluate_substitution", ["expression_evaluation"], "basic", ["positive_values"])
    assert row.format_labels == ["has_assignment", "has_assignment_true"]
    entries = spark.createDataFrame([(json.dumps(entry["format"]),)], "f string").select(tx.format_entries(F.col("f")).alias("e")).first().e
    assert [(e.key, e.kind, e.labels) for e in entries] == [("has_assignment", "boolean", ["true"])]


def test_unknown_difficulty_has_no_level(spark):
    df = spark.createDataFrame([("odd",), ("2",), ("9",), (None,)], "d string")
    assert [r[0] for r in df.select(tx.difficulty_level(F.col("d"))).collect()] == [None, 2.0, 3.0, None]


def test_validation_splits(spark):
    df = spark.createDataFrame([('{"problem": "p", "solution": "s"}',), ('{"problem": "p"}',), ("nonsense",)], "entry string")
    good, bad = bk.validate(df)
    assert good.count() == 1
    assert {r.entry: r.broken for r in bad.collect()}['{"problem": "p"}'] == ["solution_or_answer_required"]


def test_stitching(spark):
    rows = [(1, 1, "hello"), (1, 2, "lo world"), (2, 1, "Step 1. Step 2."), (2, 2, " Final answer: 42."), (3, 1, ""), (3, 2, "a"), (3, 3, "a")]
    df = spark.createDataFrame(rows, "call int, seq int, text string")
    got = {r.call: r.response for r in bk.stitch(df, "call", "seq", "text").collect()}
    assert got == {1: "hello world", 2: "Step 1. Step 2. Final answer: 42.", 3: "a"}


def test_add_purge_list(spark):
    new = spark.createDataFrame([
        (1, "algebra", "basic", "Solve x", "s", "My Type", "c"), (2, "algebra", "basic", " solve X ", "s", "t", "c"),
        (3, "history", "basic", "p", "s", "t", "c"), (4, "algebra", "basic", "In bank", "s", "t", "c"), (5, "algebra", "basic", " ", "s", "t", "c"),
    ], "pos int, subject string, difficulty string, problem string, solution string, type string, concept string")
    curated = spark.createDataFrame([("algebra", "basic", "in BANK")], "subject string, difficulty string, problem string")
    accepted, rejected = bk.add_user_examples(new, curated.limit(0), curated, now=1000.0, ttl=7200.0)
    row = accepted.first()
    assert (row.problem, row.type, row.expires_at, row.tags) == ("Solve x", "my_type", 8200.0, ["algebra", "my_type"])
    assert {r.pos: r.reason for r in rejected.collect()} == {2: "duplicate_user", 3: "invalid_subject", 4: "duplicate_curated", 5: "blank_text"}
    expired = spark.createDataFrame([("algebra", "basic", "solve x", 999.0)], "subject string, difficulty string, problem string, expires_at double")
    early = new.withColumn("solution", F.when(F.col("pos") == 1, " ").otherwise(F.col("solution")))
    later, refused = bk.add_user_examples(early, expired, curated, now=1000.0)
    assert [r.pos for r in later.collect()] == [2] and {r.pos: r.reason for r in refused.collect()}[1] == "blank_text"
    assert bk.listing(accepted, now=4600.0).first().ttl_remaining_hours == 1.0
    counts = bk.purge_counts(accepted, now=9000.0).first()
    assert (counts.kept, counts.removed) == (0, 1)
    assert sp.live(accepted, 9000.0).count() == 0


def test_history_versions(spark):
    path = scratch_path(spark, "h")
    make = lambda rows: spark.createDataFrame(rows, "domain string, difficulty string, problem_id string, winner_technique string, updated int")
    st.upsert_history(make([("a", "b", "p1", "x", 1), ("a", "b", "p2", "x", 1), ("a", "b", "p3", "x", 1)]), path, "w", 0)
    st.upsert_history(make([("a", "b", "p1", "y", 2)]), path, "w", 1)
    st.upsert_history(make([("a", "b", "p1", "y", 2)]), path, "w", 1)  # repeated batch
    st.upsert_history(make([("a", "b", "p9", "x", 1)]), path, "v", 0)  # another writer, the same number
    st.upsert_history(make([("a", "b", "p2", "old", 0), ("a", "b", "p3", "z", 7), ("a", "b", "p3", "w", 6)]), path, "v", 1)
    got = {r.problem_id: r.winner_technique for r in st.read_history(spark, path, "a", "b").collect()}
    assert got == {"p1": "y", "p2": "x", "p3": "z", "p9": "x"}
    target = scratch_path(spark, "compact")
    st.compact_history(spark, path, target)
    assert spark.read.parquet(target).count() == 4
    assert {r.problem_id: r.winner_technique for r in st.read_history(spark, target).collect()} == got
    plan = st.read_history(spark, path, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan


def test_scored_runs_and_registered_scorer(spark):
    df = spark.createDataFrame([
        ("p", "t", 1, True, "Final answer: 5", "5", "2 + 3", 2.0, 10, 20, 30), ("p", "t", 2, False, None, "5", "2 + 3", 0.0, 0, 0, 0), ("q", "t", 1, True, "it is 5", None, "2 + 3", 2.0, 10, 20, 30),
    ], "problem_id string, technique string, run_index int, success boolean, response string, ground_truth string, problem string, elapsed_time double, prompt_tokens int, completion_tokens int, total_tokens int")
    sco.register_scorer("length", lambda response, truth: F.length(response).cast("double"))
    try:
        got = {(r.problem_id, r.run_index): r for r in sco.score_runs(df).collect()}
    finally:
        sco.unregister_scorer("length")
    assert (got[("p", 1)].accuracy, got[("p", 1)].normalized_output, got[("p", 1)].length) == (1.0, "num:5", 15.0)
    assert (got[("p", 2)].accuracy, got[("p", 2)].efficiency, got[("p", 2)].normalized_output) == (0.0, 0.0, "error:run_2")
    assert got[("q", 1)].accuracy == 1.0  # plain arithmetic supplies its own answer


def test_stitching_many_chunks(spark):
    """Equal to the plain rule, chunk by chunk; 100,000 chunks of one call in linear time."""
    rng = random.Random(3)

    def plain(chunks, window=500):
        have = ""
        for t in chunks:
            t = t or ""
            k = next((k for k in range(min(len(have), len(t), window), 0, -1) if have.endswith(t[:k])), 0)
            have += t[k:]
        return have

    calls = {c: [rng.choice([None, "", "a", "ab", "aab" * rng.randrange(200), "".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(12)))]) for _ in range(rng.choice([1, 5, 300, 700]))] for c in range(8)}
    df = spark.createDataFrame([(c, k, t) for c, ts in calls.items() for k, t in enumerate(ts)], "call int, seq int, text string")
    got = {r.call: (r.response, r.chunks) for r in bk.stitch(df, "call", "seq", "text").collect()}
    assert got == {c: (plain(ts), len(ts)) for c, ts in calls.items()}
    start = time.time()
    long = spark.range(100_000).selectExpr("1 call", "id seq", "concat('part ', id, ' of the answer, ') text")
    assert bk.stitch(long, "call", "seq", "text").selectExpr("length(response) n").first().n > 1_000_000 and time.time() - start < 60


def test_the_difficulty_of_a_bank_is_read_once(spark):
    texts = ["Hard", "", None, "interm", "2", "odd", " EASY ", "-1", "7", "2.5", "nan", "expert"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r[0] for r in df.select(tx.bank_difficulty(F.col("d"))).collect()]
    assert got == ["advanced", None, None, "intermediate", "intermediate", None, "basic", "basic", "advanced", "intermediate", "advanced", "advanced"]
    # written out, the steps repeat the label 100 times and more, which no compiler of the plan takes
    bank = df.selectExpr("'x + 1' as problem", "'algebra' as subject", "d as difficulty", "d as bucket")
    plan = bk.bucket_report(bk.retag_difficulties(bank))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 16


def test_a_regrouped_bank_has_few_files(spark):
    rows = spark.range(0, 400, 1, 8).selectExpr(
        "id", "'x + 1' as problem", "concat('s', id % 2) as subject", "element_at(array('easy', 'medium', 'hard'), cast(id % 3 + 1 as int)) as difficulty", "'' as bucket"
    )
    path = scratch_path(spark, "regrouped")
    bk.regroup(rows, path)
    back = spark.read.json(path)
    assert back.count() == 400 and back.select("subject", "bucket").distinct().count() == 6
    assert back.where("difficulty <> bucket").count() == 0
    assert len(back.inputFiles()) == 6  # 8 tasks wrote 48
