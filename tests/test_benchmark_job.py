from pyspark.sql import functions as F

from gaugeline.functions import metrics as mx
from gaugeline.functions.metrics import normalise_weights
from gaugeline.plans import benchmark as bm


def test_runs_to_route(spark):
    problems = spark.createDataFrame(
        [(f"p{i}", f"Solve for x: {i}x + 1 = 9.", str(i), "algebra", "basic") for i in range(1, 9)],
        "problem_id string, problem string, answer string, domain string, difficulty string",
    )
    rows = []
    for i in range(1, 9):
        for run in (1, 2, 3):
            rows.append((f"p{i}", "few_shot", run, True, f"Final answer: {i}", 2.0, 10, 30, 40))
            rows.append((f"p{i}", "zero_shot", run, True, f"Final answer: {i + run}", 2.0, 10, 30, 40))
    runs = spark.createDataFrame(rows, "problem_id string, technique string, run_index int, success boolean, response string, elapsed_time double, prompt_tokens int, completion_tokens int, total_tokens int")
    made = bm.benchmark(runs, problems, normalise_weights())
    assert {r.best_technique for r in made["winners"].collect()} == {"few_shot"}
    top = made["comparison"].where("place = 1").first()
    assert (top.accuracy, top.consistency) == (1.0, 1.0)
    stored, scores = bm.history_tables(made["results"], made["winners"], problems)
    assert stored.count() == 8 and stored.where("has_ground_truth").count() == 8
    assert bm.history_tables(made["results"], made["winners"], problems, mode="normal")[0].count() == 0
    targets = spark.createDataFrame([(1, "algebra", "basic", "Solve for x: 70x + 1 = 9.")], "target_id int, domain string, difficulty string, problem string")
    documents = stored.withColumnRenamed("problem_id", "doc_id")
    history = scores.select(F.col("problem_id").alias("doc_id"), "technique", "overall")
    row = bm.route(targets, documents, history).first()
    assert (row.history_source, row.best_technique) == ("db_profile_rules", "few_shot")


def test_all_tasks_score_the_runs(spark):
    runs = spark.range(0, 400, 1, 1).selectExpr(
        "'p' as problem_id", "'zero_shot' as technique", "cast(id as int) as run_index", "true as success", "concat('Answer: ', id % 5) as response",
        "2.0D as elapsed_time", "10 as prompt_tokens", "30 as completion_tokens", "40 as total_tokens",
    )
    problems = spark.createDataFrame([("p", None, "3")], "problem_id string, problem string, answer string")
    made = bm.benchmark(runs, problems, normalise_weights())
    assert made["runs"].count() == 400 and made["runs"].agg(F.sum("accuracy")).first()[0] == 80.0
    assert len(made["runs"].inputFiles()) > 1


def test_words_are_counted_once_per_response(spark):
    row = spark.createDataFrame([("a b c", 2.0, 40, 10, 30), (None, 0.0, 0, 0, 0), (" ", 40.0, 5, 5, 0)], "response string, s double, t int, p int, c int")
    made = row.select(mx.efficiency(F.col("response"), F.col("s"), F.col("t"), F.col("p"), F.col("c")).alias("e"))
    # 0.4 * time + 0.3 * tokens + 0.3 * conciseness
    assert [r.e for r in made.collect()] == [0.79, 0.5, 0.495]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
