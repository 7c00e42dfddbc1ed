import pytest
from pyspark.sql import functions as F

from gaugeline.functions import answers as an
from gaugeline.operators import scoring as sco
from gaugeline.functions import metrics as mx

ACCURACY = [
    ("The answer is 42.", "42", 1.0),
    ("we get 5c = 15a and therefore c/a = 3.\nFinal answer: c/b = 1.", "15", 0.0),
    ("Result: 15/5", "15", 0.0),
    ("(m - 4)(2n + 7) = m(2n + 7) - 4(2n + 7)\n= 2mn + 7m - 8n - 28\nFinal answer:", "2mn + 7m - 8n - 28", 1.0),
    ("We expand.\nSo, the expanded expression is: 2mn + 7m - 8n - 28.", "2mn + 7m - 8n - 28", 1.0),
    ("Final answer: +√3", "x = 1, x = -1, x = 3, x = -3", 0.0),
    ("Final answer: x = -3, x = 1, x = -1, x = 3", "x = 1, x = -1, x = 3, x = -3", 1.0),
    ("Step 1: 3\nFinal answer: 40%", "0.4", 1.0),
    ("Answer: 2/0", "2", 0.0),
    ("so x is 11", "11", 1.0),
    ("", "1", 0.0),
    ("roots are ±3", "x = 3 or x = -3", 1.0),
    ("Step 12\nresult 7 then 8", "12", 1.0),
]


def test_accuracy_golden(spark):
    df = spark.createDataFrame(ACCURACY, "r string, e string, want double")
    got = df.select("r", "e", "want", an.accuracy(F.col("r"), F.col("e")).alias("got")).collect()
    assert [(r.r, r.got) for r in got] == [(r.r, r.want) for r in got]


def test_final_only_ignores_steps(spark):
    df = spark.createDataFrame([("Step 12\nresult 7 then 8", "12")], "r string, e string")
    assert df.select(an.accuracy(F.col("r"), F.col("e"), final_only=True)).first()[0] == 0.0


@pytest.mark.parametrize("group", [
    ["Ans: 2/1.", "The answer is 2", "result = 02.0", "2", "The answer is 2."],
    ["0.5", "1/2", "Ans: 1/2", "The answer is 0.5"],
    ["The answer is n(n-1)/2.", "Ans: n*(n-1)/2"],
    ["Therefore, the final answer is: 1,234", "so thus hence 1234"],
])
def test_output_keys_agree(spark, group):
    df = spark.createDataFrame([(g,) for g in group], "r string")
    assert df.select(an.output_key(F.col("r")).alias("k")).distinct().count() == 1


def test_output_key_forms(spark):
    rows = [("", "text:__empty__"), ("3", "num:3"), ("work\nAnswer: x = 1/3", "num:0.333333333333"), ("Hello  World!", "text:helloworld")]
    df = spark.createDataFrame(rows, "r string, want string")
    assert all(r.k == r.want for r in df.select("want", an.output_key(F.col("r")).alias("k")).collect())


def test_simple_arithmetic(spark):
    rows = [("What is 3 + 4?", "7"), ("10 / 4 =?", "2.5"), ("10 / 4 = ?", None), ("7 * 6", "42"), ("1/0", None), ("Solve x", None), ("What is 5?", "5")]
    df = spark.createDataFrame(rows, "p string, want string")
    assert [r.k for r in df.select(an.simple_arithmetic(F.col("p")).alias("k")).collect()] == [w for _, w in rows]


def test_root_score(spark):
    rows = [("x = 4 and x = 5", 1.0), ("x = 4", 0.5), ("none 7", 0.0), ("4, 5, 6", 1.0)]
    df = spark.createDataFrame(rows, "r string, want double")
    got = df.select(an.root_score(F.col("r"), F.expr("array(4D, 5D)"), F.expr("array(1D, -9D, 20D)")).alias("k")).collect()
    assert [r.k for r in got] == [1.0, 0.5, 0.0, 1.0]


def test_response_checks(spark):
    df = spark.createDataFrame([
        ("", "stop", True), ("x" * 60 + " 5", "length", True), ("too short 5", "stop", True),
        ("I am not sure about this one but here is a long text that ends in 5", "stop", True),
        ("This long text explains every step of the solution.\nFinal answer: 5", "stop", False),
    ], "r string, d string, want boolean")
    assert all(r.f.needs_retry == r.want for r in df.select("want", an.quality_flags(F.col("r"), F.col("d")).alias("f")).collect())
    v = spark.createDataFrame([("VERDICT: PASS", True), ("fail.", False), ("hm", None)], "t string, want boolean")
    assert all(r.k is r.want for r in v.select("want", an.verdict(F.col("t")).alias("k")).collect())
    e = spark.createDataFrame([
        (404, "model 'a' not found", "model_missing"), (404, "nope", "endpoint"), (500, "requires more system memory", "memory"),
        (500, "CUDA error: x", "gpu"), (500, None, "other"),
    ], "s int, m string, want string")
    assert all(r.k == r.want for r in e.select("want", an.error_class(F.col("s"), F.col("m")).alias("k")).collect())


def test_weights():
    assert mx.normalise_weights(3, 1, 0) == {"accuracy": 0.75, "consistency": 0.25, "efficiency": 0.0}
    for bad in ((0, 0, 0), (-1, 1, 1), (float("nan"), 1, 1)):
        with pytest.raises(ValueError):
            mx.normalise_weights(*bad)
    assert mx.run_count("3") == 3
    for bad in (0, "x", None):
        with pytest.raises(ValueError):
            mx.run_count(bad)


def test_example_scores(spark):
    w = mx.normalise_weights()
    df = spark.createDataFrame([(1.0, 0.85, 0.81), (1.0, None, 0.5)], "a double, c double, e double")
    cols = {"accuracy": F.col("a"), "consistency": F.col("c"), "efficiency": F.col("e")}
    got = [round(r[0], 3) for r in df.select(mx.overall(cols, w)).collect()]
    assert got == [0.887, 0.75]


MIXED = [
    ("Final answer: 7", "7"), ("so x = 3 or x = 2", "2, 3"), ("step 12\nfinal answer: 1/2", "50%"), ("it gives 12\n9", "12"), ("the sum is: 0.5", "1/2"),
    ("Answer: X ^2", "x^2"), ("ΑΣ b", "ας"), ("Σ", "σ"), ("3\n/4", "3/4"), ("therefore 5\nresult:", "5"), ("no number because", None), ("", "7"), (None, None), ("7!", "7"),
]


def test_both_accuracies_agree_with_each_alone(spark):
    df = spark.createDataFrame(MIXED, "r string, e string")
    r, e = F.col("r"), F.col("e")
    got = df.select(an.accuracies(r, e).alias("both"), an.accuracy(r, e).alias("any"), an.accuracy(r, e, True).alias("final"), an.accuracy(r, e, F.col("e") == "7").alias("some"), "e").collect()
    assert all((g.both["any"], g.both["final"]) == (g["any"], g.final) for g in got)
    assert all(g.some == (g.final if g.e == "7" else g["any"]) for g in got if g.e)
    assert all(g.final <= g["any"] for g in got)
    assert [g["any"] for g in got][:5] == [1.0] * 5


def test_tokens_never_cross_texts(spark):
    """Candidates are scanned as one text; a line that begins with a slash makes no fraction with the one before."""
    df = spark.createDataFrame([("answer: 3\nresult: / 4",)], "r string")
    found = df.select(an.priority_candidates(F.col("r"))).first()[0]
    assert "3" in found and not any(x.replace(" ", "") == "3/4" for x in found)


def test_keys_per_problem_score_like_answers_per_run(spark):
    rows = [(str(i), "t", 1, True, r, 1.0, 1, 1, 2) for i, (r, _) in enumerate(MIXED)] + [("sum", "t", 1, True, "Final answer: 5", 1.0, 1, 1, 2), ("none", "t", 1, True, "5", 1.0, 1, 1, 2)]
    runs = spark.createDataFrame(rows, "problem_id string, technique string, run_index int, success boolean, response string, elapsed_time double, prompt_tokens int, completion_tokens int, total_tokens int")
    problems = spark.createDataFrame([(str(i), "p", e) for i, (_, e) in enumerate(MIXED)] + [("sum", "What is 2 + 3?", None)], "problem_id string, problem string, answer string")
    keyed, plain = (sco.score_runs(sco.with_ground_truth(runs, problems, keys=keys)) for keys in (True, False))
    assert keyed.columns == plain.columns
    assert sorted(keyed.collect(), key=str) == sorted(plain.collect(), key=str)
    assert keyed.where("problem_id = 'sum'").first()["accuracy"] == 1.0
