import pytest
from pyspark.sql import functions as F

from gaugeline.operators import tagging as tg

INTENTS = [
    ("How many ways can 5 books be arranged on a shelf?", "counting_arrangements"),
    ("Find the expected value of the number shown on a fair die.", "expected_value"),
    ("Find sin(75 degrees).", "trigonometric_values"),
    ("Find the domain and asymptote of f(x) = 1/(x-2).", "function_analysis"),
    ("Find the 12th term of a geometric sequence.", "sequence_series"),
    ("A freight train travels 1 mile in 1 minute 30 seconds. At this rate, how many miles will the train travel in 1 hour?", "ratio_proportion"),
    ("Which of the following has the least value? A = 2, B = 4/4, C = 8/8.", "compare_values"),
    ("Solve for all real solutions: x^2 - 9x + 20 = 0.", "real_solutions"),
    ("Solve for all real solutions: x² - 9x + 20 = 0.", "real_solutions"),
    ("x² - 9x + 20 = 0", "solve_equation"),
    ("Find the domain and range of f(x) = (x^2 - 9x + 20)/(x - 4).", "function_analysis"),
    ("What is the positive value of the expression x^3 - 2y when x = 5 and y = 2?", "evaluate_substitution"),
]
SUBJECTS = [
    (INTENTS[5][0], "algebra"),
    (INTENTS[6][0], "algebra"),
    (INTENTS[7][0], "algebra"),
    (INTENTS[9][0], "algebra"),
    (INTENTS[10][0], "pre-calculus"),
    ("Find the period of y = sin(2x) and state its range.", "pre-calculus"),
]


def test_intents(spark):
    df = spark.createDataFrame(INTENTS, "problem string, want string")
    rows = tg.with_intent(df, "problem").collect()
    assert [(r.problem, r.intent) for r in rows] == INTENTS


def test_subjects_without_a_bank(spark):
    df = spark.createDataFrame(SUBJECTS, "problem string, want string")
    assert {r.problem: r.subject for r in tg.with_subject(df, "problem").collect()} == dict(SUBJECTS)


def test_feature_tags(spark):
    df = spark.createDataFrame([
        ("Solve for x: 2x + 3 = 7.",), ("Solve x^2 - 4 = 0",), ("solve for x and y: 2x+y=7, x-y=2",),
        ("What is life",), ("Find x² + 1",),
    ], "problem string")
    got = [r.features for r in tg.with_feature_tags(df, "problem").collect()]
    assert got[0] == ["linear", "solve"]
    assert "quadratic" in got[1] and "exponent" in got[1]
    assert "system_of_equations" in got[2]
    assert got[3] == []
    assert "quadratic" in got[4]


@pytest.mark.parametrize("problem,requested", [
    ("What is life", "algebra"),
    ("Find the area of a triangle with base 10 and height 6.", "algebra"),
    ("Solve for x: x + 1 = 2", "history"),
])
def test_refused(spark, problem, requested):
    df = spark.createDataFrame([(problem, requested)], "problem string, subject string")
    assert tg.resolve_domains(df, "problem", "subject").first().domain is None


def test_accepted(spark):
    df = spark.createDataFrame([
        ("Solve for x: x + 1 = 2", "algebra", "request_subject", "algebra"),
        ("Find sin(75 degrees).", "", "auto_detected_signal", "pre-calculus"),
        ("Find sin(75 degrees).", "precal", "request_subject", "pre-calculus"),
    ], "problem string, subject string, source string, want string")
    for r in tg.resolve_domains(df, "problem", "subject").collect():
        assert (r.domain_source, r.domain) == (r.source, r.want)


def test_external_labels(spark):
    df = spark.createDataFrame([
        ('sure: {"subject": "Algebra", "type": "Linear Eq", "concept": "lines", "difficulty": "basic"} ok',),
        ('{"subject": "history", "type": "a", "concept": "b", "difficulty": "basic"}',),
        ("no json",),
    ], "payload string")
    got = [r.x for r in df.select(tg.external_labels(F.col("payload")).alias("x")).collect()]
    assert got[0].asDict() == {"subject": "algebra", "type": "linear_eq", "concept": "lines", "difficulty": "basic"}
    assert got[1] is None and got[2] is None


def test_profile_and_form_labels(spark):
    df = spark.createDataFrame([("Q: Solve x^2 = 4 for all real solutions", "Algebra", None)], "problem string, domain string, difficulty string")
    p = tg.with_profile(df, "problem", "domain", "difficulty").first().profile
    assert (p.subject, p.difficulty, p.intent) == ("algebra", "basic", "real_solutions")
    assert p.constraints == ["real_solutions"] and "exponent" in p.features
    r = tg.with_form_labels(df, "problem").first()
    assert r.form_subject == "algebra" and r.length_difficulty == "basic"
