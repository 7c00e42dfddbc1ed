import random

import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm import toxicity
from gaugeline.llm.queries import op2_toxicity


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    e, firsts = rng.normal(size=7), np.array([True, False, False, True, False, False, False])
    start, steps = 0.3, rng.normal(size=(2, 2))
    got, counts = toxicity._forward_backward(e, firsts, start, steps)
    total, p, want = 0.0, np.zeros(7), np.zeros((2, 2))
    for code in range(1 << 7):
        y = [(code >> k) & 1 for k in range(7)]
        weight = sum(e[k] * y[k] + (start * y[k] if firsts[k] else steps[y[k - 1], y[k]]) for k in range(7))
        weight = np.exp(weight)
        total += weight
        p += weight * np.array(y)
        for k in range(7):
            if not firsts[k]:
                want[y[k - 1], y[k]] += weight
    assert np.allclose(got, p / total) and np.allclose(counts, want / total)


def test_rows_of_matrices_join_up(monkeypatch):
    rng = np.random.default_rng(2)
    e, firsts, steps = rng.normal(size=500), rng.random(500) < 0.02, rng.normal(size=(2, 2))
    firsts[0] = True
    one = toxicity._forward_backward(e, firsts, 0.1, steps)[0]
    monkeypatch.setattr(toxicity, "ROW", 7)
    assert np.allclose(one, toxicity._forward_backward(e, firsts, 0.1, steps)[0])


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.choice(['la', 'mo', 'ti'])}{rng.choice('xyz')}" for _ in range(rng.randrange(5, 60))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "scum"]) if k % 2 else f"vermin{rng.choice('abcdefghijklmnop')}")
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_learns_words_and_beginnings(spark, docs_of):
    rows = corpus(1)
    docs = docs_of([(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows] + [(None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, F.lit(True))
    text = "alax bmoy you IDIOT scum, cla verminq x"
    tests = [(1, text), (2, "alax bmoy ctiz"), (3, None), (4, ""), (5, "12 .."), (6, "alax " * 30_000), (6, "alax " * 30_000), (7, "alax " * 30_000 + "idiot"), (None, "scum")]
    out = toxicity.score(docs_of(tests, extra=True), chain).collect()
    assert len(out) == len(tests)
    by_id = {r["doc_id"]: r for r in out}
    assert [text[s["start"] : s["end"]] for s in by_id[1]["spans"]] == ["IDIOT scum", "verminq"]
    assert by_id[7]["score"] > 0.7 and by_id[None]["score"] > 0.7 and all(by_id[k]["score"] < 0.3 and not by_id[k]["spans"] for k in (2, 3, 4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in out)
    blank = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert [r["score"] < 0.1 for r in toxicity.score(docs_of(tests[:4]), blank).collect()] == [True] * 4
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_learns_from_long_documents(spark, docs_of):
    rows = [(k, f"{t} " * (12_000 // len(t) + 1) if toxic else t, toxic) for k, t, toxic in corpus(2)]
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs_of([(k, t) for k, t, _ in rows]), labels, F.lit(True))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of([(1, "alax bmoy you IDIOT scum"), (2, "alax bmoy ctiz")]), chain).collect()}
    assert out[1] > 0.7 and out[2] < 0.3


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op2_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)
    false = sum(r["predicted"] for r in rows if not truth[r["doc_id"]])
    assert len(rows) > 500 and right > 0.97 and false <= 0.01 * len(rows)


def test_sample_is_bounded_whatever_repeats(spark, docs_of):
    """Repeated rows count once, rows of one doc_id with different texts are documents, and no class exceeds the sample."""
    rows = [(1, "same text")] * 500 + [(i, f"text {i}") for i in range(2, 300)] + [(2, f"other {i}") for i in range(50)] + [(400, None)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(300)] + [(400, 0, 1)], "doc_id long, quality int, toxic int")
    every = toxicity.sampled(docs_of(rows), labels, F.lit(True), 1000).collect()
    assert len(every) == 1 + 298 + 50
    some = toxicity.sampled(docs_of(rows), labels, F.lit(True), 20).collect()
    assert sorted(r["toxic"] for r in some) == [0] * 20 + [1] * 20 and {tuple(r) for r in some} <= {tuple(r) for r in every}
    assert sorted(map(tuple, toxicity.sampled(docs_of(rows[::-1]), labels, F.lit(True), 20).collect())) == sorted(map(tuple, some))
