"""Matching of long texts: few pairs get a score, texts are labelled once, patterns are guarded by plain texts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import features as ft
from gaugeline.functions import lexicon as lx
from gaugeline.functions.basics import rx
from gaugeline.operators import similarity as sm


def side(n, seed, vectored):
    """Sets of tokens, many of them near copies, with a few sets of tags; some empty."""
    rng = random.Random(seed)
    bases = [[rng.randrange(60) if rng.random() < 0.4 else rng.randrange(10**6) for _ in range(rng.choice([0, 3, 20, 80]))] for _ in range(12)]
    rows = []
    for _ in range(n):
        tokens = [t for t in rng.choice(bases) if rng.random() < 0.9] + [rng.randrange(60) for _ in range(rng.randrange(8))]
        tags, kind = rng.choice([([], 0), ([], 0), ([1], 1), ([1, 2], 1), ([2, 3], 2), ([4], 0)])
        rows.append((np.array(sorted(set(tokens)), np.int64), np.array(tags, np.int64), kind, vectored and rng.random() < 0.3))
    df = pd.DataFrame(rows, columns=["tokens", "tags", "kind", "vectored"])
    return df.assign(vector=None, size=df["tokens"].map(len) + [rng.randrange(2) for _ in rows])


@pytest.mark.parametrize("vectored", [False, True])
@pytest.mark.parametrize("columns, pairs", [(1024, 1 << 21), (5, 300), (0, 1)])
def test_sums_equal_those_of_all_scores(monkeypatch, vectored, columns, pairs):
    monkeypatch.setattr(sm, "COLUMNS", columns)
    monkeypatch.setattr(sm, "PAIRS", pairs)
    a, b = side(60, 1, vectored), side(150, 2, vectored)
    facts = np.random.default_rng(3).random((len(sm.FACTS), len(b), 3))
    every = sm.scores(a, b)
    every[a["vectored"].to_numpy()[:, None] & b["vectored"].to_numpy()[None]] = -1.0
    near = sm._Near(a, b, (0.55, 0.60), True)
    for begin, end in ((0, len(a)), (7, 41)):
        seen, met, weighted = near.sums(begin, end, facts)
        want = every[near.rows[begin:end]]
        np.testing.assert_allclose(seen, (want >= sm.SEEN) @ facts[0][:, 0], atol=1e-9)
        for level, limit in enumerate((0.55, 0.60)):
            np.testing.assert_allclose(met[level], [(want >= limit) @ f for f in facts], atol=1e-9)
            np.testing.assert_allclose(weighted[level], [((want >= limit) * want) @ facts[k] for k in sm.WEIGHED], atol=1e-9)


def test_few_pairs_get_a_score(monkeypatch):
    rng = random.Random(4)
    rows = [np.array(rng.sample(range(2000), rng.choice([10, 100, 400])), np.int64) for _ in range(200)]
    df = pd.DataFrame({"tokens": rows, "tags": [np.empty(0, np.int64)] * 200, "kind": 0, "vectored": False, "vector": None})
    scored, shares = [], sm._shares
    monkeypatch.setattr(sm, "_shares", lambda *args: scored.append(args[0].size) or shares(*args))
    near = sm._Near(df, df, (0.55, 0.60), True)
    scored.clear()
    seen, _, _ = near.sums(0, 200, np.ones((len(sm.FACTS), 200, 1)))
    assert seen.min() >= 1 and sum(scored) < 200 * 200 / 20


def test_texts_of_both_sides_are_labelled_once(spark, sf, monkeypatch):
    from workload import matching as wm

    seen, tagged = [], sm.with_feature_tags
    monkeypatch.setattr(sm, "with_feature_tags", lambda *args: seen.append(args) or tagged(*args))
    made = wm.document_history(spark, sf)
    assert len(seen) == 1 and made.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_guarded_patterns_equal_plain_ones(spark):
    rng = random.Random(5)
    patterns = sorted({p for p, _ in (*lx.FEATURES_HISTORY, *lx.FEATURES_BANK)} | {lx.MULTI_UNKNOWN})
    pieces = sorted({t for p in patterns for t in ft.needed_texts(p)})
    assert all(ft.needed_texts(p) for p in patterns)
    extra = ["x", "3", " ", "  ", "= 4", "(x + 1)", "for y, z", "that", "value", "ways", "function", "formula", "é", "_", "ing", "the root", "x^2", "y²", "7!", "1/x", "2x = 5"]
    whole = ["rational function", "arithmetic sequence", "when x = 3 and y = 4", "solve for x, y", "find x and y", "expected value", "how many ways", "2^(3a", "d/dx"]
    texts = ["".join(rng.choice([*pieces, *extra, " ", " "]) for _ in range(rng.randrange(1, 7))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in [*texts, *pieces, *(f" {p} " for p in pieces), *whole, "", None]], "v string")
    plain = F.array(*[F.expr(rx("v", p)) for p in patterns])
    guarded = F.array(*[F.expr(ft.guarded("v", p)) for p in patterns])
    rows = df.select("v", plain.alias("plain"), guarded.alias("guarded")).collect()
    assert all(r.plain == r.guarded for r in rows)
    assert all(any(r.plain[k] for r in rows) for k in range(len(patterns)))
