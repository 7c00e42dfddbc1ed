import math

import numpy as np
import pytest

from gaugeline.llm import mtree


def brute(rows, every=100, k=10):
    seen = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * float(np.float32(x))) for x in v]
            seen[vec_id] = min(seen.get(vec_id, q), q)
    out = []
    for a, x in seen.items():
        if a % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), b) for b, y in seen.items() if b != a)  # noqa: B905
            out += [(a, rank, b, -s) for rank, (s, b) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(seed, n, dims=6, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [(int(k), [float(x) for x in (centres[k % clusters] + rng.normal(size=dims) * 0.2) * rng.uniform(0.1, 2)]) for k in range(n)]


def run(spark, rows, **kw):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    return sorted(map(tuple, mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **kw).collect()))


@pytest.mark.parametrize("part,page,cells", [(16_384, 128, 32), (40, 8, 4), (7, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, part, page, cells):
    monkeypatch.setattr(mtree, "PART", part)
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "CELLS", cells)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rows = vectors(1, 500) + [(1000 + k, [0.5] * 6) for k in range(150)]  # many equal vectors
    rows += [(2000, None), (2100, [1.0, None, 0, 0, 0, 0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(2400, [0.0] * 6), (2500, [3.0]), (2600, []), (-300, [0.1] * 6), (100, [9.0] * 6), (2700, [1e5, -1e5, 0, 0, 0, 0]), (2800, [4e4, -5e4, 1, 0, 0, 0])]
    assert run(spark, rows, every=50) == brute(rows, 50)


def test_few_or_no_vectors(spark):
    assert run(spark, []) == run(spark, [(100, None)]) == run(spark, [(100, [1.0])]) == run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, [(100, [1.0]), (2, [2.0])]) == [(100, 1, 2, 1024 * 2048)]


def test_large_components(spark):
    rows = vectors(3, 220) + [(300, [3e5, -2e5, 1, 0, 0, 0]), (400, [2e5, -3e5, 0, 7, 0, 0]), (401, [1.5e5, 0, 0, 0, 0, 1]), (402, [1.4e5, 0, 0, 0, 0, 2])]
    assert run(spark, rows) == brute(rows)
    near = [(100, [4e6, 3e6, 4e6]), (101, [2e6, 1e6, -3e6]), (102, [2e6, 1e6, -2.5e6]), (103, [-4e6, 3e6, 2e6])]  # sums within 64 bits, their parts' bound not
    assert run(spark, near) == brute(near)
    for beyond in ([(100, [3e7]), (101, [3e8])], [(100, [1.0]), (101, [1e20])]):
        with pytest.raises(Exception, match="64 bits|too large|overflow"):
            run(spark, beyond)


def test_pruning_skips_work(monkeypatch):
    """On clustered vectors most pages are never opened."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 8))[np.arange(4000) % 8] + rng.normal(size=(4000, 8)) * 0.02
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    root = mtree.Root(x[:4], float((x.astype(float) ** 2).sum(1).max()), 8)
    part = mtree.Part(root, 0, np.arange(4000), x)
    opened = []
    monkeypatch.setattr(mtree.heapq, "heappop", lambda q, pop=mtree.heapq.heappop: opened.append(1) or pop(q))
    best = part.search(17, x[17], 10, None)
    scores = sorted(((-int(s), k) for k, s in enumerate(x @ x[17]) if k != 17))[:10]
    assert best == [(-s, k) for s, k in scores] and len(opened) < len(part.pages)
