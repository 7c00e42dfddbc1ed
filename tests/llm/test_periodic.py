import hashlib
import random
import time
import zlib

import numpy as np

from gaugeline.llm import periodic
from gaugeline.llm.queries import op11_periodic_runs


def brute_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(least, 2 * q):
                found.setdefault((first - q, i - first + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes(rng):
    """Words of few kinds in stretches that repeat, touch, nest and break."""
    n = rng.randrange(200)
    yield [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(n)]
    yield [w if rng.random() < 0.99 else 2 for w in fibonacci(n)]
    base, words = [rng.randrange(2) for _ in range(rng.randrange(1, 12))], []
    while len(words) < n:
        words += base * rng.randrange(1, 9) + [rng.randrange(3) for _ in range(rng.randrange(3))]
    yield words
    blocks = [[0] * rng.randrange(1, 30) + [1] for _ in range(2)]
    yield [w for _ in range(8) for w in rng.choice(blocks)]
    unit = [rng.randrange(2) for _ in range(rng.randrange(1, 60))]
    yield [w if rng.random() < 0.995 else 1 - w for w in (unit * 12)[:n]]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        for words in shapes(rng):
            assert periodic.runs(np.array(words, np.int64)) == brute_runs(words), words


def test_long_repetitive_texts_take_near_linear_time():
    n, rng = 200_000, np.random.default_rng(1)
    border = np.concatenate([np.tile([0, 0, 1], n // 6), [0, 0], np.tile([0, 0, 1], n // 6)])  # a run around the border for every multiple of the period
    for words in (np.zeros(n, np.int64), rng.integers(0, 2, n), np.tile(np.r_[np.zeros(20_000, np.int64), 1], 10), border):
        start = time.time()
        found = periodic.runs(words.astype(np.int64))
        assert found and time.time() - start < 20


def test_words_split_at_block_borders(monkeypatch):
    text = b" a\x0bbb\tccc \xc2\xa0d\x1fe\n\na" * 50
    whole = periodic.word_ids(text)
    monkeypatch.setattr(periodic, "BLOCK", 7)
    cut = periodic.word_ids(text)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1] and [whole[1][k] for k in whole[0]] == text.split()


def test_operator_returns_runs_and_collapsed_text(spark, docs_of):
    rows = [(1, "x " + "a b c " * 6 + "y"), (2, "no run here"), (3, None), (4, ""), (5, "z " * 12), (5, "z " * 12), (None, "z " * 11)]
    docs = docs_of(rows, extra=True).selectExpr("*", "'old' as runs")
    out = periodic.periodic_runs(docs)
    assert out.columns == [*docs.columns[:-1], "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()))
    assert got == [
        (0, 11, [], " ".join("z" * 11)), (1, 20, [(1, 18, 3)], "x a b c y"), (2, 3, [], "no run here"), (3, 0, [], ""), (4, 0, [], ""),
        (5, 12, [(0, 12, 1)], "z"), (5, 12, [(0, 12, 1)], "z"),
    ]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{w}" for words in shapes(rng) for w in words[: rng.randrange(60)])) for i in range(120)]
    rows += [(None, "a " * 40), (300, None), (301, ""), (302, "\n\t"), (7, rows[7][1]), (303, "é\xa0x " * 30), (304, "long " * 3000 + "tail")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120))
