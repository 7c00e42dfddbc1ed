import hashlib
import random

import pytest

from gaugeline.llm import chunk_dedup
from gaugeline.llm.queries import op13_exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        named = sorted(i for i in ids if i is not None)
        keep = named[-1] if named else None
        left = 1
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), left == 1, hashlib.sha256(text.encode()).hexdigest()))
            left = 0
    return sorted(out, key=repr)


def texts(rng, n=60):
    words = ["alpha", "Beta", "gamma", "é", "漢字", "\n", "delta"]
    passage = " ".join(rng.choice(words) for _ in range(800))
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(2000))) for _ in range(n)]
    return made + [passage + m for m in made[:10]] + [m + passage for m in made[:10]] + [m + "x" for m in made[:5]]


def test_chunks_are_cut_by_content():
    rng = random.Random(3)
    data = [bytes(rng.randrange(32, 127) for _ in range(n)) for n in (0, 1, 255, 256, 257, 5000, 200_000)] + [b"a" * 100_000, b"ab" * 3_000_000]
    for d in data:
        made = list(chunk_dedup.chunks(d))
        assert b"".join(made) == d and all(len(c) <= chunk_dedup.MOST for c in made) and all(len(c) >= chunk_dedup.LEAST for c in made[:-1])
    one, two = set(chunk_dedup.chunks(data[6])), set(chunk_dedup.chunks(b"some words in front " + data[6]))
    assert len(one & two) > 0.9 * len(one)


def test_chunks_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    whole = list(chunk_dedup.chunks(data))
    monkeypatch.setattr(chunk_dedup, "BLOCK", 1000)
    assert list(chunk_dedup.chunks(data)) == whole


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(9)
    made = texts(rng)
    rows = list(enumerate(made)) + [(1000 + i, t) for i, t in enumerate(made[::3])] + [(2000 + i, made[0]) for i in range(40)]
    rows += [(3000, None), (3001, ""), (None, made[1]), (None, "only here"), (None, "only here"), (7, made[7]), (7, made[8]), (3002, "é" * 400_000), (3003, "é" * 400_000), (3004, "﻿"), (3005, " ")]
    docs_of(rows, extra=True).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_exact_dedup(spark, str(tmp_path))
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute(rows)


@pytest.mark.parametrize("heavy", [1, 50, 10**6])
def test_hot_groups_are_joined_alike(docs_of, monkeypatch, heavy):
    rows = [(i, f"text {i % 4 if i % 3 else 0}") for i in range(60)] + [(100 + i, f"own {i}") for i in range(20)]
    monkeypatch.setattr(chunk_dedup, "HEAVY", heavy)
    out = chunk_dedup.exact_duplicates(docs_of(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute(rows)


def test_clashing_identifiers_are_widened(docs_of):
    rows = list(enumerate(texts(random.Random(1)))) + [(500, "a"), (501, "a")]
    docs = docs_of(rows)
    assert not chunk_dedup.clashes(chunk_dedup.chunk_store(docs, 1)).isEmpty()
    out = chunk_dedup.exact_duplicates(docs, widths=(1, 16)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute(rows)
    with pytest.raises(ValueError):
        chunk_dedup.exact_duplicates(docs, widths=(1,))


def test_distinct_documents_keep_all_columns(docs_of):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z"), (5, "b")]
    docs = docs_of(rows, extra=True)
    out = chunk_dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(2, "a"), (4, ""), (None, "z"), (5, "b")], key=repr)
    assert chunk_dedup.exact_duplicates(docs.limit(0)).count() == 0
