import hashlib
import random

import numpy as np

from gaugeline.llm import multiset_hash as mh
from gaugeline.llm.queries import op10_multiset_hash


def prose(rng, lines):
    return "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 25))) for _ in range(lines))


def of(text):
    return mh.encoded(*mh.vectors([text]))[0]


def test_order_insertion_and_deletion():
    a, b, c = "one two three four", "five six", "seven"
    assert of(f"{a}\n{b}\n{c}") == of(f"{c}\n\n{a}\n \n{b}")
    assert of(f"{a}\n{b}") == mh.plus(of(a), of(b)) and mh.minus(of(f"{a}\n{b}\n{b}"), of(b)) == of(f"{a}\n{b}")
    assert of(f"{a}\n{a}") != of(a) and of(a) != of("one two three four ") != of("") == of("\n\n")


def test_vectors_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(8)) for _ in range(40)] + ["", "x", "x y", "x" * 9000]
    whole = mh.encoded(*mh.vectors(texts))
    monkeypatch.setattr(mh, "BYTES", 100)
    assert whole == mh.encoded(*mh.vectors(texts)) == [of(t) for t in texts]


def brute(rows):
    """(doc_id, n_chars, sha) of rows with ids; None ids come last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(docs_of):
    rng = random.Random(4)
    rows = [(k * 7 - 50, prose(rng, 1 + k % 5)) for k in range(120)] + [(5000, None), (5001, ""), (5002, "é😀" * 5), (5003, "w " * 60_000), (None, "last one")]
    got = mh.compared(docs_of(rows, extra=True).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == brute(rows)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_ties_and_lone_documents(docs_of):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "x y")]
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in mh.compared(docs_of(rows)).collect()) == brute(rows)
    (only,) = mh.compared(docs_of([(1, "abcd")])).collect()
    assert only["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and only["near_next"] == 1
    assert mh.compared(docs_of([(1, "x")]).limit(0)).count() == 0


def test_hot_and_missing_ids(docs_of):
    rng = random.Random(6)
    head = "same beginning " * 6
    rows = [(7, prose(rng, 2)) for _ in range(150)] + [(None, "é" * rng.randrange(4) + prose(rng, 1)) for _ in range(150)] + [(3, head + prose(rng, 1)) for _ in range(60)]
    got = mh.compared(docs_of(rows).repartition(6)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == brute(rows)


def test_long_repetitive_document():
    text = "w " * 70_000
    edited = text[:70_000] + prose(random.Random(5), 6000)[:70_000]
    own, changed = mh.vectors([text]), mh.vectors([edited])
    assert mh.likeness(own, changed)[0] > 0.9
    for exact, lanes in (own, changed):
        again = mh.decoded(mh.encoded(exact, lanes)[0])
        assert (again[0] == exact[0]).all() and (again[1] == lanes[0]).all()


def test_fingerprints_column(docs_of):
    out = mh.fingerprints(docs_of([(1, "a\nb"), (2, "b\na"), (3, None)], extra=True)).orderBy("doc_id").collect()
    assert out[0]["fingerprint"] == out[1]["fingerprint"] == of("a\nb") and out[2]["fingerprint"] == of("") and out[0]["line"] == "x"


def test_query_tells_edits_from_other_texts(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op10_multiset_hash(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr) == brute(texts)
    by_id = dict(texts)
    assert all(r["fingerprint"] == of(by_id[r["doc_id"]]) for r in rows)
    assert np.mean([r["near_edited"] > r["near_next"] + 0.1 for r in rows if r["n_chars"] > 100]) > 0.95
