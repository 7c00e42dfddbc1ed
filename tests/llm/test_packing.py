import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeline.llm import packing
from gaugeline.llm.queries import op6_packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, with_ids=True):
    """Every id in one piece, sequences without gaps and of sizes of powers of two; texts by doc_id (unique)."""
    tokenizer = Tokenizer.from_file(FILE)
    ids = {d: plain_ids(tokenizer, t) for d, t in texts.items()}
    at, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        want = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(want) and r["length"] > 0
        piece = np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert bytes(r["ids"]) == piece if with_ids else r["ids_crc32"] == zlib.crc32(piece)
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    assert all(at[d] == len(x) for d, x in ids.items())
    for pieces in sequences.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        assert end == pieces[0][2] <= 2048 and end & (end - 1) == 0


TEXTS = [
    None, "", " \n\t ", "Hello, World. it's <|endoftext|>x don't", "é́ ﬁ Ǆ İ Σ ΑΣ ὈΔΥΣΣΕΎΣ\u00a0x\u2028y\x1cz\x85", "word " * 9000, "a" * 5000, "İ. İ, ÉÀ., Straße ß. ÿ×÷", "x\x0by\x0cz <|endoftext|>. <|ENDOFTEXT|> don.'t.", "한글 각 Å 漢字, 🙂.. A.B., ..",
]


def test_ids_equal_the_tokenizers(spark, docs_of):
    texts = dict(enumerate(TEXTS + ["tok%d " % k * k for k in range(300)]))
    rows = packing.pack(docs_of(list(texts.items()), extra=True).coalesce(1), FILE).collect()
    check(rows, texts)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r["step_group"]] += r["length"]
    assert max(tokens.values()) - min(tokens.values()) <= 4096


def test_repeated_rows_null_ids_and_empty(docs_of):
    rows = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), FILE).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["doc_tokens"]) for r in rows if r["start"] == 0)[0][0] == 0
    assert sum(r["length"] for r in rows) == 8
    assert packing.pack(docs_of([(1, "a")]).limit(0), FILE).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op6_packing(spark, sf).collect(), texts, with_ids=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=60))
def test_windows_are_full(lengths):
    pool = packing.Pool()
    for k, n in enumerate(lengths):
        pool.put(k, 0, n)
    windows, rest = packing.fill(pool)
    windows += packing.binary(rest)
    assert all(sum(p[2] for p in pieces) == size for size, pieces in windows)
    got = defaultdict(list)
    for _, pieces in windows:
        for doc, start, length in pieces:
            got[doc].append((start, length))
    for k, n in enumerate(lengths):
        end = 0
        for start, length in sorted(got[k]):
            assert start == end
            end += length
        assert end == n


def test_memory_is_emptied_when_full():
    tokenizer = Tokenizer.from_file(FILE)
    ids = packing.WordIds(tokenizer, 3)
    for k in range(5):
        text = " ".join(f"w{i}." for i in range(k, k + 6))
        assert ids.of(pa.array([text]))[0] == np.array(plain_ids(tokenizer, text)[:-1], "<u4").tobytes()
