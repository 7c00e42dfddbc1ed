"""Document fingerprints: a homomorphic multiset hash of the paragraphs.

Every paragraph becomes a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors: EXACT numbers
modulo 2^32 from a cryptographic hash of the paragraph, which tell unequal multisets apart, and LANES numbers modulo 2^32
that each of the paragraph's runs of WIDTH words moves by one, up or down, at a place its hash names. The sum doesn't
depend on the order of the paragraphs; a paragraph is inserted or deleted by adding or subtracting its vector. The cosine
of two documents' lanes estimates how many runs of words they share.

Paragraphs are the lines of a text that hold more than white space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import stored
from gaugeline.llm.wordhash import hash_words, mix, stream

#: Numbers of a fingerprint, all modulo 2^32: from the paragraphs' hashes, from their runs; words of a run.
EXACT, LANES, WIDTH = 16, 256, 3
#: Texts that are hashed at a time, in bytes, about.
BYTES = 1 << 20
#: Code points of a text that range bounds are made of.
BEGINNING = 64


def _runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of WIDTH words inside each paragraph (all words, where it has fewer), and each run's paragraph."""
    sizes = np.diff(bounds)
    paragraph = np.repeat(np.arange(len(sizes)), sizes)
    factors = stream(WIDTH, 7)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(words))  # words from here to the paragraph's end
    first = np.repeat(bounds[:-1], sizes) == np.arange(len(words))
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            total += np.where(left > k, padded[k : k + len(words)] * factors[k], np.uint64(k + 1))
    keep = (left >= WIDTH) | first
    return mix(total[keep]), paragraph[keep]


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts: rows of EXACT and of LANES numbers."""
    exact, lanes = np.zeros((len(texts), EXACT), np.uint32), np.zeros((len(texts), LANES), np.uint32)
    k = 0
    while k < len(texts):
        end, size, parts, owner = k, 0, [], []
        while end < len(texts) and (end == k or size < BYTES):
            for line in texts[end].encode("utf-8").split(b"\n"):
                if line.strip(b" \t\n\x0b\x0c\r"):
                    parts.append(line)
                    owner.append(end - k)
                    size += len(line)
            end += 1
        if parts:
            owner = np.array(owner)
            digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=4 * EXACT).digest() for p in parts), "<u4").reshape(-1, EXACT)
            np.add.at(exact, owner + k, digests)
            hashes, paragraph = _runs(*hash_words(parts))
            place = owner[paragraph] * LANES + (hashes % np.uint64(LANES)).astype(np.int64)
            sign = 1.0 - 2.0 * ((hashes >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
            moved = np.bincount(place, sign, (end - k) * LANES).astype(np.int64)
            lanes[k:end] = moved.reshape(-1, LANES).astype(np.uint32)
        k = end
    return exact, lanes


def packed(exact: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Lanes are mostly small: sign last (0, -1, 1, -2, ...), all first bytes before all second ones, they compress well."""
    signed = lanes.astype("<u4").view("<i4")
    folded = ((signed << 1) ^ (signed >> 31)).view(np.uint8).reshape(len(lanes), LANES, 4).transpose(0, 2, 1)
    return [a.astype("<u4").tobytes() + b.tobytes() for a, b in zip(exact, folded, strict=True)]


def encoded(exact: np.ndarray, lanes: np.ndarray) -> list[str]:
    """Fingerprints as text, in hexadecimal."""
    return [x.hex() for x in packed(exact, lanes)]


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    folded = np.ascontiguousarray(np.frombuffer(raw[4 * EXACT :], np.uint8).reshape(4, LANES).T).view("<u4")[:, 0]
    return np.frombuffer(raw[: 4 * EXACT], "<u4"), (folded >> 1) ^ (np.uint32(0) - (folded & 1))


def plus(one: str, two: str) -> str:
    """The fingerprint of both multisets together; ``minus`` takes one out again."""
    (a, x), (b, y) = decoded(one), decoded(two)
    return encoded((a + b)[None], (x + y)[None])[0]


def minus(one: str, two: str) -> str:
    (a, x), (b, y) = decoded(one), decoded(two)
    return encoded((a - b)[None], (x - y)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, otherwise the cosine of the lanes, from 0 to just below 1."""
    x, y = (v[1].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 0.999))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``. Null text counts as empty; a column of that name is replaced; rows stay as they are."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(encoded(*vectors([t or "" for t in texts])), dtype=object)

    return docs.withColumn("fingerprint", of("text"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _judged(doc_ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns of documents whose next documents are known."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    own, changed, after = vectors(texts), vectors(edited), vectors(following)
    columns = (
        doc_ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
        packed(*own), packed(*changed), likeness(own, changed).tolist(), likeness(own, after).tolist(),
    )
    return dict(zip(NAMES, columns, strict=True))


def _batch(columns: dict[str, list], names: list[str]):
    """An Arrow batch of the columns; those that are missing are null."""
    import pyarrow as pa

    kinds = {"fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "place": pa.int32(), "kind": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    rows = len(columns["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * rows), kinds.get(c, pa.string())) for c in names], names=names)


def compared(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, next to those of its edited text and of the next document.

    The next document is that of the next smaller doc_id (ties: smaller text; rows without a doc_id come last), after the
    last one the first, so a lone document is its own next. The edited text is the text with its last floor(n / 2) code
    points replaced by the first as many of the next document, or all. Null texts are empty. Rows are documents of their
    own; other columns are ignored; an empty table gives an empty result.

    The rows are sorted in ranges and walked once; the first and last document of each range are joined afterwards. A doc_id
    with many texts spreads over several ranges; only rows that agree in their first ``BEGINNING`` code points too don't.
    """

    def walk(batches):
        from pyspark import TaskContext

        names = ["place", "kind", "text", *NAMES]
        number, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            if not ids:
                continue
            if held is None:
                yield _batch({"place": [number], "kind": [1], "text": texts[:1], "doc_id": ids[:1]}, names)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            for k in range(0, len(ids) - 1, 500):
                n = min(500, len(ids) - 1 - k)
                rows = _judged(ids[k : k + n], texts[k : k + n], texts[k + 1 : k + n + 1])
                yield _batch(rows | {"place": [number] * n, "kind": [0] * n}, names)
        if held is not None:
            yield _batch({"place": [number], "kind": [2], "text": [held[1]], "doc_id": [held[0]]}, names)

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    # texts of one doc_id, or of none, part by how they begin, which goes with their order
    begins = F.substring("text", 1, BEGINNING).desc_nulls_last()
    ranged = docs.select("doc_id", "text").repartitionByRange(order[0], begins).sortWithinPartitions(*order)
    rows = stored(ranged.mapInArrow(walk, f"place int, kind int, text string, {RESULT}"), "fingerprints")

    firsts = rows.where("kind = 1").select("place", F.coalesce("text", F.lit("")).alias("following"))
    places = Window.orderBy("place")  # a row per range
    after = firsts.select("place", F.coalesce(F.lead("place").over(places), F.min("place").over(Window.partitionBy())).alias("then"))
    edges = (
        rows.where("kind = 2").select("place", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(after, "place").join(firsts.withColumnRenamed("place", "then"), "then").select("doc_id", "text", "following")
    )

    def finish(batches):
        for batch in batches:
            yield _batch(_judged(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")]), NAMES)

    both = rows.where("kind = 0").select(*NAMES).unionByName(edges.mapInArrow(finish, RESULT))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
