"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last 32 bytes says so, so equal passages are cut alike wherever they stand. A
chunk's identifier is a hash of its bytes; a text's recipe is the list of its chunks' identifiers in order. The chunks are
deduplicated by identifier and bytes: where one identifier turns out to stand for two different chunks, all identifiers are
made anew with more bytes. Equal recipes of verified identifiers are equal texts, so that only the recipes (16 bytes for
about a kilobyte of text) are grouped and joined; a text itself moves once, in chunks, and its repeated chunks don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import stored
from gaugeline.llm.wordhash import stream, utf8

#: Bytes of a chunk: at least (but for the last one of a text), at most; a cut is taken at one of MEAN places beyond LEAST.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Bytes of an identifier; the next width is taken where two different chunks got one identifier.
WIDTHS = (16, 32, 64)
#: Groups with at least one HEAVY-th of all rows are joined as a table of their own, which has at most HEAVY rows.
HEAVY = 1000
#: Bytes whose rolling hashes are computed at a time.
BLOCK = 1 << 20
#: Bytes that decide about a cut: each moves one bit to the left as the next ones come, out of 32 bits at last.
WINDOW = 32
_GEAR = (stream(256, 13) >> np.uint64(16)).astype(np.uint32)


def _places(data: bytes) -> np.ndarray:
    """Where a chunk may end: after every byte at which the rolling hash of the last WINDOW bytes has no low bit set."""
    found = []
    for at in range(0, len(data), BLOCK):
        low = max(0, at - WINDOW + 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + BLOCK) - low, low)]
        step = 1
        while step < WINDOW:
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        ends = np.flatnonzero((h >> np.uint32(16)) % np.uint32(MEAN) == 0) + low + 1
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunks(data: bytes) -> Iterator[bytes]:
    """The chunks of a text, which depend on its bytes alone; an empty text has none."""
    start, places = 0, _places(data).tolist() if len(data) > LEAST else []
    for place in places:
        while place - start > MOST:
            yield data[start : start + MOST]
            start += MOST
        if place - start >= LEAST:
            yield data[start:place]
            start = place
    while len(data) - start > MOST:
        yield data[start : start + MOST]
        start += MOST
    if start < len(data):
        yield data[start:]


def recipes(docs: DataFrame, width: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, text_sha256 and ``recipe``, the identifiers of its chunks, end to end."""
    import pyarrow as pa

    def cut(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            made = [b"".join(hashlib.blake2b(c, digest_size=width).digest() for c in chunks(t)) for t in texts]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests), pa.array(made, pa.binary())],
                names=["doc_id", "n_bytes", "text_sha256", "recipe"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, n_bytes long, text_sha256 string, recipe binary")


def chunk_store(docs: DataFrame, width: int) -> DataFrame:
    """Every different chunk of the texts, once: ``chunk`` (its identifier) and ``content``."""
    import pyarrow as pa

    def cut(batches):
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            size = 0
            for text in utf8(batch.column("text")):
                for c in chunks(text):
                    if c not in seen:
                        seen[c] = hashlib.blake2b(c, digest_size=width).digest()
                        size += len(c)
                    if size > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.binary()), pa.array(seen, pa.binary())], names=["chunk", "content"])
                        seen, size = {}, 0
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.binary()), pa.array(seen, pa.binary())], names=["chunk", "content"])

    return docs.select("text").mapInArrow(cut, "chunk binary, content binary").distinct()


def clashes(store: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk of the store."""
    return store.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1")


def verified_recipes(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``recipes`` with the first width for which every identifier stands for one chunk only, and a number per row; stored."""
    for width in widths:
        if clashes(chunk_store(docs, width)).isEmpty():
            return stored(recipes(docs, width).withColumn("_row", F.monotonically_increasing_id()), "recipes")
    raise ValueError("different chunks got equal identifiers of all widths")


def exact_duplicates(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, keep_id, group_size, kept, text_sha256.

    Rows with equal texts are a group, ``keep_id`` is its largest doc_id, whose row is kept. Null text counts as empty, and
    empty texts are a group. Rows are documents of their own: of repeated rows one is kept, and rows without a doc_id lose
    against all others (keep_id is null where no row of the group has one). Other columns are ignored; an empty table gives
    an empty result.

    A hot group's rows are settled by a broadcast: the groups with a HEAVY-th of all rows are at most HEAVY, and their recipes
    together take at most HEAVY times the mean size of a recipe (about 50 bytes for the documents here).
    """
    rows = verified_recipes(docs, widths)
    n = rows.count()
    found = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("last")).where("group_size > 1")
    groups = stored(found.select("recipe", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last._row").alias("_last")), "groups")
    heavy = F.col("group_size") * HEAVY > n
    large = groups.where(heavy).select("recipe", F.struct("group_size", "keep_id", "_last").alias("_large"))
    small = groups.where(~heavy).select("recipe", F.struct("group_size", "keep_id", "_last").alias("_small"))
    with_large = rows.join(F.broadcast(large), "recipe", "left")
    settled = with_large.where("_large is not null").withColumn("_group", F.col("_large")).drop("_large")
    rest = with_large.where("_large is null").drop("_large").join(small, "recipe", "left").withColumnRenamed("_small", "_group")
    return settled.unionByName(rest).select(
        "doc_id", "n_bytes",
        F.when(F.col("_group").isNull(), F.col("doc_id")).otherwise(F.col("_group.keep_id")).alias("keep_id"),
        F.coalesce("_group.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_group._last"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of rows with equal doc_id and text one stays."""
    gone = exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_doc"), "keep_id", F.col("text_sha256").alias("_sha")).where("not (_doc <=> keep_id)")
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    left = docs.withColumn("_sha256", text).join(gone.select("_doc", "_sha").distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_sha256") == F.col("_sha")), "left_anti")
    return left.dropDuplicates(["doc_id", "_sha256"]).select(*docs.columns)
