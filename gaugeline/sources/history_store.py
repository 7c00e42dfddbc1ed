"""Stored history as Parquet, partitioned by domain and difficulty.

Every upsert writes a folder of its own, named by its writer and the writer's batch number. No write touches what another
writer or batch has stored, so nothing can be lost to a reused number; repeating a batch replaces its own folder only, and
a failed one leaves the table as it was. Rows carry ``updated``, an event time or a sequence number: readers keep the row
of each key that was updated last. Two kinds of rows are stored this way, each below its own path: problems (key ``KEY``)
and scores per technique (key ``SCORE_KEY``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["domain", "difficulty", "problem_id"]
SCORE_KEY = [*KEY, "technique"]
PLACE = ["writer", "batch"]


def _latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; equal ones are decided by their content, so that reruns agree."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return rows.groupBy(*key).agg(last.alias("_last")).select(*key, "_last.*").select(*rows.columns)


def upsert_history(rows: DataFrame, path: str, writer: str, batch: int, key: list[str] = KEY) -> None:
    """Store rows (with ``updated``) as a batch of a writer; the last update of a key wins, whoever wrote it."""
    folder = f"{path.rstrip('/')}/writer=by-{writer}/batch={batch}"
    _latest(rows, key, ["updated"]).write.mode("overwrite").partitionBy("domain", "difficulty").parquet(folder)


def read_history(spark: SparkSession, path: str, domain: str | None = None, difficulty: str | None = None, key: list[str] = KEY) -> DataFrame:
    """The last update of each key; domain and difficulty prune partitions. Equal updates: the later batch."""
    rows = spark.read.parquet(path)
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    if difficulty is not None:
        rows = rows.where(F.col("difficulty") == difficulty)
    return _latest(rows, key, ["updated", "batch", "writer"]).drop(*PLACE)


def compact_history(spark: SparkSession, path: str, target: str, key: list[str] = KEY) -> None:
    """Write the last updates as a new table of one batch."""
    upsert_history(read_history(spark, path, key=key), target, "compaction", 0, key)
