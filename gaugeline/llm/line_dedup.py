"""Line dedup: levelled sorted runs of line hashes.

Documents arrive in batches (here: ranges of doc_id, highest first). A batch reduces its long lines to one row per line
hash, merge-anti-joins the runs written so far to find the lines nobody held before, and adds its own sorted run. A level
that collects ``FANOUT`` runs is compacted into one run of the next level. Runs are tables bucketed and sorted by the
hash, so neither the anti-join nor a compaction moves a run's rows again.

DataFrame functions only; no Python code runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import SPACES, lower_ascii, stored
from gaugeline.session import scratch_path, shuffle_width

#: Parts of the doc_id range that are fed one after the other, and runs of a level that make one of the next.
BATCHES, FANOUT = 4, 2


class LineRuns:
    """Runs of (line, n_docs, holder): documents that hold the line, and the largest doc_id among them.

    ``holder`` is set once per line, in the run of the batch that first brought it; later runs only add counts.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_width(spark)
        self.levels: list[list[str]] = [[]]
        self.made: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "line").write.bucketBy(self.buckets, "line").sortBy("line")
        writer.option("path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        self.made.append(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (line, doc_id). All its doc_ids are below those of earlier batches."""
        rows = batch.groupBy("line").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"))
        for level in self.levels:
            for name in level:
                # rows without a partner are the anti-join: lines that this run has never held
                first = self.spark.table(name).where("holder is not null").select("line", F.lit(True).alias("_held"))
                rows = rows.join(first, "line", "left").select(
                    "line", "n_docs", F.when(F.col("_held").isNull(), F.col("holder")).alias("holder")
                )
        self.levels[0].append(self._write(rows))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(level)))
                self.levels[k] = []

    def totals(self) -> DataFrame:
        """A row per line over all runs."""
        return self._merged([name for level in self.levels for name in level])

    def _merged(self, names: list[str]) -> DataFrame:
        """Merge sorted runs by full joins on the line, which read equal buckets side by side."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select("line", F.col("n_docs").alias("_more"), F.col("holder").alias("_holder"))
            out = out.join(other, "line", "full").select(
                "line",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("n_docs"),
                F.coalesce("holder", "_holder").alias("holder"),
            )
        return out

    def forget(self) -> None:
        """Take the run tables out of the catalog; their files stay below the shared folder."""
        for name in self.made:
            self.spark.sql(f"drop table if exists {name}")


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents hold, except in the largest doc_id holding them.

    Lines are split at ``\\n``; null or empty text is one empty line. Keys shorter than ``min_chars`` code points stay.
    ``text`` is replaced by the kept lines, joined by ``\\n``; ``n_lines`` and ``n_dropped`` are added (columns of these
    names are replaced), all other columns pass through. A line counts once per doc_id, so repeated rows neither reach the
    threshold together nor lose lines against each other. Rows without a doc_id belong to no document: they count
    nowhere and keep all lines. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    marks = F.transform(lines, lambda x: F.when(F.length(line_key(x)) >= min_chars, F.unhex(F.md5(line_key(x).cast("binary")))))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("b")).first()["b"] or []
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("doc_id") < F.lit(bound)).cast("int")
    held = stored(
        docs.where("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("text_id"), batch.alias("batch"), F.posexplode(marks).alias("pos", "line"))
        .where("line is not null")
        .select("doc_id", "text_id", "pos", "line", "batch"),
        "lines", ["batch"],
    )
    runs = LineRuns(spark)
    for k in range(len(bounds) + 1):
        runs.add(held.where(F.col("batch") == k).select("line", "doc_id"))
    common = stored(runs.totals().where(F.col("n_docs") >= min_docs).select("line", "holder"), "common-lines")
    runs.forget()

    gone = (
        held.join(common, "line").where("doc_id <> holder")
        .groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_id").alias("_gone_text"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    )
    joined = docs.withColumn("_text_id", F.xxhash64("text")).join(
        gone, (F.col("doc_id") == F.col("_gone_id")) & (F.col("_text_id") == F.col("_gone_text")), "left"
    )
    gone_at = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    # the stretches between dropped lines, so that the work is linear in the lines
    ends = F.concat(gone_at, F.array(F.size(lines)))
    kept = F.flatten(
        F.transform(
            ends,
            lambda end, i: F.slice(
                lines,
                F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1) + 1,
                end - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1),
            ),
        )
    )
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    out = joined.select(
        *own,
        F.when(F.col("_gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone_at).cast("long").alias("n_dropped"),
    )
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
