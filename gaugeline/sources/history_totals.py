"""Totals of a stored history, kept up to date by deltas with retraction.

A ledger beside the two stores (problems, scores) holds, per domain, difficulty, technique and state of the ground truth,
exact sums of what the stores' last updates say. :func:`advance_totals` takes the batches that are new since its last call:
for the problems they touch it takes back what the ledger holds of them and adds what holds now, and writes the difference
as a generation of its own. Rankings and coverage then read a few rows per block and generation instead of all scores.

One job at a time advances a ledger; any number of writers may upsert meanwhile. A batch counts once it is complete (its
``_SUCCESS`` file exists). A generation counts once its list of batches is stored, which happens after its deltas, so a failed
call leaves the ledger as it was and the next one writes the same generation again. A batch that is repeated must hold the
rows that it held before (as :func:`~gaugeline.sources.history_store.history_from_stream` batches do). After a compaction into a new path start a new
ledger. Null in ``has_ground_truth`` is a state of its own (``unknown``), and so are scores whose problem is not stored
(``absent``); scores without ``overall`` count as tested, not as samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import durable
from gaugeline.sources.history_store import KEY, PLACE, SCORE_KEY, _latest

GROUP = ["domain", "difficulty", "technique", "truth"]
SUMS = {"score_sum": "decimal(38,10)", "samples": "long", "tested": "long", "problems": "long"}
TOTALS = "domain string, difficulty string, technique string, truth string, " + ", ".join(f"{n} {t}" for n, t in SUMS.items())
BATCHES = "generation long, store string, writer string, batch long"


def _files(spark: SparkSession, pattern: str) -> list[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return [f.getPath().toString() for f in found or []]


def _complete(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """(writer, batch) of every batch that is wholly stored; one name per batch."""
    names = [f.split("/")[-3:-1] for f in _files(spark, f"{path.rstrip('/')}/writer=*/batch=*/_SUCCESS")]
    return {(w.removeprefix("writer="), int(b.removeprefix("batch="))) for w, b in names}


def _of(spark: SparkSession, path: str, batches: set[tuple[str, int]]) -> DataFrame:
    """Stored rows of some batches; the condition prunes folders."""
    wanted = F.lit(False)
    for writer in sorted({w for w, _ in batches}):
        wanted = wanted | ((F.col("writer") == writer) & F.col("batch").isin(sorted(b for w, b in batches if w == writer)))
    return spark.read.parquet(path).where(wanted)


def _facts(problems: DataFrame, scores: DataFrame) -> DataFrame:
    """Sums of the last updates among the given rows, all of which belong to the same problems."""
    order = ["updated", "batch", "writer"]
    truth = F.when(F.col("has_ground_truth"), "yes").when(~F.col("has_ground_truth"), "no").otherwise("unknown")
    known = _latest(problems, KEY, order).select(*KEY, "winner_technique", truth.alias("truth"))
    value = F.col("overall").cast("decimal(18,10)")
    judged = _latest(scores, SCORE_KEY, order).join(known.select(*KEY, "truth"), KEY, "left")
    judged = judged.withColumn("truth", F.coalesce("truth", F.lit("absent"))).groupBy(*GROUP).agg(
        F.sum(value).alias("score_sum"), F.count("overall").alias("samples"), F.count("*").alias("tested")
    )
    won = known.groupBy("domain", "difficulty", F.col("winner_technique").alias("technique"), "truth").agg(F.count("*").alias("problems"))
    return judged.unionByName(won, allowMissingColumns=True)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast(t).alias(n) for n, t in SUMS.items()])


def _included(spark: SparkSession, ledger: str) -> list:
    """The batches that the ledger holds, one row each."""
    if not _files(spark, f"{ledger}/batches/generation=*/_SUCCESS"):
        return []
    rows = spark.read.schema(BATCHES).parquet(f"{ledger}/batches")
    return rows.select("generation", "store", "writer", "batch").collect()


def advance_totals(spark: SparkSession, problems: str, scores: str, ledger: str) -> int:
    """Add the batches that are new since the last call; the last generation (0: nothing stored yet).

    Work grows with the blocks that the new batches touch. Each store must hold a row by the first call.
    """
    paths = {"problems": problems, "scores": scores}
    rows = _included(spark, ledger)
    generation = max((r.generation for r in rows), default=0)
    before = {s: {(r.writer, r.batch) for r in rows if r.store == s} for s in paths}
    added = {s: _complete(spark, p) - before[s] for s, p in paths.items()}
    if not any(added.values()):
        return generation
    generation += 1
    touched = durable(
        _of(spark, problems, added["problems"]).select(*KEY).unionByName(_of(spark, scores, added["scores"]).select(*KEY)).distinct()
    )

    def facts(batches: dict[str, set]) -> DataFrame:
        # null-safe, as a key column may be null
        of = {s: _of(spark, p, batches[s]).alias("r").join(touched.alias("t"), _same("r", "t"), "left_semi") for s, p in paths.items()}
        return _facts(of["problems"], of["scores"])

    now = facts({s: before[s] | added[s] for s in paths})
    back = facts(before).withColumns({n: -F.col(n) for n in SUMS})
    change = _summed(now.unionByName(back)).where(" or ".join(f"{n} <> 0" for n in SUMS))
    change.write.mode("overwrite").parquet(f"{ledger}/deltas/generation={generation}")
    listed = [(s, w, b) for s in paths for w, b in sorted(added[s])]
    spark.createDataFrame(listed, "store string, writer string, batch long").write.mode("overwrite").parquet(f"{ledger}/batches/generation={generation}")
    return generation


def _same(left: str, right: str):
    condition = F.lit(True)
    for c in KEY:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def read_totals(spark: SparkSession, ledger: str) -> DataFrame:
    """Totals of all generations that count: GROUP and SUMS. The technique is null for problems without a winner."""
    last = max((r.generation for r in _included(spark, ledger)), default=0)
    if not last:
        return spark.createDataFrame([], TOTALS)
    deltas = spark.read.schema(TOTALS + ", generation long").parquet(f"{ledger}/deltas").where(F.col("generation") <= last)
    return _summed(deltas).where(" or ".join(f"{n} <> 0" for n in SUMS))
