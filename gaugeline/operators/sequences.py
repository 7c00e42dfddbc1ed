"""Numbering and running values inside groups of any size, as a scan in two phases.

A plain window puts a whole group in one task. Here the rows are sorted into ranges of (keys, order), cut at quantiles that
Spark samples, so neither a hot key nor a hot stretch of the order fills a range. The first phase takes totals per range and
group; the second adds to every row what the earlier ranges hold of its group. The table of totals has one row per range and
group (and value) that meets it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeline.session import durable


def ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, stored in ranges of (keys, order), with the number of their range ``_range`` and their place in it ``_place``."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stored = durable(ranged.withColumn("_m", F.monotonically_increasing_id()))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumns({"_range": F.shiftright("_m", 33), "_place": place}).drop("_m")


def _earlier(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _met(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``totals`` (one row per keys); null keys meet each other."""
    named = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def sequence_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row number within ``keys`` by ``order``, from 1."""
    rows = ranges(df, keys, order)
    totals = rows.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0))
    totals = totals.select(*keys, "_range", (before - F.col("_first") + 1).alias("_shift"))
    return _met(rows, totals, [*keys, "_range"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def running_share(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Share of the most frequent value among the rows so far.

    Adds ``position`` (rows so far) and ``matching`` (rows of the most frequent value so far). The most frequent count only
    grows, so it is the running maximum of each value's own running count: that of the earlier ranges comes from the totals,
    the rest from windows within a range.
    """
    rows = ranges(df, keys, [order])
    counts = rows.groupBy(*keys, value, "_range").agg(F.count("*").alias("_n"))
    counts = durable(counts.withColumn("_value_before", F.coalesce(F.sum("_n").over(_earlier([*keys, value])), F.lit(0))))
    whole = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"), F.max(F.col("_n") + F.col("_value_before")).alias("_top"))
    whole = whole.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.max("_top").over(_earlier(keys)), F.lit(0)).alias("_top_before"),
    )
    local = [*keys, "_range"]
    joined = _met(_met(rows, whole, local), counts.drop("_n"), [*local, value])
    # one exchange serves both windows
    local_rows = joined.repartition("_range", *keys)
    seen = F.row_number().over(Window.partitionBy(*local, value).orderBy("_place")) + F.col("_value_before")
    in_range = Window.partitionBy(*local).orderBy("_place")
    best = F.max("_seen").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    made = local_rows.withColumn("_seen", seen).withColumns({
        "position": (F.row_number().over(in_range) + F.col("_rows_before")).cast("long"),
        "matching": F.greatest(best, F.col("_top_before")).cast("long"),
    })
    return made.drop("_range", "_place", "_seen", "_value_before", "_rows_before", "_top_before")


def with_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """S3: consecutive ids from 0 in the given order, without a single-task window."""
    one = sequence_numbers(df.withColumn("_all", F.lit(0)), ["_all"], order, name)
    return one.withColumn(name, F.col(name) - 1).drop("_all")
