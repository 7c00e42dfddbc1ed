"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents stand in a shuffled line (order of a hash) that is cut into blocks of equal words. The schedule
has 2^m points; point i is the van der Corput number of i, read as an integer below 2^m, and falls into one source's
interval of the cumulative slot counts. A source's slots are ranked by i and slot r takes block r of the source, wrapping
around. The points of one power of two are a permutation of all integers below it, so every source gets exactly the
slots it is due, evenly spread over the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import stored

#: No document is taken more often than this.
MOST = 3
#: Pieces of a source's hash order that get running sums on their own, and cells of the schedule that sources are matched in.
CHUNK_BITS, CELL_BITS = 10, 10
#: The mix has about this many blocks at least, of 8 to 2048 words each.
LEAST_BLOCKS, BLOCK_WORDS = 65_536, (8, 2048)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Water filling over rows of (src, source_size): adds ``target`` (double).

    Sources in order of ``src`` weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at ``most``
    times its source's size and the excess is shared by weight among the others. One row per source.
    """
    all_rows = Window.partitionBy()
    weighed = sizes.withColumn("weight", (F.row_number().over(Window.orderBy("src")) - 1) % 3 + 1)
    full = F.col("source_size") * most
    before = Window.orderBy(full / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn(
        "level",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(full).over(before), F.lit(0)))
        / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    ).withColumn("open", full / F.col("weight") >= F.col("level"))
    # in order of the level at which sources are full, the first one that isn't full sets the level of all others
    first = F.col("open") & (F.coalesce(F.sum(F.col("open").cast("int")).over(before), F.lit(0)) == 0)
    shared = level.withColumn("_first", F.when(first, F.col("level"))).withColumn("_level", F.max("_first").over(all_rows))
    target = F.when(F.col("open"), F.least(F.col("_level") * F.col("weight"), full.cast("double"))).otherwise(full.cast("double"))
    return shared.select("src", "source_size", "weight", target.alias("target"))


def point(i: Column, bits: int) -> Column:
    """The van der Corput number of i, as an integer below 2^bits: the bits of i, reversed."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def rank(i: Column, own_point: Column, low: Column, width: Column, bits: int) -> Column:
    """How many i' < i have their point in [low, low + width).

    The numbers below i fall into one aligned block of 2^b for every set bit b of i; the points of such a block are an
    arithmetic progression of step 2^(bits - b), so each is counted without a look at the other slots. It starts at the
    reversed bits of i above b, which are the lowest bits of i's own point.
    """
    total = F.lit(0).cast("long")
    for b in range(bits):
        step, first = 1 << (bits - b), own_point.bitwiseAND(F.lit((1 << (bits - 1 - b)) - 1))

        def below(end: Column) -> Column:
            return F.greatest(F.lit(0), F.least(F.lit(1 << b), F.ceil((end - first) / F.lit(step)).cast("long")))  # noqa: B023

        total = total + F.when(i.bitwiseAND(F.lit(1 << b)) != 0, below(low + width) - below(low)).otherwise(0)
    return total


class Mix:
    """The parts of one mix: ``line`` (a row per document), ``sources``, ``slots`` and ``taken()``."""

    def __init__(self, docs: DataFrame, seed: int = 0, most: int = MOST, carry: list[str] | None = None):
        """``carry``: further columns of ``docs`` that ``line`` keeps.

        Null text has size 0; null sources are one source, the last. Repeated rows are documents of their own. Documents
        without words and sources of size 0 take nothing; an empty table gives an empty mix.
        """
        spark = docs.sparkSession
        src = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
        order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
        sized = stored(
            docs.select(
                F.col("doc_id"), src.alias("src"), n_words(F.col("text")).alias("size"), order.alias("_order"),
                *[F.col(c) for c in carry or []],
            ).withColumn("_chunk", F.shiftrightunsigned("_order", 64 - CHUNK_BITS).cast("int")),
            "mix-sizes",
        )
        chunks = sized.groupBy("src", "_chunk").agg(F.sum("size").alias("_words"))
        earlier = Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.select("src", "_chunk", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
        within = Window.partitionBy("src", "_chunk").orderBy(F.col("_order"), F.col("doc_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = sized.withColumn("_within", F.sum("size").over(within)).join(chunks, ["src", "_chunk"])
        self.line = stored(
            placed.select("doc_id", "src", "size", (F.col("_before") + F.col("_within") - F.col("size")).alias("start"), *[F.col(c) for c in carry or []]),
            "mix-line",
        )
        sizes = self.line.groupBy("src").agg(F.sum("size").alias("source_size"))
        total = sizes.agg(F.sum("source_size")).first()[0] or 0
        self.block = max(BLOCK_WORDS[0], min(BLOCK_WORDS[1], total // LEAST_BLOCKS))
        due = F.least(F.round("target").cast("long"), F.col("source_size") * most)
        size = F.greatest(F.col("source_size"), F.lit(1))
        counted = (
            targets(sizes, most)
            .withColumn("due", due)
            .withColumn("blocks", F.ceil(F.col("source_size") / self.block))
            .withColumn("slots", F.floor(F.col("due") / size) * F.col("blocks") + F.ceil((F.col("due") % size) / self.block))
        )
        cumulated = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
        self.sources = stored(counted.withColumn("low", F.coalesce(F.sum("slots").over(cumulated), F.lit(0)).cast("long")), "mix-sources")
        n_slots = self.sources.agg(F.sum("slots")).first()[0] or 0
        self.bits = max(1, (max(1, int(n_slots)) - 1).bit_length())
        self.slots = self._schedule(spark)

    def _schedule(self, spark) -> DataFrame:
        """Rows of (slot, src, rank): the source that each slot draws from and the slot's number within its source."""
        shift = max(0, self.bits - CELL_BITS)
        spans = self.sources.where("slots > 0").select(
            "src", "low", "slots",
            F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("low") + F.col("slots") - 1, shift))).alias("_cell"),
        )
        drawn = spark.range(1 << self.bits).withColumn("_point", point(F.col("id"), self.bits))
        drawn = drawn.withColumn("_cell", F.shiftright("_point", shift))
        held = drawn.join(spans, "_cell").where("_point >= low and _point < low + slots")
        own = rank(F.col("id"), F.col("_point"), F.col("low"), F.col("slots"), self.bits)
        return held.select(F.col("id").alias("slot"), "src", own.alias("rank"))

    def pieces(self) -> DataFrame:
        """The mix itself: (slot, src, start, from_word, to_word), a row per document and slot that takes words of it.

        ``start`` names the document within its source; the words are counted from the document's first.
        """
        sources = self.sources.select("src", "source_size", "due", "blocks")
        slots = (
            self.slots.join(sources, "src")
            .withColumn("_block", F.col("rank") % F.col("blocks"))
            .withColumn("_lap", F.floor(F.col("rank") / F.col("blocks")))
            .withColumn("_from", F.col("_block") * self.block)
            .withColumn("_to", F.least(F.col("_from") + self.block, F.col("source_size"), F.col("due") - F.col("_lap") * F.col("source_size")))
            .select("slot", "src", "_block", "_from", "_to")
        )
        cut = self.line.where("size > 0").select(
            "src", "start", "size",
            F.explode(F.sequence(F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block))).alias("_block"),
        )
        low, high = F.greatest("_from", "start"), F.least(F.col("_to"), F.col("start") + F.col("size"))
        return (
            cut.join(slots, ["src", "_block"])
            .select("slot", "src", "start", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word"))
            .where("to_word > from_word")
        )

    def taken(self) -> DataFrame:
        """``line`` with ``source_size``, ``target`` and ``taken``: the words that the slots take of each document."""
        words = self.pieces().groupBy("src", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"))
        sources = self.sources.select("src", "source_size", "target")
        joined = self.line.join(sources, "src").join(words, ["src", "start"], "left")
        return joined.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long")).drop("_taken")
