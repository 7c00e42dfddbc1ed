"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, and one over the groups' roots.

Digests are hexadecimal text. The leaves of a group are numbered; each aligned block of BLOCK of them keeps a level as one
string, the digests end to end. Fixed-width substrings of FANOUT digests are hashed to the next level's string, and what
stands left and right of a digest in its substring are its siblings. The blocks' roots are the leaves of the next round,
until every group has one digest left; the groups' digests then make the last tree in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.basics import let
from gaugeline.llm.common import stored

#: Digits of a digest, children of a node, levels and leaves of a block.
DIGITS, FANOUT, LEVELS = 64, 8, 3
BLOCK = FANOUT**LEVELS
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its size in UTF-8 bytes in front, so that fields can't run into each other; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def _cut(level: Column, first: Column, count: Column | int) -> Column:
    """``count`` digests of a level from number ``first`` (from 0); bytes, where a fixed width needs no walk through the text."""
    width = count * F.lit(DIGITS) if isinstance(count, Column) else F.lit(count * DIGITS)
    return level.cast("binary").substr((first * DIGITS + 1).cast("int"), width.cast("int")).cast("string")


def _above(level: Column) -> Column:
    """The next level's string."""

    def hashed(s: Column) -> Column:
        runs = F.ceil(F.length(s) / (DIGITS * FANOUT)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(_cut(s, i * FANOUT, FANOUT).cast("binary"), 256)), "")

    return let(level, hashed)


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with ``place``, counted from 0 within ``grp``, and ``n``, the size of the group; stored.

    The rows are sorted in ranges of (grp, order); a range adds what earlier ranges hold of the group. The table of those
    counts has a row per range and group that meets it.
    """
    ranged = nodes.repartitionByRange(F.col("grp").asc_nulls_first(), *order).sortWithinPartitions(F.col("grp").asc_nulls_first(), *order)
    rows = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "leaves").withColumn("_range", F.shiftright("_id", 33))
    parts = rows.groupBy("grp", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("grp")
    parts = parts.select(
        F.col("grp").alias("_grp"), F.col("_range").alias("_part"), "_first", F.sum("_rows").over(whole).alias("n"),
        F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    joined = rows.join(parts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_range") == F.col("_part")))
    return joined.withColumn("place", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_grp", "_part", "_first", "_before")


def _blocks(nodes: DataFrame, members: list[str]) -> DataFrame:
    """Blocks of the nodes (grp, place, n, node and ``members``): grp, block, n, levels, the strings l0 to l3, rows by place.

    A level that the block has not got repeats the one below, so l3 is the digest that the block hands on.
    """
    columns = F.struct("place", "node", *members)
    grouped = nodes.groupBy("grp", F.floor(F.col("place") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(columns)).alias("rows"))
    made = grouped.withColumn("levels", reduce(lambda a, b: a + b, [(F.col("n") > FANOUT**k).cast("int") for k in range(LEVELS)]))
    made = made.withColumn("l0", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    for k in range(LEVELS):
        made = made.withColumn(f"l{k + 1}", F.when(F.col("levels") > k, _above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return made


def _flanks(levels: str = "levels", place: str = "place") -> Column:
    """Per level of its block the digests left and right of a node: array of (a, b)."""
    inside = F.pmod(F.col(place), F.lit(BLOCK))
    found = []
    for k in range(LEVELS):
        own = F.floor(inside / FANOUT**k)
        first, at = own - F.pmod(own, F.lit(FANOUT)), F.pmod(own, F.lit(FANOUT))
        pair = F.struct(_cut(F.col(f"l{k}"), first, at).alias("a"), _cut(F.col(f"l{k}"), own + 1, F.lit(FANOUT - 1) - at).alias("b"))
        found.append(F.when(F.col(levels) > k, pair))
    return F.array_compact(F.array(*found))


def folded(node: Column, flanks: Column) -> Column:
    """The root that a node leads to, hashed with its siblings level by level."""
    return F.aggregate(flanks, node, lambda acc, f: F.sha2(F.concat(f["a"], acc, f["b"]).cast("binary"), 256))


def siblings(flanks: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(flanks, lambda f: F.concat(f["a"], f["b"])), "")


def _climb(nodes: DataFrame) -> DataFrame:
    """Of blocks' digests (grp, place, n, node): grp, place, ``flanks`` from there up to the group's root, ``root``.

    A round makes the blocks' digests of the next; the flanks are put together on the way back down. Groups that have one
    digest left pass through without a level. Each round has a BLOCK-th of the rows of the one before.
    """
    most = nodes.agg(F.max("n")).first()[0]
    if most is None or most <= 1:
        return nodes.select("grp", "place", F.expr("cast(array() as array<struct<a:string,b:string>>)").alias("flanks"), F.col("node").alias("root"))
    blocks = stored(_blocks(nodes, []), "blocks")
    above = _climb(_next(blocks)).select(F.col("grp").alias("_grp"), F.col("place").alias("_block"), F.col("flanks").alias("_above"), "root")
    return _spread(blocks.join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))).select(
        "grp", "place", F.concat("flanks", "_above").alias("flanks"), "root"
    )


def _next(blocks: DataFrame) -> DataFrame:
    """The blocks' digests as nodes of the next round."""
    count = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1)
    return blocks.select("grp", F.col("block").alias("place"), count.cast("long").alias("n"), F.col(f"l{LEVELS}").alias("node"))


def _spread(blocks: DataFrame) -> DataFrame:
    """A row per node of the blocks, with its flanks inside the block and the blocks' other columns."""
    rows = blocks.withColumn("_r", F.explode("rows"))
    others = [c for c in blocks.columns if c not in ("rows", "levels", "n", *[f"l{k}" for k in range(LEVELS + 1)])]
    inner = [f.name for f in blocks.schema["rows"].dataType.elementType]
    return rows.select(*others, *[F.col(f"_r.{c}").alias(c) for c in inner], *[f"l{k}" for k in range(LEVELS)], "levels").withColumn("flanks", _flanks()).drop(*[f"l{k}" for k in range(LEVELS)], "levels")


def manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """Tree of ``docs`` (FIELDS): a row per row, with doc_id, ``group``, place (in the group, from 0), leaf, subroot, root,
    ``flanks`` (the siblings left and right per level, from the leaf up to the root) and ``presented``.

    A leaf is the digest of FIELDS. Per group the leaves ascend by doc_id (nulls first; ties by leaf), and FANOUT consecutive
    nodes become their digest until one is left, the subroot; the subroots in the order of the groups (null first, then by
    bytes) make the root. ``tampered`` is another text, null where the row is untouched; ``presented`` is its leaf, otherwise
    the row's own. Null fields have a mark of their own, so they differ from empty ones; repeated rows are leaves each; other
    columns are ignored; an empty table gives an empty result.
    """
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if tampered is None else tampered
    changed = F.when(other.isNotNull(), leaf([*fields[:-1], other]))
    leaves = docs.select(F.col(group).cast("string").alias("grp"), "doc_id", leaf(fields).alias("node"), changed.alias("changed"))
    blocks = stored(_blocks(numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("node")]), ["doc_id", "changed"]), "blocks")

    inner = _climb(_next(blocks)).select(F.col("grp").alias("_grp"), F.col("place").alias("_block"), F.col("flanks").alias("_inner"), F.col("root").alias("subroot"))
    inner = stored(inner, "subroots")
    tops = inner.where("_block = 0").select(F.lit("").alias("grp"), F.col("_grp").alias("_name"), F.col("subroot").alias("node"))
    tops = numbered(tops, [F.col("_name").asc_nulls_first()])
    ways = _climb(stored(tops, "tops").select("grp", "place", "n", "node")).select("place", F.col("flanks").alias("_outer"), "root")
    outer = tops.join(ways, "place").select(F.col("_name").alias("_top"), "_outer", "root")
    upper = inner.join(outer, F.col("_grp").eqNullSafe(F.col("_top"))).select(
        "_grp", "_block", "subroot", "root", F.concat("_inner", "_outer").alias("_upper")
    )
    rows = _spread(blocks.join(upper, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block"))))
    return rows.select(
        "doc_id", F.col("grp").alias(group), "place", F.col("node").alias("leaf"), "subroot", "root",
        F.concat("flanks", "_upper").alias("flanks"), F.coalesce("changed", "node").alias("presented"),
    )


def verified(tree: DataFrame) -> DataFrame:
    """``tree`` with ``proof`` (all siblings), ``folded_root`` (from the presented leaf) and ``verified``."""
    made = tree.withColumn("proof", siblings(F.col("flanks"))).withColumn("folded_root", folded(F.col("presented"), F.col("flanks")))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
