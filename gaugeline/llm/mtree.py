"""Exact top-k search with a paged M-tree.

The largest inner products are the smallest distances once every vector gets one more coordinate that brings all to the
same length, sqrt(M^2 - |x|^2); queries get 0 there. The root of the tree holds a fixed number of routing vectors with
covering radii, each over a cell of the vectors next to it. A cell is cut into parts of bounded size, and a task holds
the pages of one part: routing vector, covering radius, distance to the cell's routing vector, and the members with their
distance to the page's. The search visits pages in the order of their smallest possible distance; the stored distances
rule out pages and members by the triangle inequality before anything is computed for them. Scores are exact integers;
distances only prune, with some slack for rounding.

Each query is first answered within its own part, which gives a bound; then it goes to the parts that may beat it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import stored

#: Routing vectors of the root, vectors of a part, vectors of a page, queries of a block.
CELLS, PART, PAGE, BLOCK = 32, 16_384, 128, 8_192
#: Scale of the components.
SCALE = 1024


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) per component, x as double.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id. Rows of one
    vec_id are one vector, the smallest. Shorter vectors count as ending in zeros. Components beyond 64 bits are an error.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    wide = lambda c: F.raise_error(F.concat(F.lit("component beyond 64 bits: "), c.cast("string"))).cast("long")
    scaled = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * SCALE) < float(1 << 63), F.floor(c.cast("double") * SCALE)).otherwise(wide(c)))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
    return rows.select("vec_id", scaled.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Root:
    """The routing vectors (with their last coordinate), and what all tasks need to know of the whole."""

    def __init__(self, routes: np.ndarray, top: float, dims: int):
        self.top, self.dims = top, dims
        self.routes = self.lifted(routes)
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))[:, None]])

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.zeros((len(x), 1))])


class Part:
    """The pages of one part of a cell."""

    def __init__(self, root: Root, cell: int, ids: np.ndarray, x: np.ndarray):
        self.root = root
        spread = np.argsort((ids * 2654435761) % (1 << 32), kind="stable")
        self.ids, self.x = ids, x
        lifted = root.lifted(x)
        heads = lifted[spread[: max(1, len(ids) // PAGE)]]
        nearest = np.concatenate([_distances(lifted[k : k + 2048], heads).argmin(1) for k in range(0, len(ids), 2048)])
        self.pages = []  # routing vector, radius, distance to the cell's, members by their distance to the page's
        for p, head in enumerate(heads):
            members = np.flatnonzero(nearest == p)
            if len(members):
                away = np.sqrt(((lifted[members] - head) ** 2).sum(1))
                order = np.argsort(away)
                self.pages.append((away[order[-1]], members[order], away[order]))
            else:
                self.pages.append((-1.0, members, np.empty(0)))
        self.heads = heads
        self.radii = np.array([p[0] for p in self.pages])
        self.parents = np.sqrt(((heads - root.routes[cell]) ** 2).sum(1))
        self.cell = cell

    def search(self, query_id: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, vec_id), best first; only scores of at least ``least`` matter."""
        root, lifted = self.root, self.root.queries(q[None])[0]
        length = (lifted * lifted).sum() + root.top
        reach = lambda score: np.sqrt(max(length - 2.0 * score, 0.0)) + root.slack
        limit = np.inf if least is None else reach(least)
        to_cell = np.sqrt(((lifted - root.routes[self.cell]) ** 2).sum())
        # the distance to a page's routing vector is computed only where the stored distance to the cell's leaves a chance
        bound = np.abs(to_cell - self.parents) - self.radii
        near = np.flatnonzero((self.radii >= 0) & (bound <= limit))
        away = np.sqrt(((self.heads[near] - lifted) ** 2).sum(1))
        queue = [(max(0.0, d - self.radii[p]), p, d) for p, d in zip(near.tolist(), away.tolist(), strict=True)]
        heapq.heapify(queue)
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, len(q))
        # scores in floats, 64 bits or Python's integers, whichever holds them exactly
        kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object
        while queue:
            lower, p, d = heapq.heappop(queue)
            if lower > limit:
                break
            _, members, stored_away = self.pages[p]
            a, b = np.searchsorted(stored_away, [d - limit, d + limit], side="left")
            rows = members[a : b + 1]
            if not len(rows):
                continue
            scores = self.x[rows].astype(kind) @ q.astype(kind)
            scores = scores if kind is object else scores.astype(np.int64)
            for score, vec_id in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                if vec_id == query_id or (least is not None and score < least):
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -vec_id))
                elif (score, -vec_id) > best[0]:
                    heapq.heapreplace(best, (score, -vec_id))
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        return [(s, -v) for s, v in sorted(best, reverse=True)]


FOUND = "query_id long, vec_id long, score long"


def _answers(part: Part, ids, vectors, least, k: int) -> pd.DataFrame:
    """Scores beyond 64 bits are an error. Where some of ``least`` is missing all are rounded, so the number below counts."""
    least = [None if pd.isna(x) else int(np.nextafter(x, -np.inf)) if isinstance(x, float) else int(x) for x in least]
    rows = [
        (query_id, vec_id, score)
        for query_id, q, floor in zip(ids, _matrix(vectors, part.root.dims), least, strict=True)
        for score, vec_id in part.search(int(query_id), q, k, floor)
    ]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each vec_id that ``every`` divides.

    Candidates are all vectors but the query's own; ties go to the smaller vec_id; with fewer than k others, all. See
    ``quantised`` for null, broken and repeated rows. No vectors, no queries or no candidates give no rows.
    """
    rows = stored(quantised(vectors), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    seen = rows.agg(F.max(norm).alias("top"), F.max(F.size("v")).alias("dims"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("asked")).first()
    dims = max(1, seen["dims"] or 0)
    heads = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CELLS).collect()
    if not heads:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spark = vectors.sparkSession
    root = spark.sparkContext.broadcast(Root(_matrix([r["v"] for r in heads], dims), float(seen["top"]), dims))  # CELLS vectors

    @F.pandas_udf("cell int, away double")
    def cell_of(v: pd.Series) -> pd.DataFrame:
        away = _distances(root.value.lifted(_matrix(v, dims)), root.value.routes)
        return pd.DataFrame({"cell": away.argmin(1).astype("int32"), "away": away.min(1)})

    celled = stored(rows.withColumn("_c", cell_of("v")).select("vec_id", "v", "_c.cell", "_c.away"), "cells")
    shape = {r["cell"]: (r["n"], r["radius"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    parts = {c: -(-n // PART) for c, (n, _) in shape.items()}
    radii = {c: r for c, (_, r) in shape.items()}
    per_cell = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    placed = celled.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), per_cell[F.col("cell")].cast("long")).cast("int").alias("part"))

    def tree(frame: pd.DataFrame) -> Part:
        return Part(root.value, int(frame["cell"].iloc[0]), frame["vec_id"].to_numpy(np.int64), _matrix(frame["v"], dims))

    def home(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame[frame["vec_id"] % every == 0]
        if not len(asked):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        return _answers(tree(frame), asked["vec_id"], asked["v"], [None] * len(asked), k)

    first = stored(placed.groupBy("cell", "part").applyInPandas(home, FOUND), "answers")
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    asked = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("cell").alias("own_cell"), F.col("part").alias("own_part"))
    asked = asked.join(bounds, "query_id", "left").select("query_id", "q", "own_cell", "own_part", F.when(F.col("n") >= k, F.col("least")).alias("least"))

    @F.pandas_udf("array<int>")
    def cells_for(q: pd.Series, least: pd.Series) -> pd.Series:
        x = root.value.queries(_matrix(q, dims))
        away, length = _distances(x, root.value.routes), (x * x).sum(1) + root.value.top
        limit = np.where(least.isna(), np.inf, np.sqrt(np.maximum(length - 2.0 * least.fillna(0).to_numpy(np.float64), 0)) + root.value.slack)
        radius = np.array([radii.get(c, -np.inf) for c in range(away.shape[1])])
        return pd.Series([np.flatnonzero(a - radius <= t + root.value.slack).astype("int32").tolist() for a, t in zip(away, limit, strict=True)])

    blocks = max(1, -(-(seen["asked"] or 0) // BLOCK))
    sent = (
        asked.withColumn("cell", F.explode(cells_for("q", "least")))
        .withColumn("part", F.explode(F.sequence(F.lit(0), per_cell[F.col("cell")].cast("int") - 1)))
        .where("not (cell = own_cell and part = own_part)")
        .select("cell", "part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "q", "least")
    )
    held = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def elsewhere(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        return _answers(tree(members), queries["query_id"], queries["q"], queries["least"], k)

    keys = ["cell", "part", "block"]
    second = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(elsewhere, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
