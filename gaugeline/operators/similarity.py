"""Similarity of many targets with many documents.

Targets are a stated set of queries against all documents of their block. What is compared is not rows:

* Rows of a block with equal tags, type and tokens are one *form*; its documents' facts are summed first.
* A token that at most RARE forms of a block's documents hold is rare, others are common. Forms with equal tags, type, common
  tokens and number of tokens are one *skeleton*. Skeletons are compared with skeletons as if rare tokens never met, which
  gives exact sums for all pairs of forms without a rare token in common.
* The other pairs come from an inverted index of the rare tokens, at most RARE forms per token, so they grow with the tokens
  and not with the square of the rows; each one's true score replaces that of its skeletons.
* In a block of long texts every form is its own skeleton with all its tokens, as rare tokens save nothing there.

Pairs that both have a vector have scores of their own; those rows are compared as they are. Both sides of a block are cut
into parts of bounded size; a task compares one part with one part as arrays and returns sums or the best few per target.
Texts don't travel, their tags and tokens do as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import lexicon as lx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import rounded, strip
from gaugeline.functions.pairs import WITH_VECTORS, feature_similarity, hybrid, jaccard_counts, type_mismatch
from gaugeline.operators.history import usable
from gaugeline.operators.tagging import with_feature_tags
from gaugeline.session import durable, shuffle_width

#: Targets, documents and tokens of either side that one task compares, about. A row travels once per part of the other side.
TARGETS, DOCUMENTS, TOKENS = 8192, 8192, 1 << 22
#: Pairs that a task holds scores of at once.
PAIRS = 1 << 21
#: Share of a part's documents from which a token is counted by a matrix product, and most such tokens.
OFTEN, COLUMNS = 0.05, 1024
#: Sums that a task holds at once, about.
SLAB = 1 << 22
#: Queries and vectors that one task multiplies.
QUERIES, VECTORS = 1024, 2048
#: Rows of a batch that leaves a task of :func:`pair_layers`.
ROWS = 1 << 16
#: Documents' forms of a block that hold a rare token, at most.
RARE = 8
#: Mean tokens of a block's forms of documents above which its forms are compared as they are.
LONG = 32
#: What a text is compared by.
LABELS = ["tag_key", "type_key", "tokens"]
#: Scores from which a document counts as seen, and from which it matches when few or many were seen.
SEEN, FLOOR, RAISED, MANY = 0.20, 0.55, 0.60, 15


def labelled(df: DataFrame, text: str, rules: str = "history") -> DataFrame:
    """LABELS of a text column, for blank texts too."""
    stop = lx.STOP_WORDS_HISTORY if rules == "history" else lx.STOP_WORDS_BANK
    tagged = with_feature_tags(df, text, rules, "tags")
    return tagged.withColumn("tag_key", F.array_join("tags", ",")).withColumn("tokens", tx.tokens(F.col(text), stop)).drop("tags")


def prepare(df: DataFrame, text: str, rules: str = "history") -> DataFrame:
    """Tags, type key and content tokens of a text column; blank texts drop out."""
    return labelled(df.where(strip(F.col(text)) != ""), text, rules)


def _hashed(df: DataFrame) -> list[Column]:
    """The columns that the score is made of."""
    tags = F.array_remove(F.split("tag_key", ","), "")
    narrow = dict(df.dtypes).get("embedding") == "array<float>"
    vector = F.col("embedding").cast("array<float>" if narrow else "array<double>") if "embedding" in df.columns else F.lit(None).cast("array<double>")
    return [
        F.transform(tags, lambda t: F.xxhash64(t)).alias("tags"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"),
        F.xxhash64("type_key").alias("kind"), vector.alias("vector"),
    ]


class _Index(NamedTuple):
    """The sets of one side by value: each value's first place among the owners, the end, and how many sets there are."""

    values: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray


def _index(sets: list[np.ndarray]) -> _Index:
    sizes = np.array([len(x) for x in sets], np.int64)
    values = np.concatenate([np.empty(0, np.int64), *sets]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    values, first = np.unique(values[order], return_index=True)
    return _Index(values, np.append(first, len(order)), np.repeat(np.arange(len(sets)), sizes)[order], sizes)


def _shared(a: list[np.ndarray], b: list[np.ndarray] | _Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of all intersections of the sets of both sides, and of the sets."""
    index = b if isinstance(b, _Index) else _index(b)
    count, last = len(index.sizes), len(index.values) - 1
    out = np.zeros((len(a), count))
    for k, own in enumerate(a):
        place = np.minimum(np.searchsorted(index.values, own), last)
        place = place[index.values[place] == own] if last >= 0 else place[:0]
        low, size = index.starts[place], index.starts[place + 1] - index.starts[place]
        ends = np.cumsum(size)
        at = np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        out[k] = np.bincount(index.owners[at], minlength=count)
    return out, np.array([len(x) for x in a])[:, None], index.sizes[None]


def _jaccard(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Jaccard of all pairs, 0 where a side is empty; and the sizes of the sets."""
    both, left, right = _shared(a, b)
    return _shares(both, left, right), left, right


def _cosine(a: pd.Series, b: pd.Series) -> np.ndarray | None:
    """Cosine of all pairs, 0 for a vector of zeros, NaN where a side has none; None if no pair has two."""

    def side(column: pd.Series):
        has = np.array([v is not None and len(v) > 0 for v in column], bool)
        if not has.any():
            return None
        known = [np.asarray(v, float) for v, h in zip(column, has, strict=True) if h]
        width = max(len(v) for v in known)
        rows = np.full((len(column), width), np.nan)
        rows[has] = np.stack([v if len(v) == width else np.pad(v, (0, width - len(v)), constant_values=np.nan) for v in known])
        length = np.sqrt((rows * rows).sum(1, keepdims=True))
        return np.where(length == 0, 0.0, rows / np.where(length == 0, 1.0, length))

    x, y = side(a), side(b)
    return None if x is None or y is None else x @ y.T


def _shares(both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    union = left + right - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def scores(a: pd.DataFrame, b: pd.DataFrame, index: _Index | None = None) -> np.ndarray:
    """J7 for all pairs of two parts with the columns of ``_hashed``: a row per target, a column per document.

    Layers that a pair lacks hand their weight to the others; a type mismatch keeps 45 %. Where a side has a column ``size``,
    it counts for the number of tokens, of which ``tokens`` may then hold some only. ``index`` is that of ``b``'s tokens.
    """
    lexical, left, right = _shared(list(a["tokens"]), list(b["tokens"]) if index is None else index)
    if "size" in a:
        left, right = a["size"].to_numpy()[:, None], b["size"].to_numpy()[None]
    lexical = _shares(lexical, left, right)
    feature, left, right = _jaccard(list(a["tags"]), list(b["tags"]))
    mismatch = (left > 0) & (right > 0) & (a["kind"].to_numpy()[:, None] != b["kind"].to_numpy()[None])
    tagged = (left > 0) | (right > 0)
    feature = np.where(mismatch, feature * 0.3, feature)
    total = np.where(tagged, 0.55 * feature + 0.45 * lexical, lexical)
    cosine = _cosine(a["vector"], b["vector"])
    if cosine is not None:
        by_vector, by_feature, by_text = WITH_VECTORS
        layered = np.where(tagged, by_vector * cosine + by_feature * feature + by_text * lexical, 0.75 * cosine + 0.25 * lexical)
        total = np.where(np.isnan(cosine), total, layered)
    return np.clip(np.where(mismatch, total * 0.45, total), 0.0, 1.0)


def _parts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, most: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``i`` and ``j``: every part of a group of the left meets every part of it on the right, in one place.

    ``most`` are the rows of a part of either side, about.
    """
    targets, documents = most or (TARGETS, DOCUMENTS)

    def counted(df: DataFrame, most: int, name: str) -> DataFrame:
        tokens = F.sum(F.size("tokens"))
        return df.groupBy("group").agg(F.greatest(F.floor((F.count("*") - 1) / most) + 1, F.floor(tokens / TOKENS) + 1).alias(name))

    shape = counted(left, targets, "n_i").join(counted(right, documents, "n_j"), "group")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(shape, "group").select("*", F.pmod(F.xxhash64(left_id), F.col("n_i")).alias("i"), every("n_j").alias("j"))
    b = right.join(shape, "group").select("*", every("n_i").alias("i"), F.pmod(F.xxhash64(right_id), F.col("n_j")).alias("j"))
    return a.drop("n_i", "n_j"), b.drop("n_i", "n_j")


def _units(column: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    """Vectors at length one, and which of them have no length."""
    known = [np.empty(0) if v is None else np.asarray(v, float) for v in column]
    length = np.array([np.sqrt((v * v).sum()) for v in known])
    return [v / n if n != 0 else v for v, n in zip(known, length, strict=True)], length == 0


def cosines(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """J6 of all pairs of different ids: (query_id, vec_id, cosine).

    ``asked``: query_id, embedding. ``vectors``: vec_id, embedding. Both sides are cut into parts, and a task multiplies one
    part with one part. 0 where a vector is null, holds a null or is all zeros; null where the numbers of components differ.
    """
    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding")).alias("embedding")
    n_i, n_j = (max(0, df.count() - 1) // most + 1 for df, most in ((asked, QUERIES), (vectors, VECTORS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.where("query_id is not null").select("query_id", whole, F.pmod(F.xxhash64("query_id"), F.lit(n_i)).cast("int").alias("i"), every(n_j).alias("j"))
    b = vectors.where("vec_id is not null").select("vec_id", whole, every(n_i).alias("i"), F.pmod(F.xxhash64("vec_id"), F.lit(n_j)).cast("int").alias("j"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["query_id", "vec_id", "cosine"])
        (left, none_left), (right, none_right) = _units(x["embedding"]), _units(y["embedding"])
        sizes = np.array([len(v) for v in left]), np.array([len(v) for v in right])
        out = np.full((len(x), len(y)), np.nan)
        for n in np.intersect1d(*sizes):
            p, q = (np.flatnonzero(s == n) for s in sizes)
            out[np.ix_(p, q)] = np.stack([left[k] for k in p]) @ np.stack([right[k] for k in q]).T
        out[none_left[:, None] | none_right[None]] = 0.0
        p, q = np.nonzero(x["query_id"].to_numpy()[:, None] != y["vec_id"].to_numpy()[None])
        return pd.DataFrame({"query_id": x["query_id"].to_numpy()[p], "vec_id": y["vec_id"].to_numpy()[q], "cosine": out[p, q]})

    schema = f"query_id {dict(asked.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, cosine double"
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(compare, schema)


def _rounded(values: np.ndarray) -> np.ndarray:
    """:func:`basics.rounded` to six decimals; values near a half go through ten decimals one by one."""
    scaled = values * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 2e-4
    if near.any():
        known, place = np.unique(values[near], return_inverse=True)
        halves = [Decimal(repr(float(v))).quantize(Decimal("1e-10"), ROUND_HALF_UP).quantize(Decimal("1e-6"), ROUND_HALF_UP) for v in known]
        out[near] = np.array(halves, float)[place]
    return out


def _vector_layer(x: pd.Series, y: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """J6 of all pairs, and which of them have one: 0 for None (a vector with a null) or zeros, none where the sizes differ."""
    left, right = ([None if v is None else np.asarray(v, float) for v in side] for side in (x, y))
    with np.errstate(all="ignore"):
        length = np.outer(*(np.array([0.0 if v is None else np.sqrt((v * v).sum()) for v in side]) for side in (left, right)))
        sizes = [np.array([-1 if v is None else len(v) for v in side]) for side in (left, right)]
        dots = np.full(length.shape, np.nan)
        for n in np.intersect1d(*sizes):
            p, q = (np.flatnonzero(s == n) for s in sizes)
            if n >= 0:
                dots[np.ix_(p, q)] = np.stack([left[k] for k in p]) @ np.stack([right[k] for k in q]).T
        none = (sizes[0] < 0)[:, None] | (sizes[1] < 0)[None] | (length == 0)
        return np.where(none, 0.0, dots / length), none | (sizes[0][:, None] == sizes[1][None])


def _hybrid(lexical: np.ndarray, feature: np.ndarray, mismatch: np.ndarray, cosine: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """J7 to six decimals, as :func:`pairs.hybrid` has it; ``known`` says which pairs have a cosine."""
    tagged = feature >= 0
    total = np.where(tagged, 0.55 * feature + 0.45 * lexical, lexical)
    if cosine is not None:
        by_vector, by_feature, by_text = WITH_VECTORS
        layered = np.where(tagged, by_vector * cosine + by_feature * feature + by_text * lexical, 0.75 * cosine + 0.25 * lexical)
        total = np.where(known, layered, total)
    total = np.where(mismatch, total * 0.45, total)
    # NaN is the largest number to Spark
    return _rounded(np.where(np.isnan(total), 1.0, np.clip(total, 0.0, 1.0)))


def _compared(x: pd.DataFrame, y: pd.DataFrame) -> list[np.ndarray]:
    """id, other_id, lexical, feature, type_mismatch, hybrid of all pairs of different ids of two parts."""
    p, q = (pd.factorize(side["form"])[0] for side in (x, y))
    a, b = (side.iloc[np.unique(codes, return_index=True)[1]] for side, codes in ((x, p), (y, q)))
    lexical, _, _ = _jaccard(list(a["tokens"]), list(b["tokens"]))
    # rows share few sets of tags
    (r, c), (ka, kb) = zip(*(_kinds(side) for side in (a, b)), strict=True)
    base, left, right = _jaccard(list(ka["tags"]), list(kb["tags"]))
    mismatch = (left > 0) & (right > 0) & (ka["kind"].to_numpy()[:, None] != kb["kind"].to_numpy()[None])
    feature = np.where((left > 0) | (right > 0), np.where(mismatch, base * 0.3, base), -1.0)
    feature, mismatch = (v.take(c, axis=1).take(r, axis=0) for v in (feature, mismatch))
    every = lambda v: v.take(q, axis=1).take(p, axis=0)
    hybrid_scores = every(_hybrid(lexical, feature, mismatch))
    both = [np.flatnonzero(side["vectored"]) for side in (x, y)]
    if len(both[0]) and len(both[1]):
        layers = [v[np.ix_(p[both[0]], q[both[1]])] for v in (lexical, feature, mismatch)]
        hybrid_scores[np.ix_(*both)] = _hybrid(*layers, *_vector_layer(*(side["vector"].iloc[k] for side, k in zip((x, y), both, strict=True))))
    own, other = x["id"].to_numpy(), y["other_id"].to_numpy()
    made = [
        np.repeat(own, len(other)), np.tile(other, len(own)), every(_rounded(lexical)).ravel(), every(_rounded(feature)).ravel(),
        every(mismatch).ravel(), hybrid_scores.ravel(),
    ]
    if np.isin(own, other).any():
        others = np.flatnonzero(made[0] != made[1])
        made = [v[others] for v in made]
    return made


def pair_layers(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """J3-J7 of all pairs of different ids of a group, to six decimals: (id, other_id, lexical, feature, type_mismatch, hybrid).

    Both sides: group, tags, type_key, tokens, embedding, and id or other_id. Both sides of a group are cut into parts; a task
    compares one part with one part as arrays. The layers of tags and tokens are taken once per pair of different rows of a
    part, the vector layer for the pairs that both have a vector.
    """

    def side(df: DataFrame, key: str) -> DataFrame:
        ready = df.where(F.col(key).isNotNull()).select(
            key, "group", F.xxhash64("type_key").alias("kind"), F.transform("tags", lambda t: F.xxhash64(t)).alias("tags"),
            F.sort_array(F.transform(F.coalesce("tokens", F.expr("array()")), lambda t: F.xxhash64(t))).alias("tokens"),
            F.col("embedding").isNotNull().alias("vectored"), F.when(~F.exists("embedding", lambda v: v.isNull()), F.col("embedding")).alias("vector"),
        )
        return ready.withColumn("form", _digest(["kind", "tags", "tokens"]))

    names = ["lexical", "feature", "type_mismatch", "hybrid"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [left.schema.field("id"), right.schema.field("other_id"), *(pa.field(c, pa.bool_() if c == "type_mismatch" else pa.float64()) for c in names)]
        found = _compared(left.to_pandas(), right.to_pandas()) if len(left) and len(right) else [[]] * len(kinds)
        made = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(found, kinds, strict=True)], schema=pa.schema(kinds))
        return pa.Table.from_batches(made.to_batches(max_chunksize=ROWS), made.schema)

    a, b = durable(side(asked, "id")), durable(side(rows, "other_id"))
    schema = f"id {dict(a.dtypes)['id']}, other_id {dict(b.dtypes)['other_id']}, lexical double, feature double, type_mismatch boolean, hybrid double"
    a, b = _parts(a, b, "id", "other_id", (QUERIES, VECTORS))
    # few bytes, but much work each: partitions that AQE must not merge
    keys, n = ["group", "i", "j"], shuffle_width(asked.sparkSession)
    a, b = a.repartition(n, *keys), b.repartition(n, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(compare, schema)


# --- history matching ----------------------------------------------------------------------

FACTS = ["docs", "with_winner", "n", "total", "squares", "wins"]
SUMS = ["preliminary_count", *FACTS, "doc_similarity", "weight", "weighted_total"]
EXACT = "decimal(28,12)"
#: Places of the FACTS that are weighed by similarity: documents, scores and their totals.
WEIGHED = [FACTS.index(c) for c in ("docs", "n", "total")]
#: What forms and skeletons have in common besides their tokens.
KIND = ["group", "tags", "kind", "vectored"]
FORM, SKELETON = [*KIND, "tokens"], [*KIND, "common", "size"]


def _facts(documents: DataFrame, scored: DataFrame, techniques: list[str] | None, by_score: bool) -> DataFrame:
    """Rows (doc_id, technique, score and FACTS): the document itself (no technique), its winner, the sums of its scores.

    With ``by_score`` a row per different score instead of sums.
    """
    row = lambda technique, score="cast(null as double)", **facts: [
        f"{technique} as technique", f"{score} as score", *[f"cast({facts.get(c, 0)} as double) as {c}" for c in FACTS]
    ]
    own = documents.selectExpr("doc_id", *row("cast(null as string)", docs=1, with_winner="winner_technique is not null"))
    kept = scored.where("overall is not null")
    won = documents.where("winner_technique is not null")
    if techniques:
        kept, won = kept.where(F.col("technique").isin(*techniques)), won.where(F.col("winner_technique").isin(*techniques))
    if by_score:
        counted = kept.groupBy("doc_id", "technique", F.col("overall").cast("double").alias("overall")).agg(F.count("*").alias("n"))
        return own.unionByName(counted.selectExpr("doc_id", *row("technique", "overall", n="n")))
    value = F.col("overall").cast("decimal(18,10)")
    summed = kept.groupBy("doc_id", "technique").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"))
    winners = won.selectExpr("doc_id", *row("winner_technique", wins=1))
    return own.unionByName(winners).unionByName(summed.selectExpr("doc_id", *row("technique", n="n", total="total", squares="squares")))


def _digest(columns: list[str]) -> Column:
    """A 128-bit name of the values, so that arrays don't travel just to be compared."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary")))


def _with_facts(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` with ``facts``, the sums of the rows' facts: an entry per technique (and score)."""
    sums = rows.groupBy(key, "technique", "score").agg(*[F.sum(c).alias(c) for c in FACTS])
    return sums.groupBy(key).agg(F.collect_list(F.struct("technique", "score", *FACTS)).alias("facts"))


class Forms(NamedTuple):
    """What is compared: target_id -> a (form) -> s (skeleton); documents' forms b with facts; skeletons; met forms (a, b)."""

    targets: DataFrame
    of_targets: DataFrame
    of_documents: DataFrame
    skeletons: DataFrame
    document_skeletons: DataFrame
    met: DataFrame


def forms(goals: DataFrame, docs: DataFrame, facts: DataFrame) -> Forms:
    """Forms and skeletons of both sides, and the pairs of forms that have a rare token in common."""
    b = docs.select(F.col("form").alias("b"), *FORM).dropDuplicates(["b"])
    b = durable(b.join(_with_facts(docs.select("doc_id", F.col("form").alias("b")).join(facts, "doc_id"), "b"), "b"))
    a = durable(goals.select(F.col("form").alias("a"), *FORM).dropDuplicates(["a"]))
    targets = goals.select("target_id", F.col("form").alias("a"))

    # long natural texts differ in more than their rare tokens: their forms are skeletons, without an index of tokens
    long = durable(b.groupBy("group").agg(F.avg(F.size("tokens")).alias("n")).where(F.col("n") > LONG).select("group"))
    whole = {name: df.join(long, "group", "left_semi") for name, df in (("a", a), ("b", b))}
    a, b = a.join(long, "group", "left_anti"), b.join(long, "group", "left_anti")
    postings = {name: df.select("group", name, F.explode("tokens").alias("token")) for name, df in (("a", a), ("b", b))}
    held = durable(postings["b"].groupBy("group", "token").agg(F.count("*").alias("n")))
    rare, common = held.where(F.col("n") <= RARE), held.where(F.col("n") > RARE)

    def parted(df: DataFrame, name: str) -> DataFrame:
        shared = postings[name].join(common, ["group", "token"], "left_semi").groupBy(name).agg(F.sort_array(F.collect_list("token")).alias("common"))
        made = df.join(shared, name, "left").withColumns({"common": F.coalesce("common", F.expr("cast(array() as array<bigint>)")), "size": F.size("tokens")}).drop("tokens")
        return durable(made.withColumn("s", _digest(SKELETON)))

    # their rows are stored already and need no second grouping
    long_a, long_b = (df.withColumnRenamed("tokens", "common").withColumns({"size": F.size("common"), "s": F.col(name)}) for name, df in whole.items())
    a, b = parted(a, "a"), parted(b, "b").withColumnRenamed("s", "d")
    skeletons = durable(a.select("s", *SKELETON).dropDuplicates(["s"])).unionByName(long_a.select("s", *SKELETON))
    of_skeletons = _with_facts(b.select("d", F.explode("facts").alias("f")).select("d", "f.*"), "d")
    of_skeletons = durable(b.select("d", *SKELETON).dropDuplicates(["d"]).join(of_skeletons, "d"))
    of_skeletons = of_skeletons.unionByName(long_b.withColumnRenamed("s", "d").select(*of_skeletons.columns))
    a, b = a.unionByName(long_a), b.unionByName(long_b.withColumnRenamed("s", "d"))
    met = postings["a"].join(rare, ["group", "token"], "left_semi").join(postings["b"].join(rare, ["group", "token"], "left_semi"), ["group", "token"])
    return Forms(targets, a, b, skeletons, of_skeletons, met.groupBy("a", "b").agg(F.count("*").alias("shared")))


def _named(facts: list) -> tuple[list, np.ndarray]:
    """The techniques (and scores) of the documents of a part, and their FACTS by document and technique."""
    names = sorted({(f["technique"], f["score"]) for fs in facts for f in fs if f["technique"] is not None}, key=repr)
    place = {name: k for k, name in enumerate([None, *names])}
    out = np.zeros((len(FACTS), len(facts), len(place)))
    for k, fs in enumerate(facts):
        for f in fs:
            out[:, k, place[None if f["technique"] is None else (f["technique"], f["score"])]] = [f[c] for c in FACTS]
    return names, out


class _Near:
    """The pairs of two parts without vectors that may reach SEEN or a limit, and the sums over them.

    Of rows with equal tags and type the tag layer is known, so a score follows from the token layer, and a limit from a least
    number of common tokens. Tokens that many documents have are counted by a matrix product, others by their places in an
    index; pairs below their least number get no score. Rows are taken by size, so that documents too small or too large for
    a step's targets are left out before anything is counted.
    """

    def __init__(self, a: pd.DataFrame, b: pd.DataFrame, limits: tuple[float, ...], masked: bool):
        self.limits = limits
        self.code_a, kinds_a = _kinds(a)
        code_b, kinds_b = _kinds(b)
        size = lambda df: (df["size"] if "size" in df else df["tokens"].map(len)).to_numpy(np.float64)
        vectored_a, vectored_b = (df["vectored"].to_numpy(bool) & masked for df in (a, b))
        # a target's group is its tags and type, and whether pairs with vectors are left out
        self.code_a = self.code_a * 2 + vectored_a
        self.rows = np.lexsort((size(a), self.code_a))
        self.order = np.argsort(size(b), kind="stable")
        self.sizes_a, self.sizes_b = size(a)[self.rows], size(b)[self.order]
        self.code_a, self.code_b, self.out_b = self.code_a[self.rows], code_b[self.order], vectored_b[self.order]
        base, left, right = _jaccard(list(kinds_a["tags"]), list(kinds_b["tags"]))
        self.mismatch = (left > 0) & (right > 0) & (kinds_a["kind"].to_numpy()[:, None] != kinds_b["kind"].to_numpy()[None])
        self.tagged = (left > 0) | (right > 0)
        self.feature = np.where(self.mismatch, base * 0.3, base)
        self.tokens = [a["tokens"].iloc[k] for k in self.rows]
        self.index = _index([b["tokens"].iloc[k] for k in self.order])
        often = np.flatnonzero(np.diff(self.index.starts) > max(1, len(b) * OFTEN))
        often = often[np.argsort(-np.diff(self.index.starts)[often], kind="stable")[:COLUMNS]]
        self.column = np.full(len(self.index.values), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(b), len(often)), np.float32)
        for k, v in enumerate(often):
            self.matrix[:, k] = np.bincount(self.index.owners[self.index.starts[v] : self.index.starts[v + 1]], minlength=len(b))

    def _score(self, lexical: np.ndarray, feature: np.ndarray, tagged: np.ndarray, mismatch: np.ndarray) -> np.ndarray:
        total = np.where(tagged, 0.55 * feature + 0.45 * lexical, lexical)
        return np.clip(np.where(mismatch, total * 0.45, total), 0.0, 1.0)

    def _least(self, own: int, limit: float) -> np.ndarray:
        """The token layer from which documents reach the limit with targets of this group, about; never too high."""
        layers = self.feature[own], self.tagged[own], self.mismatch[own]
        free, top = (self._score(np.full(len(layers[0]), x), *layers) for x in (0.0, 1.0))
        slope = np.where(layers[1], 0.45, 1.0) * np.where(layers[2], 0.45, 1.0)
        return np.where(free >= limit, 0.0, np.where(top < limit, np.inf, np.maximum((limit - free) / slope - 1e-9, 0.0)))

    def _common(self, begin: int, end: int, low: int, high: int) -> np.ndarray:
        """Common tokens of the targets with the documents from low to high."""
        own = self.tokens[begin:end]
        sizes = np.array([len(t) for t in own], np.int64)
        values = np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64)
        last = len(self.index.values) - 1
        place = np.minimum(np.searchsorted(self.index.values, values), last)
        known = self.index.values[place] == values if last >= 0 else np.zeros(len(values), bool)
        row, place = np.repeat(np.arange(len(own)), sizes)[known], place[known]
        column = self.column[place] if last >= 0 else place
        width = self.matrix.shape[1]
        some = column >= 0
        counted = np.bincount(row[some] * width + column[some], minlength=len(own) * width).reshape(len(own), width)
        out = counted.astype(np.float32) @ self.matrix[low:high].T
        row, place = row[~some], place[~some]
        edges = np.searchsorted(row, np.arange(len(own) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own_place = place[edges[k] : edges[k + 1]]
            first, size = self.index.starts[own_place], self.index.starts[own_place + 1] - self.index.starts[own_place]
            ends = np.cumsum(size)
            at = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
            out[k] += np.bincount(self.index.owners[at], minlength=len(self.order))[low:high]
        return out

    def sums(self, begin: int, end: int, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many documents the targets see, and per limit their FACTS and those that similarity weighs."""
        facts = facts[:, self.order]
        names = facts.shape[2]
        seen = np.zeros(end - begin)
        met, weighted = np.zeros((len(self.limits), len(FACTS), end - begin, names)), np.zeros((len(self.limits), len(WEIGHED), end - begin, names))
        begins = begin + np.flatnonzero(np.r_[True, np.diff(self.code_a[begin:end]) != 0])
        for first, last in zip(begins, [*begins[1:], end], strict=True):
            own, masked = divmod(int(self.code_a[first]), 2)
            out = self.out_b if masked else np.zeros(len(self.order), bool)
            sure = (self._least(own, SEEN) == 0)[self.code_b] & ~out
            # documents seen without a common token need a score only if they may match
            least = np.where(self._least(own, SEEN) == 0, self._least(own, min(self.limits)), np.minimum(self._least(own, SEEN), self._least(own, min(self.limits))))
            least = np.where(out, np.inf, least[self.code_b])
            seen[first - begin : last - begin] = facts[0][sure, 0].sum()
            if not np.isfinite(least).any():
                continue
            smallest = least.min()
            at, step = first, max(1, PAIRS // len(self.order))
            while at < last:
                to = min(at + step, last)
                low, high = 0, len(self.order)
                if smallest > 0:
                    low = int(np.searchsorted(self.sizes_b, self.sizes_a[at] * smallest * (1 - 1e-9), "left"))
                    high = int(np.searchsorted(self.sizes_b, self.sizes_a[to - 1] / smallest * (1 + 1e-9), "right"))
                if low < high:
                    self._add(at, to, low, high, own, least[low:high], sure[low:high], facts[:, low:high], seen[at - begin : to - begin], met[:, :, at - begin : to - begin], weighted[:, :, at - begin : to - begin])
                at = to
        return seen, met, weighted

    def _add(self, at: int, to: int, low: int, high: int, own: int, least: np.ndarray, sure: np.ndarray, facts: np.ndarray, seen: np.ndarray, met: np.ndarray, weighted: np.ndarray) -> None:
        """Adds what the targets from at to to find among the documents from low to high."""
        common = self._common(at, to, low, high)
        share = np.where(np.isfinite(least), least / (1 + np.where(np.isfinite(least), least, 0.0)), 0.0)
        bound = np.multiply.outer(self.sizes_a[at:to].astype(np.float32), share.astype(np.float32))
        # whole numbers are compared: the slack covers the rounding of sizes up to some millions
        bound += np.where(np.isfinite(least), share * self.sizes_b[low:high] - 0.5, np.inf).astype(np.float32)
        row, spot = np.nonzero(common >= bound)
        both = common[row, spot].astype(np.float64)
        kind = self.code_b[low:high][spot]
        lexical = _shares(both, self.sizes_a[at:to][row], self.sizes_b[low:high][spot])
        found = self._score(lexical, self.feature[own][kind], self.tagged[own][kind], self.mismatch[own][kind])
        new = (found >= SEEN) & ~sure[spot]
        seen += np.bincount(row[new], weights=facts[0][spot[new], 0], minlength=to - at)
        for level, limit in enumerate(self.limits):
            hit = found >= limit
            r, c, v = row[hit], spot[hit], found[hit]
            if not len(r):
                continue
            if len(r) * 16 > common.size:
                weight = np.zeros(common.shape)
                weight[r, c] = v
                hits = np.zeros(common.shape)
                hits[r, c] = 1.0
                for k in range(len(FACTS)):
                    met[level, k] += hits @ facts[k]
                for k, f in enumerate(WEIGHED):
                    weighted[level, k] += weight @ facts[f]
                continue
            edge = np.flatnonzero(np.diff(r, prepend=-1))
            for k in range(len(FACTS)):
                met[level, k][r[edge]] += np.add.reduceat(facts[k][c], edge, axis=0)
            for k, f in enumerate(WEIGHED):
                weighted[level, k][r[edge]] += np.add.reduceat(facts[f][c] * v[:, None], edge, axis=0)


def _summed(left: DataFrame, right: DataFrame, left_id: str, right_id: str, limits: tuple[float, float], masked: bool) -> DataFrame:
    """Rows (left_id, level, technique, score, SUMS) over the documents that reach each limit, part by part.

    With ``masked`` pairs of rows that both have a vector are left out.
    """
    columns = [left_id, "level", "technique", "score", *SUMS]

    def rows_of(ids: np.ndarray, names: list, seen: np.ndarray, met: np.ndarray, weighted: np.ndarray) -> list[pd.DataFrame]:
        """``met``: level x FACTS x rows x names; ``weighted``: similarity times the documents, scores and their totals."""
        out = []
        for level in range(len(limits)):
            sums = dict(zip(FACTS, met[level], strict=True))
            near, heavy, heavy_total = weighted[level]
            for k, name in enumerate([None, *names]):
                own = name is None
                rows = np.arange(len(ids)) if own else np.flatnonzero((sums["n"][:, k] > 0) | (sums["wins"][:, k] > 0))
                made = {c: sums[c][rows, k] for c in FACTS}
                out.append(pd.DataFrame({
                    left_id: ids[rows], "level": level, "technique": None if own else name[0], "score": None if own else name[1],
                    "preliminary_count": seen[rows] if own else 0.0, **made, "doc_similarity": near[rows, 0] if own else 0.0,
                    "weight": heavy[rows, k], "weighted_total": heavy_total[rows, k],
                }))
        return out

    def every_pair(a: pd.DataFrame, b: pd.DataFrame, names: list, facts: np.ndarray) -> list[pd.DataFrame]:
        """All scores of the pairs, for rows with vectors."""
        index, out = _index(list(b["tokens"])), []
        step = max(1, PAIRS // len(b))
        for k in range(0, len(a), step):
            some = a.iloc[k : k + step]
            found = scores(some, b, index)
            if masked:
                found[some["vectored"].to_numpy(bool)[:, None] & b["vectored"].to_numpy(bool)[None]] = -1.0
            hits = [(found >= limit).astype(float) for limit in limits]
            met = np.array([[hit @ f for f in facts] for hit in hits])
            weighted = np.array([[(hit * found) @ facts[c] for c in WEIGHED] for hit in hits])
            out += rows_of(some[left_id].to_numpy(), names, (found >= SEEN) @ facts[0][:, 0], met, weighted)
        return out

    def near_pairs(a: pd.DataFrame, b: pd.DataFrame, names: list, facts: np.ndarray) -> list[pd.DataFrame]:
        """The same without vectors, where only pairs that may reach a limit get a score."""
        near, out = _Near(a, b, limits, masked), []
        slab = max(1, SLAB // facts[:, 0].size)
        for k in range(0, len(a), slab):
            rows = near.rows[k : k + slab]
            out += rows_of(a[left_id].to_numpy()[rows], names, *near.sums(k, k + len(rows), facts))
        return out

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=columns)
        names, facts = _named(list(b["facts"]))
        vectors = a["vector"].notna().any() and b["vector"].notna().any()
        out = (every_pair if vectors else near_pairs)(a, b, names, facts)
        made = pd.concat([x for x in out if len(x)], ignore_index=True)[columns]
        made["score"] = made["score"].astype(object).where(made["score"].notna(), None)
        return made

    a, b = _parts(left, right, left_id, right_id)
    keys = ["group", "i", "j"]
    schema = f"{left_id} {dict(left.dtypes)[left_id]}, level int, technique string, score double, " + ", ".join(f"{c} double" for c in SUMS)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(compare, schema)


def _corrections(found: Forms, limits: tuple[float, float]) -> DataFrame:
    """Rows (a, level, technique, score, SUMS): what the forms' true scores change against those of their skeletons."""
    left = found.of_targets.select("a", *[F.col(c).alias(f"a_{c}") for c in SKELETON])
    right = found.of_documents.select("b", "facts", *[F.col(c).alias(f"b_{c}") for c in SKELETON])
    pairs = found.met.join(left, "a").join(right, "b").where("not (a_vectored and b_vectored)")
    keys = (F.col("a_tags"), F.col("b_tags"), F.col("a_kind"), F.col("b_kind"))
    pairs = pairs.withColumns({"_both": F.size(F.array_intersect("a_common", "b_common")), "_feature": feature_similarity(*keys), "_mismatch": type_mismatch(*keys)})
    score = lambda both: hybrid(jaccard_counts(both, F.col("a_size"), F.col("b_size")), F.col("_feature"), F.col("_mismatch"))
    pairs = pairs.withColumns({"_was": score(F.col("_both")), "_is": score(F.col("_both") + F.col("shared"))})
    change = lambda limit: (F.col("_is") >= limit).cast("double") - (F.col("_was") >= limit).cast("double")
    weight = lambda limit: F.when(F.col("_is") >= limit, F.col("_is")).otherwise(0.0) - F.when(F.col("_was") >= limit, F.col("_was")).otherwise(0.0)
    levels = [F.struct(F.lit(k).alias("level"), change(SEEN).alias("seen"), change(x).alias("hit"), weight(x).alias("weight")) for k, x in enumerate(limits)]
    pairs = pairs.select("a", "facts", F.explode(F.array(*levels)).alias("l")).where("l.seen <> 0 or l.hit <> 0 or l.weight <> 0")
    rows = pairs.select("a", "l.*", F.explode("facts").alias("f"))
    own = F.col("f.technique").isNull()
    return rows.select(
        "a", "level", "f.technique", "f.score", F.when(own, F.col("seen") * F.col("f.docs")).otherwise(0.0).alias("preliminary_count"),
        *[(F.col("hit") * F.col(f"f.{c}")).alias(c) for c in FACTS], F.when(own, F.col("weight") * F.col("f.docs")).otherwise(0.0).alias("doc_similarity"),
        (F.col("weight") * F.col("f.n")).alias("weight"), (F.col("weight") * F.col("f.total")).alias("weighted_total"),
    )


def _sides(targets: DataFrame, documents: DataFrame, require_ground_truth: bool, allow_unknown: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with their block as ``group``, tags, kind, tokens, vector and ``vectored``; stored."""
    block = F.to_json(F.struct("domain", "difficulty"))
    known = lambda df: df.where(strip(F.col("problem")) != "") if set(LABELS) <= set(df.columns) else prepare(df, "problem")
    docs, goals = known(usable(documents, require_ground_truth, allow_unknown)), known(targets)
    vectors = "embedding" in targets.columns and "embedding" in documents.columns
    vectored = (F.coalesce(F.size("vector"), F.lit(0)) > 0) if vectors else F.lit(False)
    docs = docs.select("doc_id", "winner_technique", block.alias("group"), *_hashed(docs)).withColumn("vectored", vectored)
    goals = goals.select("target_id", block.alias("group"), *_hashed(goals)).withColumn("vectored", vectored)
    return durable(goals.withColumn("form", _digest(FORM))), durable(docs.withColumn("form", _digest(FORM)))


def match_work(targets: DataFrame, documents: DataFrame, scored: DataFrame, require_ground_truth: bool = False, allow_unknown: bool = False) -> dict[str, int]:
    """What :func:`match_history` compares without vectors: pairs of rows, of forms and of skeletons in a block, and met forms."""
    goals, docs = _sides(targets, documents, require_ground_truth, allow_unknown)
    found = forms(goals, docs, _facts(docs, scored, None, False))

    def pairs(left: DataFrame, right: DataFrame) -> int:
        sizes = left.groupBy("group").agg(F.count("*").alias("x")).join(right.groupBy("group").agg(F.count("*").alias("y")), "group")
        return sizes.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]

    return {
        "rows": goals.count() + docs.count(), "pairs_of_rows": pairs(goals, docs), "pairs_of_forms": pairs(found.of_targets, found.of_documents),
        "pairs_of_skeletons": pairs(found.skeletons, found.document_skeletons), "met_forms": found.met.count(),
    }


def match_history(
    targets: DataFrame,
    documents: DataFrame,
    scored: DataFrame,
    techniques: list[str] | None = None,
    min_similarity: float = 0.35,
    respect_min: bool = False,
    by_score: bool = False,
    require_ground_truth: bool = False,
    allow_unknown: bool = False,
) -> DataFrame:
    """Sums over the history documents similar to each target.

    ``targets``: target_id, domain, difficulty, problem. ``documents``: doc_id,
    domain, difficulty, problem, winner_technique and, where ground truth is
    required, has_ground_truth. ``scored``: doc_id, technique, overall. Where
    both sides have an ``embedding`` the score has its vector layer; a side with
    the columns of :func:`labelled` is not labelled again. One row per
    (target, technique), technique null for the document totals; with
    ``by_score`` also per single score.
    """
    goals, docs = _sides(targets, documents, require_ground_truth, allow_unknown)
    facts = _facts(docs, scored, techniques, by_score)
    limits = (FLOOR, RAISED)
    if respect_min:
        limits = tuple(max(x, min_similarity) for x in limits)
    exact = lambda df, key: df.select(key, "level", "technique", "score", *[F.col(c).cast(EXACT).alias(c) for c in SUMS])

    found = forms(goals, docs, facts)
    left = found.skeletons.withColumn("vector", F.lit(None).cast("array<double>")).withColumnRenamed("common", "tokens")
    right = found.document_skeletons.withColumn("vector", F.lit(None).cast("array<double>")).withColumnRenamed("common", "tokens")
    by_skeleton = exact(_summed(left, right, "s", "d", limits, True), "s").groupBy("s", "level", "technique", "score").agg(*[F.sum(c).alias(c) for c in SUMS])
    by_form = found.of_targets.select("a", "s").join(by_skeleton, "s").drop("s").unionByName(exact(_corrections(found, limits), "a"))
    by_form = by_form.groupBy("a", "level", "technique", "score").agg(*[F.sum(c).cast(EXACT).alias(c) for c in SUMS])
    whole = found.targets.join(by_form, "a").drop("a")
    if "embedding" in targets.columns and "embedding" in documents.columns:
        single = _with_facts(docs.where("vectored").select("doc_id").join(facts, "doc_id"), "doc_id").join(docs.drop("winner_technique", "form"), "doc_id")
        both = exact(_summed(goals.where("vectored").drop("form"), single, "target_id", "doc_id", limits, False), "target_id")
        whole = whole.unionByName(both).groupBy("target_id", "level", "technique", "score").agg(*[F.sum(c).alias(c) for c in SUMS])
    whole = durable(whole.where("technique is null or n > 0 or wins > 0"))

    seen = whole.where("technique is null and level = 0").select("target_id", F.col("preliminary_count").cast("long").alias("_seen"))
    count = F.coalesce("_seen", F.lit(0).cast("long"))
    raised = F.when(count > MANY, RAISED).when(count > 0, FLOOR).otherwise(max(min_similarity, FLOOR))
    if respect_min:
        raised = F.greatest(raised, F.lit(min_similarity))
    named = goals.select("target_id").join(seen, "target_id", "left").select("target_id", count.alias("preliminary_count"), raised.alias("threshold"), (count > MANY).cast("int").alias("level"))
    made = named.join(whole.drop("preliminary_count"), ["target_id", "level"], "left").drop("level")
    return made.withColumns({c: F.col(c).cast("long") for c in ("docs", "with_winner", "n", "wins")})


def match_summary(matches: DataFrame) -> DataFrame:
    """Matched documents, their average similarity, preliminary count and threshold per target."""
    own = F.col("technique").isNull()
    return matches.groupBy("target_id").agg(
        F.max("preliminary_count").alias("preliminary_count"),
        F.max("threshold").alias("threshold"),
        F.coalesce(F.max(F.when(own, F.col("docs"))), F.lit(0)).alias("matched_documents"),
        rounded(F.coalesce(F.try_divide(F.max(F.when(own, F.col("doc_similarity").cast("double"))), F.max(F.when(own, F.col("docs")))), F.lit(0.0)), 4).alias("average_similarity"),
        F.coalesce(F.max(F.when(own, F.col("with_winner"))), F.lit(0)).alias("total_with_winner"),
    )


def profile_ranking(matches: DataFrame) -> DataFrame:
    """A10: techniques of each target by similarity-weighted average.

    Variance comes from exact sums. The single scores are available as counted
    rows through ``match_history(..., by_score=True)``.
    """
    winners = matches.where("technique is null").select("target_id", F.col("with_winner").alias("_with_winner"))
    n, total, squares = F.col("n"), F.col("total").cast("double"), F.col("squares").cast("double")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), F.try_divide(squares - total * total / n, n - 1))).otherwise(0.0)
    made = matches.where("technique is not null and n > 0").join(winners, "target_id", "left").withColumns({
        "_var": variance, "_std": F.sqrt(variance),
        "simple_average": rounded(total / n, 4),
        "average_overall": rounded(F.try_divide(F.col("weighted_total").cast("double"), F.col("weight").cast("double")), 4),
        "effective_samples": rounded(F.col("weight").cast("double"), 2),
    })
    place = Window.partitionBy("target_id").orderBy(F.desc("average_overall"), F.desc("effective_samples"), "technique")
    return made.select(
        "target_id", "technique", "simple_average", "average_overall", F.col("n").cast("long").alias("samples"), "effective_samples",
        rounded(F.col("_std"), 4).alias("std_dev"),
        rounded(F.col("_var"), 4).alias("variance"),
        F.when(F.col("_std") < 0.08, "high").when(F.col("_std") < 0.15, "medium").otherwise("low").alias("confidence"),
        rounded(F.greatest(F.lit(0.0), 1.0 - F.col("_std")), 4).alias("consistency"),
        F.col("wins").cast("long").alias("wins"),
        rounded(F.coalesce(F.try_divide(F.col("wins"), F.col("_with_winner")), F.lit(0.0)), 4).alias("win_rate"),
        F.row_number().over(place).alias("rank"),
    )


# --- nearest documents ---------------------------------------------------------------------------

def _kinds(rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """Rows with equal tags and type: the number of each row's group, and one row per group."""
    codes, _ = pd.factorize(pd.Series([(k, *sorted(t)) for k, t in zip(rows["kind"], rows["tags"], strict=True)], dtype=object))
    first = np.unique(codes, return_index=True)[1]
    return codes, rows.iloc[first][["tags", "kind"]]


def _length(tokens: pd.Series) -> np.ndarray:
    return np.array([len(t) for t in tokens], float)


def _first(every: np.ndarray, spot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest values (ties: the smaller spot) and their spots, in this order; only rows' own candidates are sorted."""
    if every.shape[1] > 4 * k:
        least = np.partition(every, every.shape[1] - k, axis=1)[:, every.shape[1] - k, None]
        row, column = np.nonzero(every >= least)
        value, at = every[row, column], spot[row, column]
        order = np.lexsort((at, -value, row))
        begins = np.searchsorted(row[order], np.arange(len(every)))
        order = order[begins[:, None] + np.arange(k)]
        return value[order], at[order]
    order = np.lexsort((spot, -every), axis=1)[:, :k]
    return np.take_along_axis(every, order, 1), np.take_along_axis(spot, order, 1)


def best(a: pd.DataFrame, b: pd.DataFrame, k: int, out: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``a`` the k rows of ``b`` with the highest scores (ties: the earlier row) and these, -1 where there are fewer.

    ``out`` says, for rows of ``a`` against rows of ``b``, which pairs don't count. Threshold algorithm over groups of rows
    with equal tags and type: of two groups the tag layer is known, the token layer can't exceed the ratio of the sizes and
    the vector layer 1. Groups are taken by falling bound, and a row needs a group only while its bound reaches the row's
    k-th score.
    """
    code_a, kinds_a = _kinds(a)
    code_b, kinds_b = _kinds(b)
    vectors = any(v is not None for v in a["vector"]) and any(v is not None for v in b["vector"])

    def ceiling(lexical: np.ndarray) -> np.ndarray:
        """Highest scores of all pairs of groups at this token layer."""
        feature, left, right = _jaccard(list(kinds_a["tags"]), list(kinds_b["tags"]))
        mismatch = (left > 0) & (right > 0) & (kinds_a["kind"].to_numpy()[:, None] != kinds_b["kind"].to_numpy()[None])
        tagged = (left > 0) | (right > 0)
        feature = np.where(mismatch, feature * 0.3, feature)
        total = np.where(tagged, 0.55 * feature + 0.45 * lexical, lexical)
        if vectors:
            by_vector, by_feature, by_text = WITH_VECTORS
            total = np.maximum(total, np.where(tagged, by_vector + by_feature * feature + by_text * lexical, 0.75 + 0.25 * lexical))
        return np.where(mismatch, total * 0.45, total) + 1e-9

    floor, top = ceiling(np.zeros((len(kinds_a), len(kinds_b)))), ceiling(np.ones((len(kinds_a), len(kinds_b))))
    size_a, size_b = _length(a["tokens"]), _length(b["tokens"])
    columns = [np.flatnonzero(code_b == g) for g in range(len(kinds_b))]
    small, large = [size_b[c].min() for c in columns], [size_b[c].max() for c in columns]
    score, place = np.full((len(a), k), -1.0), np.full((len(a), k), len(b), np.int64)
    for own in range(len(kinds_a)):
        rows = np.flatnonzero(code_a == own)
        for g in np.argsort(-top[own], kind="stable"):
            n = size_a[rows]
            ratio = np.where(n < small[g], n / max(small[g], 1.0), np.where(n > large[g], large[g] / np.maximum(n, 1.0), 1.0))
            asked = rows[floor[own, g] + (top[own, g] - floor[own, g]) * ratio + 1e-9 >= score[rows, -1]]
            if not len(asked):
                continue
            step = max(1, PAIRS // len(columns[g]))
            for at in range(0, len(asked), step):
                some = asked[at : at + step]
                found = scores(a.iloc[some], b.iloc[columns[g]])
                found[out(some, columns[g])] = -1.0
                every = np.concatenate([score[some], found], axis=1)
                spot = np.concatenate([place[some], np.broadcast_to(columns[g], found.shape)], axis=1)
                score[some], place[some] = _first(every, spot, k)
    return place, score


def nearest(targets: DataFrame, documents: DataFrame, links: DataFrame | None, k: int) -> DataFrame:
    """K1/K2: the k most similar documents of each target, ties by document order.

    ``targets``: target_key, a_group, canonical, skip_identical, match_signature,
    signature and the columns of :func:`prepare`. ``documents``: doc_id, pos,
    b_group, canonical, signature and the columns of :func:`prepare`. ``links``
    (a_group, b_group) says which groups meet; without it equal groups meet.
    Where both sides have an ``embedding`` the score has its vector layer.

    Targets that ask the same are asked about once, and of equal documents the
    first k stand for all. Pairs of forms without a rare token in common score as
    their skeletons do, so each skeleton of the targets is asked about once, and
    the first documents of each skeleton stand for all of it; the other pairs come
    from the rare tokens (see the head of this module). Only rows that both have a
    vector are compared one by one.
    """
    score = ["canonical", "signature", "tags", "tokens", "kind", "vector"]
    vectors = "embedding" in targets.columns and "embedding" in documents.columns
    vectored = F.coalesce(F.size("vector"), F.lit(0)) > 0 if vectors else F.lit(False)
    right = documents.select("doc_id", "pos", "canonical", "signature", F.col("b_group").alias("group"), *_hashed(documents))
    equal = Window.partitionBy("group", *score).orderBy("pos")
    right = right.withColumn("_copy", F.row_number().over(equal)).where(F.col("_copy") <= k).drop("_copy")
    right = durable(right.withColumn("vectored", vectored).withColumn("row", F.monotonically_increasing_id()))
    # new names for the columns, since both sides may come from one table
    asked = targets.select(
        F.col("target_key").alias("target_key"), F.col("a_group").alias("a_group"), F.coalesce("skip_identical", F.lit(False)).alias("skip_identical"), F.coalesce("match_signature", F.lit(False)).alias("match_signature"),
        F.when(F.col("skip_identical"), F.col("canonical")).alias("canonical"), F.when(F.col("match_signature"), F.col("signature")).alias("signature"), *_hashed(targets),
    )
    same = ["a_group", "skip_identical", "match_signature", *score]
    asked = durable(asked.withColumn("goal", _digest(same)).withColumn("vectored", vectored))
    known = asked.select("target_key", "goal")
    goals = durable(asked.drop("target_key").dropDuplicates(["goal"]))

    found = _nearest_plain(goals, right, links, k)
    if vectors:
        found = found.unionByName(_nearest_vectored(goals.where("vectored"), right.where("vectored"), links, k))
    found = found.groupBy("goal", "row").agg(F.max(F.struct("similarity", "pos", "doc_id")).alias("f")).select("goal", "row", "f.*")
    place = Window.partitionBy("goal").orderBy(F.desc("similarity"), F.col("pos"), F.col("row"))
    chosen = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("goal", "doc_id", "similarity", "place")
    return known.join(chosen, "goal").select("target_key", "doc_id", "similarity", "place")


def _meeting(goals: DataFrame, links: DataFrame | None) -> DataFrame:
    """The targets once per group that they meet."""
    if links is None:
        return goals.withColumnRenamed("a_group", "group")
    return goals.join(links, "a_group").drop("a_group").withColumnRenamed("b_group", "group")


def _codes(a: pd.DataFrame, b: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of both sides as numbers."""
    codes = pd.factorize(np.concatenate([a[name].to_numpy(object), b[name].to_numpy(object)]))[0]
    return codes[: len(a)], codes[len(a) :]


def _nearest_vectored(goals: DataFrame, right: DataFrame, links: DataFrame | None, k: int) -> DataFrame:
    """Rows (goal, row, doc_id, pos, similarity): the best k of each part for targets and documents that all have a vector."""
    kinds = dict(right.dtypes) | dict(goals.dtypes)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["goal", "row", "doc_id", "pos", "similarity"])
        b = b.sort_values(["pos", "row"], kind="stable")
        codes = {name: _codes(a, b, name) for name in ("canonical", "signature")}
        skip, match = a["skip_identical"].to_numpy(bool), a["match_signature"].to_numpy(bool)

        def out(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            equals = lambda name: codes[name][0][x][:, None] == codes[name][1][y][None]
            return (skip[x][:, None] & equals("canonical")) | (match[x][:, None] & ~equals("signature"))

        place, found = best(a, b, k, out)
        rows, columns = np.nonzero(found >= 0)
        spot = place[rows, columns]
        return pd.DataFrame({
            "goal": a["goal"].to_numpy()[rows], "row": b["row"].to_numpy()[spot], "doc_id": b["doc_id"].to_numpy()[spot], "pos": b["pos"].to_numpy()[spot], "similarity": found[rows, columns],
        })

    a, b = _parts(_meeting(goals, links), right, "goal", "row")
    keys = ["group", "i", "j"]
    schema = f"goal binary, row long, doc_id {kinds['doc_id']}, pos {kinds['pos']}, similarity double"
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(compare, schema)


def _nearest_plain(goals: DataFrame, right: DataFrame, links: DataFrame | None, k: int) -> DataFrame:
    """Rows (goal, row, doc_id, pos, similarity) that hold the best k of each target among the pairs without two vectors.

    At most k rows of a text rank before any other text's k-th, so of a list the first k of each text, and the first 2k of
    these, hold the best k of a target that leaves out one text.
    """
    entry = F.struct("pos", "row", "doc_id", "canonical")

    def heads(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        text = Window.partitionBy(*keys, "canonical").orderBy(*order)
        first = df.withColumn("_n", F.row_number().over(text)).where(F.col("_n") <= k)
        return first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= 2 * k).drop("_n")

    look = ["tags", "kind", "vectored", "signature"]
    form_a, form_b = ["a_group", "match_signature", *look, "tokens"], ["group", *look, "tokens"]
    a = goals.withColumn("a", _digest(form_a))
    asks = durable(a.select("goal", "a", "skip_identical", "canonical"))
    a = durable(a.select("a", *form_a).dropDuplicates(["a"]))
    named = right.withColumn("b", _digest(form_b))
    listed = heads(named.select("b", "pos", "row", "doc_id", "canonical"), ["b"], [F.col("pos"), F.col("row")])
    listed = listed.groupBy("b").agg(F.sort_array(F.collect_list(entry)).alias("docs"))
    b = durable(named.select("b", *form_b).dropDuplicates(["b"]).join(listed, "b"))

    postings = {name: df.select(name, group, F.explode("tokens").alias("token")) for name, group, df in (("a", "a_group", a), ("b", "group", b))}
    held = durable(postings["b"].groupBy("token").agg(F.count("*").alias("n")))
    rare, common = held.where(F.col("n") <= RARE).select("token"), held.where(F.col("n") > RARE).select("token")

    def parted(df: DataFrame, name: str) -> DataFrame:
        shared = postings[name].join(common, "token", "left_semi").groupBy(name).agg(F.sort_array(F.collect_list("token")).alias("common"))
        made = df.join(shared, name, "left").withColumns({"common": F.coalesce("common", F.expr("cast(array() as array<bigint>)")), "size": F.size("tokens")}).drop("tokens")
        return durable(made.withColumn("s", _digest([c for c in (form_a if name == "a" else form_b) if c != "tokens"] + ["common", "size"])))

    a, b = parted(a, "a"), parted(b, "b")
    skeletons = durable(a.drop("a").dropDuplicates(["s"]))
    several = b.select("s", F.explode("docs").alias("d")).select("s", "d.*")
    several = heads(several, ["s"], [F.col("pos"), F.col("row")]).join(b.drop("b", "docs").dropDuplicates(["s"]), "s").withColumnRenamed("s", "d")
    several = durable(several.withColumnRenamed("common", "tokens"))
    kinds = dict(several.dtypes)
    columns = ["s", "row", "doc_id", "pos", "canonical", "similarity"]

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=columns)
        y = y.sort_values(["pos", "row"], kind="stable")
        mine, theirs = _codes(x, y, "signature")
        match = x["match_signature"].to_numpy(bool)
        both = x["vectored"].to_numpy(bool), y["vectored"].to_numpy(bool)

        def out(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (both[0][p][:, None] & both[1][q][None]) | (match[p][:, None] & (mine[p][:, None] != theirs[q][None]))

        texts = pd.factorize(y["canonical"])[0]
        most = min(len(y), k + int(np.bincount(texts + 1).max()))
        place, found = best(x, y, most, out)
        rows, at = np.nonzero(found >= 0)
        spot = place[rows, at]
        return pd.DataFrame({"s": x["s"].to_numpy()[rows], **{c: y[c].to_numpy()[spot] for c in columns[1:-1]}, "similarity": found[rows, at]})

    nothing = F.lit(None).cast("array<double>")
    p, q = _parts(_meeting(skeletons.withColumnRenamed("common", "tokens"), links).withColumn("vector", nothing), several.withColumn("vector", nothing), "s", "row")
    keys = ["group", "i", "j"]
    schema = f"s binary, row long, doc_id {kinds['doc_id']}, pos {kinds['pos']}, canonical string, similarity double"
    near = heads(p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(compare, schema), ["s"], [F.desc("similarity"), F.col("pos"), F.col("row")])
    near = near.select("s", F.struct((-F.col("similarity")).alias("below"), "pos", "row", "doc_id", "canonical").alias("n")).groupBy("s").agg(F.sort_array(F.collect_list("n")).alias("docs"))
    of_skeletons = a.select("a", "s").join(near, "s").select("a", "docs")

    # pairs of forms with a rare token in common, at their true scores
    meets = postings["a"].join(rare, "token", "left_semi").join(postings["b"].join(rare, "token", "left_semi"), "token")
    meets = meets.where("a_group = `group`") if links is None else meets.join(links.select("a_group", F.col("b_group").alias("group")), ["a_group", "group"], "left_semi")
    meets = meets.groupBy("a", "b").agg(F.count("*").alias("shared"))
    told = lambda df, name: df.select(name, *[F.col(c).alias(f"{name}_{c}") for c in [*look, "common", "size"]], *(["match_signature"] if name == "a" else ["docs"]))
    pairs = meets.join(told(a, "a"), "a").join(told(b, "b"), "b").where("not (a_vectored and b_vectored) and (not match_signature or a_signature <=> b_signature)")
    tags = (F.col("a_tags"), F.col("b_tags"), F.col("a_kind"), F.col("b_kind"))
    lexical = jaccard_counts(F.size(F.array_intersect("a_common", "b_common")) + F.col("shared"), F.col("a_size"), F.col("b_size"))
    pairs = pairs.withColumn("below", -hybrid(lexical, feature_similarity(*tags), type_mismatch(*tags)))
    met = pairs.select("a", F.transform("docs", lambda d: F.struct(F.col("below").alias("below"), d["pos"].alias("pos"), d["row"].alias("row"), d["doc_id"].alias("doc_id"), d["canonical"].alias("canonical"))).alias("docs"))

    lists = of_skeletons.unionByName(met)
    left = lambda d: ~F.col("skip_identical") | ~d["canonical"].eqNullSafe(F.col("canonical"))
    kept = asks.join(lists, "a").select("goal", F.explode(F.slice(F.filter("docs", left), 1, k)).alias("d"))
    return kept.select("goal", "d.row", "d.doc_id", "d.pos", (-F.col("d.below")).alias("similarity"))
