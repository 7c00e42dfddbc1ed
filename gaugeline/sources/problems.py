"""Problem sets and example banks as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import text as tx
from gaugeline.functions.basics import non_empty
from gaugeline.sources.slices import read_items

NO_ITEMS = "cast(array() as array<struct<outer:string, inner:string, item:string>>)"
ITEM = (
    "problem string, answer string, solution string, category string, difficulty string, type string, concept string, "
    "skills string, format string, tags string, constraints string, anchor_priority string, created_at string, expires_at double"
)


def _items(value: Column) -> Column:
    """Objects of a JSON text: a list, lists by key, or lists by two keys."""

    def rows(text: Column, outer: Column, inner: Column) -> Column:
        found = F.coalesce(F.from_json(text, "array<string>"), F.expr("cast(array() as array<string>)"))
        return F.transform(found, lambda i: F.struct(outer.alias("outer"), inner.alias("inner"), i.alias("item")))

    nothing = F.lit(None).cast("string")

    def of_key(pair: Column) -> Column:
        nested = F.map_entries(F.from_json(pair["value"], "map<string,string>"))
        deep = F.flatten(F.transform(F.filter(nested, lambda p: p["value"].startswith("[")), lambda p: rows(p["value"], pair["key"], p["key"])))
        return F.when(pair["value"].startswith("["), rows(pair["value"], pair["key"], nothing)).when(pair["value"].startswith("{"), deep).otherwise(F.expr(NO_ITEMS))

    text = F.regexp_replace(value, "\\A[\ufeff\\s]+", "")
    keyed = F.flatten(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), of_key))
    return F.when(text.startswith("["), rows(text, nothing, nothing)).otherwise(F.coalesce(keyed, F.expr(NO_ITEMS)))


def json_items(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per object with its path keys, place and known fields; other columns stay."""
    rest = [c for c in df.columns if c != value]
    flat = df.select(*rest, F.posexplode(_items(F.col(value))).alias("pos", "_row"))
    flat = flat.select(*rest, "pos", F.col("_row.outer").alias("outer_key"), F.col("_row.inner").alias("inner_key"), F.col("_row.item").alias("item"))
    return _known_fields(flat.where(F.col("item").startswith("{")))


def _known_fields(items: DataFrame) -> DataFrame:
    return items.withColumn("_f", F.from_json("item", ITEM)).select("*", "_f.*").drop("_f")


def problems_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Problems with answers; keys inside an object win over the path keys."""
    return _problems(json_items(df, value), [c for c in df.columns if c != value])


def _problems(items: DataFrame, rest: list[str]) -> DataFrame:
    answer = F.coalesce(non_empty(F.col("answer")), F.col("solution"))
    return items.where((F.col("problem") != "") & answer.isNotNull()).select(
        *rest, "pos", "problem", answer.alias("answer"),
        F.coalesce("category", "outer_key", F.lit("general")).alias("category"),
        F.coalesce("difficulty", "inner_key").alias("difficulty"),
    )


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """JSON documents with the file they come from: a document per file, read in one piece (below 2 GB), or per line.

    Documents of many files are ordered by (file, pos); large sets come as lines, which split into tasks, or are read in slices.
    """
    return spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("file"))


def read_problems(spark: SparkSession, path: str, lines: bool = False, sliced: bool = False) -> DataFrame:
    """Problem files; ``sliced`` reads a large document in many tasks (see :mod:`gaugeline.sources.slices`)."""
    if sliced:
        return _problems(_known_fields(read_items(spark, path)), ["file"])
    return problems_from_json(_documents(spark, path, lines))


def append_problems(problems: DataFrame, path: str) -> None:
    """Add problems to a stored set."""
    problems.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


# --- example banks ----------------------------------------------------------------------

def _list(text: Column) -> Column:
    """A field that is one string or a list of strings, as an array."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def examples_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Flattened, normalised bank: subject, pos, problem, solution and optional metadata."""
    return _examples(json_items(df, value), [c for c in df.columns if c != value])


def _examples(items: DataFrame, rest: list[str]) -> DataFrame:
    items = items.withColumn("solution", F.coalesce(non_empty(F.col("solution")), non_empty(F.col("answer"))))
    items = items.where((F.col("problem") != "") & F.col("solution").isNotNull() & F.col("outer_key").isNotNull())
    numeric = F.col("difficulty").try_cast("double").isNotNull()
    return items.select(
        *rest, "pos", F.col("outer_key").alias("subject"),
        tx.example_text(F.col("problem"), False).alias("problem"),
        tx.example_text(F.col("solution"), True).alias("solution"),
        F.coalesce(tx.difficulty_label(F.col("difficulty"), numeric), tx.difficulty_label(F.col("inner_key"))).alias("difficulty"),
        non_empty(tx.type_label(F.col("type"))).alias("type"),
        tx.label_list(_list(F.col("concept"))).alias("concept"),
        tx.label_list(_list(F.col("skills"))).alias("skills"),
        tx.format_labels(F.col("format")).alias("format_labels"),
        tx.label_list(_list(F.col("tags"))).alias("tags"),
        F.when(F.col("constraints").isNotNull(), tx.constraint_labels(_list(F.col("constraints")))).alias("constraints"),
        tx.anchor_priority(F.col("anchor_priority")).alias("anchor_priority"),
        "created_at", "expires_at",
    )


def read_examples(spark: SparkSession, path: str, lines: bool = False, sliced: bool = False) -> DataFrame:
    """Curated bank files; ``sliced`` as in :func:`read_problems`."""
    if sliced:
        return _examples(_known_fields(read_items(spark, path)), ["file"]).drop("created_at", "expires_at")
    return examples_from_json(_documents(spark, path, lines)).drop("created_at", "expires_at")


def read_user_examples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """User examples; a missing or broken file counts as empty."""
    try:
        raw = _documents(spark, path, lines)
    except AnalysisException:
        raw = spark.createDataFrame([], "value string, file string")
    return examples_from_json(raw)


def live(examples: DataFrame, now: float) -> DataFrame:
    """Rows that have not expired at ``now`` (epoch seconds); no expiry means for ever."""
    return examples.where(F.coalesce(F.col("expires_at"), F.lit(float("inf"))) > F.lit(float(now)))


def merge_banks(curated: DataFrame, user: DataFrame, now: float) -> DataFrame:
    """Curated examples followed by the live user examples, without the expiry columns."""
    added = live(user, now).drop("created_at", "expires_at")
    first = curated.withColumn("bank", F.lit(0))
    return first.unionByName(added.withColumn("bank", F.lit(1)), allowMissingColumns=True)


def _place(bank: DataFrame) -> Column:
    """Bank order: by file where there are several, then by place in the file."""
    return F.struct("file", "pos") if "file" in bank.columns else F.struct("pos")


def distinct_examples(bank: DataFrame) -> DataFrame:
    """One row per (problem, solution): the first in bank order.

    Rows meet by a digest of both texts, so that a text travels at most once per map task, not as a key.
    """
    texts = F.struct("problem", "solution")
    made = bank.withColumn("_digest", F.sha2(F.to_json(texts, {"ignoreNullFields": "false"}), 256))
    first = made.groupBy("_digest").agg(F.min_by(texts, _place(bank)).alias("_texts"), F.min_by("pos", _place(bank)).alias("pos"), F.count("*").alias("copies"))
    return first.select("_texts.*", "pos", "copies")


def catalogue(bank: DataFrame) -> DataFrame:
    """Number of examples per subject, difficulty and concept, with the first problem."""
    concept = F.coalesce(F.get("concept", F.lit(0)), F.col("type"), F.lit("general"))
    return bank.withColumn("concept", concept).groupBy("subject", "difficulty", "concept").agg(
        F.count("*").alias("count"), F.min(F.struct(_place(bank).alias("at"), "problem")).getField("problem").alias("sample")
    )


def known_types(bank: DataFrame) -> DataFrame:
    """Types and difficulties found per subject (both come from small vocabularies)."""
    kinds = bank.select("subject", F.coalesce("type", F.lit("general")).alias("type"), "difficulty").distinct()
    return kinds.groupBy("subject").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.array_join(F.array_sort(F.collect_set("difficulty")), ",").alias("difficulties"),
    )
