"""Similarity of two problems from their prepared columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import features as ft
from gaugeline.functions import lexicon as lx
from gaugeline.functions.basics import let, words_literal

WITH_VECTORS = (0.60, 0.25, 0.15)


def jaccard_counts(shared: Column, left: Column, right: Column) -> Column:
    """Jaccard from the sizes of the intersection and of both sides; 0 when a side is empty."""
    return F.coalesce(F.try_divide(shared, left + right - shared), F.lit(0.0)) * F.when((left > 0) & (right > 0), 1.0).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of distinct values."""
    return let(F.size(F.array_intersect(left, right)), lambda n: jaccard_counts(n, F.size(left), F.size(right)))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Share of the left values found on the right."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(left)), F.lit(0.0))


def type_mismatch(tags_a: Column, tags_b: Column, key_a: Column, key_b: Column) -> Column:
    """Both sides are tagged and their type tags differ."""
    return (F.size(tags_a) > 0) & (F.size(tags_b) > 0) & (key_a != key_b)


def feature_similarity(tags_a: Column, tags_b: Column, key_a: Column, key_b: Column) -> Column:
    """Tag Jaccard, 0.3 of it on a type mismatch, -1 when neither side is tagged."""
    base = jaccard(tags_a, tags_b)
    return F.when((F.size(tags_a) == 0) & (F.size(tags_b) == 0), -1.0).otherwise(
        F.when(type_mismatch(tags_a, tags_b, key_a, key_b), base * 0.3).otherwise(base)
    )


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when one of them is all zeros."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def hybrid(lexical: Column, feature: Column, mismatch: Column, cosine_value: Column | None = None) -> Column:
    """Weighted layers; absent layers shift their weight, a type mismatch keeps 45 %."""
    tagged = feature >= 0
    plain = F.when(tagged, 0.55 * feature + 0.45 * lexical).otherwise(lexical)
    if cosine_value is None:
        total = plain
    else:
        a, b, c = WITH_VECTORS
        layered = F.when(tagged, a * cosine_value + b * feature + c * lexical).otherwise(0.75 * cosine_value + 0.25 * lexical)
        total = F.when(cosine_value.isNotNull(), layered).otherwise(plain)
    capped = F.when(mismatch, total * 0.45).otherwise(total)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped))


def intent_family(intent: str) -> Column:
    """Family of an intent column, the intent itself outside the families."""
    return F.expr(ft.families(intent, lx.INTENT_FAMILIES))


def intent_similarity(a: Column, b: Column) -> Column:
    """1 for equal, .55 for related, 0 for other intents."""
    pairs = [f"{x}>{y}" for x, y in lx.RELATED_INTENTS] + [f"{y}>{x}" for x, y in lx.RELATED_INTENTS]
    related = F.array_contains(words_literal(pairs), F.concat_ws(">", a, b))
    return F.when(a == b, 1.0).when(related, 0.55).otherwise(0.0)


def alignment_score(problem: dict[str, Column], example: dict[str, Column]) -> Column:
    """Explicit metadata alignment.

    ``problem``: type, structure, keywords, operations, format_labels,
    constraints, complexity. ``example``: type, concept, skills, format_labels,
    constraints, level, tags, anchor, rate_problem. Arrays hold distinct labels.
    """
    general = problem["type"] == "general"
    closeness = intent_similarity(problem["type"], example["type"])
    by_type = (
        F.when(example["type"].isNull(), 0.0).when(closeness > 0, closeness * 0.55)
        .when((problem["type"] == "ratio_proportion") & example["rate_problem"], 0.24)
        .when(~general, -0.16).otherwise(0.0)
    )

    def share(known: Column, wanted: Column, weight: float) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(known, wanted)), F.size(wanted)), F.lit(0.0)) * weight

    concepts = F.when(general, problem["structure"]).otherwise(F.array_append(problem["structure"], problem["type"]))
    tags = F.array_union(F.array_append(problem["structure"], problem["type"]), problem["keywords"])
    both_formats = (F.size(example["format_labels"]) > 0) & (F.size(problem["format_labels"]) > 0)
    by_format = share(example["format_labels"], problem["format_labels"], 0.28)
    missing = F.size(F.array_except(problem["constraints"], example["constraints"]))
    both_constraints = (F.size(problem["constraints"]) > 0) & (F.size(example["constraints"]) > 0)
    gap = F.abs(problem["complexity"] - example["level"])
    return (
        by_type
        + share(concepts, example["concept"], 0.24)
        + share(F.array_union(problem["structure"], problem["operations"]), example["skills"], 0.20)
        + F.when(both_formats, by_format - F.when(by_format == 0, 0.08).otherwise(0.0)).otherwise(0.0)
        + F.when(both_constraints, share(example["constraints"], problem["constraints"], 0.36) - missing * 0.12).otherwise(0.0)
        + F.coalesce(F.greatest(F.lit(0.0), 0.14 - 0.07 * gap), F.lit(0.0))
        + share(tags, example["tags"], 0.14)
        + F.coalesce(example["anchor"] * 0.06, F.lit(0.0))
    )
