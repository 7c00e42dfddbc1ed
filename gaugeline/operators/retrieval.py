"""Few-shot example retrieval for whole tables of problems.

The filter cascade looks only at labels of both sides, so it runs between
*groups* of examples with equal labels and distinct problem forms; problems
and examples themselves never meet in pairs (see ``operators.similarity``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import features as ft
from gaugeline.functions import lexicon as lx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import alias, let, lower_strip
from gaugeline.functions.pairs import intent_family
from gaugeline.operators import similarity as sm
from gaugeline.operators import tagging as tg
from gaugeline.session import durable

LABELS = ["subject", "ex_type", "ex_intent", "ex_family", "ex_rate", "ex_conditional", "ex_constraints"]
EQUATIONS = ["solve_equation", "real_solutions", "system"]


def _identity(text: Column) -> Column:
    """Digest of the canonical text, so that no texts travel just to be compared."""
    return F.md5(tx.canonical(text).cast("binary"))


def prepare_bank(bank: DataFrame) -> DataFrame:
    """Examples with all labels the cascade reads. Needs example_id, pos, subject, problem, solution; type and constraints are optional."""
    made = bank.where("problem <> '' and solution <> ''").withColumn("_det", tx.detection_text(F.col("problem")))
    made = made.withColumn("_low", F.lower("problem")).withColumn("_both", F.lower(F.concat_ws(" ", "problem", "solution")))
    given = F.nullif(tx.type_label(F.col("type")), F.lit("")) if "type" in bank.columns else F.lit(None).cast("string")
    limits = F.array_join(tx.constraint_labels(F.col("constraints")), ",") if "constraints" in bank.columns else F.lit("")
    made = made.withColumns({
        "ex_type": F.coalesce(given, F.lit("")),
        "ex_intent": F.expr(ft.intent("_det")),
        "ex_family": F.coalesce(F.expr(ft.equation_family("_det")), F.lit("")),
        "ex_rate": F.expr(ft.rate_problem("_low")),
        "ex_conditional": F.expr(ft.conditional_example("_both")),
        "ex_constraints": F.coalesce(limits, F.lit("")),
        "signature": tx.signature(F.col("problem")),
        "canonical": _identity(F.col("problem")),
    })
    made = sm.prepare(made, "problem", "bank").drop("_det", "_low", "_both")
    return made.withColumn("doc_id", F.col("example_id")).withColumn("b_group", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in LABELS]))


def resolve_subjects(targets: DataFrame, subjects: DataFrame, type_map: DataFrame) -> DataFrame:
    """subject whose examples serve each problem. ``subjects`` has one row per bank subject (subject, first_pos)."""
    based = targets.withColumn("ptext", tx.problem_text(F.col("problem")))
    based = tg.with_subject(based, "ptext", type_map, "_found").withColumns({
        "_explicit": lower_strip(F.coalesce(F.col("requested"), F.lit(""))),
        "_wanted": tx.subject_label(F.col("requested")),
        "detected": tx.subject_label(F.col("_found")),
    })
    names = subjects.select("subject")
    for source, flag in (("_explicit", "_has_explicit"), ("_wanted", "_has_wanted"), ("detected", "has_detected")):
        known = names.select(F.col("subject").alias(source), F.lit(True).alias(flag))
        based = based.join(known, source, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    general = subjects.where("subject = 'general'").agg(F.max("subject")).scalar()
    first = subjects.agg(F.min_by("subject", "first_pos")).scalar()
    wanted = F.when((F.col("_wanted") == "general") & F.col("has_detected"), F.col("detected")).otherwise(F.col("_wanted"))
    subject = (
        F.when(F.col("_has_explicit") & (F.col("_explicit") != "general"), F.col("_explicit"))
        .when(F.col("_has_wanted"), wanted)
        .when(F.col("has_detected"), F.col("detected"))
        .otherwise(F.coalesce(general, first, F.lit("general")))
    )
    return based.withColumn("subject", subject).drop("_found", "_explicit", "_wanted", "_has_explicit", "_has_wanted")


def _target_labels(df: DataFrame) -> DataFrame:
    made = df.withColumns({"_det": tx.detection_text(F.col("ptext")), "_low": F.lower("ptext")})
    made = made.withColumns({"intent": F.expr(ft.intent("_det")), "family": F.coalesce(F.expr(ft.equation_family("_det")), F.lit(""))})
    limits = F.expr(ft.constraints("_low"))
    kind = alias(F.col("intent"), lx.TYPE_ALIASES)
    descriptive = kind.isin("evaluate_substitution", "function_composition")
    return made.withColumns({
        "kind": kind,
        "strict": tg.strict_matching(F.col("intent"), F.col("subject")),
        "limits": F.array_join(F.when(descriptive, F.array_remove(limits, "positive_values")).otherwise(limits), ","),
        "conditional": F.expr(ft.conditional_question("_low")),
        "signature": tx.signature(F.col("ptext")),
        "canonical": _identity(F.col("ptext")),
    }).drop("_det", "_low")


def _type_match() -> Column:
    """The example's type suits the problem's type."""
    same_family = F.lit(False)
    for name in ("equation", "probability", "counting"):
        members = lx.INTENT_FAMILIES[name]
        same_family = same_family | (F.col("ex_type").isin(*members) & F.col("kind").isin(*members))
    known = [i for n in ("equation", "probability", "counting") for i in lx.INTENT_FAMILIES[n]]
    equations = lx.INTENT_FAMILIES["equation"]
    by_text = ~F.col("ex_type").isin(*known) & (
        (F.col("ex_intent") == F.col("kind")) | (F.col("ex_intent").isin(*equations) & F.col("kind").isin(*equations))
    )
    rate = (F.col("kind") == "ratio_proportion") & F.col("ex_rate")
    return (F.col("ex_type") == F.col("kind")) | same_family | by_text | rate


def _any(flag: Column, keys: list[str]) -> Column:
    return F.max(flag.cast("int")).over(Window.partitionBy(*keys)) == 1


FORM = ["subject", "kind", "intent", "strict", "family", "limits", "conditional"]


def eligible_groups(forms: DataFrame, groups: DataFrame) -> DataFrame:
    """F3 (i)-(iii): distinct problem forms with all example groups of their subject; ``eligible`` says which pass the label filters."""
    key = ["form"]
    met = forms.join(groups, "subject")
    typed = F.col("ex_type") != ""
    met = met.withColumn("_fits", typed & _type_match())
    met = met.withColumns({"_typed": _any(typed, key), "_some": _any(F.col("_fits"), key)})
    by_type = F.col("_typed") & (F.col("kind") != "general")
    fits = ~by_type | F.col("_fits") | (~F.col("_some") & ~F.col("strict"))
    related = ~F.col("strict") | (intent_family("ex_intent") == intent_family("intent"))
    by_family = F.col("strict") & F.col("intent").isin(*EQUATIONS) & (F.col("family") != "")
    same_family = ~by_family | (F.col("ex_family") == F.col("family"))
    return met.withColumn("eligible", F.coalesce(fits & related & same_family, F.lit(False))).drop("_fits", "_typed", "_some")


def _set(flag: Column | None = None) -> Column:
    """The numbers of the groups for which the flag holds, in order."""
    return F.sort_array(F.collect_set(F.col("g") if flag is None else F.when(flag, F.col("g"))))


def _links(targets: DataFrame, bank: DataFrame, min_examples: int) -> tuple[DataFrame, DataFrame]:
    """F3 (iv)-(vi) and F4: (which pool of example groups each distinct problem form, signature and text draws from, the pools).

    The groups of a subject are numbered, and each filter of the cascade is a set of these numbers: one per problem form for
    the filters on labels, one per signature and one per text for those on texts. A problem intersects them, so it is one row
    throughout, and a set has at most as many numbers as its subject has groups, which are combinations of labels.
    """
    groups = bank.groupBy("b_group", *LABELS).agg(F.count("*").alias("n_all"))
    groups = durable(groups.withColumn("g", F.row_number().over(Window.partitionBy("subject").orderBy("b_group"))))
    named = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in FORM])
    shares = F.arrays_overlap(F.array_remove(F.split("limits", ","), ""), F.array_remove(F.split("ex_constraints", ","), ""))
    real = (F.col("intent") == "real_solutions") & (F.col("ex_intent") == "real_solutions")
    forms = eligible_groups(targets.select(*FORM).distinct().withColumn("form", named), groups).groupBy("form").agg(
        _set().alias("every"), _set(F.col("eligible")).alias("allowed"), _set(shares).alias("limited"),
        _set(F.col("conditional") & F.col("ex_conditional")).alias("teaching"), _set(real).alias("real"),
    )
    numbered = bank.join(groups.select("b_group", "g", "n_all"), "b_group")
    alike = numbered.groupBy("subject", "signature", "g").agg(F.count("*").alias("n")).groupBy("subject", "signature").agg(F.collect_list(F.struct("g", "n")).alias("alike"))
    own = numbered.groupBy("subject", "canonical", "g", "n_all", F.col("signature").alias("s")).agg(F.count("*").alias("n"))
    own = own.groupBy("subject", "canonical").agg(F.collect_list(F.struct("g", "s", "n", "n_all")).alias("own"))

    texts = targets.select(*FORM, "signature", "canonical").distinct().withColumn("form", named)
    texts = texts.withColumn("link_text", F.md5(F.concat_ws("\u0001", "form", "signature", "canonical").cast("binary")))
    met = texts.join(forms, "form").join(alike, ["subject", "signature"], "left").join(own, ["subject", "canonical"], "left")
    met = met.withColumns({"alike": F.coalesce("alike", F.expr("cast(array() as array<struct<g:int,n:bigint>>)")), "own": F.coalesce("own", F.expr("cast(array() as array<struct<g:int,s:string,n:bigint,n_all:bigint>>)"))})

    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    owned = lambda g, also=None: F.filter("own", lambda o: (o["g"] == g) & (o["s"].eqNullSafe(F.col("signature")) if also else F.lit(True)))
    # examples of the same signature that are not the text itself, by group
    others = F.filter(F.transform(F.filter("alike", lambda x: F.array_contains("allowed", x["g"])), lambda x: F.struct(x["g"].alias("g"), (x["n"] - total(owned(x["g"], True))).alias("n"))), lambda x: x["n"] > 0)
    met = met.withColumn("_others", others).withColumn("match_signature", F.col("strict") & (total(F.col("_others")) >= min_examples))
    used_up = F.transform(F.filter("own", lambda o: total(owned(o["g"])) == o["n_all"]), lambda o: o["g"])
    left = (
        F.when(F.col("match_signature"), F.sort_array(F.transform("_others", lambda x: x["g"])))
        .when(F.col("strict"), F.array_except("allowed", used_up)).otherwise(F.col("allowed"))
    )
    within = lambda pool, some: F.when(F.size(F.array_intersect(pool, some)) > 0, F.array_intersect(pool, some)).otherwise(F.col(pool))
    met = met.withColumn("_left", left).withColumn("_left", within("_left", "limited"))
    # (vi) nothing left: other subjects than the core ones fall back to the whole subject
    met = met.withColumn("_left", F.when((F.size("_left") == 0) & ~F.col("strict"), F.col("every")).otherwise(F.col("_left"))).where(F.size("_left") > 0)
    met = met.withColumns({"_teaching": F.array_intersect("_left", "teaching"), "_real": F.array_intersect("_left", "real")})
    pool = F.when(F.size("_teaching") > 0, F.col("_teaching")).when(F.size("_real") > 0, F.col("_real")).otherwise(F.col("_left"))
    met = met.withColumn("_pool", pool).withColumn("priority", (F.size("_teaching") > 0) | (F.size("_real") > 0))
    met = met.withColumn("a_group", F.concat_ws("\u0001", "subject", F.array_join("_pool", ",")))
    links = durable(met.select("link_text", "match_signature", "priority", "subject", "a_group", "_pool"))
    pools = links.select("subject", "a_group", "_pool").distinct().select("subject", "a_group", F.explode("_pool").alias("g"))
    return links.drop("subject", "_pool"), pools.join(groups.select("subject", "g", "b_group"), ["subject", "g"]).select("a_group", "b_group")


def diversify(pool: DataFrame, weight: float = 0.15) -> DataFrame:
    """K3: the best example first, then supports by relevance minus their overlap with chosen supports.

    ``pool`` has at most 6k rows per target (target_key, place, similarity, words, wanted), so a group is always small. It
    becomes an array, from which a fold takes one support at a time; each candidate carries its highest overlap so far.
    """
    candidate = F.struct("place", "similarity", "words", F.lit(0.0).alias("shared"))
    listed = pool.groupBy("target_key").agg(F.sort_array(F.collect_list(candidate)).alias("rows"), F.first("wanted").alias("wanted"))
    first, rest = F.slice("rows", 1, 1), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))

    def overlap(a: Column, b: Column) -> Column:
        ratio = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
        return F.when((F.size(a) > 0) & (F.size(b) > 0), ratio).otherwise(0.0)

    def take(state: Column, _: Column) -> Column:
        value = lambda r: r["similarity"] - weight * r["shared"]
        top = F.array_max(F.transform(state["left"], lambda r: F.struct(value(r).alias("value"), (-r["place"]).alias("place"), r["words"].alias("words"))))

        def moved(t: Column) -> Column:
            others = F.filter(state["left"], lambda r: r["place"] != -t["place"])
            left = F.transform(others, lambda r: F.struct(r["place"].alias("place"), r["similarity"].alias("similarity"), r["words"].alias("words"), F.greatest(r["shared"], overlap(r["words"], t["words"])).alias("shared")))
            return F.struct(F.array_append(state["picked"], -t["place"]).alias("picked"), left.alias("left"))

        return let(top, moved)

    nothing = F.slice(F.transform("rows", lambda r: r["place"]), 1, 0)
    picked = F.aggregate(F.sequence(F.lit(1), F.col("wanted") - 1), F.struct(nothing.alias("picked"), rest.alias("left")), take, lambda state: state["picked"])
    every = F.transform(rest, lambda r: r["place"])
    supports = F.when(F.size("rows") <= F.col("wanted"), every).when(F.col("wanted") > 1, picked).otherwise(nothing)
    made = listed.select("target_key", F.posexplode(F.concat(F.transform(first, lambda r: r["place"]), supports)).alias("rank", "place"))
    return made.select("target_key", "place", (F.col("rank") + 1).alias("rank"))


def select_examples(targets: DataFrame, bank: DataFrame, most: int, min_examples: int, weight: float = 0.15) -> DataFrame:
    """chosen examples (target_key, example_id, rank, similarity) of labelled targets with their wanted number."""
    links, meets = _links(targets, bank, min_examples)
    keyed = targets.withColumn("form", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in FORM])).withColumn(
        "link_text", F.md5(F.concat_ws("\u0001", "form", "signature", "canonical").cast("binary"))
    )
    goals = keyed.join(links, "link_text").withColumn("skip_identical", F.col("strict"))
    goals = durable(sm.prepare(goals, "ptext", "bank"))
    if most <= 2:  # one anchor and one support: always the two best, whatever the pool
        best = sm.nearest(goals, bank, meets, most).join(goals.select("target_key", "wanted"), "target_key").where("place <= wanted")
        return best.select("target_key", F.col("doc_id").alias("example_id"), F.col("place").alias("rank"), "similarity")
    ranked = sm.nearest(goals, bank, meets, 6 * most).withColumnRenamed("doc_id", "example_id")

    ranked = ranked.join(goals.select("target_key", "priority", "wanted"), "target_key")
    whole = Window.partitionBy("target_key")
    ranked = ranked.withColumn("_high", F.sum(F.when(F.col("similarity") > 0.3, 1).otherwise(0)).over(whole))
    few = F.col("_high") < F.col("wanted")
    inside = (
        F.when(F.col("priority"), F.col("place") <= 6 * F.col("wanted"))
        .when(few, F.col("place") <= 3 * F.col("wanted"))
        .otherwise((F.col("similarity") > 0.3) & (F.col("place") <= 4 * F.col("wanted")))
    )
    pool = ranked.where(inside).drop("_high", "priority")
    pool = durable(pool)
    words = bank.select("example_id", tx.tokens(F.col("problem")).alias("words"))
    chosen = diversify(pool.join(words, "example_id").select("target_key", "place", "similarity", "words", "wanted"), weight)
    return pool.join(chosen, ["target_key", "place"]).select("target_key", "example_id", "rank", "similarity")


def zero_shot(problems: DataFrame) -> DataFrame:
    """zero-shot prompt."""
    body = F.concat(F.lit(lx.ZERO_SHOT_HEAD + "\n\nQ: "), F.col("problem"), F.lit("\nA:"))
    return problems.select("target_id", F.lit("zero_shot").alias("technique"), body.alias("prompt"), F.lit(None).cast("string").alias("error"))


def few_shot(
    targets: DataFrame,
    bank: DataFrame,
    min_examples: int = 2,
    max_examples: int = 2,
    medium_examples: int = 2,
    hard_examples: int = 2,
    weight: float = 0.15,
    min_relevance: float = 0.35,
    floor: float = 0.55,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, chosen examples) of every target.

    ``targets``: target_id, problem, requested. Decisions hold the subject used,
    the best relevance and an error text where no few-shot prompt is possible.
    """
    examples = durable(prepare_bank(bank))
    subjects = examples.groupBy("subject").agg(F.min("pos").alias("first_pos"))
    named = examples.where("ex_type <> ''").select(F.col("ex_type").alias("type"), "subject", "pos")
    resolved = resolve_subjects(targets, subjects, tg.type_subjects(named))
    resolved = tg.with_complexity(resolved, "ptext", "subject")
    goal = F.when(F.col("complexity") >= 3, hard_examples).when(F.col("complexity") == 2, medium_examples).otherwise(min_examples)
    wanted = F.greatest(F.lit(min_examples), F.least(goal, F.lit(max_examples)))
    resolved = resolved.withColumn("wanted", F.least(wanted, F.lit(max(min_examples, max_examples)))).withColumn("final_canonical", _identity(F.col("problem")))
    # labels are stored once; the second attempt only looks at another subject
    first = durable(_target_labels(resolved.withColumn("attempt", F.lit(1))))
    second = first.where((F.col("detected") != F.col("subject")) & F.col("has_detected")).withColumns({"subject": F.col("detected"), "attempt": F.lit(2)})
    second = second.withColumn("strict", tg.strict_matching(F.col("intent"), F.col("subject")))
    kept = first.unionByName(second).withColumn("target_key", F.concat_ws("#", F.col("target_id").cast("string"), F.col("attempt").cast("string")))
    chosen = durable(select_examples(kept, examples, max(min_examples, max_examples), min_examples, weight))

    best = chosen.groupBy("target_key").agg(F.max("similarity").alias("best"))
    tries = kept.select("target_id", "target_key", "attempt", "subject", "strict", "final_canonical").join(best, "target_key", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    a = tries.where("attempt = 1")
    b = tries.where("attempt = 2").select("target_id", F.col("target_key").alias("key2"), F.col("subject").alias("subject2"), F.col("best").alias("best2"))
    met = a.join(b, "target_id", "left")
    swap = F.coalesce(~F.col("strict") & (F.col("best") < min_relevance) & (F.col("best2") > F.col("best") + 0.05), F.lit(False))
    met = met.select(
        "target_id", "strict", "final_canonical",
        F.when(swap, F.col("key2")).otherwise(F.col("target_key")).alias("target_key"),
        F.when(swap, F.col("subject2")).otherwise(F.col("subject")).alias("subject"),
        F.when(swap, F.col("best2")).otherwise(F.col("best")).alias("best_relevance"),
    )
    texts = examples.select("example_id", F.col("problem").alias("example"), "solution", F.col("canonical").alias("_canonical"))
    used = met.where(~F.col("strict") | (F.col("best_relevance") >= floor)).join(chosen, "target_key").join(texts, "example_id")
    used = used.where("_canonical <> final_canonical").select("target_id", "example_id", "rank", "similarity", "example", "solution")
    counts = used.groupBy("target_id").agg(F.count("*").alias("n_examples"))
    decided = met.join(counts, "target_id", "left").withColumn("n_examples", F.coalesce("n_examples", F.lit(0)))
    error = (
        F.when(F.col("n_examples") == 0, "no_matching_examples")
        .when(F.col("n_examples") < min_examples, "too_few_examples")
    )
    return decided.select("target_id", "subject", "best_relevance", "n_examples", error.alias("error")), used


def few_shot_prompts(targets: DataFrame, decisions: DataFrame, used: DataFrame) -> DataFrame:
    """prompt text; targets without enough examples carry the reason instead."""
    shown = F.concat(
        F.lit("Q: "), tx.prompt_ready(F.col("example"), False), F.lit("\nA: "), tx.prompt_ready(F.col("solution"), True)
    )
    # at most max_examples rows per target
    bodies = used.withColumn("_shown", shown).groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_shown"))).alias("_rows"))
    joined = targets.select("target_id", "problem").join(decisions, "target_id").join(bodies, "target_id", "left")
    body = F.concat(
        F.lit(lx.FEW_SHOT_HEAD + "\n\n"), F.array_join(F.col("_rows._shown"), "\n\n"), F.lit("\n\nQ: "), F.col("problem"), F.lit("\nA:")
    )
    return joined.select(
        "target_id", F.lit("few_shot").alias("technique"), F.when(F.col("error").isNull(), body).alias("prompt"), "error"
    )


Technique = Callable[[DataFrame], DataFrame]
_TECHNIQUES: dict[str, Technique] = {}


def register_technique(name: str, build: Technique) -> None:
    """``build(targets)`` returns target_id, technique, prompt, error."""
    _TECHNIQUES[name] = build


def unregister_technique(name: str) -> None:
    _TECHNIQUES.pop(name, None)


def all_techniques(targets: DataFrame, bank: DataFrame, **options: float) -> DataFrame:
    """prompts of every technique per problem."""
    decisions, used = few_shot(targets, bank, **options)
    made = zero_shot(targets).unionByName(few_shot_prompts(targets, decisions, used))
    for build in _TECHNIQUES.values():
        made = made.unionByName(build(targets).select("target_id", "technique", "prompt", "error"))
    return made
