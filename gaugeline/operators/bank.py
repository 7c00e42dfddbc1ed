"""Curating the example bank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import features as ft
from gaugeline.functions import lexicon as lx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import alias, let, lookup, lower_strip, non_empty, quoted, rounded, strip, words_literal
from gaugeline.sources.problems import live

FIELDS = ["problem", "solution", "answer", "type", "concept", "skills", "format", "difficulty", "tags", "constraints", "anchor_priority"]
NO_LABELS = "cast(array() as array<string>)"


# --- validation -----------------------------------------------------------------------

def broken_rules(entry: Column) -> Column:
    """B2: names of the rules a JSON entry breaks."""
    value = F.try_parse_json(entry)
    members = F.from_json(entry, "map<string,string>")

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("missing"))

    def field(name: str) -> Column:
        return F.element_at(members, name)

    def given(name: str) -> Column:
        return F.coalesce(F.map_contains_key(members, name), F.lit(False))

    def bad_text(name: str) -> Column:
        return given(name) & ((kind(name) != "STRING") | (F.coalesce(field(name), F.lit("")) == ""))

    def bad_list(name: str, may_be_empty: bool = False) -> Column:
        items = F.from_json(field(name), "array<string>")
        empty = F.lit(False) if may_be_empty else F.size(items) == 0
        text_only = kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")
        return given(name) & (~text_only | empty | F.exists(items, lambda x: x == ""))

    number = kind("difficulty").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    either_list = lambda name: F.when(kind(name).startswith("ARRAY"), bad_list(name)).otherwise(bad_text(name))
    anchor = field("anchor_priority").try_cast("double")
    rules = [
        ("not_an_object", F.coalesce(~F.schema_of_variant(value).startswith("OBJECT"), F.lit(True))),
        ("problem_required", ~given("problem")),
        ("problem", bad_text("problem")),
        ("solution_or_answer_required", ~given("solution") & ~given("answer")),
        ("solution", bad_text("solution")),
        ("answer", bad_text("answer")),
        ("type", bad_text("type")),
        ("concept", either_list("concept")),
        ("skills", bad_list("skills")),
        ("format", F.when(kind("format").startswith("OBJECT"), kind("format") == "OBJECT<>").otherwise(either_list("format"))),
        ("difficulty", F.when(number, field("difficulty").try_cast("double") < 1).otherwise(bad_text("difficulty"))),
        ("tags", bad_list("tags")),
        ("constraints", bad_list("constraints", may_be_empty=True)),
        ("anchor_priority", given("anchor_priority") & ~F.coalesce(anchor.between(0, 1) & (kind("anchor_priority") != "STRING"), F.lit(False))),
        ("unknown_field", F.size(F.array_except(F.coalesce(F.map_keys(members), F.expr(NO_LABELS)), words_literal(FIELDS))) > 0),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def validate(entries: DataFrame, entry: str = "entry") -> tuple[DataFrame, DataFrame]:
    """B2: (valid, rejected) entries; rejected ones list their broken rules."""
    judged = entries.withColumn("broken", broken_rules(F.col(entry)))
    return judged.where(F.size("broken") == 0).drop("broken"), judged.where(F.size("broken") > 0)


# --- retagging ----------------------------------------------------------------------------

def _intent(text: Column, df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_det", tx.detection_text(text)).withColumn(name, alias(F.expr(ft.intent("_det")), lx.TYPE_ALIASES)).drop("_det")


def retag_types(bank: DataFrame) -> DataFrame:
    """Detected type next to the stored one; tags follow the new type (at most eight)."""
    made = _intent(F.col("problem"), bank, "detected_type").withColumn("old_type", non_empty(tx.type_label(F.col("type"))))
    changed = ~F.col("old_type").eqNullSafe(F.col("detected_type"))
    kept = F.array_remove(tx.label_list(F.col("tags")), F.coalesce("old_type", F.lit("")))
    synced = F.slice(F.array_union(kept, F.array("detected_type")), 1, 8)
    return made.withColumns({
        "type_changed": changed,
        "type": F.col("detected_type"),
        "tags": F.when(changed & F.col("tags").isNotNull(), synced).otherwise(F.col("tags")),
    })


def retag_difficulties(bank: DataFrame) -> DataFrame:
    """Target difficulty: stored label, else the bucket it sits in, else complexity, else intermediate."""
    made = bank.withColumns({"source_bucket": tx.bank_difficulty(F.col("bucket")), "_own": tx.bank_difficulty(F.col("difficulty"))})
    made = made.withColumns({"_low": F.lower("problem"), "_words": tx.word_count(F.col("problem"))})
    level = F.expr(ft.complexity("_low", "_words", "subject")).cast("double")
    by_text = F.when(F.col("problem") != "", tx.level_label(level))
    target = F.coalesce("_own", "source_bucket", by_text, F.lit("intermediate"))
    return made.withColumn("target", target).withColumns({
        "relabelled": ~F.col("difficulty").eqNullSafe(F.col("target")),
        "moved": F.coalesce(F.col("source_bucket") != F.col("target"), F.lit(False)),
    }).drop("_own", "_low", "_words")


def regroup(bank: DataFrame, path: str) -> DataFrame:
    """Write the bank by subject and target difficulty, every entry relabelled; returns the retagged rows.

    Entries are JSON lines below ``subject=…/bucket=…``, so a bucket is read without the others. Rows are dealt by bucket
    before they are written, large ones over several tasks: otherwise every task opens a file in every bucket.
    """
    retagged = retag_difficulties(bank)
    made = retagged.withColumns({"difficulty": F.col("target"), "bucket": F.col("target")}).drop("source_bucket", "target", "relabelled", "moved")
    dealt = made.hint("rebalance", F.col("subject"), F.col("bucket"))
    dealt.write.mode("overwrite").partitionBy("subject", "bucket").json(path)
    return retagged


def transition_report(changes: DataFrame, old: str, new: str, most: int = 20) -> DataFrame:
    """The most frequent changes (a top-k report)."""
    return changes.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "old", "new"
    ).limit(most)


def bucket_report(retagged: DataFrame) -> DataFrame:
    """Entries per source and target bucket."""
    return retagged.groupBy(F.coalesce("source_bucket", F.lit("(list)")).alias("source_bucket"), "target").agg(
        F.count("*").alias("n"), F.count_if("moved").alias("moved"), F.count_if("relabelled").alias("relabelled")
    )


def cleaning_report(bank: DataFrame) -> DataFrame:
    """Cleaned texts, whether they changed, and the first line that differs (0 when none does)."""

    def first_change(old: Column, new: Column) -> Column:
        lines = F.zip_with(F.split(old, tx.LINE_BREAK), F.split(new, tx.LINE_BREAK), lambda a, b: ~a.eqNullSafe(b))
        return F.when(old == new, F.lit(0)).otherwise(F.greatest(F.array_position(lines, F.lit(True)), F.lit(1)))

    made = bank
    for field, is_solution in (("problem", False), ("solution", True)):
        clean = tx.example_text(F.col(field), is_solution, drop_repeats=False, keep_blocks=True)
        made = made.withColumn(f"clean_{field}", clean)
        made = made.withColumn(f"{field}_first_change", first_change(F.col(field), F.col(f"clean_{field}")))
    return made


def cleaning_counts(report: DataFrame) -> DataFrame:
    """Entries, changed entries and the earliest line that differs, per field."""
    long = report.select(F.explode(F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(f"{field}_first_change").alias("line")) for field in ("problem", "solution")
    ])).alias("c")).select("c.*")
    return long.groupBy("field").agg(
        F.count("*").alias("entries"), F.count_if(F.col("line") > 0).alias("changed"), F.min(F.when(F.col("line") > 0, F.col("line"))).cast("long").alias("first_line")
    )


# --- metadata upgrade -------------------------------------------------------------------------

def _concept(intent: Column, structure: Column, marks: Column, limits: Column, words: Column) -> Column:
    def feature(name: str) -> Column:
        return F.array_contains(structure, name)

    return (
        F.when(intent == "evaluate_substitution", F.when(feature("multi_assignment"), "multi_variable_expression_evaluation").otherwise("single_variable_expression_evaluation"))
        .when(intent == "real_solutions", F.when(marks["has_x4"], "quartic_real_roots").when(marks["has_x3"], "cubic_real_roots").when(marks["has_x2"], "quadratic_real_roots").otherwise("real_solution_equation"))
        .when(
            intent == "solve_equation",
            F.when(marks["has_system"], "system_of_equations_solving").when(marks["has_x4"], "quartic_equation_solving")
            .when(marks["has_x3"], "cubic_equation_solving").when(marks["has_x2"], "quadratic_equation_solving")
            .when(feature("fraction"), "rational_equation_solving").otherwise("linear_equation_solving"),
        )
        .when(intent == "percent", F.when(F.array_contains(limits, "positive_values"), "percent_difference_comparison").otherwise("percent_application"))
        .otherwise(F.coalesce(
            lookup(intent, lx.CONCEPT_BY_INTENT),
            F.when(words >= 14, "word_problem_reasoning").when(feature("exponent"), "exponent_expression_evaluation")
            .when(feature("fraction"), "fraction_expression_evaluation").otherwise("algebraic_expression_evaluation"),
        ))
    )


def _template(intent: Column, structure: Column, marks: Column, assigned: Column, words: Column) -> Column:
    substituted = F.array_contains(structure, "substitution")
    return (
        F.when(intent == "conditional_probability", "conditional_probability_statement")
        .when(intent.isin("counting_arrangements", "expected_value", "probability") & (words >= 10), "counting_probability_word_problem")
        .when(marks["has_system"], "system_of_equations")
        .when(substituted & (assigned >= 2), "expression_with_assignments")
        .when(substituted, "single_assignment_expression")
        .when(marks["has_equation"], "single_equation")
        .when(words >= 14, "word_problem")
        .otherwise("direct_expression")
    )


def upgrade_metadata(bank: DataFrame) -> DataFrame:
    """Fill in type, constraints, concept, skills, template, difficulty, tags and anchor priority.

    Stored values win; lists are stored values first. Needs subject, bucket,
    problem, solution, type, concept, skills, template, constraints,
    difficulty, tags and anchor_priority.
    """
    both = F.lower(F.concat_ws(" ", "problem", "solution"))
    made = bank.withColumns({"_low": F.lower("problem"), "_both": both, "_words": tx.word_count(F.col("problem"))})
    made = made.withColumn("_marked", F.expr(ft.low_powers("_low")))
    made = _intent(F.col("problem"), made, "_found").withColumns({
        "_structure": F.expr(ft.structural_features("_both")),
        "_marks": F.expr(ft.equation_marks("_marked")),
        "_assigned": F.size(F.expr(ft.assigned_variables("_low"))),
        "_limits": F.array_sort(F.array_union(F.coalesce(tx.constraint_labels(F.col("constraints")), F.expr(NO_LABELS)), F.expr(ft.constraints("_low")))),
        "_complexity": F.expr(ft.complexity("_low", "_words", "subject")),
        "_solution_words": tx.word_count(F.col("solution")),
    })
    made = made.withColumn("_intent", F.coalesce(non_empty(tx.type_label(F.col("type"))), F.col("_found")))
    intent, structure, marks, limits = F.col("_intent"), F.col("_structure"), F.col("_marks"), F.col("_limits")
    level = F.coalesce(
        tx.difficulty_level(tx.difficulty_label(F.col("difficulty"))), tx.difficulty_level(tx.difficulty_label(F.col("bucket"))), F.col("_complexity").cast("double")
    )
    skill_map = "map(" + ",".join(f"{quoted(k)}, array({','.join(quoted(x) for x in v)})" for k, v in lx.SKILLS_BY_INTENT.items()) + ")"
    by_feature = F.array_compact(F.array(*[F.when(F.array_contains(structure, f), F.lit(s)) for f, s in lx.SKILLS_BY_FEATURE]))
    inferred = F.concat(
        F.coalesce(F.element_at(F.expr(skill_map), intent), F.expr(NO_LABELS)), by_feature,
        F.when(F.size(limits) > 0, F.array(F.lit("constraint_filtering"))).otherwise(F.expr(NO_LABELS)),
    )
    inferred = F.slice(F.array_distinct(inferred), 1, 4)
    inferred = F.when(F.size(inferred) == 0, F.array(F.lit("algebraic_reasoning"))).otherwise(inferred)
    powers = F.array_compact(F.array(*[F.when(marks[m], F.lit(n)) for m, n in (("has_x4", "quartic"), ("has_x3", "cubic"), ("has_x2", "quadratic"))]))
    by_text = F.concat(
        F.array(F.replace("subject", F.lit("-"), F.lit("_")), intent), F.filter(words_literal(lx.TAG_FEATURES), lambda t: F.array_contains(structure, t)), powers, limits,
    )
    by_text = F.slice(F.array_distinct(by_text), 1, 8)
    difficulty = F.coalesce(tx.level_label(level), F.lit("intermediate"))
    telling = F.size(F.array_intersect(structure, words_literal(["substitution", "fraction", "exponent", "probability", "derivative", "integral"])))

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    heavy = marks["has_system"] | marks["has_x4"] | F.array_contains(structure, "conditional_probability")
    score = reduce(lambda a, b: a + b, [
        F.lit(0.58), points(intent != "general", 0.08), points(F.size(limits) > 0, 0.08), points(heavy, 0.08), points(F.col("_assigned") >= 2, 0.06),
        points(telling >= 2, 0.04), points(F.col("_solution_words").between(15, 180), 0.04), points(difficulty == "advanced", 0.05), points(difficulty == "basic", -0.02),
    ])
    anchor = F.coalesce(tx.anchor_priority(F.col("anchor_priority")), rounded(F.greatest(F.lit(0.50), F.least(F.lit(0.97), score)), 2))
    kept = [c for c in bank.columns if c not in ("type", "constraints", "concept", "skills", "template", "difficulty", "tags", "anchor_priority")]
    return made.select(
        *kept,
        intent.alias("type"),
        limits.alias("constraints"),
        F.coalesce(F.get(tx.label_list(F.col("concept")), F.lit(0)), _concept(intent, structure, marks, limits, F.col("_words"))).alias("concept"),
        F.slice(F.array_union(tx.label_list(F.col("skills")), inferred), 1, 4).alias("skills"),
        F.coalesce(non_empty(tx.label(F.col("template"))), _template(intent, structure, marks, F.col("_assigned"), F.col("_words"))).alias("template"),
        F.expr("(length(problem) - length(replace(problem, '=', '')))").alias("equation_count"),
        F.col("_assigned").alias("assigned_variable_count"),
        F.array_contains(structure, "fraction").alias("has_fraction"),
        F.array_contains(structure, "exponent").alias("has_exponent"),
        marks["has_system"].alias("has_system"),
        difficulty.alias("difficulty"),
        F.slice(F.array_union(tx.label_list(F.col("tags")), by_text), 1, 8).alias("tags"),
        anchor.alias("anchor_priority"),
    )


# --- user examples --------------------------------------------------------------------------------

def _user_label(value: Column) -> Column:
    """A label as it is stored for user examples; a blank one stays empty, which B2 refuses."""
    return F.replace(lower_strip(value), F.lit(" "), F.lit("_"))


def _user_entry() -> Column:
    """The entry that would be stored for a new example, as B2 judges it."""
    kind = _user_label(F.col("type"))
    return F.to_json(F.struct(
        strip(F.col("problem")).alias("problem"), strip(F.col("solution")).alias("solution"), kind.alias("type"), _user_label(F.col("concept")).alias("concept"),
        F.array(kind).alias("skills"), F.col("difficulty"), F.array(F.col("subject"), kind).alias("tags"), F.expr(NO_LABELS).alias("constraints"),
        F.lit(0.8).alias("anchor_priority"),
    ))


def add_user_examples(new: DataFrame, user: DataFrame, curated: DataFrame, now: float, ttl: float = 3 * 24 * 3600.0) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) new examples.

    An example is refused for an unknown subject or difficulty, blank or
    oversized texts, a rule of B2 that the stored entry would break, or a
    problem already in the same subject and difficulty of either bank (or
    accepted earlier in the batch). User examples that have expired at ``now``
    are no longer in the bank.
    """
    place = ["subject", "difficulty", "_key"]
    asked = new.withColumn("_key", lower_strip(F.col("problem")))
    user = live(user, now) if "expires_at" in user.columns else user

    def known(bank: DataFrame, flag: str) -> DataFrame:
        return bank.select("subject", "difficulty", lower_strip(F.col("problem")).alias("_key")).distinct().withColumn(flag, F.lit(True))

    met = asked.join(known(user, "_in_user"), place, "left").join(known(curated, "_in_curated"), place, "left")
    fits = tx.within_limits("problem", "solution", "type", "concept")
    reason = (
        F.when(~F.col("subject").isin(*lx.DOMAINS), "invalid_subject")
        .when(~F.col("difficulty").isin(*lx.DIFFICULTIES), "invalid_difficulty")
        .when((strip(F.col("problem")) == "") | (strip(F.col("solution")) == ""), "blank_text")
        .when(~fits, "size_limit")
        .when(F.size(broken_rules(_user_entry())) > 0, "invalid_entry")
        .when(F.col("_in_user").isNotNull(), "duplicate_user")
        .when(F.col("_in_curated").isNotNull(), "duplicate_curated")
    )
    # only an example that nothing else speaks against makes a later one a duplicate
    reasons = met.withColumn("reason", reason)
    first = reasons.where("reason is null").groupBy(*place).agg(F.min("pos").alias("_first"))
    judged = reasons.join(first, place, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("pos") > F.col("_first"), "duplicate_user")))
    kind = _user_label(F.col("type"))
    accepted = judged.where("reason is null").select(
        "pos", strip(F.col("problem")).alias("problem"), strip(F.col("solution")).alias("solution"), "subject", "difficulty", kind.alias("type"),
        _user_label(F.col("concept")).alias("concept"), F.array(kind).alias("skills"), F.lit("single_equation").alias("template"),
        F.array(F.col("subject"), kind).alias("tags"), F.expr(NO_LABELS).alias("constraints"), F.lit(0.8).alias("anchor_priority"),
        F.timestamp_seconds(F.lit(float(now))).alias("created_at"), F.lit(float(now) + float(ttl)).alias("expires_at"),
    )
    return accepted, judged.where("reason is not null").select("pos", "subject", "difficulty", "problem", "reason")


def purge_counts(examples: DataFrame, now: float) -> DataFrame:
    """Kept and removed examples per subject and difficulty."""
    alive = F.coalesce(F.col("expires_at"), F.lit(float("inf"))) > F.lit(float(now))
    return examples.groupBy("subject", "difficulty").agg(F.count_if(alive).alias("kept"), F.count_if(~alive).alias("removed"))


def listing(examples: DataFrame, now: float) -> DataFrame:
    """Live user examples with the hours they have left (null: for ever)."""
    left = rounded((F.col("expires_at") - F.lit(float(now))) / 3600.0, 1)
    return examples.where(F.coalesce(F.col("expires_at"), F.lit(float("inf"))) > F.lit(float(now))).select(
        "subject", "difficulty", "problem", "type", F.timestamp_seconds("expires_at").alias("expires_at"), left.alias("ttl_remaining_hours")
    )


# --- response chunks --------------------------------------------------------------------------------

def overlap(tail: Column, new: Column, window: int = 500) -> Column:
    """The longest beginning of ``new``, up to ``window``, with which ``tail`` ends."""

    def longest(letters: Column) -> Column:
        last = F.substring(tail, -1, 1)
        most = F.least(F.length(tail), F.size(letters))
        # a beginning is compared only where its last character is the tail's
        fits = F.filter(F.sequence(most, F.lit(0), F.lit(-1)), lambda k: (k > 0) & (F.get(letters, k - 1) == last) & F.endswith(tail, F.array_join(F.slice(letters, 1, k), "")))
        return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))

    head = F.substring(new, 1, window)
    return F.when((F.length(tail) > 0) & (F.length(new) > 0), let(F.split(head, ""), longest)).otherwise(0)


#: Chunks of a response that are joined at a time, so that what is carried from chunk to chunk stays short.
CHUNKS = 256


def stitch(chunks: DataFrame, key: str, order: str, text: str, window: int = 500) -> DataFrame:
    """The whole response of each call; each chunk is appended without the part that repeats the end of the text so far.

    A call is one response, so its chunks fit one value. Only the end of the text goes from chunk to chunk; the pieces are
    joined CHUNKS at a time, and these once at the end, so the time is linear in the chunks.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, text)))
    listed = chunks.groupBy(key).agg(rows.alias("_rows"))
    listed = listed.select(key, F.transform("_rows", lambda r: F.coalesce(r[text], F.lit(""))).alias("_texts"))
    nothing = F.expr("cast(array() as array<string>)")

    def add(acc: Column, new: Column) -> Column:
        def added(k: Column) -> Column:
            piece = F.substr(new, k + 1)
            tail = F.substring(F.concat(acc["tail"], F.substring(piece, -window, window)), -window, window)
            return F.struct(tail.alias("tail"), F.array_append(acc["pieces"], piece).alias("pieces"))

        return let(overlap(acc["tail"], new, window), added)

    def block(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(F.col("_texts"), b * CHUNKS + 1, CHUNKS), F.struct(acc["tail"].alias("tail"), nothing.alias("pieces")), add)
        return let(own, lambda s: F.struct(s["tail"].alias("tail"), F.array_append(acc["blocks"], F.array_join(s["pieces"], "")).alias("blocks")))

    blocks = F.sequence(F.lit(0), F.floor((F.size("_texts") - 1) / CHUNKS).cast("int"))
    whole = F.aggregate(blocks, F.struct(F.lit("").alias("tail"), nothing.alias("blocks")), block, lambda acc: F.array_join(acc["blocks"], ""))
    return listed.select(key, whole.alias("response"), F.size("_texts").alias("chunks"))
