"""Tagging jobs: one pass over a table of problems adds label columns.

Everything is a projection: no shuffle except the optional join with the
type-to-subject map of an example bank. Store the tagged table (or use
``session.durable``) before filtering on its labels: a filter on a derived
column is pushed below the projection and would evaluate the rules twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import features as ft
from gaugeline.functions import lexicon as lx
from gaugeline.functions import scope as sc
from gaugeline.functions import text as tx
from gaugeline.functions.basics import alias, let, strip

LOW, DET = "_low", "_det"


def _with_bases(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({LOW: F.lower(F.coalesce(F.col(text), F.lit(""))), DET: tx.detection_text(F.col(text))})


def with_feature_tags(df: DataFrame, text: str, rules: str = "history", name: str = "features") -> DataFrame:
    """Tags by the ``history`` or ``bank`` rule set, and the sorted key of its type tags."""
    table = lx.FEATURES_HISTORY if rules == "history" else lx.FEATURES_BANK
    types = lx.TYPE_FEATURES_HISTORY if rules == "history" else lx.TYPE_FEATURES_BANK
    tagged = df.withColumn(LOW, F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn(name, F.expr(ft.feature_tags(LOW, table)))
    key = F.array_join(F.array_sort(F.array_intersect(F.col(name), F.lit(types))), "|")
    return tagged.withColumn("type_key", key).drop(LOW)


def with_structure(df: DataFrame, text: str) -> DataFrame:
    """Structural labels of the text column."""
    based = _with_bases(df, text).withColumn("_powers", F.expr(ft.low_powers(LOW)))
    tagged = based.withColumns({
        "structure": F.expr(ft.structural_features(LOW)),
        "marks": F.expr(ft.equation_marks("_powers")),
        "keywords": F.expr(ft.keyword_hits(LOW)),
        "operations": F.expr(ft.operation_markers(LOW)),
        "assigned": F.expr(ft.assigned_variables(LOW)),
        "family": F.expr(ft.equation_family(DET)),
        "constraint_labels": F.expr(ft.constraints(LOW)),
    })
    return tagged.withColumn("format_labels", F.expr(ft.format_label_rules(LOW, "structure", "marks"))).drop(LOW, DET, "_powers")


def with_intent(df: DataFrame, text: str, name: str = "intent") -> DataFrame:
    """Primary intent."""
    return df.withColumn(DET, tx.detection_text(F.col(text))).withColumn(name, F.expr(ft.intent(DET))).drop(DET)


def with_detectors(df: DataFrame, text: str) -> DataFrame:
    """The yes-no detectors."""
    return _with_bases(df, text).withColumns({
        "labelled_options": F.expr(ft.labelled_options(LOW)),
        "compares_values": F.expr(ft.compares_values(LOW)),
        "rate_problem": F.expr(ft.rate_problem(LOW)),
        "conditional_question": F.expr(ft.conditional_question(LOW)),
        "looks_algebraic": F.expr(ft.looks_algebraic(DET)),
    }).drop(LOW, DET)


def type_subjects(bank: DataFrame) -> DataFrame:
    """Subject of each example type; the last example in bank order decides."""
    return (
        bank.where(F.col("type").isNotNull())
        .groupBy("type")
        .agg(F.max(F.struct("pos", "subject")).getField("subject").alias("mapped_subject"))
    )


def with_subject(df: DataFrame, text: str, type_map: DataFrame | None = None, name: str = "subject") -> DataFrame:
    """Subject of a problem.

    ``type_map`` (type, mapped_subject) is the bank's own view and wins over
    the fixed intent sets. It has one row per example type; the join strategy
    is left to the optimizer, which sees its real size.
    """
    points = sc.subject_points(DET)
    tagged = df.withColumn(DET, tx.detection_text(F.col(text))).withColumn("_intent", F.expr(ft.intent(DET)))
    tagged = tagged.withColumn("_label", alias(F.col("_intent"), lx.TYPE_ALIASES))
    mapped = F.lit(None).cast("string")
    if type_map is not None:
        plain = type_map.select(F.col("type").alias("_intent"), F.col("mapped_subject").alias("_by_intent"))
        aliased = type_map.select(F.col("type").alias("_label"), F.col("mapped_subject").alias("_by_label"))
        tagged = tagged.join(plain, "_intent", "left").join(aliased, "_label", "left")
        mapped = F.when(F.col("_intent") != "general", F.coalesce("_by_intent", F.when(F.col("_label") != F.col("_intent"), F.col("_by_label"))))
    tagged = tagged.withColumns({f"_{k[:3]}": F.expr(v) for k, v in points.items()})
    by_points = F.expr(sc.subject_by_points(DET, "_pre", "_cou", "_alg"))
    found = F.coalesce(
        mapped,
        F.expr(sc.subject_by_intent("_intent")),
        F.when(F.expr(ft.looks_algebraic(DET)), F.lit("algebra")),
        by_points,
    )
    made = tagged.withColumn(name, found)
    return made.drop(DET, "_intent", "_label", "_by_intent", "_by_label", "_pre", "_cou", "_alg")


def with_form_labels(df: DataFrame, text: str) -> DataFrame:
    """Subject and difficulty as the input form proposes them, and word-count difficulty."""
    words = tx.word_count(F.col(text))
    return (
        _with_bases(df, text)
        .withColumn("form_subject", F.expr(sc.form_subject(DET)))
        .withColumn("form_points", F.expr(sc.form_difficulty_points(text, LOW, "form_subject")))
        .withColumn("form_difficulty", F.when(F.col("form_points") >= 6, "advanced").when(F.col("form_points") >= 3, "intermediate").otherwise("basic"))
        .withColumn("length_difficulty", F.when(words <= 15, "basic").when(words <= 30, "intermediate").otherwise("advanced"))
        .drop(LOW, DET)
    )


def with_complexity(df: DataFrame, text: str, subject: str, name: str = "complexity") -> DataFrame:
    """Complexity 1-3."""
    return (
        df.withColumn(LOW, F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_words", tx.word_count(F.col(text)))
        .withColumn(name, F.expr(ft.complexity(LOW, "_words", subject)))
        .drop(LOW, "_words")
    )


def with_signals(df: DataFrame, text: str) -> DataFrame:
    """Signal scores per domain, the inferred domain and its gap to the second."""
    based = df.withColumn(LOW, F.lower(strip(F.coalesce(F.col(text), F.lit(""))))).withColumn("_tokens", F.expr(sc.letter_words(LOW)))
    scores = sc.signal_scores(LOW, "_tokens")
    based = based.withColumns({
        "signal_algebra": F.expr(scores["algebra"]),
        "signal_precalculus": F.expr(scores["pre-calculus"]),
        "signal_counting": F.expr(scores["counting-probability"]),
    })
    ranked = F.expr(
        "array_sort(array(named_struct('s', -signal_algebra, 'd', 'algebra'),"
        " named_struct('s', -signal_counting, 'd', 'counting-probability'),"
        " named_struct('s', -signal_precalculus, 'd', 'pre-calculus')))"
    )

    def summary(r: Column) -> Column:
        top, gap = -r[0]["s"], r[1]["s"] - r[0]["s"]
        domain = F.when((top >= 2) & (gap >= 1), r[0]["d"])
        return F.struct(domain.alias("domain"), F.when(top <= 0, F.lit(0)).otherwise(gap).alias("gap"))

    based = based.withColumn("_signal", let(ranked, summary))
    return based.withColumns({"signal_domain": F.col("_signal.domain"), "signal_gap": F.col("_signal.gap")}).drop("_signal", "_tokens", LOW)


def resolve_domains(df: DataFrame, text: str, requested: str, type_map: DataFrame | None = None) -> DataFrame:
    """Effective domain of each problem, or why it is refused.

    Adds ``domain`` (null when refused) and ``domain_source``.
    """
    tagged = with_signals(with_subject(df, text, type_map, name="_detected"), text)
    tagged = _with_bases(tagged, text)
    tagged = tagged.withColumns({
        "_tokens": F.expr(sc.letter_words(LOW)),
        "_intent": F.expr(ft.intent(DET)),
        "_wanted_raw": strip(F.coalesce(F.col(requested), F.lit(""))),
        "_wanted": tx.domain_label(F.col(requested)),
        "_structure": F.expr(ft.structural_features(DET)),
    })
    tagged = tagged.withColumn("_special", F.expr(sc.special_case(LOW, "_intent")))
    evidence = sc.direct_evidence(LOW)
    tagged = tagged.withColumns({
        "_in_scope": (strip(F.col(LOW)) != "") & (F.expr(sc.math_signal(LOW, "_tokens")) | (F.col("_intent") != "general") | (F.size("_structure") > 0)),
        "_geometry": F.expr(sc.pure_geometry("_tokens", "_special")),
        "_outside": F.expr(sc.outside_math(LOW, "_tokens", "_special")),
        "_direct": F.coalesce(
            *[F.when(F.col("_wanted") == d, F.expr(evidence[d])) for d in lx.DOMAINS], F.lit(False)
        ),
    })
    facts = F.struct("_wanted_raw", "_wanted", "_detected", "signal_domain", "signal_gap", "_in_scope", "_geometry", "_outside", "_direct")
    made = tagged.withColumn("_decision", let(facts, _decide))
    return made.withColumns({"domain": F.col("_decision.domain"), "domain_source": F.col("_decision.source")}).withColumnRenamed(
        "_detected", "detected_subject"
    ).drop(
        LOW, DET, "_tokens", "_intent", "_wanted_raw", "_wanted", "_structure", "_special", "_in_scope", "_geometry", "_outside", "_direct", "_decision"
    )


def _decide(f: Column) -> Column:
    """Outcome of the gathered facts. The facts are bound once, so filters on the result stay small."""
    wanted, detected, signal, direct = f["_wanted"], f["_detected"], f["signal_domain"], f["_direct"]
    supported = wanted.isin(*lx.DOMAINS)
    other = detected.isin(*lx.DOMAINS) & (detected != wanted)
    clash = signal.isNotNull() & (signal != wanted) & (f["signal_gap"] >= 2) & other & ~direct
    disagrees = other & ~direct & ~F.coalesce(signal == wanted, F.lit(False))
    unsure = (detected == "general") & signal.isNull() & ~direct
    nothing = F.lit(None).cast("string")

    def outcome(source: str, domain: Column = nothing) -> Column:
        return F.struct(domain.alias("domain"), F.lit(source).alias("source"))

    return (
        F.when((f["_wanted_raw"] != "") & ~supported & (wanted != "general"), outcome("explicit_subject_unsupported"))
        .when(~f["_in_scope"], outcome("out_of_scope_problem"))
        .when(f["_geometry"], outcome("pure_geometry_out_of_scope"))
        .when(supported & F.coalesce(clash, F.lit(False)), outcome("subject_mismatch_signal"))
        .when(supported & disagrees, outcome("subject_mismatch"))
        .when(supported & f["_outside"], outcome("out_of_domain_math"))
        .when(supported & unsure, outcome("ambiguous_requested_subject"))
        .when(supported, outcome("request_subject", wanted))
        .when(signal.isNotNull(), outcome("auto_detected_signal", signal))
        .when(detected.isin(*lx.DOMAINS), outcome("auto_detected", detected))
        .otherwise(outcome("unsupported_detected"))
    )


def scope_flags(df: DataFrame, text: str) -> DataFrame:
    """The single guard flags."""
    based = _with_bases(df, text).withColumns({"_intent": F.expr(ft.intent(DET)), "_tokens": F.expr(sc.letter_words(LOW))})
    based = based.withColumn("special_case", F.expr(sc.special_case(LOW, "_intent")))
    evidence = sc.direct_evidence(LOW)
    return based.withColumns({
        "math_signal": F.expr(sc.math_signal(LOW, "_tokens")),
        "pure_geometry": F.expr(sc.pure_geometry("_tokens", "special_case")),
        "outside_math": F.expr(sc.outside_math(LOW, "_tokens", "special_case")),
        "evidence_algebra": F.expr(evidence["algebra"]),
        "evidence_precalculus": F.expr(evidence["pre-calculus"]),
        "evidence_counting": F.expr(evidence["counting-probability"]),
    }).drop(LOW, DET, "_intent", "_tokens")


def baseline_domain(df: DataFrame, text: str, requested: str, type_map: DataFrame | None = None) -> DataFrame:
    """T21, baseline variant: label, else signal, else classifier, else ``general``."""
    tagged = with_signals(with_subject(df, text, type_map, name="_detected"), text)
    wanted = tx.domain_label(F.col(requested))
    found = F.coalesce(
        F.when(wanted.isin(*lx.DOMAINS), wanted), F.col("signal_domain"),
        F.when(F.col("_detected").isin(*lx.DOMAINS), F.col("_detected")), F.lit("general"),
    )
    return tagged.withColumn("domain", found).drop("_detected", "signal_domain", "signal_gap", "signal_algebra", "signal_precalculus", "signal_counting")


def with_profile(df: DataFrame, text: str, domain: str, difficulty: str) -> DataFrame:
    """Problem profile struct of the problem text."""
    based = df.withColumn("_ptext", F.lower(tx.problem_text(F.col(text))))
    tagged = with_structure(with_intent(based, "_ptext", "_pintent"), "_ptext")
    profile = F.struct(
        tx.key(F.col(domain), "general").alias("subject"),
        tx.key(F.col(difficulty), "basic").alias("difficulty"),
        alias(F.col("_pintent"), lx.TYPE_ALIASES).alias("intent"),
        F.col("structure").alias("features"),
        F.col("format_labels").alias("format_labels"),
        F.col("constraint_labels").alias("constraints"),
    )
    return tagged.withColumn("profile", profile).select(*df.columns, "profile")


def strict_matching(intent: Column, subject: Column) -> Column:
    """Strict few-shot matching applies to the three core domains and known intents."""
    return F.lower(strip(subject)).isin(*lx.DOMAINS) & (alias(intent, lx.TYPE_ALIASES) != "general")


def external_labels(payload: Column) -> Column:
    """Labels found in a classifier's answer text, null when any of them is not allowed."""
    body = F.regexp_extract(payload, r"(?s)(\{[^}]+\})", 1)
    parsed = F.from_json(body, "subject string, type string, concept string, difficulty string")
    subject = F.lower(strip(parsed["subject"]))
    difficulty = F.lower(strip(parsed["difficulty"]))
    kind, concept = tx.key(parsed["type"]), tx.key(parsed["concept"])
    fine = subject.isin(*lx.DOMAINS) & difficulty.isin(*lx.DIFFICULTIES) & kind.isNotNull() & concept.isNotNull()
    return F.when(fine, F.struct(subject.alias("subject"), kind.alias("type"), concept.alias("concept"), difficulty.alias("difficulty")))


def analyse_examples(df: DataFrame, text: str, payload: str, type_map: DataFrame | None = None) -> DataFrame:
    """Labels of new examples: checked external labels first, rule labels otherwise."""
    tagged = with_form_labels(with_intent(with_subject(df, text, type_map, "_subject"), text, "_intent"), text)
    tagged = tagged.withColumn("_ext", external_labels(F.col(payload)))
    subject = F.coalesce(F.col("_ext.subject"), F.col("_subject"))
    return tagged.select(
        *df.columns,
        F.when(subject.isin(*lx.DOMAINS), subject).otherwise("algebra").alias("detected_subject"),
        F.coalesce(F.col("_ext.type"), F.col("_intent")).alias("detected_type"),
        F.coalesce(F.col("_ext.difficulty"), F.col("length_difficulty")).alias("detected_difficulty"),
        F.coalesce(F.col("_ext.concept"), F.col("_intent")).alias("detected_concept"),
        F.when(F.col("_ext").isNotNull(), "external").otherwise("rules").alias("detection_method"),
    )
