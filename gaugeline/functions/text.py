"""Text and label normalisers as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import lexicon as lx
from gaugeline.functions.basics import (
    alias, let, lookup, lower_strip, non_empty, strip, words_literal,
)

SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
LINE_BREAK = r"[\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"


# --- labels -------------------------------------------------------------------

def domain_label(value: Column) -> Column:
    """Alias to canonical domain; the dashed, plain and compact forms are tried in turn."""
    plain = F.coalesce(lower_strip(value), F.lit(""))
    compact = F.replace(F.translate(plain, " _-", ""), F.lit("&"), F.lit("and"))
    return F.coalesce(
        lookup(F.replace(plain, F.lit(" "), F.lit("-")), lx.DOMAIN_ALIASES),
        lookup(plain, lx.DOMAIN_ALIASES),
        lookup(compact, lx.DOMAIN_ALIASES),
        plain,
    )


def subject_label(value: Column) -> Column:
    """Alias to canonical subject; empty gives ``general``."""
    empty = value.isNull() | (value == "")
    return F.when(empty, F.lit("general")).otherwise(alias(lower_strip(value), lx.SUBJECT_ALIASES))


def key(value: Column, default: str | None = None) -> Column:
    """Trimmed lower-case key with underscores for spaces."""
    cleaned = non_empty(F.replace(lower_strip(value.cast("string")), F.lit(" "), F.lit("_")))
    return cleaned if default is None else F.coalesce(cleaned, F.lit(default))


def label(value: Column) -> Column:
    """snake_case label."""
    return F.btrim(F.regexp_replace(lower_strip(value), "[^a-z0-9]+", "_"), F.lit("_"))


def label_list(values: Column, ordered: bool = False) -> Column:
    """P5: distinct labels of an array, in first-seen order (or sorted)."""
    made = F.transform(F.filter(values, lambda v: v.isNotNull()), label)
    kept = F.array_distinct(F.filter(made, lambda v: v != ""))
    kept = F.coalesce(kept, F.expr("cast(array() as array<string>)"))
    return F.array_sort(kept) if ordered else kept


def type_label(value: Column) -> Column:
    """Canonical type label."""
    return alias(label(value), lx.TYPE_ALIASES)


def constraint_labels(values: Column) -> Column:
    """Canonical constraint labels, first-seen order."""
    return F.array_distinct(F.transform(label_list(values), lambda v: alias(v, lx.CONSTRAINT_ALIASES)))


def _numeral(value: Column) -> Column:
    """Text of a positive number, whole numbers without a fraction; null when not a number."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    whole = number == F.floor(number)
    return F.when(number > 0, F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string")))


def difficulty_label(value: Column, numeric: Column | None = None) -> Column:
    """Canonical difficulty; ``numeric`` marks rows whose source value was a number."""
    words = let(non_empty(label(value)), lambda v: alias(v, lx.DIFFICULTY_ALIASES))
    if numeric is None:
        return words
    return F.when(numeric, _numeral(value)).otherwise(words)


def difficulty_level(value: Column) -> Column:
    """Level 1-3 of a canonical difficulty label or of a number in text form."""

    def scaled(number: Column) -> Column:
        return (
            F.when(number <= 0, F.lit(None).cast("double"))
            .when(number <= 3, number)
            .when(number.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(3.0), 1.0 + (number - 1.0) / 2.0)))
        )

    def level(text: Column) -> Column:
        return (
            F.when(text == "basic", F.lit(1.0))
            .when(text == "intermediate", F.lit(2.0))
            .when(text == "advanced", F.lit(3.0))
            .otherwise(let(text.try_cast("double"), scaled))
        )

    return let(value, level)


def level_label(level: Column) -> Column:
    """Difficulty label of a level."""
    return let(level, lambda x: F.when(x <= 1.5, "basic").when(x <= 2.5, "intermediate").when(x.isNotNull(), "advanced"))


def bank_difficulty(value: Column) -> Column:
    """P6/P9 for bank files: extra aliases first, then labels and numeric scales.

    Every step is used several times by the next, so each is bound once: written out, the steps multiply to an expression
    that is too large to be compiled.
    """
    aliased = let(non_empty(label(value)), lambda v: alias(v, lx.DIFFICULTY_ALIASES_BANK))

    def judge(known: Column) -> Column:
        number = value.try_cast("double")
        level = F.when(number > 0, difficulty_level(number.cast("string"))).otherwise(difficulty_level(known))
        return F.when(known.isin(*lx.DIFFICULTIES), known).otherwise(level_label(level))

    return let(difficulty_label(aliased), judge)


def anchor_priority(value: Column) -> Column:
    """P10: priority in [0, 1]; 0-10 and 0-100 scales are accepted."""
    number = value.try_cast("double")
    scaled = F.when(number < 0, F.lit(0.0)).when(number <= 1, number).when(number <= 10, number / 10.0).otherwise(number / 100.0)
    return F.when(number.isNotNull(), F.least(F.lit(1.0), scaled))


def format_entries(text: Column) -> Column:
    """A format field (JSON text, list or bare word) as normalised (key, kind, labels) entries."""
    value = F.try_parse_json(text)
    pairs = F.map_entries(text_map(text))

    def entry(pair: Column) -> Column:
        item = F.try_parse_json(pair["value"])
        kind = F.coalesce(F.schema_of_variant(item), F.lit("STRING"))
        many = F.when(kind.startswith("ARRAY"), F.from_json(pair["value"], "array<string>")).otherwise(F.array(F.coalesce(F.try_variant_get(item, "$", "string"), pair["value"])))
        scalar = kind.isin("BOOLEAN", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        return F.struct(
            label(pair["key"]).alias("key"),
            F.when(scalar, F.lower(kind)).otherwise("text").alias("kind"),
            F.when(scalar, F.array(pair["value"])).otherwise(label_list(many)).alias("labels"),
        )

    made = F.transform(pairs, entry)
    kept = F.filter(made, lambda e: (e["key"] != "") & (F.size(e["labels"]) > 0) & (e["labels"][0] != "null"))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), kept)


def text_map(text: Column) -> Column:
    """Top-level members of a JSON object as text."""
    return F.from_json(text, "map<string,string>")


def format_labels(text: Column) -> Column:
    """Labels of a format field: keys, ``key_true`` for true flags, and values."""
    value = F.try_parse_json(text)
    kind = F.coalesce(F.schema_of_variant(value), F.lit("STRING"))
    pairs = F.map_entries(text_map(text))

    def of_pair(pair: Column) -> Column:
        name = label(pair["key"])
        flag = pair["value"].isin("true", "false")
        values = F.when(pair["value"].startswith("["), F.from_json(pair["value"], "array<string>")).otherwise(F.array(pair["value"]))
        extra = (
            F.when(pair["value"].isNull(), F.expr("cast(array() as array<string>)"))
            .when(flag, F.when(pair["value"] == "true", F.array(F.concat(name, F.lit("_true")))).otherwise(F.expr("cast(array() as array<string>)")))
            .otherwise(label_list(values))
        )
        return F.concat(F.array(name), extra)

    from_object = F.flatten(F.transform(pairs, of_pair))
    from_list = label_list(F.from_json(text, "array<string>"))
    bare = label_list(F.array(F.coalesce(F.try_variant_get(value, "$", "string"), text)))
    made = F.when(kind.startswith("OBJECT"), from_object).when(kind.startswith("ARRAY"), from_list).otherwise(bare)
    return F.array_sort(F.array_distinct(F.filter(made, lambda v: v != "")))


# --- flags and numbers ------------------------------------------------------------

def truth(value: Column, numeric: Column | None = None) -> Column:
    """Boolean of a flag in text form; words other than the known ones are null.

    ``numeric`` says where the flag was a number and not a word (JSON keeps the difference): non-zero is true then.
    """
    word = lower_strip(value.cast("string"))
    said = F.when(word.isin(*lx.TRUE_WORDS), True).when(word.isin(*lx.FALSE_WORDS), False)
    if numeric is None:
        return said
    return F.when(numeric, word.try_cast("double") != 0).otherwise(said)


def quality_truth(value: Column) -> Column:
    word = lower_strip(value)
    return F.when(word == "ground_truth", True).when(word.isin("no_ground_truth", "heuristic"), False)


def ground_truth_known(entry_flag: Column, doc_flag: Column, entry_quality: Column, doc_quality: Column) -> Column:
    """Three-valued ground-truth flag; flags win over quality words, the entry over the document."""
    return F.coalesce(truth(entry_flag), truth(doc_flag), quality_truth(entry_quality), quality_truth(doc_quality))


def document_truth_known(doc_flag: Column, doc_quality: Column, runs: Column) -> Column:
    """The document's own flag or quality word, else that of its first run entry that has either.

    ``runs``: array of structs with ``has_ground_truth`` and ``evaluation_quality`` as text, in run order.
    """
    said = F.transform(runs, lambda r: ground_truth_known(r["has_ground_truth"], doc_flag, r["evaluation_quality"], doc_quality))
    first = F.get(F.filter(said, lambda k: k.isNotNull()), F.lit(0))
    return F.coalesce(ground_truth_known(doc_flag, doc_flag, doc_quality, doc_quality), first)


def stored_quality(flag: Column, ground_truth: Column) -> tuple[Column, Column]:
    """(has_ground_truth, evaluation_quality) as written to history."""
    known = F.coalesce(truth(flag), F.coalesce(strip(ground_truth) != "", F.lit(False)))
    return known, F.when(known, "ground_truth").otherwise("no_ground_truth")


def number(value: Column) -> Column:
    """A number or null."""
    return value.try_cast("double")


def first_filled(*values: Column, default: str) -> Column:
    """P25: first non-empty of several candidates as a key."""
    return key(F.coalesce(*[non_empty(v) for v in values], F.lit(default)), default)


def ground_truth_text(value: Column) -> Column:
    """Trimmed ground truth, empty becomes null."""
    return non_empty(strip(value))


def run_mode(value: Column) -> Column:
    """``normal`` or ``benchmark``; anything else counts as normal."""
    word = lower_strip(value)
    return F.when(word.isin("normal", "benchmark"), word).otherwise("normal")


# --- problem text ------------------------------------------------------------------

def word_count(text: Column) -> Column:
    """Number of blank-separated words."""
    cleaned = strip(F.coalesce(text, F.lit("")))
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, r"\s+")))


def problem_id(text: Column) -> Column:
    """Document id of a problem text."""
    return F.concat(F.lit("problem_"), F.sha1(F.regexp_replace(lower_strip(text), r"\s+", " ")))


def math_symbols(text: Column, superscripts: bool = True) -> Column:
    """Unicode math signs to ASCII, superscript digits to ``^n``."""
    made = F.translate(text, "−–×÷", "--*/")
    if not superscripts:
        return made
    return F.translate(F.regexp_replace(made, f"([{SUPERSCRIPTS}])", "^$1"), SUPERSCRIPTS, "0123456789")


def detection_text(text: Column) -> Column:
    """The form the intent and subject rules read."""
    return lower_strip(F.regexp_replace(math_symbols(F.coalesce(text, F.lit(""))), r"\s+", " "))


def raised(text: Column) -> Column:
    """Carets before a run of digits, signs or brackets become superscripts."""
    group = r"^(\([^)]*\)?|[0-9+\-=()]+)"

    def piece(part: Column, index: Column) -> Column:
        run = F.regexp_extract(part, group, 1)
        lifted = F.concat(F.translate(run, "0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾"), F.substr(part, F.length(run) + 1))
        return F.when(index == 0, part).when(run == "", F.concat(F.lit("^"), part)).otherwise(lifted)

    return F.when(F.contains(text, F.lit("^")), F.array_join(F.transform(F.split(text, r"\^"), piece), "")).otherwise(text)


def problem_text(text: Column, superscripts: bool = True) -> Column:
    """Unicode operators, leading ``Q:`` and trailing ``A:`` lines removed."""
    made = F.translate(strip(text), "−–—×÷", "---*/")
    made = F.regexp_replace(made, r"\A[qQ]:\s*", "")
    made = strip(F.regexp_replace(made, r"(?:(?:\A|\n)[^\S\n]*[aA]:[^\S\n]*)+\z", ""))
    return raised(made) if superscripts else made


def signature(text: Column) -> Column:
    """Numbers and single letters replaced by placeholders."""
    made = detection_text(text)
    for pattern, by in (
        (r"(?<![a-z])(\d+(?:\.\d+)?)([a-z])(?![a-z])", "<num><var>"),
        (r"\b\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?\b", "<num>"),
        (r"(?<![a-z])[a-z](?![a-z])", "<var>"),
        (r"\s+", ""),
        (r"[.,;:!?]+$", ""),
    ):
        made = F.regexp_replace(made, pattern, by)
    return made


def canonical(text: Column) -> Column:
    """Text form used to find identical problems."""
    made = F.regexp_replace(detection_text(text), "[qa]:", " ")
    for pattern in (r"\s+", r"[^a-z0-9^=+\-*/()\[\]{}|<>.,]", r"[.,;:!?]+$"):
        made = F.regexp_replace(made, pattern, "")
    return made


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """P20: distinct lower-case tokens without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    return F.array_distinct(found) if not stop_words else F.array_except(found, words_literal(stop_words))


# --- example text ---------------------------------------------------------------------

def _fragmented(lines: Column) -> Column:
    """Token-per-line layout: many lines, nearly all of them very short."""
    compact = F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", ""))

    def verdict(c: Column) -> Column:
        total = F.size(c)
        short = F.size(F.filter(c, lambda x: F.length(x) <= 3))
        plain = F.size(F.filter(c, lambda x: x.rlike(r"\A[0-9a-zA-Z+\-*/=^().,%]+\z")))
        return (total >= 6) & ((short / total >= 0.55) | ((total >= 8) & (plain / total >= 0.75)))

    return let(compact, verdict)


def _lines(text: Column) -> Column:
    parts = F.transform(F.split(text, LINE_BREAK), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.filter(parts, lambda x: x != "")


def _without_repeats(lines: Column) -> Column:
    """Drop a line equal to the one before it."""
    return let(lines, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def example_text(text: Column, is_solution: bool, drop_repeats: bool = True, keep_blocks: bool = False) -> Column:
    """Cleaned example text.

    ``drop_repeats`` is the loader's variant; the bank cleaning job keeps
    repeated lines and, with ``keep_blocks``, never flattens drawing or
    environment blocks.
    """
    word = "a|answer" if is_solution else "q|question"
    start = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[\u200b\u200c\u200d\ufeff]", "")
    start = F.regexp_replace(strip(start), rf"(?i)\A\s*(?:{word})\s*:\s*", "")

    def build(value: Column) -> Column:
        lines = _without_repeats(_lines(value)) if drop_repeats else _lines(value)

        def joined(items: Column) -> Column:
            flat = _fragmented(items)
            if keep_blocks:
                flat = flat & ~value.rlike(r"\[/?asy\]|\\begin\{|\\end\{")
            text_form = F.when(flat, F.array_join(items, " ")).otherwise(F.array_join(items, "\n"))
            return F.when(F.size(items) == 0, value).otherwise(strip(text_form))

        return let(lines, joined)

    return let(start, build)


def _fractions(text: Column) -> Column:
    """Innermost fractions first, once per fraction sign, so any nesting depth is resolved."""
    signs = F.size(F.split(text, r"\\frac")) - 1
    opened = F.aggregate(
        F.array_repeat(F.lit(1), signs), text,
        lambda acc, _: F.regexp_replace(acc, r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"($1)/($2)"),
    )
    opened = F.when(signs > 0, opened).otherwise(text)
    return F.regexp_replace(opened, r"\\frac\s+([0-9A-Za-z])\s*([0-9A-Za-z])", r"($1)/($2)")


def plain_math(text: Column) -> Column:
    """Noisy LaTeX to plain text."""
    made = _fractions(text)
    for old, new in (
        ("\\displaystyle", ""), ("\\left", ""), ("\\right", ""), ("\\times", " x "),
        ("\\cdot", " * "), ("\\div", " / "), ("\\quad", " "), ("\\qquad", " "), ("\\,", " "), ("\\!", " "),
    ):
        made = F.replace(made, F.lit(old), F.lit(new))
    made = F.regexp_replace(made, r"\\(?:begin|end)\{align\*?\}", "")
    for old, new in (("\\\\", " ; "), ("\\[", " "), ("\\]", " "), ("\\(", " "), ("\\)", " ")):
        made = F.replace(made, F.lit(old), F.lit(new))
    made = F.regexp_replace(made, r"\\boxed\{([^{}]+)\}", "$1")
    made = F.regexp_replace(made, r"\^\{([^{}]+)\}", r"^$1")
    return let(made, _fractions)


def prompt_ready(text: Column, is_solution: bool) -> Column:
    """Example text as it appears inside a prompt."""
    made = example_text(text, is_solution)
    made = F.regexp_replace(made, r"(?is)\[asy\].*?\[/asy\]", " ")
    made = F.regexp_replace(made, r"(?is)\\begin\{asy\}.*?\\end\{asy\}", " ")
    made = F.regexp_replace(made, r"```(?:[a-zA-Z0-9_+\-]+)?\s*[\s\S]*?```", " ")

    def joined(items: Column) -> Column:
        body = F.when(_fragmented(items), F.array_join(items, " ")).otherwise(F.array_join(items, "\n"))
        return strip(F.regexp_replace(F.regexp_replace(body, r"[ \t]{2,}", " "), r"\s+([,.;:!?])", "$1"))

    return let(_lines(plain_math(made)), joined)


def long_enough(text: Column, least: int = 10) -> Column:
    """The text without outer white space has ``least`` characters (10 for a new problem, 5 for a single run)."""
    return F.coalesce(F.length(strip(text)) >= least, F.lit(False))


def within_limits(*names: str) -> Column:
    """Columns of a new example, none of them empty or longer than its limit; null where one is missing and the others fit."""
    return reduce(lambda a, b: a & b, [F.length(n).between(1, lx.EXAMPLE_LIMITS[n]) for n in names])
