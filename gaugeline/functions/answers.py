"""Reading answers out of responses and comparing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions import lexicon as lx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import SPACE, let, literal_pattern, non_empty, strip

# fixed values: how answers, numbers and their labels look
LABEL = r"(?:final\s+answer|answer|result|solution)"
LABEL_START = rf"(?i)\A\s*{LABEL}\s*[:\-=]\s*"
TOKEN = (
    r"(?<![a-zA-Z])(?:[-+]?\d+(?:\.\d+)?%|[-+]?\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?|[-+]?\d+(?:\.\d+)?)(?![a-zA-Z!])"
)
NUMERAL = r"\A[-+]?\d+(?:\.\d+)?\z"
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:\s*/\s*[-+]?\d+(?:\.\d+)?)?"

EMPTY = "cast(array() as array<string>)"
ASCII = r"\A[\x00-\x7F]*\z"
#: Stands between texts that are scanned as one: no blank, sign, digit or letter.
BETWEEN = "\x01"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _present(items: Column) -> Column:
    """Stripped, non-empty, distinct values in first-seen order."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != "")))


def _no_tail(text: Column) -> Column:
    return F.rtrim(text, F.lit(".;,"))


def _after(text: Column, sign: str) -> Column:
    return strip(F.substring_index(text, sign, -1))


def lines_of(response: Column) -> Column:
    return F.filter(F.transform(F.split(response, "\n"), strip), lambda x: x != "")


MATH_LIKE = r"(?s)\A(?:(?=.*\d)(?=.*[A-Za-z+\-*/^=()])|(?=.*[A-Za-z])(?=.*[+\-*/^=()])|\d+(?:\.\d+)?\z)"


def math_like(text: Column) -> Column:
    """Digits with an operator or a letter, letters with an operator, or a plain number."""
    return text.rlike(MATH_LIKE)


def inline_math(text: Column) -> Column:
    """The expression a sentence ends with, null when there is none."""

    def usable(value: Column) -> Column:
        return let(_no_tail(strip(value)), lambda x: F.when(math_like(x), x))

    def pick(value: Column) -> Column:
        said = F.coalesce(
            usable(F.regexp_extract(value, r"(?i)\b(?:is|equals|becomes|gives)\s*[:=]\s*([^\n]+)$", 1)),
            usable(F.regexp_extract(value, r"(?i)\b(?:is|equals|becomes|gives)\s+([-+]?\d[^\n]*?)$", 1)),
        )
        return F.coalesce(
            F.when(F.contains(value, F.lit(":")), usable(_after(value, ":"))),
            F.when(value.rlike("(?i)is|equals|becomes|gives"), said),
        )

    return let(_no_tail(strip(text)), lambda v: F.when(v.rlike("(?i):|is|equals|becomes|gives"), pick(v)))


def has_label(response: Column) -> Column:
    """The response marks an answer explicitly."""
    return response.rlike(rf"(?i)\b{LABEL}\s*[:\-=]")


def priority_candidates(response: Column) -> Column:
    """Q6: likely final answers, best first."""
    labelled = F.transform(_all(response, rf"(?imd)^\s*{LABEL}\s*[:\-=]\s*([^\n]+)", 1), strip)

    def from_lines(lines: Column) -> Column:
        total = F.size(lines)
        last = F.get(lines, total - 1)
        before = F.slice(lines, F.lit(1), F.greatest(total - 1, F.lit(0)))
        mathy = F.filter(before, lambda x: x.rlike(r"=|\d"))
        salvaged = F.when(last.rlike(rf"(?i)\A\s*{LABEL}\s*[:\-=]\s*\z"), F.slice(F.reverse(mathy), F.lit(1), F.lit(1)))
        previous = F.get(lines, total - 2)
        concluding = F.when(previous.rlike(r"(?i)\b(therefore|thus|hence|so|final)\b"), F.array(previous))
        none = F.expr(EMPTY)
        return F.concat(labelled, F.coalesce(salvaged, none), F.when(total > 0, F.array(last)).otherwise(none), F.coalesce(concluding, none))

    def expanded(base: Column) -> Column:
        texts = F.array_distinct(F.filter(base, lambda x: x != ""))
        return F.array_distinct(F.array_compact(F.flatten(F.transform(texts, lambda x: F.array(x, inline_math(x))))))

    def with_numbers(found: Column) -> Column:
        # one scan over all texts; no token crosses the mark between them
        return _present(F.concat(found, _all(F.array_join(found, BETWEEN), TOKEN)))

    return let(let(let(lines_of(response), from_lines), expanded), with_numbers)


def all_candidates(response: Column, priority: Column) -> Column:
    """Q7: Q6 plus every labelled text, every number and the last line."""
    labelled = _all(response, r"(?i)(?:answer|result|solution)\s*[:\-=]\s*([^\n]+)", 1)
    numbers = _all(response, r"-?\d+\.?\d*(?:/\d+)?")
    last = F.slice(F.reverse(lines_of(response)), F.lit(1), F.lit(1))
    return _present(F.concat(priority, labelled, numbers, last))


def answer_form(text: Column) -> Column:
    """Q8: answer text for exact comparison: label and left-hand side dropped, no blanks, lower case."""

    def build(value: Column) -> Column:
        made = F.coalesce(inline_math(value), value)
        made = let(made, lambda m: F.when(F.contains(m, F.lit("=")), _after(m, "=")).otherwise(m))
        return F.regexp_replace(F.lower(_no_tail(made)), r"\s+", "")

    whole = let(strip(F.regexp_replace(strip(text), LABEL_START, "")), build)
    # most candidates are bare numerals and already in their final form
    return F.when(text.rlike(NUMERAL), text).otherwise(whole)


def _ratio(token: Column) -> Column:
    """Number of a plain or fractional numeral, null on a zero denominator."""

    def fraction(compact: Column) -> Column:
        top = F.substring_index(compact, "/", 1).try_cast("double")
        bottom = F.substring_index(compact, "/", -1).try_cast("double")
        return let(bottom, lambda b: F.when(F.abs(b) >= 1e-12, F.try_divide(top, b)))

    return F.when(F.contains(token, F.lit("/")), let(F.regexp_replace(token, r"\s+", ""), fraction)).otherwise(token.try_cast("double"))


def numeric_value(text: Column) -> Column:
    """Q9: the one number an answer states; null when there is none or more than one."""

    def parse(value: Column) -> Column:
        rhs = F.when(F.contains(value, F.lit("=")), _after(value, "=")).otherwise(value)

        def single(v: Column) -> Column:
            found = _all(v, NUMBER)
            return F.when(~v.rlike(r"\d[a-zA-Z]|[a-zA-Z]\d") & (F.size(found) == 1), _ratio(F.get(found, F.lit(0))))

        return let(rhs, single)

    bare = let(strip(F.regexp_replace(strip(text), LABEL_START, "")), parse)
    return F.when(text.rlike(NUMERAL), text.try_cast("double")).otherwise(F.when(text.rlike(r"\d"), bare))


def numbers_agree(found: Column, found_text: Column, wanted: Column, wanted_text: Column) -> Column:
    """Q9: equal within 1e-4, a percentage also equals its fraction."""
    percent, wanted_percent = F.contains(found_text, F.lit("%")), F.contains(wanted_text, F.lit("%"))
    direct = F.abs(found - wanted) < 0.0001
    as_percent = percent & ~wanted_percent & (F.abs(found / 100.0 - wanted) < 0.0001)
    wanted_as_percent = wanted_percent & ~percent & (F.abs(wanted / 100.0 - found) < 0.0001)
    return F.coalesce(direct | as_percent | wanted_as_percent, F.lit(False))


def value_set(text: Column) -> Column:
    """Q10: sorted distinct numbers of a several-values answer, null below two."""

    def build(value: Column) -> Column:
        algebra = value.rlike(r"\d\s*\(\s*[a-zA-Z]|[a-zA-Z]\s*[\^²³⁴]")
        made = value
        for pattern, by in (
            (r"[a-zA-Z]\s*=\s*", ""),
            (r"[a-zA-Z]+\s*\(\s*[-+]?\d+(?:\.\d+)?\s*\)", ""),
            (r"(?i)\b(?:and|or)\b", ","),
            (r"±\s*(\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?)", "+$1, -$1"),
            (r"\+\s*/\s*-\s*(\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?)", "+$1, -$1"),
        ):
            made = F.regexp_replace(made, pattern, by)
        found = _all(made, r"[-+]?\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?")
        values = F.transform(found, lambda x: F.round(_ratio(x), 8))
        distinct = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))
        return let(distinct, lambda d: F.when(~algebra & (F.size(d) >= 2), d))

    made = let(strip(F.regexp_replace(tx.math_symbols(strip(text)), LABEL_START, "")), build)
    # two values need two runs of digits, or one after a plus-minus sign
    return F.when(text.rlike(r"[0-9](?s:.*)[^0-9](?s:.*)[0-9]|±|\+\s*/\s*-|[⁰¹²³⁴⁵⁶⁷⁸⁹]"), made)


def expected_keys(expected: Column) -> Column:
    """What candidates are held against, read once per expected answer: its text, and either its set of numbers (``values``)
    or its form and number. Null without an expected answer."""

    def read(text: Column, values: Column) -> Column:
        form = F.when(values.isNull(), answer_form(text))
        number = F.when(values.isNull(), numeric_value(text))
        return let(form, lambda f: F.struct(text.alias("text"), values.alias("values"), f.alias("form"), f.rlike(ASCII).alias("ascii"), number.alias("number")))

    return F.when(expected.isNotNull(), let(strip(expected), lambda text: let(value_set(text), lambda values: read(text, values))))


def _matches(candidates: Column, keys: Column) -> Column:
    """Some candidate is the expected answer; only others than the same text are parsed."""

    def agree(value: Column, c: Column) -> Column:
        return numbers_agree(value, c, keys["number"], keys["text"])

    def alike(c: Column) -> Column:
        # a form is a stretch of its text in lower case without blanks; sigma alone depends on its neighbours, hence ASCII
        holds = ~keys["ascii"] | F.contains(F.lower(F.translate(c, SPACE, "")), keys["form"])
        formed = F.when(holds, answer_form(c) == keys["form"]).otherwise(False)
        number = F.when(keys["number"].isNotNull(), let(numeric_value(c), lambda v: agree(v, c))).otherwise(False)
        bare = (c == keys["form"]) | F.when(keys["number"].isNotNull(), agree(c.try_cast("double"), c)).otherwise(False)
        return F.when(c.rlike(NUMERAL), bare).otherwise(formed | number)

    same = F.coalesce(F.array_contains(candidates, keys["text"]), F.lit(False))
    return F.when(same, True).when(keys["values"].isNotNull(), _same_set(candidates, keys)).otherwise(F.exists(candidates, alike))


def _same_set(candidates: Column, keys: Column) -> Column:
    return F.exists(candidates, lambda c: F.coalesce(value_set(c) == keys["values"], F.lit(False)))


def heuristic_score(response: Column) -> Column:
    """Q13: signs of a reasoned answer when no ground truth exists."""
    score = (
        F.lit(0.5)
        + F.when(response.rlike(r"\d"), 0.2).otherwise(0.0)
        + F.when(response.rlike("(?i)therefore|because|thus|so"), 0.1).otherwise(0.0)
        + F.when(response.rlike(r"(?i)(?:answer|result|solution)\s*[:\-=]"), 0.2).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def accuracies(response: Column, expected: Column, keys: Column | None = None) -> Column:
    """Q11/Q12: struct (``any``, ``final``): accuracy of a response against a known answer, heuristic without one.

    ``final`` doesn't let the numbers of the working steps count. The candidates are read once for both: the likely final
    answers first, the others only where those don't match. ``keys``: ``expected_keys``, where they are at hand.
    """

    def both(wide: Column, final: Column) -> Column:
        return F.struct(wide.alias("any"), final.alias("final"))

    def graded(hit: Column) -> Column:
        return F.when(hit, 1.0).otherwise(0.0)

    def judge(wanted: Column, priority: Column) -> Column:
        marked_only = has_label(response) & (F.size(priority) > 0)
        others = let(
            F.array_except(all_candidates(response, priority), priority),
            lambda rest: both(graded(_matches(rest, wanted)), graded(wanted["values"].isNotNull() & _same_set(rest, wanted))),
        )
        return F.when(_matches(priority, wanted), both(F.lit(1.0), F.lit(1.0))).when(marked_only, both(F.lit(0.0), F.lit(0.0))).otherwise(others)

    known = let(expected_keys(expected) if keys is None else keys, lambda wanted: let(priority_candidates(response), lambda p: judge(wanted, p)))
    blank = F.coalesce(strip(response) == "", F.lit(True))
    guess = let(heuristic_score(response), lambda score: both(score, score))
    return F.when(blank, both(F.lit(0.0), F.lit(0.0))).when(expected.isNull(), guess).otherwise(known)


def accuracy(response: Column, expected: Column, final_only: Column | bool = False, keys: Column | None = None) -> Column:
    """One of the two ``accuracies``: with ``final_only`` the numbers of the working steps never count."""
    return let(accuracies(response, expected, keys), lambda both: F.when(F.lit(final_only), both["final"]).otherwise(both["any"]))


def unique_within(values: Column, tolerance: float = 1e-6) -> Column:
    """Sorted numbers, each further than the tolerance from the last kept one."""
    empty = F.expr("cast(array() as array<double>)")
    return F.aggregate(
        F.array_sort(values), empty,
        lambda kept, v: F.when((F.size(kept) > 0) & (F.abs(v - F.element_at(kept, -1)) <= tolerance), kept).otherwise(F.array_append(kept, v)),
    )


def root_score(response: Column, roots: Column, coefficients: Column) -> Column:
    """Q14: credit for naming the roots of a polynomial (coefficients highest power first)."""
    named = F.transform(_all(response, r"-?\d+(?:\.\d+)?"), lambda x: x.try_cast("double"))

    def residual(value: Column) -> Column:
        return F.abs(F.aggregate(coefficients, F.lit(0.0), lambda acc, c: acc * value + c))

    valid = F.filter(unique_within(named), lambda v: residual(v) <= 1e-5)

    def judge(found: Column) -> Column:
        start = F.struct(roots.alias("left"), F.lit(0).alias("hits"))

        def take(state: Column, value: Column) -> Column:
            place = F.array_position(F.transform(state["left"], lambda r: F.abs(r - value) <= 1e-4), F.lit(True))
            left = F.filter(state["left"], lambda r, i: i != place - 1)
            return F.struct(left.alias("left"), (state["hits"] + F.when(place > 0, 1).otherwise(0)).alias("hits"))

        hits = F.aggregate(found, start, take, lambda s: s["hits"])

        def bands(n: Column) -> Column:
            precision, recall = n / F.size(found), n / F.size(roots)
            f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
            return (
                F.when((n == F.size(roots)) & (F.size(found) == F.size(roots)), 1.0)
                .when(f1 >= 0.9, 0.9).when(f1 >= 0.7, 0.75).when(f1 >= 0.5, 0.5).otherwise(0.25)
            )

        return F.when(F.size(found) == 0, 0.0).otherwise(let(hits, bands))

    return F.when(F.size(roots) > 0, let(valid, judge)).otherwise(heuristic_score(response))


def simple_arithmetic(problem: Column) -> Column:
    """Q15: ground truth of ``What is a op b`` and ``a op b =?`` questions, as text (no blank before the question mark)."""
    operand = r"([-+]?\d+\.?\d*)"
    text = strip(problem)
    asked = F.regexp_extract(text, r"(?i)\Awhat\s+is\s+([\d\s+\-*/().]+)[?\s]*\z", 1)
    plain = F.regexp_extract(text, r"\A([\d\s+\-*/().]+)\s*[=?]*\s*\z", 1)
    plain = F.when(plain.rlike(r"[+\-*/]"), plain).otherwise("")

    def solve(expression: Column) -> Column:
        pattern = rf"\A{operand}(?:\s*([+\-*/])\s*{operand})?\z"
        left = F.regexp_extract(expression, pattern, 1).try_cast("double")
        sign = F.regexp_extract(expression, pattern, 2)
        right = F.regexp_extract(expression, pattern, 3).try_cast("double")
        result = (
            F.when(sign == "", left).when(sign == "+", left + right).when(sign == "-", left - right)
            .when(sign == "*", left * right).when(sign == "/", F.try_divide(left, right))
        )
        return let(result, lambda r: F.when(r == F.floor(r), r.cast("long").cast("string")).otherwise(r.cast("string")))

    return let(strip(F.when(asked != "", asked).otherwise(plain)), solve)


def number_key(value: Column) -> Column:
    """Shortest decimal text of a number at twelve digits."""
    text = F.round(value, 12).try_cast("decimal(38,12)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def output_key(response: Column) -> Column:
    """Q16: comparison key of a response: ``num:`` for numbers, ``text:`` otherwise."""
    label = r"(?:final\s+answer|answer|ans(?:wer)?|result|solution)"
    text = strip(F.coalesce(response, F.lit("")))
    marked = _all(text, rf"(?i){label}\s*[:=\-]\s*([^\n]+)", 1)

    def from_lines(lines: Column) -> Column:
        last = F.element_at(lines, -1)
        bare = last.rlike(rf"(?i)\A{label}\s*[:=\-]?\s*\z") & (F.size(lines) > 1)
        return F.when(bare, F.get(lines, F.size(lines) - 2)).otherwise(last)

    candidate = F.when(F.size(marked) > 0, strip(F.element_at(marked, -1))).when(text != "", let(lines_of(text), from_lines))
    wrapper = (
        r"(?i)\A(?:\s*(?:therefore|thus|hence|so)\b\s*[,:\-]?\s*"
        r"|\s*(?:the\s+)?(?:final\s+)?(?:answer|ans(?:wer)?|result|solution)\b\s*(?:is|equals)?\s*[:=\-]?\s*"
        r"|\s*(?:it\s+is|we\s+get|we\s+have|this\s+gives)\b\s*[:=\-]?\s*)++"
    )
    bare = F.rtrim(strip(tx.math_symbols(strip(F.regexp_replace(candidate, wrapper, "")), superscripts=False)), F.lit(".,;:!?"))

    def keyed(value: Column) -> Column:
        rhs = F.coalesce(non_empty(F.when(F.contains(value, F.lit("=")), _after(value, "="))), value)

        def build(answer: Column) -> Column:
            prepared = F.regexp_replace(answer, r"(?<=\d),(?=\d)", "")
            prepared = strip(F.regexp_replace(F.regexp_replace(prepared, r"[^A-Za-z0-9+\-*/()._=\s]", " "), r"\s+", " "))
            number = F.when(prepared.rlike(r"\A[-+]?\d+(?:\.\d*)?(?:\s*/\s*[-+]?\d+(?:\.\d*)?)?\z"), number_key(_ratio(prepared)))
            plain = F.rtrim(F.regexp_replace(F.lower(answer), r"[\s_]+", ""), F.lit(".,;:!?"))
            plain = F.regexp_replace(plain, r"\b0+(\d)\b", "$1")
            plain = F.regexp_replace(plain, r"(?<=[a-z)])\*(?=[a-z0-9(])|(?<=[0-9])\*(?=[a-z(])", "")
            return F.coalesce(
                F.concat(F.lit("num:"), number),
                F.concat(F.lit("text:"), F.coalesce(non_empty(plain), F.lit("__empty__"))),
            )

        return let(rhs, build)

    return F.when(F.coalesce(candidate, F.lit("")) == "", F.lit("text:__empty__")).otherwise(let(bare, keyed))


# --- response checks ----------------------------------------------------------------

def has_final_answer(response: Column) -> Column:
    last = F.get(F.reverse(lines_of(response)), F.lit(0))
    marked = response.rlike(r"(?im)^\s*final\s+answer\s*[:=-]")
    number = r"(?i)\b([a-z]\s*=\s*)?[-+]?\d+(?:\.\d+)?(?:/\d+)?\b"
    return marked | F.coalesce(last.rlike(r"(?i)^\s*answer\s*[:=-]") | last.rlike(number), F.lit(False))


def quality_flags(response: Column, done_reason: Column, min_chars: int = 48, require_final: bool = True) -> Column:
    """Q17: why a response should be asked again; ``needs_retry`` sums it up."""
    text = strip(F.coalesce(response, F.lit("")))
    empty = text == ""
    truncated = F.coalesce(done_reason == "length", F.lit(False))
    short = F.length(text) < min_chars
    hedged = text.rlike(lx.HEDGES)
    unfinished = ~has_final_answer(text) if require_final else F.lit(False)
    return F.struct(
        empty.alias("empty"), truncated.alias("truncated"), short.alias("short"), hedged.alias("hedged"),
        unfinished.alias("no_final_answer"),
        (empty | truncated | short | hedged | unfinished).alias("needs_retry"),
    )


def verdict(text: Column) -> Column:
    """Q18: pass, fail or unknown."""
    word = F.lower(strip(F.coalesce(text, F.lit(""))))
    passed = F.contains(word, F.lit("verdict: pass")) | word.startswith("pass")
    failed = F.contains(word, F.lit("verdict: fail")) | word.startswith("fail")
    return F.when(passed, True).when(failed, False)


def error_class(status: Column, message: Column) -> Column:
    """Q19: class of a failed call."""
    text = F.lower(F.coalesce(message, F.lit("")))
    missing = F.contains(text, F.lit("model")) & F.contains(text, F.lit("not found"))
    return (
        F.when((status == 404) & missing, "model_missing")
        .when(status == 404, "endpoint")
        .when(F.contains(text, F.lit(lx.MEMORY_MARKER)), "memory")
        .when(text.rlike(literal_pattern(lx.GPU_MARKERS)), "gpu")
        .otherwise("other")
    )
