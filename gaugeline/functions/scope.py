"""Subject scoring and scope guards as SQL conditions."""

from __future__ import annotations

from gaugeline.functions import lexicon as lx
from gaugeline.functions.basics import count_of, has, quoted, rx, sql_array

SQUARED = r"\b[a-z]\s*(?:\^2|²)"
BETWEEN = r"\b(?:difference\s+of|differ(?:ence)?\s+by)\b"


def hits(v: str, words: list[str]) -> str:
    """SQL: how many of the words occur in the text."""
    return f"size(filter({sql_array(words)}, w -> contains({v}, w)))"


def token_hits(tokens: str, words: list[str]) -> str:
    return f"size(array_intersect({sql_array(words)}, {tokens}))"


def one_of(name: str, values: list[str]) -> str:
    return f"({name} in ({','.join(quoted(x) for x in values)}))"


def letter_words(v: str) -> str:
    """SQL: array of letter-only words."""
    return f"regexp_extract_all({v}, r'([a-zA-Z]+)', 1)"


def subject_points(v: str) -> dict[str, str]:
    """Keyword and pattern points per subject; ``v`` is detection text."""
    return {
        "pre-calculus": f"({hits(v, lx.SUBJECT_WORDS_PRECALCULUS)} + if({rx(v, lx.SUBJECT_PATTERN_PRECALCULUS)}, 3, 0))",
        "counting-probability": f"({hits(v, lx.SUBJECT_WORDS_COUNTING)} + if({rx(v, lx.SUBJECT_PATTERN_COUNTING)}, 3, 0))",
        "algebra": f"({hits(v, lx.SUBJECT_WORDS_ALGEBRA)} + if({rx(v, lx.SUBJECT_PATTERN_ALGEBRA)}, 2, 0))",
    }


def subject_by_points(v: str, precalculus: str, counting: str, algebra: str) -> str:
    """Subject with the most points; ties fall to algebra only for equation wording."""
    top = f"greatest({precalculus}, {counting}, {algebra})"
    tie = (
        f"{algebra} = {top} and {precalculus} = {top} and {has(v, '=')} and {rx(v, lx.SUBJECT_TIE_ALGEBRA)}"
        f" and not {rx(v, lx.SUBJECT_TIE_CALCULUS)}"
    )
    return (
        f"case when {top} = 0 then 'general' when {tie} then 'algebra'"
        f" when {precalculus} = {top} then 'pre-calculus'"
        f" when {counting} = {top} then 'counting-probability' else 'algebra' end"
    )


def subject_by_intent(intent: str) -> str:
    """Subject that an intent implies without looking at an example bank."""
    return (
        f"case when {one_of(intent, lx.INTENTS_PRECALCULUS)} then 'pre-calculus'"
        f" when {one_of(intent, lx.INTENTS_COUNTING)} then 'counting-probability'"
        f" when {one_of(intent, lx.INTENTS_ALGEBRA)} then 'algebra' end"
    )


def form_points(v: str, subject: str) -> str:
    """Points of one subject in the input form's scorer."""
    weight, keywords, patterns, operations = lx.FORM_SUBJECTS[subject]
    matched = " or ".join(rx(v, p) for p in patterns)
    return (
        f"(if({has(v, *keywords)}, {weight}D, 0D) + if({matched}, {weight * 1.5}D, 0D)"
        f" + if({has(v, *operations)}, {round(weight * 1.2, 10)}D, 0D))"
    )


def form_subject(v: str) -> str:
    """Subject by the input form's scorer; ``v`` is detection text."""
    asks = hits(v, lx.FORM_GOALS_PRECALCULUS)
    counts = hits(v, lx.FORM_GOALS_COUNTING)
    algebra_first = (
        f"({has(v, '=')} and {rx(v, r'\b[a-z]\b|\d+[a-z]|[a-z]\d')} and not {rx(v, lx.FORM_NOT_ALGEBRA)}"
        f" and ({rx(v, lx.FORM_ALGEBRA)} or {rx(v, r'\b[a-z]\^?\d|[-+]?\d+[a-z]|\b[a-z]\s*[+\-*/]\s*[a-z0-9]')}))"
    )
    calculus = f"({form_points(v, 'pre-calculus')} + if({asks} > {counts}, 2D, 0D))"
    counting = f"({form_points(v, 'counting-probability')} + if({counts} > {asks}, 2D, 0D))"
    algebra = form_points(v, "algebra")
    scored = f"named_struct('p', {calculus}, 'c', {counting}, 'a', {algebra})"
    decided = (
        "case when greatest(s.p, s.c, s.a) = 0 then 'algebra'"
        " when s.p = greatest(s.p, s.c, s.a) then 'pre-calculus'"
        " when s.c = greatest(s.p, s.c, s.a) then 'counting-probability' else 'algebra' end"
    )
    return f"case when {algebra_first} then 'algebra' else element_at(transform(array({scored}), s -> {decided}), 1) end"


def form_difficulty_points(text: str, v: str, subject: str) -> str:
    """Difficulty points; ``text`` is the raw text, ``v`` its lower-case form."""
    operators = count_of(text, r"[+\-*/^=<>≤≥]")
    brackets = count_of(text, r"[\(\)\[\]\{}]")
    fractions = count_of(text, "/")
    numbers = count_of(text, r"\d+")
    large = count_of(text, r"\d{3,}")
    words = f"size(filter(split({text}, r'\\s+'), w -> w <> ''))"
    sentences = f"size(filter(split({text}, r'[.!?]+'), s -> s rlike r'\\S'))"
    hard = f"({has(v, *lx.FORM_HARD_PRECALCULUS)} or {has(v, *lx.FORM_HARD_COUNTING)} or {has(v, *lx.FORM_HARD_ALGEBRA)})"
    parts = [
        f"case {subject} when 'pre-calculus' then 3D when 'counting-probability' then 1D else 0D end",
        f"if({hard}, 3D, 0D)",
        f"if({has(v, *lx.FORM_MEDIUM)}, 2D, 0D)",
        f"if({has(v, *lx.FORM_BASIC)}, 0.5D, 0D)",
        f"case when {operators} >= 8 then 2D when {operators} >= 5 then 1.5D when {operators} >= 3 then 1D else 0D end",
        f"case when {brackets} >= 4 then 1.5D when {brackets} >= 2 then 0.5D else 0D end",
        f"case when {fractions} >= 3 then 1D when {fractions} >= 1 then 0.5D else 0D end",
        f"if({large} >= 2, 1D, 0D)",
        f"case when {numbers} >= 8 then 1D when {numbers} >= 5 then 0.5D else 0D end",
        f"case when {words} >= 40 then 1D when {words} >= 25 then 0.5D else 0D end",
        f"if({sentences} >= 3, 1D, 0D)",
    ]
    return " + ".join(f"({p})" for p in parts)


def signal_scores(v: str, tokens: str) -> dict[str, str]:
    """Light domain evidence; ``v`` is lower-cased text, ``tokens`` its letter words."""
    overlap = f"if({token_hits(tokens, lx.OVERLAP_WORDS)} > 0, 1, 0)"
    squares = f"if({rx(v, r'\bperfect\s+squares?\b')}, 3, 0)"
    differ = f"if({rx(v, BETWEEN)} and {rx(v, r'\bsquares?\b')}, 2, 0)"
    two_squares = f"if({count_of(v, SQUARED + lx.END)} >= 2, 2, 0)"
    circle = f"if({has(v, 'circle')} and {has(v, 'diameter', 'endpoint', 'radius')}, 2, 0)"
    point = f"if({rx(v, r'\(\s*[-+]?\d+\s*,\s*[-+]?\d+\s*\)')}, 1, 0)"
    return {
        "algebra": (
            f"({token_hits(tokens, lx.SIGNAL_WORDS['algebra'])} + {overlap}"
            f" + if({rx(v, r'\b(solve\s+for|factor|simplify|quadratic|polynomial)\b')}, 2, 0)"
            f" + {squares} + {differ} + {two_squares} + {circle} + {point})"
        ),
        "pre-calculus": (
            f"({token_hits(tokens, lx.SIGNAL_WORDS['pre-calculus'])} + {overlap}"
            f" + if({rx(v, r'\b(sin|cos|tan|sec|csc|cot)\b')}, 2, 0))"
        ),
        "counting-probability": (
            f"({token_hits(tokens, lx.SIGNAL_WORDS['counting-probability'])}"
            f" + if({rx(v, r'\b(p\(|probability|permutation|combination|how\s+many)\b')}, 2, 0)"
            f" + if({has(v, '!', 'factorial')}, 2, 0)"
            f" + if({has(v, 'tens digit', 'ones digit', 'units digit', 'palindrome')}, 2, 0))"
        ),
    }


def direct_evidence(v: str) -> dict[str, str]:
    """Clear cues for each domain in lower-cased text."""
    trig = r"(?:^|[^a-z])(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)(?:[^a-z]|$)"
    return {
        "pre-calculus": f"({rx(v, trig)} or {rx(v, r'\b(derivative|differentiate|integral|integrate|limit|radian|radians)\b')} or {has(v, 'd/dx', 'dy/dx', '∫')})",
        "counting-probability": f"({rx(v, r'\b(probability|chance|odds|expected\s+value|permutation|combination|factorial)\b')} or {has(v, 'p(')} or {rx(v, r'\b(coin|dice|die|card|marble|bag|how\s+many\s+ways)\b')})",
        "algebra": f"({rx(v, r'\b(solve\s+for|equation|linear|quadratic|polynomial|factor|expand|simplify|system)\b')} or {has(v, '=')})",
    }


def math_signal(v: str, tokens: str) -> str:
    """Surface signs of a math task in lower-cased text."""
    direct = f"({rx(v, r'\d')} and {rx(v, r'[=+\-*/^%]|\bwhat\s+is\b|\bfind\b|\bcompute\b')})"
    return f"({direct} or {token_hits(tokens, lx.SCOPE_WORDS)} > 0)"


def special_case(v: str, intent: str) -> str:
    """In-scope although the word guards would reject it."""
    return (
        f"({one_of(intent, lx.INTENTS_IN_SCOPE)} or {rx(v, r'\bperfect\s+squares?\b')}"
        f" or ({has(v, 'circle')} and {has(v, 'diameter', 'endpoint', 'radius')}))"
    )


def outside_math(v: str, tokens: str, special: str) -> str:
    """Math outside the three domains."""
    excused = (
        f"({special} or ({rx(v, BETWEEN)} and {rx(v, r'\bsquares?\b')}) or {count_of(v, SQUARED + lx.END)} >= 2)"
    )
    formula = f"({rx(v, r'\b(area|perimeter|circumference|volume)\b')} and {rx(v, r'\b(circle|triangle|rectangle|square|sphere|cube|cylinder|cone)\b')})"
    return f"(not {excused} and ({token_hits(tokens, lx.OUTSIDE_WORDS)} >= 2 or {formula}))"


def pure_geometry(tokens: str, special: str) -> str:
    """Plane or solid geometry and ladder-against-wall problems."""
    measured = f"({token_hits(tokens, lx.SHAPE_WORDS)} > 0 and {token_hits(tokens, lx.MEASURE_WORDS)} > 0)"
    ladder = f"(array_contains({tokens}, 'ladder') and {token_hits(tokens, ['wall', 'ground', 'angle', 'height'])} > 0)"
    cues = f"({token_hits(tokens, lx.GEOMETRY_CUES)} >= 3 and not array_contains({tokens}, 'probability'))"
    return f"(not {special} and ({measured} or {ladder} or {cues}))"
