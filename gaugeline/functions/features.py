"""Structural tags of problem texts as SQL conditions.

Each builder takes the *name* of a text column and returns SQL text. The name
must hold lower-cased text unless stated otherwise.
"""

from __future__ import annotations

from itertools import takewhile
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import SparkSession

from gaugeline.functions import lexicon as lx
from gaugeline.functions.basics import count_of, count_text, first_match, has, labels, raw, rx, sql_array

ASSIGNED = r"\b[a-z]\s*=\s*[-+]?\d+(?:\.\d+)?(?:\s*/\s*[-+]?\d+(?:\.\d+)?)?"
TRIG = r"\b(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)\b"
VARIABLE = r"\b[a-z]\b|\d+[a-z]|[a-z]\d+"


def needed_texts(pattern: str) -> list[str]:
    """Texts of which every match of a pattern holds at least one; none if there are no such texts."""
    return sorted(_needed(rp.parse(pattern.replace(r"\p{L}\p{N}_", r"\w"))) or [])


def _needed(parts) -> set[str] | None:
    sets, run = [], ""
    for op, value in [*parts, (rc.AT, None)]:
        if op is rc.LITERAL:
            run += chr(value)
            continue
        if run:
            sets.append({run})
        if op is rc.SUBPATTERN and not value[1] and not value[2]:
            sets.append(_needed(value[3]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] > 0:
            sets.append(_needed(value[2]))
        elif op is rc.BRANCH:
            found = [_needed(branch) for branch in value[1]]
            sets.append(None if None in found else set().union(*found))
            # the parser takes out what all alternatives begin with
            sets.append({run + "".join(chr(c) for _, c in takewhile(lambda x: x[0] is rc.LITERAL, branch)) for branch in value[1]} if run else None)
        elif op is rc.IN and all(kind is rc.LITERAL for kind, _ in value):
            sets.append({chr(c) for _, c in value})
        run = ""
    # single letters say least, the longest texts most
    return max((x for x in sets if x), key=lambda x: (min(len(t) * (len(t) > 1 or not t.isalnum()) for t in x), -len(x)), default=None)


def guarded(v: str, pattern: str) -> str:
    """``rx`` that looks for plain texts before the pattern is tried, which takes much longer in a long text."""
    texts = needed_texts(pattern)
    return f"(({' or '.join(has(v, t) for t in texts)}) and {rx(v, pattern)})" if texts else rx(v, pattern)


def several_equations(v: str) -> str:
    """A system of equations by asking for several unknowns or listing several equations."""
    listed = f"size(filter(split({v}, r'[,\\n;]'), p -> p rlike r'[a-z].*=')) >= 2"
    return f"({guarded(v, lx.MULTI_UNKNOWN)} or ({has(v, '=')} and {count_text(v, '=')} >= 2 and {listed}))"


def feature_tags(v: str, rules: tuple[tuple[str, str], ...]) -> str:
    """Feature tags of one rule set."""
    pairs = [(tag, guarded(v, pattern)) for pattern, tag in rules]
    return labels([*pairs, ("system_of_equations", several_equations(v))])


def labelled_options(v: str) -> str:
    """A=..., B=... or (A) (B) (C) choices."""
    return f"({count_of(v, r'\b[a-e]\s*=\s*[^,;\n]+')} >= 2 or {count_of(v, r'\([a-e]\)')} >= 3)"


def compares_values(v: str) -> str:
    """Which of the labelled values is least or greatest."""
    compared = has(v, "least", "greatest", "smallest", "largest", "minimum", "maximum")
    asked = has(v, "which of the following", "which option", "which choice", "which has", "which is", "among")
    geometric = has(v, "point", "triangle", "vertex", "vertices", "coordinate", "vector")
    plain = f"(not {geometric} or {has(v, 'which of the following')})"
    return f"({compared} and {asked} and {labelled_options(v)} and {plain})"


def rate_problem(v: str) -> str:
    """Unit-rate and proportion word problems."""
    length = r"(?:mile|miles|km|kilometers?|meters?|foot|feet|yards?)"
    time = r"(?:second|seconds|minute|minutes|hour|hours|day|days)"
    phrase = has(v, "at this rate", "at the same rate", "unit rate")
    travel = has(v, "travel", "distance", "speed", "train", "car", "bike", "walk", "drive", "rate")
    distance = has(v, "mile", "km", "kilometer", "meter", "foot", "feet", "yard")
    duration = has(v, "second", "minute", "hour", "day")
    per = rx(v, rf"\b{length}\s+per\s+{time}\b")
    within = rx(v, rf"\b\d+(?:\.\d+)?\s*{length}\s+in\s+\d+(?:\.\d+)?\s*{time}\b")
    return (
        f"({per} or {within} or ({phrase} and {distance} and {duration}) "
        f"or ({travel} and {distance} and {duration} and {has(v, 'how many')}))"
    )


def conditional_question(v: str) -> str:
    """The problem asks for a conditional probability."""
    return f"({has(v, 'given that', 'given ', '|', 'conditional', 'p(')} and {has(v, 'probability', 'random', 'chance', 'odds')})"


def conditional_example(v: str) -> str:
    """The example (problem and solution together) teaches conditional probability."""
    return f"({has(v, 'probability', 'p(')} and ({has(v, 'given that')} or ({has(v, '|')} and {has(v, 'p(')})))"


def listed_system(v: str, assigned: str) -> str:
    several = f"({count_text(v, '=')} >= 2 and {assigned} = 0 and ({has(v, ' and ')} or {has(v, ',')}))"
    return f"({has(v, 'system')} or contains({v}, '\\\\begin{{align') or {several})"


def structural_features(v: str) -> str:
    """The structural feature flags as a sorted array."""
    assigned = count_of(v, ASSIGNED)
    chance = has(v, "probability", "p(", "chance", "odds")
    rules = [
        ("equation", has(v, "=")),
        ("inequality", rx(v, r"[<>]=?|\\le|\\ge|≤|≥")),
        ("fraction", has(v, "\\frac", "/")),
        ("exponent", rx(v, "[\\^²³⁴⁵⁶⁷⁸⁹⁰¹]")),
        ("root", has(v, "\\sqrt", "√", "root")),
        ("logarithm", rx(v, r"\\log|\blog\b")),
        ("trigonometric", rx(v, TRIG)),
        ("derivative", rx(v, r"\b(derivative|differentiate|d/dx|dy/dx)\b|∂")),
        ("integral", rx(v, r"\b(integral|integrate)\b|∫")),
        ("limit", rx(v, r"\b(limit|lim)\b")),
        ("probability", chance),
        ("conditional_probability", f"{chance} and {has(v, 'given that', '|', 'conditional')}"),
        ("function_notation", rx(v, r"\b[a-z]\s*\(")),
        ("composition", rx(v, r"\b[a-z]\s*\(\s*[a-z]\s*\(")),
        ("decimal", rx(v, r"\d+\.\d+")),
        ("big_number", rx(v, r"\d{3,}")),
        ("percent", has(v, "%")),
        ("proportion", f"({has(v, 'ratio', 'proportion')} or {rate_problem(v)})"),
        ("variation", has(v, "varies directly", "varies inversely", "direct variation", "inverse variation")),
        ("assignment", f"{assigned} > 0"),
        ("multi_assignment", f"{assigned} >= 2"),
        ("labeled_options", labelled_options(v)),
        ("value_comparison", compares_values(v)),
        ("substitution", f"{assigned} > 0 and {has(v, 'evaluate', 'value of', 'expression', ' when ', 'if ', 'given')}"),
        ("system", listed_system(v, assigned)),
    ]
    return labels(rules)


def words_found(v: str, words: list[str], whole: list[str], parts: list[str]) -> str:
    tokens = f"regexp_extract_all({v}, r'([a-zA-Z0-9_]+)', 1)"
    spoken = f"array_intersect({sql_array(whole)}, {tokens})"
    phrases = f"filter({sql_array(parts)}, w -> contains({v}, w))"
    return f"array_sort(array_distinct(concat({spoken}, {phrases})))"


def keyword_hits(v: str) -> str:
    """T4: keywords as tokens, phrases and signs as substrings."""
    signs = set(" ()/|%-=")
    parts = [w for w in lx.KEYWORDS_PROBLEM if signs & set(w)]
    return words_found(v, lx.KEYWORDS_PROBLEM, [w for w in lx.KEYWORDS_PROBLEM if w not in parts], parts)


def operation_markers(v: str) -> str:
    """T5: operation words."""
    parts = [w for w in lx.OPERATION_WORDS if " " in w]
    return words_found(v, lx.OPERATION_WORDS, [w for w in lx.OPERATION_WORDS if w not in parts], parts)


def assigned_variables(v: str) -> str:
    """T5: letters followed by an equals sign."""
    return f"array_sort(array_distinct(regexp_extract_all({v}, r'\\b([a-z])\\s*=', 1)))"


def low_powers(v: str) -> str:
    """Superscript 2, 3, 4 written with a caret."""
    return f"replace(replace(replace({v}, '⁴', '^4'), '³', '^3'), '²', '^2')"


def equation_marks(v: str) -> str:
    """Equation signature; ``v`` went through :func:`low_powers`."""
    assigned = count_of(v, ASSIGNED)
    fields = [
        ("has_equation", has(v, "=")),
        ("has_x4", has(v, "x^4", "x4")),
        ("has_x3", has(v, "x^3", "x3")),
        ("has_x2", has(v, "x^2", "x2")),
        ("has_abs", has(v, "|", "abs(")),
        ("has_system", listed_system(v, assigned)),
        ("has_fractional", has(v, "/")),
        ("has_assignment", f"({assigned} > 0)"),
    ]
    return "named_struct(" + ",".join(f"'{name}', {cond}" for name, cond in fields) + ")"


def looks_algebraic(v: str) -> str:
    """Equation-solving prompt; ``v`` is detection text."""
    calculus = (
        r"\bd/dx\b|\bdy/dx\b|∫|\\int\b|\bderivative\b|\bdifferentiate\b|\bintegral\b|\bintegrate\b"
        r"|\blimit\b|\blim\b|\bsin\b|\bcos\b|\btan\b|\bsec\b|\bcsc\b|\bcot\b|\barcsin\b|\barccos\b|\barctan\b"
    )
    asks = has(v, "solve", "solution", "root", "equation", "polynomial", "factor", "zero", "find x")
    shape = rx(v, r"\b[a-z]\^?\d|[-+]?\d+[a-z]|\b[a-z]\s*[+\-*/]\s*[a-z0-9]")
    return f"({has(v, '=')} and {rx(v, VARIABLE)} and not {rx(v, calculus)} and ({asks} or {shape}))"


def equation_family(v: str) -> str:
    """Coarse equation family; ``v`` is detection text."""
    system = listed_system(v, count_of(v, ASSIGNED))
    return (
        f"case when not {has(v, '=')} then null"
        f" when {system} then 'system'"
        f" when {rx(v, r'\b[a-z]\s*\^\s*4\b')} then 'quartic'"
        f" when {rx(v, r'\b[a-z]\s*\^\s*3\b')} then 'cubic'"
        f" when {rx(v, r'\b[a-z]\s*\^\s*2\b')} then 'quadratic'"
        f" when {has(v, '|', 'abs(')} then 'absolute'"
        f" when {rx(v, r'\d+\s*\^\s*\{?\s*[a-z]')} then 'exponential'"
        f" when {rx(v, VARIABLE)} then 'linear' end"
    )


def constraints(v: str) -> str:
    """Constraint labels."""
    substituted = f"({count_of(v, ASSIGNED)} >= 1 and {has(v, 'expression')} and {has(v, 'value of', 'evaluate', 'compute')})"
    asked = has(v, "positive solution", "positive root", "positive difference")
    return labels([
        ("real_solutions", has(v, "real solution", "real root")),
        ("real_values", has(v, "real value")),
        ("positive_values", f"({asked} or ({has(v, 'positive value')} and not {substituted}))"),
        ("integer_solutions", has(v, "integer solution")),
        ("integer_values", has(v, "integer value", "integers")),
        ("non_negative", has(v, "nonnegative", "non-negative")),
    ])


def format_label_rules(v: str, features: str, marks: str) -> str:
    """Format labels from the features (T3) and equation marks (T6) columns."""
    pairs = [(name, f"array_contains({features}, '{feature}')") for feature, name in lx.FORMAT_LABEL_BY_FEATURE.items()]
    pairs += [
        ("solve_for_variable", has(v, "solve")),
        ("expression_evaluation", has(v, "evaluate", "value of", "compute")),
        ("quartic", f"{marks}.has_x4"),
        ("cubic", f"{marks}.has_x3"),
        ("quadratic", f"{marks}.has_x2"),
        ("system_of_equations", f"{marks}.has_system"),
    ]
    return labels(pairs)


def complexity(v: str, words: str, subject: str) -> str:
    """Complexity 1-3 from length, advanced markers and subject."""
    hits = f"size(filter({sql_array(lx.COMPLEXITY_MARKERS)}, w -> contains({v}, w)))"
    return (
        f"least(3, 1 + if({words} >= 18, 1, 0) + least(2, {hits})"
        f" + if({subject} in ('counting-probability', 'pre-calculus'), 1, 0))"
    )


def intent(v: str) -> str:
    """Primary intent; ``v`` is detection text. The first rule that holds decides."""
    chance = f"({has(v, 'probability', 'chance', 'odds')} or {rx(v, r'\bp\(\s*[a-z]')})"
    trig = rx(v, r"\b(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan|radian|degrees)\b")
    ways = has(v, "how many ways", "number of ways")
    rules = [
        ("real_solutions", has(v, "real solution", "real root", "real values")),
        ("compare_values", compares_values(v)),
        ("ratio_proportion", rate_problem(v)),
        ("palindrome_number_theory", has(v, "palindrome")),
        ("factorial_number_theory", f"{rx(v, r'\d+\s*!')} and {has(v, 'digit', 'tens', 'units', 'ones')}"),
        ("conditional_probability", f"{chance} and {has(v, 'conditional', 'given that', '|')}"),
        ("permutation_complementary", f"{chance} and {has(v, 'not adjacent', 'not next to', 'not beside', 'not sitting next', 'not standing next')}"),
        ("binomial_probability", f"{chance} and {rx(v, r'exactly\s+\d+')}"),
        ("combinatorial_probability", f"{chance} and {has(v, 'chosen from', 'selected from', 'drawn from', 'picked from', 'sum divisible', 'product is', 'product even', 'product odd', 'sum is')}"),
        ("basic_probability", chance),
        ("division_into_groups", f"({has(v, 'split equally', 'divided equally', 'distributed equally')} or ({rx(v, r'\d+\s+each\b')} and {ways}))"),
        ("combination", f"({rx(v, r'c\(\s*\d+\s*,\s*\d+\s*\)')} or ({has(v, 'choose', 'select', 'chosen')} and {ways}))"),
        ("counting_with_restrictions", f"{has(v, 'digit')} and {has(v, 'how many', 'number of')} and {has(v, 'no digit', 'not equal', 'without', 'excluding')}"),
        ("counting_principle", has(v, "how many outcomes", "how many total", "total outcomes", "total number of outcomes")),
        ("counting_arrangements", has(v, "how many", "number of ways", "arrange", "permutation", "combination")),
        ("expected_value", has(v, "expected value", "expectation")),
        ("evaluate_substitution", f"{count_of(v, ASSIGNED)} >= 1 and {has(v, 'evaluate', 'value of', 'expression', ' when ', 'if ', 'given')} and not {has(v, 'solve', 'satisfy', 'satisfies', 'roots', 'solutions')}"),
        ("function_composition", rx(v, r"\b[a-z]\s*\(\s*[a-z]\s*\(")),
        ("parametric_vector_function", f"{rx(v, '[⟨<]')} and {rx(v, r'\b[a-z]\s*\(\s*\d+\s*\)')} and {rx(v, r'\b[a-z]\s*\(\s*[a-z]\s*\)')}"),
        ("function_evaluation", f"{rx(v, r'\b[a-z]\s*\(\s*[-+]?\d+\s*\)')} and {has(v, 'find', 'evaluate', 'calculate', 'what is', 'let')} and not {trig} and not {has(v, 'solve')}"),
        ("slope_formula", f"{has(v, 'slope')} and {has(v, 'through', 'between', 'passing')} and {rx(v, r'\(\s*[-+]?\d+\s*,\s*[-+]?\d+\s*\)')}"),
        ("angle_conversion", f"{has(v, 'convert', 'express')} and {has(v, 'degree', 'radian', '°')}"),
        ("matrix_determinant", f"{has(v, 'matrix', 'det(')} and {has(v, 'non-invertible', 'singular', 'invertible', 'determinant')}"),
        ("law_of_sines", f"({has(v, 'law of sines', 'law of cosines', 'sine rule', 'cosine rule')} or ({rx(v, r'△|\\triangle|\btriangle\b')} and {trig} and {rx(v, r'find\s+sin\b')}))"),
        ("vector_magnitude", f"{has(v, 'unit vector')} and {rx(v, r'\|[a-z]\s*[+\-]\s*[a-z]\|')}"),
        ("dot_product_orthogonality", f"{has(v, 'orthogonal', 'perpendicular')} and ({rx(v, r'[⟨<]\s*[-+]?\d+')} or {has(v, 'vector', 'dot product')})"),
        ("harmonic_form", f"{trig} and {rx(v, r'\b(maximum|minimum)\s+(value)')} and {rx(v, r'\d+\s*(cos|sin)\s*[a-z]\s*[+\-]\s*\d+\s*(cos|sin)')}"),
        ("trigonometric_equation", f"{trig} and {has(v, 'solve', 'find x', 'find all', 'for x')} and {has(v, '=')}"),
        ("trigonometric_identity", f"{trig} and {has(v, 'simplify', 'show that', 'prove', 'verify', 'identity')}"),
        ("trigonometric_values", f"{trig} and {rx(v, r'\b(evaluate|find|what is)\b')} and {rx(v, r'(sin|cos|tan|sec|csc|cot)\s*\(?\s*\d+\s*°?\s*\)?')} and not {has(v, '=')}"),
        ("trigonometric", trig),
        ("derivative", has(v, "derivative", "differentiate")),
        ("integral", has(v, "integral", "integrate", "∫")),
        ("limit", has(v, "lim")),
        ("sequence_series", has(v, "sequence", "series", "nth term")),
        ("rewrite_expression", f"({has(v, 'vertex form', 'completing the square', 'complete the square')} or ({has(v, 'rewrite')} and {rx(v, r'\bform\b')}))"),
        ("find_asymptotes", f"{has(v, 'asymptote')} and not {has(v, 'domain', 'range', 'vertex', 'turning point')}"),
        ("function_analysis", has(v, "domain", "range", "asymptote", "vertex", "turning point", "increasing", "decreasing")),
        ("coordinate_conversion", has(v, "polar", "rectangular", "cartesian", "complex plane")),
        ("variance", has(v, "variance")),
        ("mean", has(v, "mean")),
        ("median", has(v, "median")),
        ("mode", has(v, "mode")),
        ("factor", has(v, "factor")),
        ("expand", has(v, "expand")),
        ("simplify", has(v, "simplify")),
        ("system", has(v, "system")),
        ("percent", has(v, "%")),
        ("variation", has(v, "varies directly", "varies inversely", "direct variation", "inverse variation")),
        ("ratio_proportion", has(v, "ratio", "proportion")),
        ("find_maximum", f"({rx(v, r'\b(maximum|minimum)\s+(value|of)\b')} or {has(v, 'max value', 'min value')})"),
        ("vietas_formulas", has(v, "has root", "with root")),
        ("analytic_geometry", f"{has(v, 'circle')} and {has(v, 'diameter', 'endpoint', 'radius')}"),
        ("solve_equation", f"(({has(v, '=')} and {rx(v, VARIABLE)} and {has(v, 'calculate', 'find', 'determine', 'what is')}) or {has(v, 'solve')} or {looks_algebraic(v)})"),
    ]
    return first_match(rules, "general")


SQL_FUNCTIONS = {"problem_intent": intent, "rate_problem": rate_problem, "compares_values": compares_values, "equation_family": equation_family}


def register_functions(spark: SparkSession) -> None:
    """The rules over detection text as temporary SQL functions; Spark inlines their bodies."""
    for name, rule in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(v string) return {rule('v')}")


def families(name: str, families_of: dict[str, list[str]]) -> str:
    """SQL: family of an intent, the intent itself when it has none."""
    body = " ".join(
        f"when {name} in ({','.join(repr(i) for i in members)}) then 'family:{family}'"
        for family, members in families_of.items()
    )
    return f"case {body} else {name} end"
