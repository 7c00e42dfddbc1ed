"""Queries over problem texts: tags, intents, subjects, scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import features as ft
from gaugeline.functions import lexicon as lx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import alias, rounded
from gaugeline.operators import tagging as tg
from gaugeline.session import durable
from workload import views as vw

QUERIES = {}
ORACLES = {}

# a second set of phrasings, so that more rules fire than the eight templates reach
PHRASES = [
    "Find the mean of {n} and 9.", "A ladder of height {n} leans on a wall at an angle.", "Simplify (x + {n})(x - 2) / 3.",
    "Find the area of a circle with radius {n}.", "Find f(g({n})) for f(x) = x.", "Evaluate the expression 3x + y when x = {n} and y = 4.",
    "Solve the system 2x + y = {n}, x - y = 1.", "Which of the following has the least value? A = {n}, B = 7, C = 9.",
    "Given that a die shows {n}, find the conditional probability.", "Find the slope of the line through (1, {n}) and (3, 4).",
    "Convert {n} degrees to radians.", "Find the limit of (x^2 - {n}) / x as x grows.", "What is the tens digit of {n}! + 7!?",
    "What is {n}% of 80?", "Two perfect squares differ by {n}. Find the integers.", "Find the vertex of y = x^2 + {n}.",
    "The variable varies directly with {n}.", "Tell me a story about {n} ships", "Find all integer values with 2^x = {n}.",
    "In how many ways can you choose {n} from 12?", "Prove that sin(x) + {n} = cos(x).", "Find the determinant of the singular matrix with {n}.",
    "Find the 12th term of a geometric sequence starting at {n}.", "Expand (x + {n})^3.",
    # one for each of the remaining intents
    "Name a palindrome between {n} and 999.", "What is the probability that {n} friends in a row are not adjacent?",
    "Two cards are drawn from a deck of {n}. What is the probability that both are red?", "What are the odds of rain on {n} days?",
    "{n} books are split equally among 3 friends.", "How many {n}-digit numbers have no digit equal to 5?",
    "How many outcomes are there when {n} dice are rolled?", "Find the expected value of {n} rolls.",
    "For r(t) = <t, 2t> sketch r({n}) and v(t).", "Find f({n}) for the line f(x) = 2x + 1.",
    "For a unit vector a write |a + b| with b of length {n}.", "Are the vectors of length {n} perpendicular?",
    "Find the maximum value of 3 sin x + {n} cos x.", "Solve sin(x) = 1 / {n}.", "The graph of tan is drawn {n} times.",
    "Integrate x^{n} from 0 to 1.", "Write x^2 + {n}x in vertex form.", "Find the asymptote of y = 1 / (x - {n}).",
    "Give the polar coordinates of (1, {n}).", "Find the variance of 1, {n} and 9.", "Find the median of 4, {n} and 9.",
    "The mode of the list is {n}.", "Factor x^2 - {n}.", "The ratio of cats to dogs is {n} to 3.",
    "Find the maximum value of 7 - (x - {n})^2.", "A polynomial with root {n} has degree 2.", "Use the law of sines with side {n}.",
    "Find all real solutions of x^2 = {n}.", "How many arrangements of {n} books are there?",
]


def phrase_sql(string_type: str) -> str:
    cases = " ".join(
        f"when {i} then concat(" + ", ".join([f"'{p.split('{n}')[0]}'", f"cast(size as {string_type})", f"'{p.split('{n}')[1]}'"]) + ")"
        for i, p in enumerate(PHRASES)
    )
    return f"case when id % 2 = 0 then problem else case (id // 2) % {len(PHRASES)} {cases} end end"


PROBLEMS = vw.MATH + ", problems as (select id, subject, size, " + phrase_sql("varchar") + " problem from math_problems), low as (select *, lower(problem) v from problems)"


def problems(spark, sf):
    base = vw.math_problems(spark, sf)
    return base.withColumn("problem", F.expr(phrase_sql("string").replace("//", "div"))).select("id", "subject", "size", "problem")


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = "with " + PROBLEMS + sql
        return fn
    return keep


# --- T1, T2 ---------------------------------------------------------------------------------
# SQL patterns without look-around; a set of characters that are no word characters stands in for it

def tag_case(pairs):
    return "list_filter([" + ", ".join(f"case when {cond} then '{tag}' end" for tag, cond in pairs) + "], lambda x: x is not null)"


def m(pattern):
    return f"regexp_matches(v, '{pattern}')"


SQL_TAGS = [
    ("quadratic", m(r"\b(quadratic|x\^2)\b")), ("cubic", m(r"\b(cubic|x\^3)\b")), ("quartic", m(r"\b(quartic|x\^4)\b")),
    ("linear", m(r"\blinear\b|(^|[^a-z/])\d*[a-z]\s*[+\-]\s*\d+\s*=|(^|[^a-z/])\d+[a-z]\s*=\s*\d")),
    ("system_of_equations", "(" + m(r"\b(system|simultaneous)\b") + " or " + m(r"(solve|find)\s+(for\s+)?[a-z]\s*((,\s*|\s+and\s+)[a-z])")
     + " or len(list_filter(string_split_regex(v, '[,\\n;]'), lambda p: regexp_matches(p, '[a-z].*='))) >= 2)"),
    ("rational_equation", m(r"\d+\s*/\s*[a-z]|\d+\s*/\s*\([^)]*[a-z]")),
    ("factoring", m(r"\b(factor|factoring|factorise|factorize)\b")), ("simplify", m(r"\b(simplif|simplify|reduce)\b")),
    ("expand", m(r"\b(expand|distribute)\b")), ("solve", m(r"\b(solve|find\s+(the\s+)?(value|root|solution|x|y|z))\b")),
    ("derivative", m(r"\b(derivative|differentiat|d/dx|dy/dx)\b")), ("integral", m(r"\b(integral|integrat)\b")), ("limit", m(r"\b(limit|lim)\b")),
    ("probability", m(r"\b(probability|p\(|chance|odds|likely|likelihood)\b")), ("conditional_probability", m(r"\b(given\s+that|conditional|bayes)\b|\|")),
    ("permutation", m(r"\b(permutation|arrange|arrangement|how\s+many\s+ways)\b")), ("combination", m(r"\b(combination|choose|selecting|subset)\b")),
    ("expected_value", m(r"\b(expected\s+value|expectation)\b")), ("trigonometric", m(r"\b(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)\b")),
    ("logarithm", m(r"\b(logarithm|log|ln)\b")), ("exponential", m(r"\b(exponential|e\^|exp\()\b|\d+\^\s*\(?\s*\d*\s*[a-z]")),
    ("polynomial", m(r"\bpolynomial\b")), ("rational", m(r"\brational\s+(expression|function)\b")),
    ("sequence_series", m(r"\b(sequence|series|nth\s+term)\b")), ("matrix", m(r"\b(matrix|matrices|determinant)\b")),
    ("conic_section", m(r"\b(circle|ellipse|parabola|hyperbola|conic)\b")), ("coordinate_geometry", m(r"\b(slope|intercept|midpoint|distance\s+formula)\b")),
    ("inequality", m("[<>≤≥]")), ("fraction", m("/")), ("exponent", m(r"\^")), ("radical", m("root|√")), ("percent", m("%|percent")),
]
BANK_ONLY = {"quadratic": m(r"\b(quadratic|[a-z]\^2)\b"), "cubic": m(r"\b(cubic|[a-z]\^3)\b"), "quartic": m(r"\b(quartic|[a-z]\^4)\b")}
SQL_BANK_TAGS = [(t, BANK_ONLY.get(t, c)) for t, c in SQL_TAGS] + [
    ("factorial_number_theory", m(r"\d+\s*!")), ("digit_extraction", m(r"\bdigit\b")), ("palindrome_number_theory", m(r"\bpalindrome\b")),
    ("multi_variable_substitution", m(r"\bwhen\b[^.?]*[a-z]\s*=\s*\S+\s*(,?\s*(and|&)\s*)[a-z]\s*=")),
]


def _sql_list(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def tag_oracle(pairs, types):
    return f""", t as (select id, {tag_case(pairs)} tags from low)
select id, array_to_string(list_sort(tags), ',') features, array_to_string(list_sort(list_filter(tags, lambda x: list_contains({_sql_list(types)}, x))), '|') type_key from t"""


@register("t1_history_features", tag_oracle(SQL_TAGS, lx.TYPE_FEATURES_HISTORY))
def history_features(spark, sf):
    return tg.with_feature_tags(problems(spark, sf), "problem", "history").select("id", F.array_join("features", ",").alias("features"), "type_key")


@register("t2_bank_features", tag_oracle(SQL_BANK_TAGS, lx.TYPE_FEATURES_BANK))
def bank_features(spark, sf):
    return tg.with_feature_tags(problems(spark, sf), "problem", "bank").select("id", F.array_join("features", ",").alias("features"), "type_key")


# --- T3-T8, T10-T12 ----------------------------------------------------------------------------

ASSIGN = r"\b[a-z]\s*=\s*[-+]?\d+(?:\.\d+)?"
N_ASSIGN = f"len(regexp_extract_all(v, '{ASSIGN}'))"
EQUALS = "(length(v) - length(replace(v, '=', '')))"
SYSTEM = f"({m('system')} or ({EQUALS} >= 2 and {N_ASSIGN} = 0 and {m(' and |,')}))"
RATE = (
    "(" + m(r"\b\d+(\.\d+)?\s*(mile|miles|km|meters?|feet)\s+in\s+\d+(\.\d+)?\s*(second|seconds|minute|minutes|hour|hours|day|days)\b")
    + " or (" + m("at this rate|at the same rate|unit rate") + " and " + m("mile|km|meter|foot|feet|yard") + " and " + m("second|minute|hour|day")
    + ") or (" + m("travel|distance|speed|train|car|bike|walk|drive|rate") + " and " + m("mile|km|meter|foot|feet|yard") + " and " + m("second|minute|hour|day") + " and " + m("how many") + "))"
)
OPTIONS = r"(len(regexp_extract_all(v, '\b[a-e]\s*=\s*[^,;\n]+')) >= 2)"
COMPARE = f"({m('least|greatest|smallest|largest|minimum|maximum')} and {m('which of the following|which option|which choice|which has|which is|among')} and {OPTIONS})"
CHANCE = m(r"probability|p\(|chance|odds")
SQL_STRUCTURE = [
    ("equation", m("=")), ("inequality", m("[<>≤≥]")), ("fraction", m("/")), ("exponent", m(r"\^")), ("root", m("root|√")), ("logarithm", m(r"\blog\b")),
    ("trigonometric", m(r"\b(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)\b")), ("derivative", m(r"\b(derivative|differentiate|d/dx|dy/dx)\b")),
    ("integral", m(r"\b(integral|integrate)\b")), ("limit", m(r"\b(limit|lim)\b")), ("probability", CHANCE),
    ("conditional_probability", f"({CHANCE} and {m('given that|[|]|conditional')})"), ("function_notation", m(r"\b[a-z]\s*\(")),
    ("composition", m(r"\b[a-z]\s*\(\s*[a-z]\s*\(")), ("decimal", m(r"\d+\.\d+")), ("big_number", m(r"\d{3,}")), ("percent", m("%")),
    ("proportion", f"({m('ratio|proportion')} or {RATE})"), ("variation", m("varies directly|varies inversely|direct variation|inverse variation")),
    ("assignment", f"{N_ASSIGN} > 0"), ("multi_assignment", f"{N_ASSIGN} >= 2"), ("labeled_options", OPTIONS), ("value_comparison", COMPARE),
    ("substitution", f"({N_ASSIGN} > 0 and {m('evaluate|value of|expression| when |if |given')})"), ("system", SYSTEM),
]


@register("t3_structural_features", f", t as (select id, {tag_case(SQL_STRUCTURE)} tags from low) select id, array_to_string(list_sort(tags), ',') structure from t")
def structure(spark, sf):
    return tg.with_structure(problems(spark, sf), "problem").select("id", F.array_join("structure", ",").alias("structure"))


@register("t4_t5_keywords_operations", f""", k as (select *, list_distinct(regexp_extract_all(v, '[a-z0-9_]+')) tk from low),
kw as (select unnest({_sql_list([w for w in lx.KEYWORDS_PROBLEM])}) w), ow as (select unnest({_sql_list(lx.OPERATION_WORDS)}) w),
kh as (select id, string_agg(w, ',' order by w) s from k, kw where case when regexp_matches(w, '[ ()/|%=-]') then contains(v, w) else list_contains(tk, w) end group by 1),
oh as (select id, string_agg(w, ',' order by w) s from k, ow where case when contains(w, ' ') then contains(v, w) else list_contains(tk, w) end group by 1)
select k.id, coalesce(kh.s, '') keywords, coalesce(oh.s, '') operations, array_to_string(list_sort(list_distinct(regexp_extract_all(v, '\\b([a-z])\\s*=', 1))), ',') assigned
from k left join kh on kh.id = k.id left join oh on oh.id = k.id""")
def keywords(spark, sf):
    df = tg.with_structure(problems(spark, sf), "problem")
    return df.select("id", *[F.array_join(c, ",").alias(c) for c in ("keywords", "operations", "assigned")])


@register("t6_t10_equation_marks_family", f"""
select id, {m('=')} has_equation, {m('x\\^3|x3')} has_x3, {m('x\\^2|x2')} has_x2, {SYSTEM} has_system, {m('/')} has_fractional, {N_ASSIGN} > 0 has_assignment,
 case when not {m('=')} then null when {SYSTEM} then 'system' when {m(r'\b[a-z]\s*\^\s*4\b')} then 'quartic' when {m(r'\b[a-z]\s*\^\s*3\b')} then 'cubic'
 when {m(r'\b[a-z]\s*\^\s*2\b')} then 'quadratic' when {m('[|]|abs[(]')} then 'absolute' when {m(r'\d+\s*\^\s*\{?\s*[a-z]')} then 'exponential'
 when {m(r'\b[a-z]\b|\d+[a-z]|[a-z]\d+')} then 'linear' end family from low""")
def marks(spark, sf):
    df = tg.with_structure(problems(spark, sf), "problem")
    return df.select("id", *[F.col(f"marks.{c}").alias(c) for c in ("has_equation", "has_x3", "has_x2", "has_system", "has_fractional", "has_assignment")], "family")


@register("t7_t8_detectors", f"""
select id, {OPTIONS} labelled_options, {COMPARE} compares_values, {RATE} rate_problem,
 ({m(r'given that|given |[|]|conditional|p\(')} and {m('probability|random|chance|odds')}) conditional_question,
 ({m('=')} and {m(r'\b[a-z]\b|\d+[a-z]|[a-z]\d')} and not {m(r'\b(d/dx|dy/dx|derivative|differentiate|integral|integrate|limit|lim|sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)\b')}
  and ({m('solve|solution|root|equation|polynomial|factor|zero|find x')} or {m(r'\b[a-z]\^?\d|[-+]?\d+[a-z]|\b[a-z]\s*[+\-*/]\s*[a-z0-9]')})) looks_algebraic from low""")
def detectors(spark, sf):
    return tg.with_detectors(problems(spark, sf), "problem").drop("subject", "size", "problem")


CONSTRAINTS = [
    ("real_solutions", m("real solution|real root")), ("real_values", m("real value")),
    ("positive_values", f"({m('positive solution|positive root|positive difference')} or ({m('positive value')} and not ({N_ASSIGN} >= 1 and {m('expression')} and {m('value of|evaluate|compute')})))"),
    ("integer_solutions", m("integer solution")), ("integer_values", m("integer value|integers")), ("non_negative", m("nonnegative|non-negative")),
]
FORMAT_SQL = [(lx.FORMAT_LABEL_BY_FEATURE[f], c) for f, c in SQL_STRUCTURE if f in lx.FORMAT_LABEL_BY_FEATURE] + [
    ("solve_for_variable", m("solve")), ("expression_evaluation", m("evaluate|value of|compute")), ("quartic", m(r"x\^4|x4")), ("cubic", m(r"x\^3|x3")), ("quadratic", m(r"x\^2|x2")),
]


@register("t11_t12_constraints_formats", f""", t as (select id, {tag_case(CONSTRAINTS)} c, {tag_case(FORMAT_SQL)} f from low)
select id, array_to_string(list_sort(c), ',') constraint_labels, array_to_string(list_sort(list_distinct(f)), ',') format_labels from t""")
def constraints(spark, sf):
    df = tg.with_structure(problems(spark, sf), "problem")
    return df.select("id", F.array_join("constraint_labels", ",").alias("constraint_labels"), F.array_join("format_labels", ",").alias("format_labels"))


# --- T9, T13, T14, T24 ---------------------------------------------------------------------------

TRIG = m(r"\b(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan|radian|degrees)\b")
PROB = "(" + m("probability|chance|odds") + " or " + m(r"\bp\(\s*[a-z]") + ")"
INTENT = f"""case when {m('real solutions?|real roots?|real values')} then 'real_solutions' when {COMPARE} then 'compare_values' when {RATE} then 'ratio_proportion'
 when {m('palindrome')} then 'palindrome_number_theory' when {m(r'\d+\s*!')} and {m('digit|tens|units|ones')} then 'factorial_number_theory'
 when {PROB} and {m('conditional|given that|[|]')} then 'conditional_probability' when {PROB} and {m('not (adjacent|next to|beside|sitting next|standing next)')} then 'permutation_complementary'
 when {PROB} and {m(r'exactly\s+\d+')} then 'binomial_probability' when {PROB} and {m('(chosen|selected|drawn|picked) from|sum divisible|product (is|even|odd)|sum is')} then 'combinatorial_probability'
 when {PROB} then 'basic_probability' when {m('(split|divided|distributed) equally')} or ({m(r'\d+\s+each\b')} and {m('how many ways|number of ways')}) then 'division_into_groups'
 when {m(r'c\(\s*\d+\s*,\s*\d+\s*\)')} or ({m('choose|select|chosen')} and {m('how many ways|number of ways')}) then 'combination'
 when {m('digit')} and {m('how many|number of')} and {m('no digit|not equal|without|excluding')} then 'counting_with_restrictions'
 when {m('how many (outcomes|total)|total outcomes|total number of outcomes')} then 'counting_principle'
 when {m('how many|number of ways|arrange|permutation|combination')} then 'counting_arrangements' when {m('expected value|expectation')} then 'expected_value'
 when {N_ASSIGN} >= 1 and {m('evaluate|value of|expression| when |if |given')} and not {m('solve|satisfy|satisfies|roots|solutions')} then 'evaluate_substitution'
 when {m(r'\b[a-z]\s*\(\s*[a-z]\s*\(')} then 'function_composition'
 when {m('<')} and {m(r'\b[a-z]\s*\(\s*\d+\s*\)')} and {m(r'\b[a-z]\s*\(\s*[a-z]\s*\)')} then 'parametric_vector_function'
 when {m(r'\b[a-z]\s*\(\s*[-+]?\d+\s*\)')} and {m('find|evaluate|calculate|what is|let')} and not {TRIG} and not {m('solve')} then 'function_evaluation'
 when {m('slope')} and {m('through|between|passing')} and {m(r'\(\s*[-+]?\d+\s*,\s*[-+]?\d+\s*\)')} then 'slope_formula'
 when {m('convert|express')} and {m('degree|radian|°')} then 'angle_conversion' when {m('matrix|det[(]')} and {m('singular|invertible|determinant')} then 'matrix_determinant'
 when {m('law of (sines|cosines)|(sine|cosine) rule')} or ({m(r'\btriangle\b')} and {TRIG} and {m(r'find\s+sin\b')}) then 'law_of_sines'
 when {m('unit vector')} and {m(r'\|[a-z]\s*[+\-]\s*[a-z]\|')} then 'vector_magnitude' when {m('orthogonal|perpendicular')} and {m('vector|dot product')} then 'dot_product_orthogonality'
 when {TRIG} and {m(r'\b(maximum|minimum)\s+value')} and {m(r'\d+\s*(cos|sin)\s*[a-z]\s*[+\-]\s*\d+\s*(cos|sin)')} then 'harmonic_form'
 when {TRIG} and {m('solve|find x|find all|for x')} and {m('=')} then 'trigonometric_equation' when {TRIG} and {m('simplify|show that|prove|verify|identity')} then 'trigonometric_identity'
 when {TRIG} and {m(r'\b(evaluate|find|what is)\b')} and {m(r'(sin|cos|tan|sec|csc|cot)\s*\(?\s*\d+')} and not {m('=')} then 'trigonometric_values' when {TRIG} then 'trigonometric'
 when {m('derivative|differentiate')} then 'derivative' when {m('integral|integrate')} then 'integral' when {m('lim')} then 'limit' when {m('sequence|series|nth term')} then 'sequence_series'
 when {m('vertex form|complet(e|ing) the square')} or ({m('rewrite')} and {m(r'\bform\b')}) then 'rewrite_expression' when {m('asymptote')} and not {m('domain|range|vertex|turning point')} then 'find_asymptotes'
 when {m('domain|range|asymptote|vertex|turning point|increasing|decreasing')} then 'function_analysis' when {m('polar|rectangular|cartesian|complex plane')} then 'coordinate_conversion'
 when {m('variance')} then 'variance' when {m('mean')} then 'mean' when {m('median')} then 'median' when {m('mode')} then 'mode' when {m('factor')} then 'factor' when {m('expand')} then 'expand'
 when {m('simplify')} then 'simplify' when {m('system')} then 'system' when {m('%')} then 'percent' when {m('varies (directly|inversely)|(direct|inverse) variation')} then 'variation'
 when {m('ratio|proportion')} then 'ratio_proportion' when {m(r'\b(maximum|minimum)\s+(value|of)\b|max value|min value')} then 'find_maximum' when {m('(has|with) root')} then 'vietas_formulas'
 when {m('circle')} and {m('diameter|endpoint|radius')} then 'analytic_geometry'
 when {m('=')} and {m(r'\b[a-z]\b|\d+[a-z]|[a-z]\d')} and {m('calculate|find|determine|what is')} then 'solve_equation' when {m('solve|find x')} then 'solve_equation'
 when {m('=')} and {m(r'\b[a-z]\b|\d+[a-z]|[a-z]\d')} and not {m(r'\b(limit|derivative|integral|sin|cos|tan)\b')} then 'solve_equation' else 'general' end"""
WITH_INTENT = f", it as (select *, {INTENT} intent, len(string_split_regex(trim(problem), '\\s+')) words from low)"


@register("t9_intent", WITH_INTENT + " select id, intent from it")
def intent(spark, sf):
    return tg.with_intent(problems(spark, sf), "problem").select("id", "intent")


@register("x4_sql_functions", WITH_INTENT + " select id, intent, " + RATE + " rate from it")
def sql_functions(spark, sf):
    ft.register_functions(spark)
    df = problems(spark, sf).withColumn("det", tx.detection_text(F.col("problem")))
    return df.withColumn("low", F.lower("problem")).selectExpr("id", "problem_intent(det) as intent", "rate_problem(low) as rate")


def hits(words):
    return "len(list_filter(" + _sql_list(words) + ", lambda w: contains(v, w)))"


LOOKS = f"""{m('=')} and {m(r'\b[a-z]\b|\d+[a-z]|[a-z]\d+')} and not {m(r'd/dx|dy/dx|\b(derivative|differentiate|integral|integrate|limit|lim|sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)\b')}
 and ({m('solve|solution|root|equation|polynomial|factor|zero|find x')} or {m(r'\b[a-z][\^]?\d|\d+[a-z]|\b[a-z]\s*[+*/-]\s*[a-z0-9]')})"""
SUBJECT = f""", sp as (select *, {hits(lx.SUBJECT_WORDS_PRECALCULUS)} + case when {m(r'\blimit\b|\blim\b|derivative|integral|optimization|\bsin\b|\bcos\b|\btan\b|\bpolar\b|\brectangular\b')} then 3 else 0 end p,
 {hits(lx.SUBJECT_WORDS_COUNTING)} + case when {m(r'\bp\(|probability|permutation|combination|counting|factorial|how many|number of ways|without replacement|with replacement|expected value')} then 3 else 0 end c,
 {hits(lx.SUBJECT_WORDS_ALGEBRA)} + case when {m(r'\bsolve\s+for\b|factor|simplify|expand|quadratic|equation')} then 2 else 0 end a from it),
sb as (select *, case when intent in ({','.join(repr(i) for i in lx.INTENTS_PRECALCULUS)}) then 'pre-calculus' when intent in ({','.join(repr(i) for i in lx.INTENTS_COUNTING)}) then 'counting-probability'
 when intent in ({','.join(repr(i) for i in lx.INTENTS_ALGEBRA)}) then 'algebra' when {LOOKS} then 'algebra' when greatest(p, c, a) = 0 then 'general' when p = greatest(p, c, a) then 'pre-calculus' when c = greatest(p, c, a) then 'counting-probability' else 'algebra' end found from sp)"""


@register("t13_t14_t24_subject_complexity", WITH_INTENT + SUBJECT + f"""
select id, found subject, (least(3, 1 + (words >= 18)::int + least(2, {hits(lx.COMPLEXITY_MARKERS)}) + (found in ('counting-probability', 'pre-calculus'))::int))::bigint complexity,
 found in ('algebra', 'pre-calculus', 'counting-probability') and intent <> 'general' strict from sb""")
def subject(spark, sf):
    df = tg.with_intent(tg.with_subject(problems(spark, sf).drop("subject"), "problem"), "problem")
    df = tg.with_complexity(df, "problem", "subject")
    return df.select("id", "subject", F.col("complexity").cast("long").alias("complexity"), tg.strict_matching(F.col("intent"), F.col("subject")).alias("strict"))


def sql_or(words):
    return "(" + " or ".join(f"contains(v, '{w}')" for w in words) + ")"


def form_points(subject):
    weight, words, patterns, ops = lx.FORM_SUBJECTS[subject]
    cleaned = [p.replace("(?i)", "") for p in patterns]
    matched = " or ".join(f"regexp_matches(v, '{p}'{', ' + repr('i') if o.startswith('(?i)') else ''})" for p, o in zip(cleaned, patterns))
    return f"(case when {sql_or(words)} then {weight} else 0 end + case when {matched} then {weight * 1.5} else 0 end + case when {sql_or(ops)} then {weight * 1.2:.1f} else 0 end)"


@register("t15_t17_form_labels", f""", f0 as (select *, {hits(lx.FORM_GOALS_PRECALCULUS)} pg, {hits(lx.FORM_GOALS_COUNTING)} cg,
 {form_points('pre-calculus')}::double p, {form_points('counting-probability')}::double c, {form_points('algebra')}::double a,
 {m('=')} and {m(r'\b[a-z]\b|\d+[a-z]|[a-z]\d')} and not regexp_matches(v, '{lx.FORM_NOT_ALGEBRA}') and (regexp_matches(v, '{lx.FORM_ALGEBRA}') or {m(r'\b[a-z]\^?\d|[-+]?\d+[a-z]|\b[a-z]\s*[+\-*/]\s*[a-z0-9]')}) eq from low),
f1 as (select *, p + case when pg > cg then 2 else 0 end pp, c + case when cg > pg then 2 else 0 end cc from f0),
f2 as (select *, case when eq then 'algebra' when greatest(pp, cc, a) = 0 then 'algebra' when pp = greatest(pp, cc, a) then 'pre-calculus' when cc = greatest(pp, cc, a) then 'counting-probability' else 'algebra' end fs,
 len(regexp_extract_all(problem, '[+\\-*/^=<>≤≥]')) o, len(regexp_extract_all(problem, '[\\(\\)\\[\\]\\{{}}]')) b, len(regexp_extract_all(problem, '/')) fr, len(regexp_extract_all(problem, '\\d+')) nn,
 len(regexp_extract_all(problem, '\\d{{3,}}')) ln, len(string_split_regex(trim(problem), '\\s+')) w, len(list_filter(string_split_regex(problem, '[.!?]+'), lambda s: trim(s) <> '')) se from f1),
f3 as (select *, (case fs when 'pre-calculus' then 3 when 'counting-probability' then 1 else 0 end
 + case when {sql_or(lx.FORM_HARD_PRECALCULUS)} or {sql_or(lx.FORM_HARD_COUNTING)} or {sql_or(lx.FORM_HARD_ALGEBRA)} then 3 else 0 end + case when {sql_or(lx.FORM_MEDIUM)} then 2 else 0 end
 + case when {sql_or(lx.FORM_BASIC)} then 0.5 else 0 end + case when o >= 8 then 2 when o >= 5 then 1.5 when o >= 3 then 1 else 0 end + case when b >= 4 then 1.5 when b >= 2 then 0.5 else 0 end
 + case when fr >= 3 then 1 when fr >= 1 then 0.5 else 0 end + case when ln >= 2 then 1 else 0 end + case when nn >= 8 then 1 when nn >= 5 then 0.5 else 0 end
 + case when w >= 40 then 1 when w >= 25 then 0.5 else 0 end + case when se >= 3 then 1 else 0 end)::double pts from f2)
select id, fs form_subject, pts form_points, case when pts >= 6 then 'advanced' when pts >= 3 then 'intermediate' else 'basic' end form_difficulty,
 case when w <= 15 then 'basic' when w <= 30 then 'intermediate' else 'advanced' end length_difficulty from f3""")
def form_labels(spark, sf):
    return tg.with_form_labels(problems(spark, sf), "problem").drop("subject", "size", "problem")


def token_hits(words):
    return "len(list_filter(" + _sql_list(words) + ", lambda w: list_contains(tk, w)))"


SIGNALS = f""", sg as (select *, list_distinct(regexp_extract_all(v, '[a-z]+')) tk, {m(r'\bperfect\s+squares?\b')} ps, {m(r'\b(?:difference\s+of|differ(?:ence)?\s+by)\b')} and {m(r'\bsquares?\b')} ds,
 {m('circle')} and {m('diameter|endpoint|radius')} ci from it),
sc as (select *, {token_hits(lx.SIGNAL_WORDS['algebra'])} + case when {token_hits(lx.OVERLAP_WORDS)} > 0 then 1 else 0 end + case when {m(r'\b(solve\s+for|factor|simplify|quadratic|polynomial)\b')} then 2 else 0 end
  + case when ps then 3 else 0 end + case when ds then 2 else 0 end + case when len(regexp_extract_all(v, '\\b[a-z]\\s*\\^2')) >= 2 then 2 else 0 end + case when ci then 2 else 0 end
  + case when {m(r'\(\s*[-+]?\d+\s*,\s*[-+]?\d+\s*\)')} then 1 else 0 end sa,
 {token_hits(lx.SIGNAL_WORDS['pre-calculus'])} + case when {token_hits(lx.OVERLAP_WORDS)} > 0 then 1 else 0 end + case when {m(r'\b(sin|cos|tan|sec|csc|cot)\b')} then 2 else 0 end spre,
 {token_hits(lx.SIGNAL_WORDS['counting-probability'])} + case when {m(r'\b(p\(|probability|permutation|combination|how\s+many)\b')} then 2 else 0 end + case when {m('!|factorial')} then 2 else 0 end
  + case when {m('(tens|ones|units) digit|palindrome')} then 2 else 0 end scp from sg),
sr as (select *, greatest(sa, spre, scp) top, sa + spre + scp - greatest(sa, spre, scp) - least(sa, spre, scp) snd from sc),
sd as (select *, case when top >= 2 and top - snd >= 1 then case when sa = top then 'algebra' when scp = top then 'counting-probability' else 'pre-calculus' end end signal_domain, case when top <= 0 then 0 else top - snd end signal_gap from sr)"""


@register("t18_domain_signals", WITH_INTENT + SIGNALS + " select id, sa::bigint signal_algebra, spre::bigint signal_precalculus, scp::bigint signal_counting, signal_domain, signal_gap::bigint signal_gap from sd")
def signals(spark, sf):
    return tg.with_signals(problems(spark, sf), "problem").drop("subject", "size", "problem")


FLAGS = f""", fl as (select *, intent in ({','.join(repr(i) for i in lx.INTENTS_IN_SCOPE)}) or ps or ci special_case,
 ({m(r'\d')} and {m(r'[=+\-*/^%]|\bwhat\s+is\b|\bfind\b|\bcompute\b')}) or {token_hits(lx.SCOPE_WORDS)} > 0 math_signal,
 {m(r'(?:^|[^a-z])(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)(?:[^a-z]|$)')} or {m(r'\b(derivative|differentiate|integral|integrate|limit|radian|radians)\b')} ep,
 {m(r'\b(probability|chance|odds|expected\s+value|permutation|combination|factorial)\b')} or {m(r'p\(')} or {m(r'\b(coin|dice|die|card|marble|bag|how\s+many\s+ways)\b')} ec,
 {m(r'\b(solve\s+for|equation|linear|quadratic|polynomial|factor|expand|simplify|system)\b')} or {m('=')} ea from sd),
fg as (select *, not special_case and (({token_hits(lx.SHAPE_WORDS)} > 0 and {token_hits(lx.MEASURE_WORDS)} > 0) or (list_contains(tk, 'ladder') and {token_hits(['wall', 'ground', 'angle', 'height'])} > 0)
  or ({token_hits(lx.GEOMETRY_CUES)} >= 3 and not list_contains(tk, 'probability'))) pure_geometry,
 not special_case and not ds and ({token_hits(lx.OUTSIDE_WORDS)} >= 2 or ({m(r'\b(area|perimeter|circumference|volume)\b')} and {m(r'\b(circle|triangle|rectangle|square|sphere|cube|cylinder|cone)\b')})) outside_math from fl)"""


@register("t19_t20_scope_flags", WITH_INTENT + SIGNALS + FLAGS + " select id, special_case, math_signal, pure_geometry, outside_math, ea evidence_algebra, ep evidence_precalculus, ec evidence_counting from fg")
def flags(spark, sf):
    return tg.scope_flags(problems(spark, sf), "problem").drop("subject", "size", "problem")


WANTED = "case id % 5 when 0 then 'Algebra' when 1 then '' when 2 then 'precal' when 3 then 'counting-probability' else 'history' end"
DECIDE = f""", jn as (select fg.*, sb.found, {WANTED} raw_wanted, case id % 5 when 0 then 'algebra' when 1 then '' when 2 then 'pre-calculus' when 3 then 'counting-probability' else 'history' end wanted from fg join (select id sid, found from sb) sb on sid = id),
jd as (select *, wanted in ('algebra', 'pre-calculus', 'counting-probability') sup, case wanted when 'algebra' then ea when 'pre-calculus' then ep when 'counting-probability' then ec else false end dir,
  found <> 'general' and found <> wanted oth, (intent <> 'general' or math_signal or len(tags) > 0) scope from jn join (select id tid, {tag_case(SQL_STRUCTURE)} tags from low) on tid = id),
js as (select *, case when wanted <> '' and not sup then 'explicit_subject_unsupported' when not scope then 'out_of_scope_problem' when pure_geometry then 'pure_geometry_out_of_scope'
  when sup and signal_domain is not null and signal_domain <> wanted and signal_gap >= 2 and oth and not dir then 'subject_mismatch_signal' when sup and oth and not dir and coalesce(signal_domain, '') <> wanted then 'subject_mismatch'
  when sup and outside_math then 'out_of_domain_math' when sup and found = 'general' and signal_domain is null and not dir then 'ambiguous_requested_subject' when sup then 'request_subject'
  when signal_domain is not null then 'auto_detected_signal' when found <> 'general' then 'auto_detected' else 'unsupported_detected' end domain_source from jd)"""


@register("t21_domain_resolution", WITH_INTENT + SUBJECT + SIGNALS + FLAGS + DECIDE + """
select id, domain_source, case domain_source when 'request_subject' then wanted when 'auto_detected_signal' then signal_domain when 'auto_detected' then found end as "domain" from js""")
def domain_resolution(spark, sf):
    df = problems(spark, sf).withColumn("wanted", F.expr(WANTED))
    return tg.resolve_domains(df, "problem", "wanted").select("id", "domain_source", "domain")


@register("t21_baseline_domain", WITH_INTENT + SUBJECT + SIGNALS + FLAGS + DECIDE + """
select id, coalesce(case when sup then wanted end, signal_domain, found) as "domain" from js""")
def baseline_domain(spark, sf):
    df = problems(spark, sf).drop("subject").withColumn("wanted", F.expr(WANTED))
    return tg.baseline_domain(df, "problem", "wanted").select("id", "domain")


@register("s13_persistable_rows", WITH_INTENT + SUBJECT + SIGNALS + FLAGS + DECIDE + """
select id from js where domain_source in ('request_subject', 'auto_detected_signal', 'auto_detected') and size % 3 = 0""")
def persistable(spark, sf):
    from gaugeline.operators.history import persistable as keep

    df = problems(spark, sf).withColumn("wanted", F.expr(WANTED)).withColumn("run_mode", F.when(F.col("size") % 3 == 0, "Benchmark").otherwise("normal"))
    # the gate filters on derived labels: store them first, or the filter would evaluate every rule again
    return keep(durable(tg.resolve_domains(df, "problem", "wanted").select("id", "domain", "run_mode"))).select("id")


@register("t22_p26_profile", WITH_INTENT + f""", t as (select id, intent, size, {tag_case(SQL_STRUCTURE)} s, {tag_case(CONSTRAINTS)} c from it)
select id, 'grp_' || (id % 4) subject, case when size % 2 = 0 then 'hard_one' else 'basic' end difficulty, case intent when 'expand' then 'polynomial_expansion' else intent end intent,
 array_to_string(list_sort(s), ',') features, array_to_string(list_sort(c), ',') constraints from t""")
def profile(spark, sf):
    df = problems(spark, sf).withColumns({
        "domain": F.concat(F.lit("Grp "), (F.col("id") % 4).cast("string")), "level": F.when(F.col("size") % 2 == 0, F.lit("Hard one")),
    })
    p = F.col("profile")
    return tg.with_profile(df, "problem", "domain", "level").select(
        "id", p["subject"].alias("subject"), p["difficulty"].alias("difficulty"), p["intent"].alias("intent"),
        F.array_join(p["features"], ",").alias("features"), F.array_join(p["constraints"], ",").alias("constraints"),
    )


PAYLOAD = """case id % 4 when 0 then concat('Sure! {"subject": "Algebra", "type": "Linear Eq", "concept": "', subject, '", "difficulty": "basic"} done')
 when 1 then '{"subject": "history", "type": "a", "concept": "b", "difficulty": "basic"}' when 2 then 'no json' else '{"subject": "pre-calculus", "type": "", "concept": "b", "difficulty": "basic"}' end"""


@register("t23_t25_analysed_examples", WITH_INTENT + SUBJECT + """
select id, case when id % 4 = 0 then 'algebra' when found = 'general' then 'algebra' else found end detected_subject, case when id % 4 = 0 then 'linear_eq' else intent end detected_type,
 case when id % 4 = 0 then 'basic' when words <= 15 then 'basic' when words <= 30 then 'intermediate' else 'advanced' end detected_difficulty,
 case when id % 4 = 0 then replace(lower(subject), ' ', '_') else intent end detected_concept, case when id % 4 = 0 then 'external' else 'rules' end detection_method from sb""")
def analysed(spark, sf):
    df = problems(spark, sf).withColumn("payload", F.expr(PAYLOAD))
    return tg.analyse_examples(df, "problem", "payload").drop("subject", "size", "problem", "payload")
