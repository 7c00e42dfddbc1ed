"""Word lists, alias tables, patterns and thresholds.

Results depend on these literals, so they are kept together as plain text.
Patterns are written for Java regular expressions.
"""

# --- domain and subject labels (fixed values) --------------------------------

DOMAINS = ("algebra", "pre-calculus", "counting-probability")

DIFFICULTIES = ("basic", "intermediate", "advanced")

DOMAIN_ALIASES = {
    "algebra": "algebra",
    "pre-calculus": "pre-calculus",
    "precalculus": "pre-calculus",
    "precal": "pre-calculus",
    "calculus": "pre-calculus",
    "counting-probability": "counting-probability",
    "counting_probability": "counting-probability",
    "counting-and-probability": "counting-probability",
    "counting_and_probability": "counting-probability",
    "counting&probability": "counting-probability",
    "counting_and_prob": "counting-probability",
    "statistics": "counting-probability",
    "stat": "counting-probability",
}

SUBJECT_ALIASES = {
    "calculus": "pre-calculus",
    "precalculus": "pre-calculus",
    "statistics": "counting-probability",
    "stat": "counting-probability",
    "probability": "counting-probability",
}

DIFFICULTY_ALIASES = {
    "beginner": "basic",
    "easy": "basic",
    "medium": "intermediate",
    "moderate": "intermediate",
    "hard": "advanced",
    "expert": "advanced",
}

DIFFICULTY_ALIASES_BANK = {
    "interm": "intermediate",
    "int": "intermediate",
    "adv": "advanced",
    "beg": "basic",
}

TYPE_ALIASES = {
    "equation": "solve_equation",
    "equation_solving": "solve_equation",
    "substitution": "evaluate_substitution",
    "substitute": "evaluate_substitution",
    "evaluation": "evaluate_substitution",
    "real_solution": "real_solutions",
    "real_root": "real_solutions",
    "conditional_prob": "conditional_probability",
    "counting": "counting_arrangements",
    "comparison": "compare_values",
    "value_comparison": "compare_values",
    "expand": "polynomial_expansion",
}

CONSTRAINT_ALIASES = {
    "real_solution": "real_solutions",
    "real_root": "real_solutions",
    "real_value": "real_values",
    "positive_solution": "positive_solutions",
    "positive_root": "positive_solutions",
    "positive_value": "positive_values",
    "integer_solution": "integer_solutions",
    "integer_value": "integer_values",
    "nonnegative": "non_negative",
}

TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")

# --- stop words (fixed values, two lists) -------------------------------------

STOP_WORDS_HISTORY = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "must", "i",
    "me", "my", "we", "us", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its",
    "they", "them", "their", "this", "that", "these", "those", "which", "who", "whom", "what",
    "and", "or", "but", "nor", "not", "no", "so", "if", "then", "else", "when", "where", "how",
    "why", "than", "because", "since", "while", "of", "in", "on", "at", "to", "for", "with", "by",
    "from", "as", "into", "through", "during", "before", "after", "about", "between", "above",
    "below", "up", "down", "out", "off", "over", "under", "again", "further", "once", "here",
    "there", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "only",
    "own", "same", "too", "very", "just", "also", "now",
]

STOP_WORDS_BANK = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need",
    "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as",
    "into", "through", "during", "before", "after", "above", "below", "between", "out", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "just", "because", "but", "and",
    "or", "if", "while", "that", "this", "these", "those", "it", "its", "what", "which", "who",
    "whom",
]

# --- structural feature patterns (fixed values, two rule sets) ----------------
# An alternative ending in a superscript closes with END instead of \b, since
# Java does not count superscript digits as word characters.

END = r"(?![\p{L}\p{N}_])"

LINEAR = (
    r"(?<!\w)(linear)\b|(?:^|[^a-z/])(\d*[a-z]\s*[+\-]\s*\d+\s*=)|(?:^|[^a-z/])(\d+[a-z]\s*=\s*\d)"
)

SHARED_FEATURES_HEAD = (
    (LINEAR, "linear"),
    (r"\b(system|simultaneous)\b", "system_of_equations"),
    (r"\d+\s*/\s*[a-z]|\d+\s*/\s*\([^)]*[a-z]", "rational_equation"),
    (r"\b(factor|factoring|factorise|factorize)\b", "factoring"),
    (r"\b(simplif|simplify|reduce)\b", "simplify"),
    (r"\b(expand|distribute)\b", "expand"),
    (r"\b(solve|find\s+(?:the\s+)?(?:value|root|solution|x|y|z))\b", "solve"),
    (r"\b(derivative|differentiat|d/dx|dy/dx)\b|∂", "derivative"),
    (r"\b(integral|integrat)\b|∫", "integral"),
    (r"\b(limit|lim)\b", "limit"),
    (r"\b(probability|p\(|chance|odds|likely|likelihood)\b", "probability"),
    (r"\b(given\s+that|conditional|bayes)\b|\|", "conditional_probability"),
    (r"\b(permutation|arrange|arrangement|how\s+many\s+ways)\b", "permutation"),
    (r"\b(combination|choose|selecting|subset)\b", "combination"),
    (r"\b(expected\s+value|expectation|E\()\b", "expected_value"),
    (r"\b(sin|cos|tan|sec|csc|cot|arcsin|arccos|arctan)\b", "trigonometric"),
    (r"\b(logarithm|log|ln)\b|\\log", "logarithm"),
    (r"\b(exponential|e\^|exp\()\b|\d+\^\s*\(?\s*\d*\s*[a-z]", "exponential"),
)

SHARED_FEATURES_TAIL = (
    (r"\b(polynomial)\b", "polynomial"),
    (r"\b(rational\s+expression|rational\s+function)\b", "rational"),
    (r"\b(sequence|series|arithmetic\s+sequence|geometric\s+sequence|nth\s+term)\b", "sequence_series"),
    (r"\b(matrix|matrices|determinant)\b", "matrix"),
    (r"\b(circle|ellipse|parabola|hyperbola|conic)\b", "conic_section"),
    (r"\b(slope|intercept|midpoint|distance\s+formula)\b", "coordinate_geometry"),
    (r"[<>]=?|\\le|\\ge|≤|≥", "inequality"),
    (r"\\frac|/", "fraction"),
    (r"\^|²|³|⁴", "exponent"),
    (r"\\sqrt|√|root", "radical"),
    (r"%|percent", "percent"),
)

FEATURES_HISTORY = (
    (rf"\b(?:(?:quadratic|x\^2)\b|x²{END})", "quadratic"),
    (rf"\b(?:(?:cubic|x\^3)\b|x³{END})", "cubic"),
    (rf"\b(?:(?:quartic|x\^4)\b|x⁴{END})", "quartic"),
    *SHARED_FEATURES_HEAD,
    *SHARED_FEATURES_TAIL,
)

FEATURES_BANK = (
    (rf"\b(?:(?:quadratic|[a-z]\^2)\b|[a-z]²{END})", "quadratic"),
    (rf"\b(?:(?:cubic|[a-z]\^3)\b|[a-z]³{END})", "cubic"),
    (rf"\b(?:(?:quartic|[a-z]\^4)\b|[a-z]⁴{END})", "quartic"),
    *SHARED_FEATURES_HEAD,
    (r"\d+\s*!", "factorial_number_theory"),
    (r"\b(tens|ones|units)\s+digit\b|\bdigit\b", "digit_extraction"),
    (r"\bpalindrome\b", "palindrome_number_theory"),
    *SHARED_FEATURES_TAIL,
    (r"\bwhen\b[^.?]*[a-z]\s*=\s*\S+\s*(?:,?\s*(?:and|&)\s*)[a-z]\s*=", "multi_variable_substitution"),
)

MULTI_UNKNOWN = r"(?:solve|find)\s+(?:for\s+)?[a-z]\s*(?:(?:,\s*|\s+and\s+)[a-z])"

TYPE_FEATURES_HISTORY = [
    "linear", "system_of_equations", "quadratic", "cubic", "quartic", "derivative", "integral",
    "limit", "matrix", "probability", "conditional_probability", "trigonometric", "logarithm",
    "exponential", "sequence_series", "conic_section", "factoring", "simplify", "expand",
    "permutation", "combination", "expected_value", "coordinate_geometry", "polynomial", "rational",
    "rational_equation",
]

TYPE_FEATURES_BANK = TYPE_FEATURES_HISTORY + ["factorial_number_theory", "palindrome_number_theory"]

# --- keyword and operation words (fixed values) --------------------------------

KEYWORDS_PROBLEM = [
    "solve", "find", "calculate", "determine", "evaluate", "value of", "equation", "equals", "=",
    "factor", "expand", "simplify", "system",
    "compare", "least", "greatest", "smallest", "largest", "minimum", "maximum",
    "least value", "greatest value", "smallest value", "largest value", "which of the following",
    "derivative", "differentiate", "integrate", "integral", "limit", "lim",
    "d/dx", "dy/dx", "∫", "∂",
    "sin", "cos", "tan", "sec", "csc", "cot", "arcsin", "arccos", "arctan",
    "polar", "rectangular", "complex", "vector",
    "sequence", "series", "domain", "range", "asymptote",
    "mean", "median", "mode", "average", "variance", "standard deviation", "deviation",
    "probability", "p(", "chance", "odds", "likely",
    "given that", "given", "|", "conditional",
    "coin", "coins", "dice", "die", "card", "ball", "balls", "bag",
    "flip", "flipped", "roll", "rolled", "draw", "drawn",
    "heads", "tails", "outcome", "outcomes", "event", "favorable",
    "combinations", "permutations", "c(", "factorial",
    "how many", "number of ways", "arrangement", "arrangements", "choose", "select",
    "without replacement", "with replacement",
    "variation", "varies", "direct variation", "inverse variation",
    "directly proportional", "inversely proportional",
    "rate", "unit rate", "at this rate", "at the same rate",
    "miles per hour", "per minute", "per hour",
    "random", "distribution", "expected value", "expectation", "sample",
]

OPERATION_WORDS = [
    "solve", "find", "calculate", "evaluate", "value", "factor", "expand", "simplify",
    "derivative", "integrate", "limit", "mean", "median", "mode", "probability", "variance",
    "roll", "flip", "draw", "combinations", "permutations",
    "arrange", "arrangement", "choose", "select", "expected value", "expectation",
    "sin", "cos", "tan", "domain", "range", "sequence", "series",
    "variation", "proportion", "rate",
    "compare", "least", "greatest", "smallest", "largest", "minimum", "maximum",
    "which of the following",
]

COMPLEXITY_MARKERS = [
    "given that", "conditional", "system", "variance", "standard deviation",
    "integral", "derivative", "limit", "chain rule", "product rule", "prove",
]

# --- intents (fixed values) -----------------------------------------------------

RELATED_INTENTS = [
    ("solve_equation", "real_solutions"),
    ("probability", "conditional_probability"),
    ("derivative", "integral"),
    ("mean", "median"),
    ("mean", "mode"),
    ("counting_arrangements", "probability"),
    ("ratio_proportion", "percent"),
    ("evaluate_substitution", "solve_equation"),
    ("variation", "ratio_proportion"),
    ("compare_values", "evaluate_substitution"),
    ("compare_values", "solve_equation"),
]

INTENT_FAMILIES = {
    "equation": ["solve_equation", "real_solutions"],
    "probability": [
        "probability", "basic_probability", "combinatorial_probability",
        "binomial_probability", "conditional_probability", "permutation_complementary",
    ],
    "counting": [
        "counting_arrangements", "counting_principle", "combination",
        "counting_with_restrictions", "division_into_groups",
    ],
    "trig": [
        "trigonometric", "trigonometric_values", "trigonometric_identity",
        "trigonometric_equation", "harmonic_form",
    ],
    "vector": ["dot_product_orthogonality", "vector_magnitude", "parametric_vector_function"],
}

INTENTS_PRECALCULUS = [
    "derivative", "integral", "limit", "trigonometric", "sequence_series", "function_analysis",
    "coordinate_conversion", "function_composition", "function_evaluation", "slope_formula",
    "angle_conversion", "trigonometric_values", "harmonic_form", "trigonometric_identity",
    "dot_product_orthogonality", "trigonometric_equation", "law_of_sines",
    "parametric_vector_function", "vector_magnitude", "matrix_determinant",
]
INTENTS_COUNTING = [
    "probability", "conditional_probability", "counting_arrangements", "expected_value",
    "variance", "mean", "median", "mode",
]
INTENTS_ALGEBRA = [
    "evaluate_substitution", "compare_values", "solve_equation", "real_solutions", "factor",
    "expand", "simplify", "system", "percent", "ratio_proportion", "variation",
]

INTENTS_IN_SCOPE = [
    "solve_equation", "real_solutions", "evaluate_substitution", "rewrite_expression",
    "find_asymptotes", "find_maximum", "vietas_formulas", "expand", "simplify",
    "ratio_proportion", "variation", "system", "function_evaluation", "slope_formula",
    "angle_conversion", "trigonometric_values", "trigonometric_identity",
    "trigonometric_equation", "harmonic_form", "dot_product_orthogonality", "law_of_sines",
    "parametric_vector_function", "vector_magnitude", "matrix_determinant",
    "analytic_geometry", "probability", "conditional_probability", "counting_arrangements",
    "counting_principle", "counting_with_restrictions", "expected_value",
    "factorial_number_theory", "palindrome_number_theory",
]

# --- subject scorers (fixed values) ---------------------------------------------

SUBJECT_WORDS_PRECALCULUS = [
    "derivative", "differentiate", "integral", "integrate", "limit", "lim",
    "d/dx", "dy/dx", "∫", "∂", "rate of change", "optimization", "concave",
    "inflection", "slope", "curve", "velocity", "acceleration", "extrema",
    "maximum", "minimum", "gradient", "second derivative", "critical point",
    "antiderivative", "riemann", "area under", "taylor", "maclaurin",
    "convergence", "divergence", "function", "exponential", "logarithmic",
    "sequence", "series", "sin", "cos", "tan", "sec", "csc", "cot",
    "arcsin", "arccos", "arctan", "radian", "degrees",
    "polar", "rectangular", "complex", "vector", "matrix", "determinant",
    "domain", "range", "asymptote",
]
SUBJECT_WORDS_COUNTING = [
    "probability", "mean", "median", "mode", "variance", "standard deviation",
    "distribution", "expected value", "random", "coin", "dice", "die", "sample",
    "permutation", "combination", "factorial", "count", "counting", "arrange",
    "arrangement", "selection", "flip", "flipped", "roll", "rolled", "choose",
    "outcome", "outcomes", "event", "favorable", "nCr", "nPr", "odds", "chance",
    "bell curve", "normal distribution", "bayes", "conditional", "dependent", "independent",
    "without replacement", "with replacement", "how many", "number of ways", "at least", "at most",
]
SUBJECT_WORDS_ALGEBRA = [
    "solve", "factor", "factorize", "simplify", "expand", "quadratic",
    "equation", "polynomial", "inequality", "linear", "matrix", "system",
    "system of equations", "roots", "zero", "parabola", "binomial", "trinomial",
    "monomial", "rational", "radical", "algebraic", "expression", "substitute",
    "evaluate", "variable", "coefficient",
]
SUBJECT_PATTERN_PRECALCULUS = (
    r"\bd/dx\b|\bdy/dx\b|∫|∂|\blimit\b|\blim\b|derivative|integral|optimization"
    r"|\bsin\b|\bcos\b|\btan\b|\barcsin\b|\barccos\b|\barctan\b|\bpolar\b|\brectangular\b"
)
SUBJECT_PATTERN_COUNTING = (
    r"\bp\(|probability|permutation|combination|C\(|nCr|counting|factorial|how many"
    r"|number of ways|without replacement|with replacement|expected value"
)
SUBJECT_PATTERN_ALGEBRA = r"\bsolve\s+for\b|factor|simplify|expand|quadratic|equation"
SUBJECT_TIE_ALGEBRA = (
    r"\breal\s+solutions?\b|\breal\s+roots?\b|\bsolve\b|\bquadratic\b|\bequation\b|\bpolynomial\b"
)
SUBJECT_TIE_CALCULUS = (
    r"\bd/dx\b|\bdy/dx\b|∫|∂|\blimit\b|\bderivative\b|\bintegral\b|\bsin\b|\bcos\b|\btan\b"
    r"|\bsequence\b|\bseries\b"
)

# second scorer: (weight, keywords, patterns, operations); patterns see lower-cased text
FORM_SUBJECTS = {
    "pre-calculus": (
        3,
        [
            "derivative", "integral", "limit", "differentiate", "integrate", "tangent",
            "rate of change", "optimization", "concave", "inflection", "slope", "curve",
            "velocity", "acceleration", "extrema", "maximum", "minimum", "gradient",
            "second derivative", "critical point", "antiderivative", "riemann", "area under",
            "function", "exponential", "logarithmic", "sequence", "series", "convergence",
            "graph", "asymptote", "domain", "range", "inverse function", "composite function",
            "trigonometric", "sine", "cosine", "tangent function", "periodic",
            "radian", "degrees", "convert", "angle", "unit circle",
            "vector", "orthogonal", "perpendicular", "dot product", "magnitude",
            "matrix", "determinant", "singular", "non-invertible", "invertible",
            "law of sines", "law of cosines", "triangle", "parametric",
            "harmonic", "identity", "double angle",
        ],
        [
            r"d/dx", r"∫", r"lim|limit", r"derivative|derivatives", r"(?i)integral|integrate",
            r"exponential|logarithm|log\(", r"sin|cos|tan|graph|function",
            r"find.*(derivative|integral|limit|domain|range|asymptote)",
            r"\bslope\b.*through", r"convert.*(?:degree|radian)", r"evaluate\s+(?:sin|cos|tan)",
            r"maximum\s+value\s+of\s+\d+\s*(?:cos|sin)", r"orthogonal|perpendicular",
            r"matrix.*(?:singular|invertible|determinant)", r"△|\\triangle",
            r"\br\s*\(\s*t\s*\)", r"unit\s+vector", r"⟨|⟩",
        ],
        ["derivative", "integral", "limit", "exponential growth"],
    ),
    "counting-probability": (
        2,
        [
            "probability", "mean", "median", "mode", "variance", "standard deviation",
            "distribution", "expected value", "random", "coin", "dice", "die", "sample",
            "permutation", "combination", "count", "arrangement", "selection",
            "bell curve", "normal distribution", "quartile", "percentile", "z-score",
            "frequency", "event", "outcome", "counting", "arrange", "choose",
            "factorial", "nCr", "nPr", "odds", "chance", "flip", "flipped", "roll", "rolled",
            "ways", "how many", "different", "possible outcomes", "sample space",
            "at least", "probability of", "likelihood", "bayes", "conditional",
        ],
        [
            r"probability|P\(", r"mean|average|median|mode", r"(?i)standard deviation|σ|variance",
            r"distribution", r"sample|population", r"(?i)permutation|combination|C\(|nCr|nPr",
            r"counting|arrange|flip|roll|die|dice|coin", r"(?i)how many ways|ways to",
            r"(?i)in how many|possible.*outcomes|select|pick",
        ],
        ["probability", "counting", "arrangement", "permutation", "combination"],
    ),
    "algebra": (
        1,
        [
            "solve", "solve for", "factor", "factorize", "expand", "quadratic",
            "equation", "polynomial", "linear", "system of equations", "roots", "zero", "parabola",
            "binomial", "trinomial", "monomial", "rational", "radical", "algebraic",
            "real solutions", "real roots", "substitute", "inequality", "variable", "coefficient",
        ],
        [
            r"solve (for|x|y|z)", r"factor|factorize", r"expand", r"(?i)quadratic",
            r"equation(s)?", r"polynomial", r"inequality", r"system.*equation",
        ],
        ["factor", "simplify", "solve", "expand"],
    ),
}
FORM_GOALS_PRECALCULUS = [
    "graph", "sketch", "solve for x", "find x", "find the derivative", "find the integral",
    "find the limit", "determine the function", "calculate the slope",
]
FORM_GOALS_COUNTING = [
    "how many ways", "in how many", "probability", "likelihood", "chance", "ways to arrange",
    "how many different", "possible outcomes", "probability of",
]
FORM_NOT_ALGEBRA = (
    r"\bd/dx\b|\bdy/dx\b|∫|\bderivative\b|\bdifferentiate\b|\bintegral\b|\bintegrate\b|\blimit\b|\blim\b"
    r"|\bsin\b|\bcos\b|\btan\b|\bsec\b|\bcsc\b|\bcot\b|\barcsin\b|\barccos\b|\barctan\b|\bslope\b"
    r"|\bconvert\b|\bradian|\bdegree|\bmatrix\b|\bdet\b|\bsingular\b|\bnon-invertible\b|\binvertible\b"
    r"|\bdeterminant\b|\borthogonal\b|\bperpendicular\b|\bvector|\bunit vector|\b[⟨<]|\btriangle\b|△"
    r"|\blaw of sines\b|\blaw of cosines\b|\br\s*\(\s*t\s*\)"
)
FORM_ALGEBRA = (
    r"\bsolve\b|\bsolution\b|\bsolutions\b|\broot\b|\broots\b|\bequation\b|\bpolynomial\b|\bfactor\b"
    r"|\bfind x\b|\bsolve for\b"
)
FORM_HARD_PRECALCULUS = [
    "differentiate", "derivative", "partial derivative", "integrate", "integral",
    "limit", "optimization", "inflection", "concavity", "series",
    "taylor", "maclaurin", "convergence", "divergence", "chain rule",
    "logarithmic differentiation", "implicit differentiation", "riemann sum",
]
FORM_HARD_COUNTING = [
    "bayes", "conditional probability", "given that", "dependent", "independent",
    "multivariate", "distribution", "binomial", "poisson", "hypergeometric",
    "permutation", "combination", "multinomial", "expected value", "variance",
]
FORM_HARD_ALGEBRA = [
    "system of equations", "quadratic formula", "imaginary", "complex", "matrix",
    "determinant", "eigenvalue", "eigenvector", "rational function", "partial fraction",
    "asymptote", "domain", "range", "piecewise",
]
FORM_MEDIUM = [
    "quadratic", "factor", "inequality", "probability", "permutation", "combination",
    "standard deviation", "variance", "word problem", "application", "exponential",
    "logarithmic", "solve the system", "arrangement", "selection",
]
FORM_BASIC = [
    "add", "subtract", "multiply", "divide", "plus", "minus", "simplify",
    "evaluate", "calculate", "find", "what is", "compute", "solve",
]

# --- scope guards (fixed values) --------------------------------------------------

SCOPE_WORDS = [
    "solve", "equation", "factor", "polynomial", "simplify", "expand", "evaluate", "derivative",
    "integral", "limit", "function", "sequence", "series", "probability", "permutation",
    "combination", "ratio", "proportion", "mean", "median", "variance", "percent", "matrix",
    "vector", "trigonometric", "log",
]

OUTSIDE_WORDS = [
    "geometry", "triangle", "triangles", "rectangle", "rectangles", "square", "squares", "circle",
    "circles", "polygon", "polygons", "perimeter", "area", "volume", "surface", "hypotenuse",
    "radius", "diameter", "circumference", "chord", "tangent", "secant", "parallel",
    "perpendicular", "angles", "angle",
]

SIGNAL_WORDS = {
    "algebra": [
        "equation", "solve", "factor", "simplify", "expand", "polynomial", "quadratic", "linear",
        "system", "inequality", "substitute", "evaluate", "expression", "variable", "root", "roots",
        "real",
    ],
    "pre-calculus": [
        "trigonometric", "sin", "cos", "tan", "sec", "csc", "cot", "arcsin", "arccos", "arctan",
        "function", "domain", "range", "limit", "derivative", "integral", "sequence", "series",
        "log", "logarithm", "exponential", "matrix", "vector",
    ],
    "counting-probability": [
        "probability", "permutation", "combination", "arrangement", "arrangements", "choose",
        "select", "random", "event", "outcome", "outcomes", "odds", "chance", "expected",
        "variance", "mean", "median", "mode", "coin", "dice", "die", "card", "bag",
    ],
}

OVERLAP_WORDS = [
    "function", "functions", "graph", "graphs", "sequence", "sequences", "series", "exponent",
    "exponents", "log", "logarithm", "coordinate", "slope", "line", "parabola", "trigonometric",
    "sin", "cos", "tan",
]

SHAPE_WORDS = [
    "triangle", "triangles", "rectangle", "rectangles", "square", "squares", "circle", "circles",
    "polygon", "polygons", "sphere", "cube", "cylinder", "cone", "prism",
]

MEASURE_WORDS = [
    "area", "perimeter", "volume", "surface", "circumference", "radius", "diameter", "hypotenuse",
    "height", "width", "length",
]

GEOMETRY_CUES = [
    "ladder", "wall", "building", "shadow", "distance", "height", "angle", "angles",
]

# --- example metadata (fixed values) -----------------------------------------------

CONCEPT_BY_INTENT = {
    "conditional_probability": "conditional_probability_application",
    "probability": "probability_computation",
    "counting_arrangements": "combinatorics_counting",
    "expected_value": "expected_value_computation",
    "derivative": "derivative_computation",
    "integral": "integral_computation",
    "limit": "limit_evaluation",
    "function_composition": "function_composition_evaluation",
    "sequence_series": "sequence_series_analysis",
    "trigonometric": "trigonometric_evaluation",
    "variation": "direct_inverse_variation",
    "ratio_proportion": "ratio_proportion_reasoning",
    "mean": "mean_calculation",
    "median": "median_calculation",
    "mode": "mode_calculation",
    "variance": "variance_calculation",
    "factor": "polynomial_factoring",
    "expand": "algebraic_expansion",
    "simplify": "algebraic_simplification",
    "system": "simultaneous_equations",
}

SKILLS_BY_INTENT = {
    "evaluate_substitution": ["substitution", "expression_evaluation"],
    "solve_equation": ["equation_solving"],
    "real_solutions": ["equation_solving", "root_filtering"],
    "conditional_probability": ["conditional_probability_rule", "probability_rules"],
    "probability": ["probability_rules"],
    "counting_arrangements": ["counting_principles"],
    "expected_value": ["expected_value"],
    "derivative": ["differentiation"],
    "integral": ["integration"],
    "limit": ["limit_laws"],
    "function_composition": ["function_composition"],
    "sequence_series": ["sequence_analysis"],
    "trigonometric": ["trigonometric_evaluation"],
    "ratio_proportion": ["proportional_reasoning"],
    "variation": ["proportional_reasoning"],
    "percent": ["percent_conversion"],
    "factor": ["factoring"],
    "expand": ["expansion"],
    "simplify": ["algebraic_simplification"],
    "system": ["simultaneous_equations"],
    "mean": ["statistical_computation"],
    "median": ["statistical_computation"],
    "mode": ["statistical_computation"],
    "variance": ["statistical_computation"],
}

SKILLS_BY_FEATURE = [
    ("fraction", "fraction_simplification"),
    ("exponent", "exponent_rules"),
    ("root", "root_simplification"),
    ("assignment", "value_substitution"),
    ("system", "simultaneous_equations"),
]

TAG_FEATURES = [
    "substitution", "system", "fraction", "exponent", "probability", "conditional_probability",
    "derivative", "integral", "limit", "trigonometric", "percent", "proportion", "variation",
]

FORMAT_LABEL_BY_FEATURE = {
    "equation": "equation",
    "inequality": "inequality",
    "fraction": "fractional_form",
    "exponent": "exponent_expression",
    "root": "root_expression",
    "function_notation": "function_notation",
    "composition": "function_composition",
    "assignment": "assigned_values",
    "multi_assignment": "multi_assignment",
    "substitution": "expression_substitution",
    "system": "system_of_equations",
    "conditional_probability": "conditional_probability_form",
    "labeled_options": "labeled_options",
    "value_comparison": "value_comparison",
}

# --- prompt wording (fixed values) ---------------------------------------------------

ZERO_SHOT_HEAD = "Solve the following math problem. "
FEW_SHOT_HEAD = "Solve math problems like the examples below."

# --- failure messages (fixed values) ---------------------------------------------------

MEMORY_MARKER = "requires more system memory"
GPU_MARKERS = [
    "cuda error", "ggml-cuda", "shared object initialization failed", "cudafuncsetattribute",
    "current device:", "llama runner process has terminated: cuda error",
]
HEDGES = r"(?i)\b(i am not sure|cannot determine|insufficient information)\b"

# fixed values: longest texts of a new example's columns, in characters
EXAMPLE_LIMITS = {"problem": 5000, "solution": 10000, "subject": 50, "difficulty": 20, "type": 100, "concept": 100}
