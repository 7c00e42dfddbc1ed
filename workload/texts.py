"""Queries over labels and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import lexicon as lx
from gaugeline.functions import text as tx
from gaugeline.functions.basics import rounded
from gaugeline.operators.sequences import with_ids
from workload import views as vw

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def pick(words: list[str], column: str) -> str:
    """SQL for both engines: a word by the remainder of an id column."""
    cases = " ".join(f"when {i} then '{w}'" for i, w in enumerate(words))
    return f"case {column} % {len(words)} {cases} end"


DOMAIN_WORDS = ["Algebra", " precal ", "Counting and Probability", "Counting-Probability", "STATISTICS", "pre calculus", "calculus", "geometry", "", "counting&probability", "stat", "probability", "Counting_And_Prob"]


@register("p1_p2_domain_labels", f"""
select event_id, case trim(lower(w)) when 'algebra' then 'algebra' when 'precal' then 'pre-calculus' when 'counting and probability' then 'counting-probability'
 when 'counting-probability' then 'counting-probability' when 'statistics' then 'counting-probability' when 'pre calculus' then 'pre-calculus' when 'calculus' then 'pre-calculus'
 when 'counting&probability' then 'counting-probability' when 'stat' then 'counting-probability' when 'counting_and_prob' then 'counting-probability' else trim(lower(w)) end domain_label,
 case trim(lower(w)) when '' then 'general' when 'calculus' then 'pre-calculus' when 'statistics' then 'counting-probability' when 'stat' then 'counting-probability'
 when 'probability' then 'counting-probability' else trim(lower(w)) end subject_label
from (select event_id, {pick(DOMAIN_WORDS, 'event_id')} w from events)""")
def domain_labels(spark, sf):
    df = vw.table(spark, sf, "events").withColumn("w", F.expr(pick(DOMAIN_WORDS, "event_id")))
    return df.select("event_id", tx.domain_label(F.col("w")).alias("domain_label"), tx.subject_label(F.col("w")).alias("subject_label"))


TYPE_WORDS = ["Equation", "substitution", "Real Root", "counting", "Linear Thing!", " expand ", "", "value-comparison"]
LEVEL_WORDS = ["easy", "Medium", "HARD", "basic", "expert", "2", "5", "interm", "", "weird"]


@register("p3_p6_labels", f"""
select p_partkey, replace(lower(trim(p_name)), ' ', '_') name_key, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') type_label,
 case l when 'equation' then 'solve_equation' when 'substitution' then 'evaluate_substitution' when 'real_root' then 'real_solutions' when 'counting' then 'counting_arrangements'
  when 'expand' then 'polynomial_expansion' when 'value_comparison' then 'compare_values' else l end canonical_type,
 case d when 'easy' then 'basic' when 'medium' then 'intermediate' when 'hard' then 'advanced' when 'expert' then 'advanced' when '' then null else d end difficulty,
 case d when 'easy' then 'basic' when 'basic' then 'basic' when 'medium' then 'intermediate' when '2' then 'intermediate' when 'interm' then 'intermediate' when 'hard' then 'advanced' when 'expert' then 'advanced' when '5' then 'advanced' end bank_difficulty
from (select *, trim(regexp_replace(lower(trim({pick(TYPE_WORDS, 'p_partkey')})), '[^a-z0-9]+', '_', 'g'), '_') l, lower({pick(LEVEL_WORDS, 'p_partkey')}) d from part)""")
def labels(spark, sf):
    df = vw.table(spark, sf, "part").withColumns({"t": F.expr(pick(TYPE_WORDS, "p_partkey")), "d": F.expr(pick(LEVEL_WORDS, "p_partkey"))})
    return df.select(
        "p_partkey", tx.key(F.col("p_name")).alias("name_key"), tx.label(F.col("p_type")).alias("type_label"),
        tx.type_label(F.col("t")).alias("canonical_type"), tx.difficulty_label(F.col("d")).alias("difficulty"),
        tx.bank_difficulty(F.col("d")).alias("bank_difficulty"),
    )


@register("p5_p6_label_lists", """
with raw as (select p_partkey, [p_name, upper(p_name), p_type, 'Real Root', 'real_root', ''] v, ['positive value', 'nonnegative', 'Positive Value'] c from part),
made as (select *, list_filter(list_transform(v, lambda x: trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '_', 'g'), '_')), lambda x: x <> '') m from raw)
select p_partkey, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') labels, array_to_string(list_sort(list_distinct(m)), ',') sorted_labels,
 'positive_values,non_negative' constraint_labels from made""")
def label_lists(spark, sf):
    df = vw.table(spark, sf, "part")
    values = F.array("p_name", F.upper("p_name"), "p_type", F.lit("Real Root"), F.lit("real_root"), F.lit(""))
    return df.select(
        "p_partkey", F.array_join(tx.label_list(values), ",").alias("labels"),
        F.array_join(tx.label_list(values, ordered=True), ",").alias("sorted_labels"),
        F.array_join(tx.constraint_labels(F.expr("array('positive value', 'nonnegative', 'Positive Value')")), ",").alias("constraint_labels"),
    )


@register("p7_p8_format_labels", """
select p_partkey, array_to_string(list_sort(list_distinct(['has_fraction', 'template', trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_')]
  || case when p_size % 2 = 0 then ['has_fraction_true'] else [] end || ['equation_count', p_size::varchar, 'kinds', 'a_b', lower(p_type)])), ',') labels,
 array_to_string(['has_fraction=' || (p_size % 2 = 0), 'template=' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 'equation_count=' || p_size, 'kinds=a_b+' || lower(p_type)], ';') entries from part""")
def format_labels(spark, sf):
    body = F.to_json(F.struct(
        (F.col("p_size") % 2 == 0).alias("Has Fraction"), F.col("p_name").alias("template"),
        F.col("p_size").alias("equation_count"), F.array(F.lit("A b"), F.col("p_type")).alias("Kinds"),
    ))
    df = vw.table(spark, sf, "part").withColumn("f", body)
    entries = F.transform(tx.format_entries(F.col("f")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["labels"], "+")))
    return df.select("p_partkey", F.array_join(tx.format_labels(F.col("f")), ",").alias("labels"), F.array_join(entries, ";").alias("entries"))


@register("p9_p10_levels", """
with l as (select event_id, value, case when value <= 0 then null when value <= 3 then value else greatest(1, least(3, 1 + (value - 1) / 2)) end lv from events)
select event_id, round(lv::decimal(28,10), 6)::double as level,
 case when lv is null then null when lv <= 1.5 then 'basic' when lv <= 2.5 then 'intermediate' else 'advanced' end level_label,
 round((case when value - 5 < 0 then 0 when value - 5 <= 1 then value - 5 when value - 5 <= 10 then (value - 5) / 10 else least(1, (value - 5) / 100) end)::decimal(28,10), 6)::double anchor from l""")
def levels(spark, sf):
    df = vw.table(spark, sf, "events")
    level = tx.difficulty_level(F.col("value").cast("string"))
    return df.select(
        "event_id", rounded(level, 6).alias("level"), tx.level_label(level).alias("level_label"),
        rounded(tx.anchor_priority((F.col("value") - 5).cast("string")), 6).alias("anchor"),
    )


@register("p11_problem_id", r"select doc_id, 'problem_' || sha1(trim(lower(regexp_replace(text, '\s+', ' ', 'g')))) problem_id from documents")
def problem_id(spark, sf):
    return vw.texts(spark, sf).select("doc_id", tx.problem_id(F.col("text")).alias("problem_id"))


@register("p12_p16_detection_text", r"""
select p_partkey, trim(lower(regexp_replace(translate(t, '−×', '-*'), '\s+', ' ', 'g'))) detection, translate(t, '−×', '-*') symbols
from (select p_partkey, concat('  ', p_name, chr(10), ' − ', p_size, ' × X', ' = ', p_type) t from part)""")
def detection(spark, sf):
    t = F.concat(F.lit("  "), "p_name", F.lit("\n − "), F.col("p_size").cast("string"), F.lit(" × X = "), "p_type")
    df = vw.table(spark, sf, "part").withColumn("t", t)
    return df.select("p_partkey", tx.detection_text(F.col("t")).alias("detection"), tx.math_symbols(F.col("t"), False).alias("symbols"))


@register("p13_problem_text", "with " + vw.MATH + r"""
select id, replace(replace(problem, 'x^2', 'x²'), 'x^3', 'x³') problem_text from math_problems""")
def problem_text(spark, sf):
    wrapped = F.concat(F.lit(" q:  "), "problem", F.lit("\nA:\n a: "))
    return vw.math_problems(spark, sf).select("id", tx.problem_text(wrapped).alias("problem_text"))


SIGNATURE = r"""
with a as (select id, trim(lower(regexp_replace(problem, '\s+', ' ', 'g'))) v from math_problems),
b as (select id, regexp_replace(v, '(^|[^a-z])(\d+(?:\.\d+)?)([a-z])([^a-z]|$)', '\1<num><var>\4', 'g') v from a),
c as (select id, regexp_replace(v, '\b\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?\b', '<num>', 'g') v from b),
d as (select id, regexp_replace(regexp_replace(v, '(^|[^a-z])[a-z]([^a-z]|$)', '\1<var>\2', 'g'), '(^|[^a-z])[a-z]([^a-z]|$)', '\1<var>\2', 'g') v from c)
select id, regexp_replace(regexp_replace(v, '\s+', '', 'g'), '[.,;:!?]+$', '') signature from d"""


@register("p14_signature", "with " + vw.MATH + ", " + SIGNATURE.strip()[5:])
def signature(spark, sf):
    return vw.math_problems(spark, sf).select("id", tx.signature(F.col("problem")).alias("signature"))


@register("p15_canonical", r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(v, 'q:', ' '), 'a:', ' '), '\s+', '', 'g'), '[^a-z0-9^=+\-*/()\[\]{}|<>.,]', '', 'g'), '[.,;:!?]+$', '') canonical
from (select doc_id, trim(lower(regexp_replace(regexp_replace(translate(text, '−–×÷', '--*/'), '([⁰¹²³⁴⁵⁶⁷⁸⁹])', '^\1', 'g'), '\s+', ' ', 'g'))) v from documents)""")
def canonical(spark, sf):
    return vw.texts(spark, sf).select("doc_id", tx.canonical(F.col("text")).alias("canonical"))


CLEAN = r"""
with a as (select doc_id, regexp_replace(trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)), '^\s*(?:q|question)\s*:\s*', '', 'i') v from documents),
b as (select doc_id, v, list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') l from a),
c as (select doc_id, v, LINES l from b),
d as (select doc_id, v, l, len(l) n, len(list_filter(l, lambda x: length(regexp_replace(x, '\s+', '', 'g')) <= 3)) short,
      len(list_filter(l, lambda x: regexp_full_match(regexp_replace(x, '\s+', '', 'g'), '[0-9a-zA-Z+\-*/=^().,%]+'))) plain from c)
select doc_id, case when n = 0 then v when n >= 6 and (short::double / n >= 0.55 or (n >= 8 and plain::double / n >= 0.75)) then array_to_string(l, ' ') else array_to_string(l, chr(10)) end cleaned from d"""


@register("p17_w7_example_text", CLEAN.replace("LINES", "list_filter(l, lambda x, i: i = 1 or x <> l[i - 1])"))
def example_text(spark, sf):
    return vw.texts(spark, sf).select("doc_id", tx.example_text(F.col("text"), False).alias("cleaned"))


@register("b6_clean_bank_text", CLEAN.replace("LINES", "l"))
def bank_text(spark, sf):
    return vw.texts(spark, sf).select("doc_id", tx.example_text(F.col("text"), False, drop_repeats=False, keep_blocks=True).alias("cleaned"))


@register("p18_p19_plain_math", r"""
select p_partkey, '((' || p_size || ')/(2))/(' || p_partkey || ') + ' || p_size || ' x (1)/(' || (p_size % 10) || ') and ' || p_name || '!' prompt_text from part""")
def plain_math(spark, sf):
    size, part = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    t = F.concat(
        F.lit("Q: \\frac{\\frac{"), size, F.lit("}{2}}{"), part, F.lit("}  + \\boxed{"), size, F.lit("}\\times\\frac 1"),
        (F.col("p_size") % 10).cast("string"), F.lit(" \\left and [asy] draw(x);\n [/asy] "), F.col("p_name"), F.lit(" !"),
    )
    return vw.table(spark, sf, "part").select("p_partkey", tx.prompt_ready(t, False).alias("prompt_text"))


def _sql_list(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


@register("p20_tokens", f"""
with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) a from documents),
u as (select doc_id, a, list_filter(a, lambda x: not list_contains({_sql_list(lx.STOP_WORDS_HISTORY)}, x)) h, list_filter(a, lambda x: not list_contains({_sql_list(lx.STOP_WORDS_BANK)}, x)) b from t)
select doc_id, len(a)::bigint all_tokens, len(h)::bigint history_tokens, len(b)::bigint bank_tokens, md5(array_to_string(list_sort(h), ' ')) digest from u""")
def tokens(spark, sf):
    text = F.col("text")
    return vw.texts(spark, sf).select(
        "doc_id", F.size(tx.tokens(text)).cast("long").alias("all_tokens"),
        F.size(tx.tokens(text, lx.STOP_WORDS_HISTORY)).cast("long").alias("history_tokens"),
        F.size(tx.tokens(text, lx.STOP_WORDS_BANK)).cast("long").alias("bank_tokens"),
        F.md5(F.array_join(F.array_sort(tx.tokens(text, lx.STOP_WORDS_HISTORY)), " ").cast("binary")).alias("digest"),
    )


FLAGS = ["true", "No", " yes ", "0", "2", "maybe", "off", ""]
QUALITIES = ["ground_truth", "heuristic", "other", "no_ground_truth", ""]


@register("p21_p23_ground_truth_flags", f"""
with f as (select o_orderkey, {pick(FLAGS, 'o_orderkey')} e, {pick(FLAGS, '(o_orderkey + 3)')} d, {pick(QUALITIES, 'o_orderkey')} eq, {pick(QUALITIES, '(o_orderkey + 2)')} dq from orders),
g as (select *, case trim(lower(e)) when 'true' then true when 'no' then false when 'yes' then true when '0' then false when 'off' then false end te,
 case trim(lower(d)) when 'true' then true when 'no' then false when 'yes' then true when '0' then false when 'off' then false end td,
 case eq when 'ground_truth' then true when 'heuristic' then false when 'no_ground_truth' then false end qe, case dq when 'ground_truth' then true when 'heuristic' then false when 'no_ground_truth' then false end qd from f)
select o_orderkey, te entry_flag, coalesce(te, td, qe, qd) known, case when coalesce(te, trim(eq) <> '') then 'ground_truth' else 'no_ground_truth' end stored_quality from g""")
def flags(spark, sf):
    df = vw.table(spark, sf, "orders").select("o_orderkey", *[
        F.expr(sql).alias(n) for n, sql in (("e", pick(FLAGS, "o_orderkey")), ("d", pick(FLAGS, "(o_orderkey + 3)")), ("eq", pick(QUALITIES, "o_orderkey")), ("dq", pick(QUALITIES, "(o_orderkey + 2)")))
    ])
    return df.select(
        "o_orderkey", tx.truth(F.col("e")).alias("entry_flag"),
        tx.ground_truth_known(*[F.col(c) for c in ("e", "d", "eq", "dq")]).alias("known"),
        tx.stored_quality(F.col("e"), F.col("eq"))[1].alias("stored_quality"),
    )


@register("p24_p25_p27_resolution", f"""
select event_id, try_cast(w as double) num, coalesce(nullif(replace(lower(trim(w)), ' ', '_'), ''), 'general') resolved, nullif(trim(w), '') truth_text,
 case when trim(lower(w)) = 'benchmark' then 'benchmark' else 'normal' end run_mode
from (select event_id, {pick([' Benchmark', '3.5', '', 'Two Words', 'normal'], 'event_id')} w from events)""")
def resolution(spark, sf):
    df = vw.table(spark, sf, "events").withColumn("w", F.expr(pick([" Benchmark", "3.5", "", "Two Words", "normal"], "event_id")))
    w = F.col("w")
    return df.select(
        "event_id", tx.number(w).alias("num"), tx.first_filled(w, default="general").alias("resolved"),
        tx.ground_truth_text(w).alias("truth_text"), tx.run_mode(w).alias("run_mode"),
    )


TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@register("p28_p30_length_guards", f"""
select conv_id, turn, len(string_split_regex({TRIMMED}, '\\s+'))::bigint words, length({TRIMMED}) >= 10 enough_for_a_problem, length({TRIMMED}) >= 5 enough_for_a_run
from conversations""")
def guards(spark, sf):
    df = vw.table(spark, sf, "conversations")
    return df.select(
        "conv_id", "turn", tx.word_count(F.col("text")).cast("long").alias("words"),
        tx.long_enough(F.col("text")).alias("enough_for_a_problem"), tx.long_enough(F.col("text"), 5).alias("enough_for_a_run"),
    )


@register("p30_example_limits", """
select doc_id, length(text) between 1 and 5000 and length(coalesce(source, '')) between 1 and 10000 and length(lang) between 1 and 20 and length(substr(text, 1, (doc_id % 120)::int)) between 1 and 100 fits from documents""")
def example_limits(spark, sf):
    made = vw.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("problem"), F.col("source").alias("solution"), F.col("lang").alias("difficulty"), F.substr("text", F.lit(1), (F.col("doc_id") % 120).cast("int")).alias("type"),
    )
    return made.select("doc_id", tx.within_limits("problem", "solution", "difficulty", "type").alias("fits"))


@register("s3_sequential_ids", "select o_orderkey, (row_number() over (order by o_orderdate, o_orderkey) - 1)::bigint id from orders")
def ids(spark, sf):
    return with_ids(vw.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")
