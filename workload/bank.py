"""Queries over JSON documents, example banks and stored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import pairs as pr
from gaugeline.functions import text as tx
from gaugeline.functions.basics import alias, rounded
from gaugeline.functions import lexicon as lx
from gaugeline.operators import bank as bk
from gaugeline.operators import history as hs
from gaugeline.operators import runs as rn
from gaugeline.operators import tagging as tg
from gaugeline.session import durable, scratch_path
from gaugeline.sources import history_store as st
from gaugeline.sources import problems as sp
from workload import tags as tgq
from workload import views as vw
from workload.texts import CLEAN, pick

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# --- JSON documents built from the part table, one document per row ---------------------------

def problem_items(spark, sf):
    item = F.to_json(F.struct(
        F.col("problem"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("size").cast("string")).alias("answer"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("see "), F.col("size").cast("string"))).alias("solution"),
        F.when(F.col("id") % 4 == 0, F.col("subject")).alias("category"),
    ))
    return vw.math_problems(spark, sf).withColumn("item", item)


def documents(spark, sf):
    base = problem_items(spark, sf)
    text = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), "item", F.lit(", 5]")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit('{"Group A": ['), "item", F.lit('], "note": "x"}')))
        .otherwise(F.concat(F.lit('\ufeff{"Group B": {"hard": ['), "item", F.lit('], "n": 3}}')))
    )
    return base.select("id", text.alias("value"))


JSON_PROBLEMS = "with " + vw.MATH + """
select id, problem, coalesce(nullif(case when id % 5 = 0 then '' else size::varchar end, ''), case when id % 7 <> 0 then 'see ' || size end) answer,
 coalesce(case when id % 4 = 0 then subject end, case id % 3 when 1 then 'Group A' when 2 then 'Group B' end, 'general') category, case when id % 3 = 2 then 'hard' end difficulty
from math_problems where not (id % 5 = 0 and id % 7 = 0)"""


@register("s1_s2_problem_documents", JSON_PROBLEMS)
def json_problems(spark, sf):
    return sp.problems_from_json(documents(spark, sf)).drop("pos")


@register("s4_s6_problem_store", JSON_PROBLEMS + " and id <> 13")
def problem_store(spark, sf):
    path = scratch_path(spark, "problems")
    made = sp.problems_from_json(documents(spark, sf)).drop("pos")
    sp.write_json(made, path)
    return spark.read.schema("id long, problem string, answer string, category string, difficulty string").json(path).where("id <> 13").select(*made.columns)


def large_documents(spark, items):
    """Folder of JSON files, one document with many records each: a list, lists by key, lists by two keys."""
    path, kind = scratch_path(spark, "documents"), F.col("file") % 3
    head = F.when(kind == 0, "[").when(kind == 1, '{"Group } A": [').otherwise('{"algebra": {"hard": [')
    tail = F.when(kind == 0, "5]").when(kind == 1, '"}"], "note": "{"}').otherwise('null], "n": 3}}')
    rows = items.select((F.col("id") % 8).alias("file"), F.col("id").cast("long").alias("place"), F.concat("item", F.lit(",")).alias("value"))
    files = rows.select("file").distinct()
    for place, text in ((-1, head), (2**62, tail)):
        rows = rows.unionByName(files.select("file", F.lit(place).cast("long").alias("place"), text.alias("value")))
    lines = rows.repartition("file").sortWithinPartitions("file", "place")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return path


@register("s1_large_documents", "with " + vw.MATH + """
select problem, coalesce(nullif(case when id % 5 = 0 then '' else size::varchar end, ''), case when id % 7 <> 0 then 'see ' || size end) answer,
 coalesce(case when id % 4 = 0 then subject end, case id % 8 % 3 when 1 then 'Group } A' when 2 then 'algebra' end, 'general') category, case when id % 8 % 3 = 2 then 'hard' end difficulty
from math_problems where not (id % 5 = 0 and id % 7 = 0)""")
def sliced_problems(spark, sf):
    path = large_documents(spark, problem_items(spark, sf))
    return sp.read_problems(spark, path, sliced=True).select("problem", "answer", "category", "difficulty")


def bank_items(spark, sf):
    entry = F.to_json(F.struct(
        F.concat(F.lit("Q: "), "problem").alias("problem"), F.concat(F.lit("Answer: "), F.col("size").cast("string")).alias("answer"),
        F.when(F.col("id") % 3 == 0, "Equation").alias("type"), F.array(F.lit("Concept One"), F.lit("x")).alias("concept"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("Positive value"), F.lit("nonnegative"))).alias("constraints"),
        F.when(F.col("id") % 4 == 0, "easy").alias("difficulty"), (F.col("size") / 10).alias("anchor_priority"),
        F.when(F.col("id") % 5 < 3, F.col("id") * 100.0).alias("expires_at"),
    ))
    return vw.math_problems(spark, sf).withColumn("item", entry)


def bank_documents(spark, sf):
    base = bank_items(spark, sf)
    text = F.concat(F.lit('{"'), F.expr("case id % 3 when 0 then 'algebra' when 1 then 'pre-calculus' else 'general' end"), F.lit('": {"hard": ['), "item", F.lit("]}}"))
    return base.select("id", text.alias("value"))


BANK_SQL = vw.MATH + """,
bank as (select id, case id % 3 when 0 then 'algebra' when 1 then 'pre-calculus' else 'general' end subject, problem, size::varchar solution, case when id % 4 = 0 then 'basic' else 'advanced' end difficulty,
 case when id % 3 = 0 then 'solve_equation' end "type", case when id % 2 = 0 then 'positive_values,non_negative' end constraints, case when size / 10 <= 1 then size / 10 else size / 100 end anchor_priority,
 case when id % 5 < 3 then id * 100.0 end expires_at from math_problems)"""


@register("s7_b1_bank_documents", "with " + BANK_SQL + """
select id, subject, problem, solution, difficulty, "type", 'concept_one,x' concept, constraints, round(anchor_priority::decimal(28,10), 6)::double anchor_priority from bank""")
def bank_rows(spark, sf):
    made = sp.examples_from_json(bank_documents(spark, sf))
    return made.select(
        "id", "subject", "problem", "solution", "difficulty", "type", F.array_join("concept", ",").alias("concept"),
        F.when(F.col("constraints").isNotNull(), F.array_join("constraints", ",")).alias("constraints"), rounded(F.col("anchor_priority"), 6).alias("anchor_priority"),
    )


@register("s7_large_bank", "with " + BANK_SQL + """
select case id % 8 % 3 when 1 then 'Group } A' else 'algebra' end subject, problem, solution, case when id % 4 = 0 then 'basic' when id % 8 % 3 = 2 then 'advanced' end difficulty, "type", 'concept_one,x' concept
from bank where id % 8 % 3 <> 0""")
def sliced_bank(spark, sf):
    made = sp.read_examples(spark, large_documents(spark, bank_items(spark, sf)), sliced=True)
    return made.select("subject", "problem", "solution", "difficulty", "type", F.array_join("concept", ",").alias("concept"))


NOW = 100000.0


@register("s9_u1_merged_banks", "with " + BANK_SQL + """
select id, 0 bank, subject, problem from bank union all select id, 1, subject, problem from bank where expires_at is null or expires_at > 100000""")
def merged(spark, sf):
    user = sp.examples_from_json(bank_documents(spark, sf))
    return sp.merge_banks(user.drop("created_at", "expires_at"), user, NOW).select("id", "bank", "subject", "problem")


@register("b8_purge_expired", "with " + BANK_SQL + """
select subject, difficulty, count(*) filter (expires_at is null or expires_at > 100000)::bigint kept, count(*) filter (expires_at <= 100000)::bigint removed from bank group by 1, 2""")
def purge(spark, sf):
    return bk.purge_counts(sp.examples_from_json(bank_documents(spark, sf)), NOW)


@register("b9_user_listing", "with " + BANK_SQL + """
select subject, difficulty, problem, "type", round(((expires_at - 100000) / 3600)::decimal(28,10), 1)::double ttl_remaining_hours from bank where expires_at is null or expires_at > 100000""")
def listing(spark, sf):
    return bk.listing(sp.examples_from_json(bank_documents(spark, sf)), NOW).drop("expires_at")


@register("a16_catalogue", "with " + BANK_SQL + """
select b.subject, b.difficulty, 'concept_one' concept, n::bigint "count", b.problem sample from (select subject, difficulty, count(*) n, min(id) first from bank group by 1, 2) g join bank b on b.id = g.first""")
def catalogue(spark, sf):
    return sp.catalogue(sp.examples_from_json(bank_documents(spark, sf)).withColumn("pos", F.col("id")))


@register("a17_known_types", "with " + BANK_SQL + """
select subject, string_agg(distinct coalesce("type", 'general'), ',' order by coalesce("type", 'general')) types, string_agg(distinct difficulty, ',' order by difficulty) difficulties from bank group by 1""")
def known_types(spark, sf):
    return sp.known_types(sp.examples_from_json(bank_documents(spark, sf)))


@register("a17_type_subjects", "with " + vw.MATH + """, t as (select 'kind' || (size % 7) "type", subject, id, row_number() over (partition by size % 7 order by id desc) r from math_problems)
select "type", subject mapped_subject from t where r = 1""")
def type_subjects(spark, sf):
    base = vw.math_problems(spark, sf).select(F.concat(F.lit("kind"), (F.col("size") % 7).cast("string")).alias("type"), "subject", F.col("id").alias("pos"))
    return tg.type_subjects(base)


@register("u2_w5_distinct_texts", "select text problem, lang solution, min(doc_id) pos, count(*)::bigint copies from documents group by 1, 2")
def distinct_texts(spark, sf):
    docs = vw.texts(spark, sf).select(F.col("text").alias("problem"), F.col("lang").alias("solution"), F.col("doc_id").alias("pos"))
    return sp.distinct_examples(docs)


ENTRIES = [
    '{"problem": "p", "solution": "s"}', '{"problem": "", "solution": "s"}', '{"solution": "s"}', '{"problem": "p"}', '{"problem": "p", "answer": "a", "skills": []}',
    '{"problem": "p", "answer": "a", "anchor_priority": 1.5}', '{"problem": "p", "answer": "a", "colour": 1}', '{"problem": "p", "answer": "a", "difficulty": 0}',
    '{"problem": "p", "answer": "a", "difficulty": 2, "tags": ["x"], "constraints": [], "format": {"a": true}}', '{"problem": 5, "answer": "a", "concept": ["x", ""]}', '[1]',
]
BROKEN = ["", "problem", "problem_required", "solution_or_answer_required", "skills", "anchor_priority", "unknown_field", "difficulty", "", "problem,concept", "not_an_object,problem_required,solution_or_answer_required"]


@register("b2_validation", f"select event_id, {pick(BROKEN, 'event_id')} broken from events")
def validation(spark, sf):
    df = vw.table(spark, sf, "events").select("event_id", F.expr(pick(ENTRIES, "event_id")).alias("entry"))
    return df.select("event_id", F.array_join(bk.broken_rules(F.col("entry")), ",").alias("broken"))


STORED_TYPES = ["Solve Equation", "probability", "counting", ""]
INTENTS = ", " + "it as (select *, case " + tgq.INTENT.removeprefix("case ") + " intent, len(string_split_regex(trim(problem), '\\s+')) words from low)"
RETAG = "with " + tgq.PROBLEMS + INTENTS + f""",
rt as (select id, case intent when 'expand' then 'polynomial_expansion' else intent end det, case {pick(STORED_TYPES, 'id')} when 'Solve Equation' then 'solve_equation' when 'probability' then 'probability' when 'counting' then 'counting_arrangements' end old from it)"""


def retag_input(spark, sf):
    return tgq.problems(spark, sf).withColumns({"type": F.expr(pick(STORED_TYPES, "id")), "tags": F.array(F.lit("Keep me"), F.lit("probability"))})


@register("b4_retagged_types", RETAG + """
select id, old old_type, det "type", old is distinct from det type_changed, case when old is distinct from det then array_to_string(list_filter(['keep_me', 'probability'], lambda x: x <> coalesce(old, '') and x <> det) || [det], ',') else 'Keep me,probability' end tags from rt""")
def retag(spark, sf):
    made = bk.retag_types(retag_input(spark, sf))
    return made.select("id", "old_type", "type", "type_changed", F.array_join("tags", ",").alias("tags"))


@register("a18_type_transitions", RETAG + """ select old, det "new", count(*)::bigint n from rt where old is distinct from det group by 1, 2 order by n desc, old nulls first, det limit 20""")
def transitions(spark, sf):
    retagged = durable(bk.retag_types(retag_input(spark, sf)).select("old_type", "type", "type_changed"))
    return bk.transition_report(retagged.where("type_changed"), "old_type", "type")


LEVELS = ["Hard", "", "interm", "2", "odd"]
BUCKETS = ["basic", "", "weird", "adv"]
REGROUP = "with " + tgq.PROBLEMS + INTENTS + f""",
lv as (select id, {pick(LEVELS, 'id')} difficulty, case {pick(LEVELS, 'id')} when 'Hard' then 'advanced' when 'interm' then 'intermediate' when '2' then 'intermediate' end own,
 case {pick(BUCKETS, '(id // 5)')} when 'basic' then 'basic' when 'adv' then 'advanced' end source_bucket,
 case least(3, 1 + (words >= 18)::int + least(2, {tgq.hits(tgq.lx.COMPLEXITY_MARKERS)})) when 1 then 'basic' when 2 then 'intermediate' else 'advanced' end by_text from it),
tr as (select *, coalesce(own, source_bucket, by_text) target from lv)"""


def regroup_input(spark, sf):
    return tgq.problems(spark, sf).withColumns({"difficulty": F.expr(pick(LEVELS, "id")), "bucket": F.expr(pick(BUCKETS, "(id div 5)"))})


@register("b5_retagged_difficulties", REGROUP + " select id, source_bucket, target, difficulty <> target relabelled, coalesce(source_bucket <> target, false) moved from tr")
def regroup(spark, sf):
    return bk.retag_difficulties(regroup_input(spark, sf)).select("id", "source_bucket", "target", "relabelled", "moved")


@register("a18_bucket_report", REGROUP + """ select coalesce(source_bucket, '(list)') source_bucket, target, count(*)::bigint n, count(*) filter (coalesce(source_bucket <> target, false))::bigint moved, count(*) filter (difficulty <> target)::bigint relabelled from tr group by 1, 2""")
def bucket_report(spark, sf):
    return bk.bucket_report(bk.retag_difficulties(regroup_input(spark, sf)))


@register("b6_cleaning_report", "select k.doc_id, d.text <> k.cleaned changed from (" + CLEAN.replace("LINES", "l") + ") k join documents d on d.doc_id = k.doc_id")
def cleaning(spark, sf):
    docs = vw.texts(spark, sf).select("doc_id", F.col("text").alias("problem"), F.col("lang").alias("solution"))
    return bk.cleaning_report(docs).select("doc_id", (F.col("problem_first_change") > 0).alias("changed"))


@register("b5_regrouped_bank", REGROUP + """, s as (select tr.*, p.subject sub from tr join problems p using (id))
select sub subject, target bucket, count(*)::bigint n, count(*) filter (id % 2 = 0)::bigint even from s group by 1, 2""")
def regrouped(spark, sf):
    path = scratch_path(spark, "regrouped")
    bk.regroup(regroup_input(spark, sf), path)
    read = spark.read.schema("id long, problem string, difficulty string, subject string, bucket string").json(path)
    whole = read.where("difficulty = bucket")
    return whole.groupBy("subject", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 2 == 0).alias("even"))


@register("b6_cleaning_counts", "with k as (" + CLEAN.replace("LINES", "l") + """), c as (select d.text <> k.cleaned changed, string_split(d.text, chr(10)) a, string_split(k.cleaned, chr(10)) b from k join documents d on d.doc_id = k.doc_id),
f as (select case when changed then coalesce(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i])[1], 1) else 0 end line from c)
select 'problem' field, count(*)::bigint entries, count(*) filter (line > 0)::bigint changed, min(line) filter (line > 0)::bigint first_line from f""")
def cleaning_counts(spark, sf):
    docs = vw.texts(spark, sf).select("doc_id", F.col("text").alias("problem"), F.col("lang").alias("solution"))
    return bk.cleaning_counts(bk.cleaning_report(docs)).where("field = 'problem'")


FEATURES = {name: cond for name, cond in tgq.SQL_STRUCTURE}
CONCEPTS = " ".join(f"when kind = '{k}' then '{v}'" for k, v in lx.CONCEPT_BY_INTENT.items())
ANY = "(" + tgq.m(r"\b[a-z]\s*=") + ")"


@register("b3_upgraded_metadata", "with " + tgq.PROBLEMS + INTENTS + f""",
f as (select id, subject, intent, words, v, {tgq.tag_case(tgq.CONSTRAINTS)} c, {FEATURES['fraction']} fraction, {FEATURES['exponent']} expo, {tgq.SYSTEM} sys, {FEATURES['substitution']} sub, {FEATURES['multi_assignment']} multi,
  {tgq.m(r'x\^4|x4')} x4, {tgq.m(r'x\^3|x3')} x3, {tgq.m(r'x\^2|x2')} x2, {tgq.m('=')} eq, len(list_distinct(regexp_extract_all(v, '\\b([a-z])\\s*=', 1))) na, {FEATURES['conditional_probability']} cond,
  {FEATURES['probability']} prob, {FEATURES['derivative']} der, {FEATURES['integral']} integ,
  case least(3, 1 + (words >= 18)::int + least(2, {tgq.hits(tgq.lx.COMPLEXITY_MARKERS)})) when 1 then 'basic' when 2 then 'intermediate' else 'advanced' end lvl from it),
g as (select *, case when id % 3 = 0 then 'solve_equation' when intent = 'expand' then 'polynomial_expansion' else intent end kind, case when id % 4 = 0 then 'advanced' else lvl end difficulty, list_sort(c) limits from f)
select id, kind "type", array_to_string(limits, ',') constraints,
 case when kind = 'evaluate_substitution' then case when multi then 'multi_variable_expression_evaluation' else 'single_variable_expression_evaluation' end
  when kind = 'real_solutions' then case when x4 then 'quartic_real_roots' when x3 then 'cubic_real_roots' when x2 then 'quadratic_real_roots' else 'real_solution_equation' end
  when kind = 'solve_equation' then case when sys then 'system_of_equations_solving' when x4 then 'quartic_equation_solving' when x3 then 'cubic_equation_solving' when x2 then 'quadratic_equation_solving' when fraction then 'rational_equation_solving' else 'linear_equation_solving' end
  when kind = 'percent' then case when list_contains(limits, 'positive_values') then 'percent_difference_comparison' else 'percent_application' end
  when kind = 'conditional_probability' then 'conditional_probability_application' when kind = 'counting_arrangements' then 'combinatorics_counting' when kind = 'derivative' then 'derivative_computation' when kind = 'limit' then 'limit_evaluation'
  when kind = 'function_composition' then 'function_composition_evaluation' when kind = 'sequence_series' then 'sequence_series_analysis' when kind = 'trigonometric' then 'trigonometric_evaluation' when kind = 'variation' then 'direct_inverse_variation'
  when kind = 'ratio_proportion' then 'ratio_proportion_reasoning' when kind = 'mean' then 'mean_calculation' when kind = 'simplify' then 'algebraic_simplification' when kind = 'system' then 'simultaneous_equations' when kind = 'factor' then 'polynomial_factoring'
  {CONCEPTS} when words >= 14 then 'word_problem_reasoning' when expo then 'exponent_expression_evaluation' when fraction then 'fraction_expression_evaluation' else 'algebraic_expression_evaluation' end concept,
 case when kind = 'conditional_probability' then 'conditional_probability_statement' when kind in ('counting_arrangements', 'expected_value', 'probability') and words >= 10 then 'counting_probability_word_problem' when sys then 'system_of_equations'
  when sub and na >= 2 then 'expression_with_assignments' when sub then 'single_assignment_expression' when eq then 'single_equation' when words >= 14 then 'word_problem' else 'direct_expression' end template,
 difficulty, na::bigint assigned_variable_count,
 round(greatest(0.50, least(0.97, 0.58 + (kind <> 'general')::int * 0.08 + (len(limits) > 0)::int * 0.08 + (sys or x4 or cond)::int * 0.08 + (na >= 2)::int * 0.06
  + (sub::int + fraction::int + expo::int + prob::int + der::int + integ::int >= 2)::int * 0.04 + case difficulty when 'advanced' then 0.05 when 'basic' then -0.02 else 0 end))::decimal(28,10), 2)::double anchor_priority from g""")
def upgraded(spark, sf):
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("array<string>")
    base = tgq.problems(spark, sf).withColumns({
        "solution": F.lit("done"), "bucket": text, "type": F.when(F.col("id") % 3 == 0, "Equation"), "concept": none, "skills": none, "template": text,
        "constraints": none, "difficulty": F.when(F.col("id") % 4 == 0, "hard"), "tags": none, "anchor_priority": text,
    })
    return bk.upgrade_metadata(base).select("id", "type", F.array_join("constraints", ",").alias("constraints"), "concept", "template", "difficulty", F.col("assigned_variable_count").cast("long").alias("assigned_variable_count"), "anchor_priority")


SKILL_CASE = "case kind " + " ".join(f"when '{k}' then {tgq._sql_list(v)}" for k, v in lx.SKILLS_BY_INTENT.items()) + " else [] end"
KEPT_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@register("b3_k6_inferred_lists", "with " + tgq.PROBLEMS + INTENTS + f""",
f as (select id, subject, case when id % 3 = 0 then 'solve_equation' when intent = 'expand' then 'polynomial_expansion' else intent end kind, list_sort({tgq.tag_case(tgq.CONSTRAINTS)}) limits,
  {tgq.tag_case([(s, FEATURES[n]) for n, s in lx.SKILLS_BY_FEATURE])} by_feature, {tgq.tag_case([(n, FEATURES[n]) for n in lx.TAG_FEATURES])} tagged,
  {tgq.tag_case([('quartic', tgq.m(r'x\^4|x4')), ('cubic', tgq.m(r'x\^3|x3')), ('quadratic', tgq.m(r'x\^2|x2'))])} powers from it),
g as (select id, {SKILL_CASE} || by_feature || case when len(limits) > 0 then ['constraint_filtering'] else [] end sk, [replace(subject, '-', '_'), kind] || tagged || powers || limits tg from f)
select id, coalesce(nullif(array_to_string(({KEPT_ORDER.format('sk')})[1:4], ','), ''), 'algebraic_reasoning') skills, array_to_string(({KEPT_ORDER.format('tg')})[1:8], ',') tags from g""")
def inferred_lists(spark, sf):
    text, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    base = tgq.problems(spark, sf).withColumns({
        "solution": F.lit("done"), "bucket": text, "type": F.when(F.col("id") % 3 == 0, "Equation"), "concept": none, "skills": none, "template": text,
        "constraints": none, "difficulty": text, "tags": none, "anchor_priority": text,
    })
    return bk.upgrade_metadata(base).select("id", F.array_join("skills", ",").alias("skills"), F.array_join("tags", ",").alias("tags"))


@register("b7_j9_added_examples", "with " + vw.MATH + """,
n as (select id pos, case id % 4 when 0 then 'history' else 'algebra' end subject, case id % 3 when 0 then 'basic' when 1 then 'advanced' else 'odd' end difficulty, problem from math_problems),
j as (select *, case when subject = 'history' then 'invalid_subject' when difficulty = 'odd' then 'invalid_difficulty' when pos % 13 = 0 then 'size_limit' when pos % 17 = 0 then 'blank_text' when pos % 19 = 0 then 'invalid_entry'
  when difficulty = 'basic' and exists (select 1 from math_problems m where m.size > 45 and m.id % 2 = 0 and lower(m.problem) = lower(n.problem)) then 'duplicate_user'
  when difficulty = 'advanced' and exists (select 1 from math_problems m where m.size < 5 and lower(m.problem) = lower(n.problem)) then 'duplicate_curated' end reason from n),
k as (select *, row_number() over (partition by subject, difficulty, lower(problem), reason is null order by pos) r from j)
select pos, subject, difficulty, coalesce(reason, case when r > 1 then 'duplicate_user' else 'accepted' end) outcome from k""")
def added(spark, sf):
    base = vw.math_problems(spark, sf)
    new = base.select(
        F.col("id").alias("pos"), F.expr("case id % 4 when 0 then 'history' else 'algebra' end").alias("subject"), F.expr("case id % 3 when 0 then 'basic' when 1 then 'advanced' else 'odd' end").alias("difficulty"),
        F.concat(F.lit(" "), "problem").alias("problem"),
        F.when(F.col("id") % 13 == 0, F.repeat(F.lit("long "), 2001)).when(F.col("id") % 17 == 0, " ").otherwise("s").alias("solution"),
        F.when(F.col("id") % 19 == 0, "  ").otherwise("My Type").alias("type"), F.lit("c").alias("concept"),
    )
    user = base.where("size > 45").select(
        F.lit("algebra").alias("subject"), F.lit("basic").alias("difficulty"), F.upper("problem").alias("problem"),
        F.when(F.col("id") % 2 == 1, NOW - 1).alias("expires_at"),
    )
    curated = base.where("size < 5").select(F.lit("algebra").alias("subject"), F.lit("advanced").alias("difficulty"), "problem")
    accepted, rejected = bk.add_user_examples(new, user, curated, NOW)
    done = accepted.select("pos", "subject", "difficulty", F.lit("accepted").alias("outcome"))
    return done.unionByName(rejected.select("pos", "subject", "difficulty", F.col("reason").alias("outcome")))


@register("b10_stitched_chunks", """
with c as (select doc_id, substr(text, 1, (n_chars // 2 + 20)::int) a, substr(text, (greatest(n_chars // 2 - 20, 0) + 1)::int) b from documents),
k as (select *, list_filter(list_reverse(range(1, least(length(a), length(b), 500)::int + 1)), lambda i: ends_with(a, substr(b, 1, i::int)))[1] o from c)
select doc_id, md5(a || substr(b, (coalesce(o, 0) + 1)::int)) digest, 2::bigint chunks from k""")
def stitched(spark, sf):
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = vw.texts(spark, sf)
    parts = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.substr("text", F.lit(1), half + 20).alias("text")),
        F.struct(F.lit(2).alias("seq"), F.substr("text", F.greatest(half - 20, F.lit(0)) + 1).alias("text")),
    )).alias("p")).select("doc_id", "p.*")
    made = bk.stitch(parts, "doc_id", "seq", "text")
    return made.select("doc_id", F.md5(F.col("response").cast("binary")).alias("digest"), F.col("chunks").cast("long").alias("chunks"))


# --- stored history -----------------------------------------------------------------------------

@register("s10_history_upsert", "with " + vw.WINNERS + """
select ['algebra','pre-calculus','counting-probability'][(problem_id % 3) + 1] as "domain", problem_id, best_technique winner_technique, case when best_technique = 'click' then 'second' else 'first' end as batch from winners""")
def upsert(spark, sf):
    path = scratch_path(spark, "history")
    won = rn.greedy_winner(vw.results(spark, sf)).select(*vw.blocks("problem_id"), "problem_id", F.col("best_technique").alias("winner_technique"))
    st.upsert_history(won.withColumns({"round": F.lit("first"), "updated": F.lit(1)}), path, "a", 1)
    st.upsert_history(won.where("winner_technique = 'click'").withColumns({"round": F.lit("second"), "updated": F.lit(2)}), path, "a", 2)
    return st.read_history(spark, path).select("domain", "problem_id", "winner_technique", F.col("round").alias("batch"))


@register("s10_two_writers", "with " + vw.WINNERS + """
select ['algebra','pre-calculus','counting-probability'][(problem_id % 3) + 1] as "domain", problem_id, best_technique winner_technique,
 case when problem_id % 4 = 0 then 'b' else 'a' end writer from winners""")
def two_writers(spark, sf):
    """Both writers use the same batch numbers in the same blocks; the later update of a key wins, in whatever order they wrote."""
    path = scratch_path(spark, "history")
    won = durable(rn.greedy_winner(vw.results(spark, sf)).select(*vw.blocks("problem_id"), "problem_id", F.col("best_technique").alias("winner_technique")))
    st.upsert_history(won.where("problem_id % 4 = 0").withColumns({"by": F.lit("b"), "updated": F.lit(5)}), path, "b", 0)
    st.upsert_history(won.where("problem_id % 2 = 0").withColumns({"by": F.lit("a"), "updated": F.lit(4)}), path, "a", 0)
    st.upsert_history(won.where("problem_id % 2 = 1").withColumns({"by": F.lit("a"), "updated": F.lit(4)}), path, "a", 1)
    target = scratch_path(spark, "compacted")
    st.compact_history(spark, path, target)
    return st.read_history(spark, target).select("domain", "problem_id", "winner_technique", F.col("by").alias("writer"))


@register("s11_baseline_rows", "with " + vw.RUNS + """,
f as (select problem_id, accuracy, (accuracy + efficiency) / 2 ov, row_number() over (partition by problem_id order by run_index desc, technique desc) back from runs),
av as (select problem_id, round((sum(accuracy::decimal(18,10))::double / count(*))::decimal(28,10), 4)::double accuracy, round((sum(round(ov::decimal(28,10), 6)::double::decimal(18,10))::double / count(*))::decimal(28,10), 4)::double ov from f where back <= 3 group by 1)
select problem_id, accuracy, coalesce(case when accuracy >= 0.5 then 0.75 end, ov)::double overall, case when accuracy >= 0.5 then 0.5 end::double consistency, 'raw_baseline' technique from av""")
def baseline_rows(spark, sf):
    from workload.runs_and_history import _run_scores

    averages = hs.last_three_average(hs.last_runs(_run_scores(spark, sf), ["problem_id"]))
    composite = averages.where("accuracy >= 0.5").select("problem_id", F.lit(0.75).alias("overall"), F.lit(0.5).alias("consistency"))
    return hs.baseline_row(averages, composite).select("problem_id", "accuracy", "overall", "consistency", "technique")


@register("s17_history_rows", "with " + vw.MATH + """
select replace(lower(subject), ' ', '_') as "domain", case when difficulty = 0 then 'basic' else 'level_' || difficulty end difficulty, 'problem_' || sha1(lower(problem)) problem_id, problem,
 case when id % 2 = 0 then 'benchmark' else 'normal' end run_mode, id % 3 = 0 has_ground_truth, case when id % 3 = 0 then 'ground_truth' else 'no_ground_truth' end evaluation_quality, size / 50 performance_score from math_problems""")
def history_rows(spark, sf):
    base = vw.math_problems(spark, sf)
    rows = base.select(
        F.lit("").alias("domain"), "subject", F.lit("x").alias("category"), F.when(F.col("difficulty") > 0, F.concat(F.lit("Level "), F.col("difficulty").cast("string"))).alias("difficulty"),
        "problem", F.when(F.col("id") % 2 == 0, "Benchmark").alias("run_mode"), F.lit(None).cast("string").alias("ground_truth_flag"),
        F.when(F.col("id") % 3 == 0, "5").otherwise(" ").alias("ground_truth"), (F.col("size") / 50).alias("overall"),
    )
    return hs.to_history_row(rows)


# --- metadata alignment --------------------------------------------------------------------------

@register("j16_alignment_score", "with " + tgq.PROBLEMS + INTENTS + f""",
p as (select id, case intent when 'expand' then 'polynomial_expansion' else intent end kind, list_sort({tgq.tag_case(tgq.SQL_STRUCTURE)}) s, least(3, 1 + (words >= 18)::int + least(2, {tgq.hits(lx.COMPLEXITY_MARKERS)})) lvl, {tgq.tag_case(tgq.CONSTRAINTS)} lim from it)
select id, round((case when kind = 'solve_equation' then 0.55 when (kind, 'solve_equation') in (select * from (values ('real_solutions', 'solve_equation'), ('evaluate_substitution', 'solve_equation'), ('compare_values', 'solve_equation'))) then 0.55 * 0.55
 when kind <> 'general' then -0.16 else 0 end + 0.24 * (list_contains(s, 'equation')::int + list_contains(s, 'fraction')::int) / 2
 + case when len(lim) > 0 then 0.36 * list_contains(lim, 'real_solutions')::int / len(lim) - 0.12 * (len(lim) - list_contains(lim, 'real_solutions')::int) else 0 end
 + greatest(0, 0.14 - 0.07 * abs(lvl - 2)) + 0.14 * list_contains(s, 'equation')::int + 0.5 * 0.06)::decimal(28,10), 6)::double score from p""")
def alignment(spark, sf):
    base = tg.with_intent(tg.with_structure(tgq.problems(spark, sf).withColumn("none", F.lit("general")), "problem"), "problem")
    base = tg.with_complexity(base, "problem", "none")
    empty = F.expr("cast(array() as array<string>)")
    problem = {
        "type": alias(F.col("intent"), lx.TYPE_ALIASES), "structure": F.col("structure"), "keywords": empty, "operations": empty, "format_labels": F.col("format_labels"),
        "constraints": F.col("constraint_labels"), "complexity": F.col("complexity"),
    }
    example = {
        "type": F.lit("solve_equation"), "concept": F.expr("array('equation', 'fraction')"), "skills": empty, "format_labels": empty, "constraints": F.expr("array('real_solutions')"),
        "level": tx.difficulty_level(F.lit("intermediate")), "tags": F.expr("array('equation')"), "anchor": F.lit(0.5), "rate_problem": F.lit(False),
    }
    return base.select("id", rounded(pr.alignment_score(problem, example), 6).alias("score"))
