"""Queries over pairs of problems: similarity, profile ranking, routing, few-shot retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import lexicon as lx
from gaugeline.functions import pairs as pr
from gaugeline.functions import text as tx
from gaugeline.functions.basics import rounded, strip
from gaugeline.operators import routing as rt
from gaugeline.operators import similarity as sm
from gaugeline.operators import tagging as tg
from gaugeline.plans.benchmark import rankings_for
from gaugeline.session import durable, shuffle_width
from workload import tags as tgq
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


def sql_list(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


# --- stored history over the problem texts -----------------------------------------------------

# Twelve domains, so that every outcome of the gates occurs: a clear lead, equal scores, one technique only, no ground
# truth, small gaps, erratic scores, too few samples, and mixed scores. All expressions are read by both engines.
GROUP = "size % 12"
FEW_SCORE = """cast(case size % 12 when 1 then 0.9 when 2 then 0.7 when 4 then 0.80 when 5 then id % 2 when 7 then 0.80 when 8 then 0.82 when 9 then round(0.5 + (id * 7) % 10 / 1000.0, 3)
 when 10 then round(0.4 + (id * 7) % 21 / 50.0, 3) else (id * 7) % 101 / 100.0 end as double)"""
ZERO_SCORE = """cast(case size % 12 when 0 then (id * 7) % 101 / 100.0 when 1 then 0.5 when 2 then null when 4 then 0.788 when 5 then (id + 1) % 2 * 0.9 when 7 then 0.795 when 8 then 0.812
 when 9 then round(0.5 + (id * 3) % 10 / 1000.0, 3) when 10 then round(0.4 + (id * 3) % 19 / 50.0, 3) else (id * 13) % 97 / 100.0 end as double)"""
TRUTH = "case when size % 12 = 3 then id % 2 = 5 when size % 12 = 6 then id % 131 = 7 when id % 10 = 3 then null else id % 4 <> 1 end"


def stored(spark, sf, vectors=False, base=None):
    base = (vw.math_problems(spark, sf) if base is None else base).withColumns({"few": F.expr(FEW_SCORE), "zero": F.expr(ZERO_SCORE), "domain": F.expr(f"concat('math', {GROUP})")})
    docs = base.select(
        F.col("id").alias("doc_id"), "domain", F.col("difficulty").cast("string").alias("difficulty"), "problem",
        F.expr("case when few > zero or zero is null then 'few_shot' when few < zero then 'zero_shot' end").alias("winner_technique"),
        F.expr(TRUTH).alias("has_ground_truth"),
    )
    scores = base.select(F.col("id").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit("few_shot").alias("technique"), F.col("few").alias("overall")), F.struct(F.lit("zero_shot").alias("technique"), F.col("zero").alias("overall")),
    )).alias("s")).select("doc_id", "s.*").where("overall is not null")
    if vectors:
        known = vw.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        docs = docs.join(known, "doc_id", "left")
    targets = docs.select(F.col("doc_id").alias("target_id"), "domain", "difficulty", "problem", *(["embedding"] if vectors else []))
    return targets, docs, scores


def document_problems(spark, sf):
    """Whole documents in the place of problems."""
    return vw.table(spark, sf, "documents").selectExpr("doc_id as id", "text as problem", "doc_id % 3 as difficulty", "doc_id % 50 as size")


def labelled_history(spark, sf, vectors=False, base=None):
    """As ``stored``; all documents are targets too, so one labelling serves both. Of a text it only stays whether it is blank."""
    _, docs, scores = stored(spark, sf, vectors, base)
    docs = durable(sm.labelled(docs, "problem").withColumn("problem", F.left(strip(F.col("problem")), F.lit(1))))
    targets = docs.select(F.col("doc_id").alias("target_id"), "domain", "difficulty", "problem", *sm.LABELS, *(["embedding"] if vectors else []))
    return targets, docs, scores


def matches(spark, sf, vectors=False, base=None, **options):
    return sm.match_history(*labelled_history(spark, sf, vectors, base), require_ground_truth=True, **options)


HYBRID_SQL = f""",
tg as (select id, difficulty, {GROUP} grp, {FEW_SCORE} few, {ZERO_SCORE} zero, {TRUTH} truth, {tgq.tag_case(tgq.SQL_TAGS)} tags, list_filter(list_distinct(regexp_extract_all(v, '[a-z0-9_]+')), lambda x: not list_contains({sql_list(lx.STOP_WORDS_HISTORY)}, x)) tk
  from (select *, lower(problem) v from math_problems)),
ty as (select *, list_sort(list_filter(tags, lambda x: list_contains({sql_list(lx.TYPE_FEATURES_HISTORY)}, x))) ty, case when few > zero or zero is null then 'few_shot' when few < zero then 'zero_shot' end winner from tg),
pairs as (select a.id a, b.id b, len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags)) fu, len(list_intersect(a.tags, b.tags)) fi, len(a.tags) fa, len(b.tags) fb,
  len(list_intersect(a.tk, b.tk)) ti, len(a.tk) ta, len(b.tk) tb, a.ty <> b.ty and len(a.tags) > 0 and len(b.tags) > 0 mis, b.few, b.zero, b.winner
  from ty a join ty b on a.difficulty = b.difficulty and a.grp = b.grp where b.truth),
sims as (select *, case when ta = 0 or tb = 0 then 0 else ti::double / (ta + tb - ti) end lex,
  case when fa = 0 and fb = 0 then null when fa = 0 or fb = 0 then 0 else fi::double / fu end * case when mis then 0.3 else 1 end feat from pairs),
hyb as (select a, b, few, zero, winner, least(1, greatest(0, (case when feat is null then lex else 0.55::double * feat + 0.45::double * lex end) * case when mis then 0.45::double else 1 end)) h from sims),
pre as (select id a, count(b) filter (h >= 0.20::double) pc from ty left join hyb on a = id group by 1),
thr as (select a, pc, case when pc > 15 then 0.60::double else 0.55::double end t from pre),
hit as (select hyb.*, pc, t from hyb join thr using (a) where h >= t)"""

MATCHES = "with " + vw.MATH + HYBRID_SQL
PLAIN = "(case when feat is null then lex else 0.55::double * feat + 0.45::double * lex end)"
# rows without a vector keep the plain weights
WITH_VECTORS = HYBRID_SQL.replace(
    "winner from tg),", "winner, e.embedding::double[] emb from tg left join embeddings e on e.vec_id = tg.id),"
).replace("select *, list_sort(", "select tg.*, list_sort(").replace(
    "pairs as (select a.id a,", "pairs as (select case when a.emb is not null and b.emb is not null then list_cosine_similarity(a.emb, b.emb) end co, a.id a,"
).replace(PLAIN, f"(case when co is null then {PLAIN} when feat is null then 0.75::double * co + 0.25::double * lex else 0.6::double * co + 0.25::double * feat + 0.15::double * lex end)")
VECTOR_MATCHES = "with " + vw.MATH + WITH_VECTORS
DOCUMENT_MATCHES = "with math_problems as (select doc_id id, text problem, doc_id % 3 difficulty, doc_id % 50 size from documents)" + HYBRID_SQL

SUMMARY = """
select thr.a target_id, thr.pc::bigint preliminary_count, thr.t threshold, count(h)::bigint matched_documents, round(coalesce(avg(h), 0)::decimal(28,10), 4)::double average_similarity,
 count(case when winner is not null then h end)::bigint total_with_winner from thr left join hit on hit.a = thr.a group by 1, 2, 3"""


def summary(found):
    made = sm.match_summary(found)
    return made.select("target_id", *[F.col(c).cast("long").alias(c) for c in ("preliminary_count", "matched_documents", "total_with_winner")], "threshold", "average_similarity")


@register("j8_vectors", VECTOR_MATCHES + SUMMARY)
def vector_history(spark, sf):
    return summary(matches(spark, sf, vectors=True))


@register("j8_document_texts", DOCUMENT_MATCHES + SUMMARY)
def document_history(spark, sf):
    return summary(matches(spark, sf, base=document_problems(spark, sf)))


@register("j8_a21_matched_history", MATCHES + """
select thr.a target_id, thr.pc::bigint preliminary_count, thr.t threshold, count(h)::bigint matched_documents, round(coalesce(avg(h), 0)::decimal(28,10), 4)::double average_similarity,
 count(case when winner is not null then h end)::bigint total_with_winner from thr left join hit on hit.a = thr.a group by 1, 2, 3""")
def matched_history(spark, sf):
    return summary(matches(spark, sf))


PROFILE = """,
tech as (select a, 'few_shot' technique, few s, h, (coalesce(winner, '') = 'few_shot')::int won from hit union all select a, 'zero_shot', zero, h, (coalesce(winner, '') = 'zero_shot')::int from hit),
dec as (select a, count(winner) decided from hit group by 1),
pa as (select a, technique, count(s) n, sum(s)::double / count(s) sa, sum(s * h) / sum(h) filter (s is not null) wa, sum(h) filter (s is not null) w, coalesce(var_samp(s), 0) va, sum(won) wins, any_value(decided) decided from tech join dec using (a) group by 1, 2 having count(s) > 0),
pk as (select a target_id, technique, round(sa::decimal(28,10), 4)::double simple_average, round(wa::decimal(28,10), 4)::double average_overall, n::bigint samples, round(w::decimal(28,10), 2)::double effective_samples,
 round(sqrt(va)::decimal(28,10), 4)::double std_dev, round(va::decimal(28,10), 4)::double variance, case when sqrt(va) < 0.08 then 'high' when sqrt(va) < 0.15 then 'medium' else 'low' end confidence,
 round(greatest(0, 1 - sqrt(va))::decimal(28,10), 4)::double consistency, wins::bigint wins, round(coalesce(wins::double / nullif(decided, 0), 0)::decimal(28,10), 4)::double win_rate from pa),
profile as (select *, row_number() over (partition by target_id order by average_overall desc, effective_samples desc, technique)::bigint "rank" from pk)"""


@register("a10_profile_ranking", MATCHES + PROFILE + " select * from profile")
def profile_ranking(spark, sf):
    return sm.profile_ranking(matches(spark, sf))


@register("a10_vectors", VECTOR_MATCHES + PROFILE + " select * from profile")
def vector_ranking(spark, sf):
    return sm.profile_ranking(matches(spark, sf, vectors=True))


@register("a10_document_texts", DOCUMENT_MATCHES + PROFILE + " select * from profile")
def document_ranking(spark, sf):
    return sm.profile_ranking(matches(spark, sf, base=document_problems(spark, sf)))


@register("a10_profile_scores", MATCHES + """,
tech as (select a, 'few_shot' technique, few s from hit union all select a, 'zero_shot', zero from hit)
select a target_id, technique, s::double score, count(*)::bigint n from tech where s is not null group by 1, 2, 3""")
def profile_scores(spark, sf):
    made = matches(spark, sf, by_score=True)
    return made.where("score is not null and n > 0").select("target_id", "technique", "score", F.col("n").cast("long").alias("n"))


@register("k1_nearest_vectors", "with " + vw.MATH + WITH_VECTORS.replace(" where b.truth)", ")") + """,
ranked as (select a, b, h, row_number() over (partition by a order by h desc, b) k from hyb where a <> b)
select a target_key, b doc_id, k::bigint place, round(h::decimal(28,10), 6)::double similarity from ranked where k <= 3""")
def nearest_vectors(spark, sf):
    targets, docs, _ = stored(spark, sf, vectors=True)
    made = sm.prepare(docs, "problem").withColumns({
        "pos": F.col("doc_id"), "canonical": F.col("doc_id").cast("string"), "signature": F.lit(""), "b_group": F.concat_ws("/", "domain", "difficulty"),
    })
    goals = made.select(*[F.col(c).alias({"doc_id": "target_key", "b_group": "a_group"}.get(c, c)) for c in made.columns]).withColumns({"skip_identical": F.lit(True), "match_signature": F.lit(False)})
    found = sm.nearest(goals, made, None, 3)
    return found.select("target_key", "doc_id", F.col("place").cast("long").alias("place"), rounded(F.col("similarity"), 6).alias("similarity"))


# --- routing ------------------------------------------------------------------------------------

ROUTES = """,
dr as (select grp, difficulty, technique, round((sum(s::decimal(18,10))::double / count(s))::decimal(28,10), 4)::double average_overall, count(s)::bigint samples from (
  select grp, difficulty, 'few_shot' technique, few s from ty where truth union all select grp, difficulty, 'zero_shot', zero from ty where truth) group by 1, 2, 3 having count(s) > 0),
dk as (select *, row_number() over (partition by grp, difficulty order by average_overall desc, samples desc, technique) "rank" from dr),
dd as (select b.grp, b.difficulty, x.technique dt, x.average_overall - coalesce(y.average_overall, 0) dg, x.samples ds, y.samples ds2 from (select distinct grp, difficulty from ty) b
  left join dk x on x.grp = b.grp and x.difficulty = b.difficulty and x."rank" = 1 left join dk y on y.grp = b.grp and y.difficulty = b.difficulty and y."rank" = 2),
md as (select a target_id, count(*) m from hit group by 1),
pp as (select ty.id target_id, ty.grp, ty.difficulty, ty.few, ty.zero, x.technique pt, x.samples pn, y.samples pn2, round((x.average_overall - coalesce(y.average_overall, 0))::decimal(28,10), 8)::double pg, x.confidence = 'low' low, coalesce(m, 0) m
  from ty left join profile x on x.target_id = ty.id and x."rank" = 1 left join profile y on y.target_id = ty.id and y."rank" = 2 left join md on md.target_id = ty.id)"""


def gate_sql(ranked, top, second, gap, low, minimum, min_gap, top_only):
    seen = f"greatest({top}, coalesce({second}, 0))"
    eff = f"round(({min_gap} * case when {seen} >= 10 then 0.5 when {seen} >= 5 then 0.75 else 1 end)::decimal(28,10), 8)::double"
    zone = f"case when {seen} >= 10 then 0.008 when {seen} >= 5 then 0.004 else 0.003 end"
    few = f"{top} < {minimum}" if top_only else f"least({top}, {second}) < {minimum}"
    return (
        f"case when {ranked} is null then 'no_ranking' when {top} < {minimum} then 'insufficient_samples' when {second} is null then 'ok_single_technique' when {few} then 'insufficient_samples' when {gap} < {eff} and {gap} < {zone} and not {low} then 'ok_indistinguishable'"
        f" when {gap} < {eff} then 'low_confidence_gap' when {low} then 'low_technique_confidence' else 'ok' end"
    )


def with_fallbacks_sql(ranked, top, second, gap, low, minimum, min_gap, top_only):
    strict = gate_sql(ranked, top, second, gap, low, minimum, min_gap, top_only)
    relaxed = gate_sql(ranked, top, second, gap, low, minimum, f"greatest(0.005, {min_gap} / 4)", top_only)
    return f"case when ({strict}) <> 'low_confidence_gap' then ({strict}) when ({relaxed}) like 'ok%' then 'ok_relaxed_gap' when ({relaxed}) = 'low_confidence_gap' and {top} >= {minimum} then 'ok_indistinguishable' else ({relaxed}) end"


MINIMUM = "(3 + case when m >= 20 then 3 when m >= 10 then 2 when m >= 5 then 1 else 0 end)"
PRE_GAP = "(0.015::double * case when m >= 20 then 0.3::double when m >= 10 then 0.5::double when m >= 5 then 0.75::double else 1 end)"
DG = "round(dg::decimal(28,10), 8)::double"


def rankings(spark, sf):
    targets, docs, scores = labelled_history(spark, sf)
    return targets, rankings_for(targets, docs, scores)


def preselected(spark, sf):
    _, ranked = rankings(spark, sf)
    asked = ranked.withColumn("run_mode", F.when(F.col("target_id") % 11 == 0, "Benchmark").otherwise("normal"))
    return rt.preselect(asked, techniques=["few_shot", "zero_shot"])


@register("d2_preselection", MATCHES + PROFILE + ROUTES + f""",
z as (select *, {with_fallbacks_sql('pt', 'pn', 'pn2', 'pg', 'low', MINIMUM, PRE_GAP, True)} pr, {with_fallbacks_sql('dt', 'ds', 'ds2', DG, 'false', 3, '0.03::double', False)} dr from pp join dd using (grp, difficulty)),
y as (select *, target_id % 11 = 0 bench from z)
select target_id, case when not bench then pr end profile_reason, case when not bench then dr end domain_reason, case when bench then null when pr like 'ok%' then 'db_profile_rules' when dr like 'ok%' then 'db_history' end history_source,
 case when bench then null when pr like 'ok%' then pt when dr like 'ok%' then dt end best_technique,
 case when bench then 'benchmark_mode_runs_all' when pr like 'ok%' then 'preselected_by_profile_history' when dr like 'ok%' then 'preselected_by_domain_history' else dr end reason from y""")
def preselection(spark, sf):
    return preselected(spark, sf).select("target_id", "profile_reason", "domain_reason", "history_source", "best_technique", "reason")


@register("d2_run_plan", """
select target_id, coalesce(best_technique, 'few_shot,zero_shot') techniques_to_run,
 case best_technique when 'few_shot' then 'zero_shot' when 'zero_shot' then 'few_shot' end skipped_technique,
 case best_technique when 'few_shot' then 1 when 'zero_shot' then 1 else 0 end::bigint skipped from (""" + ORACLES["d2_preselection"] + ")")
def run_plan(spark, sf):
    planned = rt.run_plan(preselected(spark, sf), ["few_shot", "zero_shot"])
    return planned.select("target_id", F.array_join("techniques_to_run", ",").alias("techniques_to_run"), "skipped_technique", F.size("skipped_techniques").cast("long").alias("skipped"))


AFTER = MATCHES + PROFILE + ROUTES + f""",
z as (select *, {gate_sql('pt', 'pn', 'pn2', 'pg', 'low', MINIMUM, '0.005::double', True)} pr, {with_fallbacks_sql('dt', 'ds', 'ds2', DG, 'false', 3, '0.05::double', True)} dr from pp join dd using (grp, difficulty)),
s as (select *, case when pr like 'ok%' then 'db_profile_rules' when dr like 'ok%' then 'db_history' else 'runtime_scores' end src from z)"""


def selected(spark, sf):
    _, ranked = rankings(spark, sf)
    return rt.select_after_run(ranked.withColumn("runtime_technique", F.lit("zero_shot")))


@register("d3_after_run_selection", AFTER + """
select target_id, pr profile_reason, dr domain_reason, src selection_source, case src when 'db_profile_rules' then pt when 'db_history' then dt else 'zero_shot' end best_technique from s""")
def after_run(spark, sf):
    return selected(spark, sf).select("target_id", "profile_reason", "domain_reason", "selection_source", "best_technique")


@register("d7_decision_trace", AFTER + """
select target_id, 1 tier, 'profile' "name", case when src = 'db_profile_rules' then 'passed' else 'failed' end result, pr reason from s
union all select target_id, 2, 'domain', case src when 'db_profile_rules' then 'skipped' when 'db_history' then 'passed' else 'failed' end, dr from s
union all select target_id, 3, 'runtime', case src when 'runtime_scores' then 'passed' else 'skipped' end, 'best runtime score' from s""")
def trace(spark, sf):
    return rt.decision_trace(selected(spark, sf))


@register("d5_limited_comparison", AFTER + """
select target_id problem_id, t.technique from s, (select unnest(['few_shot', 'zero_shot']) technique) t
where (t.technique = 'few_shot' and few is not null or t.technique = 'zero_shot' and zero is not null) and (src = 'runtime_scores' or t.technique = case src when 'db_profile_rules' then pt else dt end)""")
def limited(spark, sf):
    chosen = selected(spark, sf).withColumnRenamed("target_id", "problem_id")
    _, _, scores = stored(spark, sf)
    return rt.limit_comparison(scores.select(F.col("doc_id").alias("problem_id"), "technique"), chosen)


# --- pair scores: vectors whose id is divisible by 100 against all others, all pairs of a subject -------

@register("j6_cosine", """
select p.vec_id query_id, q.vec_id, round(list_cosine_similarity(p.embedding::double[], q.embedding::double[])::decimal(28,10), 6)::double cosine
from embeddings p join embeddings q on q.vec_id <> p.vec_id where p.vec_id % 100 = 0""")
def cosine(spark, sf):
    """The vectors whose id is divisible by 100 against all others."""
    vectors = vw.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return sm.cosines(asked, vectors).withColumn("cosine", rounded(F.col("cosine"), 6))


TAGGED = f""",
tg as (select id, subject, {tgq.tag_case(tgq.SQL_TAGS)} tags, list_filter(list_distinct(regexp_extract_all(v, '[a-z0-9_]+')), lambda x: not list_contains({sql_list(lx.STOP_WORDS_HISTORY)}, x)) tk from low),
ty as (select *, list_sort(list_filter(tags, lambda x: list_contains({sql_list(lx.TYPE_FEATURES_HISTORY)}, x))) ty from tg),
nb as (select a.id, b.id other_id, a.tags ga, b.tags gb, a.tk ta, b.tk tb, a.ty <> b.ty and len(a.tags) > 0 and len(b.tags) > 0 mis, ea.embedding va, eb.embedding vb
  from ty a join ty b on b.subject = a.subject and b.id <> a.id left join embeddings ea on ea.vec_id = a.id left join embeddings eb on eb.vec_id = b.id),
sc as (select *, case when len(ta) = 0 or len(tb) = 0 then 0 else len(list_intersect(ta, tb))::double / (len(ta) + len(tb) - len(list_intersect(ta, tb))) end lex,
 case when len(ga) = 0 and len(gb) = 0 then -1 when len(ga) = 0 or len(gb) = 0 then 0 else len(list_intersect(ga, gb))::double / (len(ga) + len(gb) - len(list_intersect(ga, gb))) * case when mis then 0.3 else 1 end end feat,
 case when va is not null and vb is not null then list_cosine_similarity(va::double[], vb::double[]) end co from nb)"""


@register("j3_j7_pair_scores", "with " + tgq.PROBLEMS + TAGGED + """
select id, other_id, round(lex::decimal(28,10), 6)::double lexical, round(feat::decimal(28,10), 6)::double feature, mis type_mismatch,
 round(greatest(0, least(1, case when co is not null and feat >= 0 then 0.6 * co + 0.25 * feat + 0.15 * lex when co is not null then 0.75 * co + 0.25 * lex when feat >= 0 then 0.55 * feat + 0.45 * lex else lex end
  * case when mis then 0.45 else 1 end))::decimal(28,10), 6)::double hybrid from sc""")
def pair_scores(spark, sf):
    base = tg.with_feature_tags(tgq.problems(spark, sf), "problem", "history", "tags").withColumn("tokens", tx.tokens(F.col("problem"), lx.STOP_WORDS_HISTORY))
    base = base.join(vw.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")), "id", "left")
    base = durable(base.select("id", F.col("subject").alias("group"), "tags", "type_key", "tokens", "embedding"))
    return sm.pair_layers(base, base.withColumnRenamed("id", "other_id"))


FAMILY_SQL = "case " + " ".join(f"when {{0}} in ({','.join(repr(i) for i in m)}) then '{f}'" for f, m in lx.INTENT_FAMILIES.items()) + " else {0} end"
RELATED_SQL = ",".join(f"('{a}','{b}'),('{b}','{a}')" for a, b in lx.RELATED_INTENTS)


@register("j11_j12_j15_intents", "with " + tgq.PROBLEMS + tgq.WITH_INTENT + f""", st as (select id sid, subject, {tgq.tag_case(tgq.SQL_STRUCTURE)} s from low)
select a.id, b.id other_id, {FAMILY_SQL.format('a.intent')} = {FAMILY_SQL.format('b.intent')} compatible,
 case when a.intent = b.intent then 1.0 when (a.intent, b.intent) in ({RELATED_SQL}) then 0.55 else 0.0 end::double intent_similarity,
 round(coalesce(len(list_intersect(x.s, y.s))::double / nullif(len(x.s), 0), 0)::decimal(28,10), 6)::double overlap
from st x join st y on y.subject = x.subject and y.sid <> x.sid join it a on x.sid = a.id join it b on y.sid = b.id""")
def intents(spark, sf):
    base = tg.with_structure(tg.with_intent(tgq.problems(spark, sf), "problem"), "problem").select("id", "subject", "intent", "structure")
    base = durable(base.withColumn("label", F.to_json(F.struct("intent", "structure"))))
    # the scores depend on labels only, so they are taken once per pair of labels
    labels = durable(base.select("label", "intent", "structure").dropDuplicates(["label"]).withColumn("kind", F.monotonically_increasing_id()))
    base = durable(base.join(labels.select("label", "kind"), "label").select("id", "subject", "kind"))
    a = base.select("id", "subject", F.col("kind").alias("ka"))
    b = base.select(F.col("id").alias("other_id"), "subject", F.col("kind").alias("kb"))
    met = a.select("subject", "ka").distinct().join(b.select("subject", "kb").distinct(), "subject").select("ka", "kb").distinct()
    met = met.join(labels.select(F.col("kind").alias("ka"), F.col("intent").alias("ia"), F.col("structure").alias("sa")), "ka")
    met = met.join(labels.select(F.col("kind").alias("kb"), F.col("intent").alias("ib"), F.col("structure").alias("sb")), "kb")
    scored = durable(met.select(
        "ka", "kb", (pr.intent_family("ia") == pr.intent_family("ib")).alias("compatible"),
        pr.intent_similarity(F.col("ia"), F.col("ib")).alias("intent_similarity"),
        rounded(pr.overlap_ratio(F.col("sa"), F.col("sb")), 6).alias("overlap"),
    ))
    # a subject's rows are dealt out, so that no task has all pairs of a subject
    n = shuffle_width(spark)
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    b = b.withColumn("part", F.pmod(F.xxhash64("other_id"), F.lit(n)))
    pairs = a.join(b, ["subject", "part"]).where("id <> other_id").join(scored, ["ka", "kb"])
    return pairs.select("id", "other_id", "compatible", "intent_similarity", "overlap")


# --- few-shot retrieval ---------------------------------------------------------------------------------

SUBJECT_OF = "case id % 8 when 2 then 'counting-probability' when 3 then 'counting-probability' when 4 then 'pre-calculus' when 6 then 'pre-calculus' else 'algebra' end"


def bank_and_targets(spark, sf):
    base = vw.math_problems(spark, sf).withColumn("subject", F.expr(SUBJECT_OF))
    bank = base.select(F.col("id").alias("example_id"), F.col("id").alias("pos"), "subject", "problem", F.concat(F.lit("Answer: work it out, then "), F.col("size").cast("string")).alias("solution"))
    targets = base.select(F.col("id").alias("target_id"), "problem", F.col("subject").alias("requested"))
    return targets, bank


FEW = "with " + vw.MATH + f""",
src as (select *, id % 8 tpl, {SUBJECT_OF} subj, lower(problem) v, lower(replace(replace(problem, 'x^2', 'x²'), 'x^3', 'x³')) pv, regexp_replace(lower(problem), '[\\s?]|[.,;:!?]+$', '', 'g') canon from math_problems),
tg as (select *, {tgq.tag_case(tgq.SQL_BANK_TAGS)} tags, list_filter(list_distinct(regexp_extract_all(v, '[a-z0-9_]+')), lambda x: not list_contains({sql_list(lx.STOP_WORDS_BANK)}, x)) tk,
  list_filter(list_distinct(regexp_extract_all(pv, '[a-z0-9_]+')), lambda x: not list_contains({sql_list(lx.STOP_WORDS_BANK)}, x)) ptk from src),
ty as (select *, list_sort(list_filter(tags, lambda x: list_contains({sql_list(lx.TYPE_FEATURES_BANK)}, x))) ty from tg),
pairs as (select a.id a, b.id b, a.tpl, a.canon = b.canon same, len(list_intersect(a.tags, b.tags)) fi, len(a.tags) fa, len(b.tags) fb, len(list_intersect(a.ptk, b.tk)) ti, len(a.ptk) ta, len(b.tk) tb,
  a.ty <> b.ty and len(a.tags) > 0 and len(b.tags) > 0 mis from ty a join ty b on a.subj = b.subj and (a.tpl = 5 or (a.tpl = b.tpl and a.canon <> b.canon))),
sims as (select *, case when ta = 0 or tb = 0 then 0 else ti::double / (ta + tb - ti) end lex, case when fa = 0 and fb = 0 then null when fa = 0 or fb = 0 then 0 else fi::double / (fa + fb - fi) end * case when mis then 0.3 else 1 end feat from pairs),
hyb as (select a, b, tpl, same, least(1, greatest(0, (case when feat is null then lex else 0.55::double * feat + 0.45::double * lex end) * case when mis then 0.45::double else 1 end)) h from sims),
rk as (select *, row_number() over (partition by a order by h desc, b) k from hyb),
used as (select * from rk where k <= 2 and not same)"""


@register("f2_f5_few_shot_examples", FEW + " select a target_id, b example_id, k::bigint rank, round(h::decimal(28,10), 6)::double similarity from used")
def few_shot_examples(spark, sf):
    from gaugeline.operators import retrieval as rv

    _, used = rv.few_shot(*bank_and_targets(spark, sf))
    return used.select("target_id", "example_id", F.col("rank").cast("long").alias("rank"), rounded(F.col("similarity"), 6).alias("similarity"))


# the same with a vector layer; strict problems keep examples of a relevance from 0.55 on
FEW_VECTORS = FEW.replace(" ptk from src)", " ptk, e.embedding::double[] emb from src left join embeddings e on e.vec_id = src.id)").replace(
    "pairs as (select a.id a,", "pairs as (select case when a.emb is not null and b.emb is not null then list_cosine_similarity(a.emb, b.emb) end co, a.id a,"
).replace(PLAIN, f"(case when co is null then {PLAIN} when feat is null then 0.75::double * co + 0.25::double * lex else 0.6::double * co + 0.25::double * feat + 0.15::double * lex end)")


@register("f5_vectors", FEW_VECTORS + """, relevance as (select a, max(h) best from rk where k <= 2 group by 1)
select a target_id, b example_id, k::bigint rank, round(h::decimal(28,10), 6)::double similarity from used join relevance using (a) where tpl = 5 or best >= 0.55::double""")
def few_shot_vectors(spark, sf):
    from gaugeline.operators import retrieval as rv

    known = vw.table(spark, sf, "embeddings").select("vec_id", "embedding")
    targets, bank = bank_and_targets(spark, sf)
    targets = targets.join(known.withColumnRenamed("vec_id", "target_id"), "target_id", "left")
    bank = bank.join(known.withColumnRenamed("vec_id", "example_id"), "example_id", "left")
    _, used = rv.few_shot(targets, bank)
    return used.select("target_id", "example_id", F.col("rank").cast("long").alias("rank"), rounded(F.col("similarity"), 6).alias("similarity"))


@register("f1_f6_prompts", FEW + """,
ex as (select a, count(*) n, string_agg('Q: ' || s.problem || chr(10) || 'A: work it out, then ' || s.size, chr(10) || chr(10) order by k) body from used join src s on s.id = b group by 1)
select id target_id, 'zero_shot' technique, 'Solve the following math problem. ' || chr(10) || chr(10) || 'Q: ' || problem || chr(10) || 'A:' prompt, null error from src
union all select id, 'few_shot', case when n >= 2 then 'Solve math problems like the examples below.' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Q: ' || problem || chr(10) || 'A:' end,
 case when n is null then 'no_matching_examples' when n < 2 then 'too_few_examples' end from src left join ex on ex.a = id""")
def prompts(spark, sf):
    from gaugeline.operators import retrieval as rv

    return rv.all_techniques(*bank_and_targets(spark, sf))


def overlap_sql(x, y):
    return f"(case when len({x}) = 0 or len({y}) = 0 then 0 else len(list_intersect({x}, {y}))::double / len(list_distinct({x} || {y})) end)"


# the greedy choice among at most three supports, written out
DIVERSE = FEW + f""",
wd as (select id a, list_distinct(regexp_extract_all(v, '[a-z0-9_]+')) ws, case when 1 + (len(string_split_regex(trim(pv), '\\s+')) >= 18)::int
  + least(2, len(list_filter({sql_list(lx.COMPLEXITY_MARKERS)}, lambda w: contains(pv, w)))) + (subj <> 'algebra')::int >= 2 then 4 else 2 end wanted from src),
hi as (select a, count(*) filter (h > 0.3::double) high from rk where k <= 24 group by 1),
pool as (select r.a, r.b, r.h, r.same, wanted, x.ws, row_number() over (partition by r.a order by k) pos, count(*) over (partition by r.a) n
  from rk r join hi using (a) join (select a, wanted from wd) using (a) join (select a b, ws from wd) x on x.b = r.b
  where k <= 24 and case when r.tpl = 1 then k <= 6 * wanted when high < wanted then k <= 3 * wanted else h > 0.3::double and k <= 4 * wanted end),
free as (select * from pool where n > wanted),
two as (select * from free where pos = 2),
three as (select * from (select x.*, row_number() over (partition by x.a order by x.h - 0.15::double * {overlap_sql('x.ws', 'two.ws')} desc, x.pos) r
  from free x join two using (a) where x.pos > 2 and x.wanted > 2) where r = 1),
four as (select * from (select x.*, row_number() over (partition by x.a order by x.h - 0.15::double * greatest({overlap_sql('x.ws', 'two.ws')}, {overlap_sql('x.ws', 'three.ws')}) desc, x.pos) r
  from free x join two using (a) join three using (a) where x.pos > 2 and x.pos <> three.pos) where r = 1),
chosen as (select a, b, h, same, pos k from pool where n <= wanted union all select a, b, h, same, pos from free where pos <= 2
  union all select a, b, h, same, 3 from three union all select a, b, h, same, 4 from four)
select a target_id, b example_id, k::bigint rank, round(h::decimal(28,10), 6)::double similarity from chosen where not same"""


@register("k3_diverse_examples", DIVERSE)
def diverse(spark, sf):
    from gaugeline.operators import retrieval as rv

    _, used = rv.few_shot(*bank_and_targets(spark, sf), max_examples=4, medium_examples=4, hard_examples=4)
    return used.select("target_id", "example_id", F.col("rank").cast("long").alias("rank"), rounded(F.col("similarity"), 6).alias("similarity"))
