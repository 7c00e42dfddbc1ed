"""Queries over responses: answer extraction, accuracy, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import answers as an
from gaugeline.functions.basics import rounded
from gaugeline.operators import scoring as sco
from gaugeline.plans.benchmark import benchmark
from workload import views as vw
from workload.texts import pick

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


NUMBERED = ", r as (select *, regexp_extract(response, '([0-9]+)$', 1) said, regexp_matches(response, 'Final answer: ') marked from responses)"


@register("q6_priority_candidates", "with " + vw.RESPONSES + NUMBERED + """,
c as (select *, split_part(response, chr(10), 2) line2 from r)
select problem_id, technique, run_index, ground_truth, elapsed_time, case when marked then said || '|' || line2 when line2 = said then said else line2 || '|' || said end candidates from c""")
def priority(spark, sf):
    df = vw.responses(spark, sf)
    made = F.array_join(an.priority_candidates(F.col("response")), "|")
    return df.select("problem_id", "technique", "run_index", "ground_truth", "elapsed_time", made.alias("candidates"))


@register("q7_all_candidates", "with " + vw.RESPONSES + NUMBERED + """,
c as (select *, split_part(response, chr(10), 2) line2 from r),
d as (select *, case when marked then [said, line2] when line2 = said then [said] else [line2, said] end || ['3', '4', '12.', said] l from c)
select problem_id, technique, run_index, ground_truth, elapsed_time, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') candidates from d""")
def every_candidate(spark, sf):
    df = vw.responses(spark, sf)
    made = F.array_join(an.all_candidates(F.col("response"), an.priority_candidates(F.col("response"))), "|")
    return df.select("problem_id", "technique", "run_index", "ground_truth", "elapsed_time", made.alias("candidates"))


@register("q8_q12_accuracy", "with " + vw.RESPONSES + NUMBERED + """
select problem_id, technique, run_index, ground_truth, elapsed_time, case when said = ground_truth or (not marked and ground_truth in ('3', '4', '12')) then 1.0 else 0.0 end::double accuracy,
 case when said = ground_truth then 1.0 else 0.0 end::double final_only from r""")
def accuracy(spark, sf):
    made = vw.responses(spark, sf).withColumn("both", an.accuracies(F.col("response"), F.col("ground_truth")))
    return made.select(
        "problem_id", "technique", "run_index", "ground_truth", "elapsed_time",
        F.col("both.any").alias("accuracy"), F.col("both.final").alias("final_only"),
    )


@register("q9_numeric_values", f"""
select l_orderkey, l_linenumber, l_suppkey, l_partkey, round((case l_partkey % 5 when 0 then l_quantity / l_linenumber when 1 then -l_quantity when 2 then l_quantity when 3 then null else null end)::decimal(28,10), 8)::double number,
 case l_partkey % 5 when 2 then abs(l_quantity / 100 - l_discount) < 0.0001 or abs(l_quantity - l_discount) < 0.0001 when 0 then abs(l_quantity / l_linenumber - l_discount) < 0.0001 when 1 then abs(-l_quantity - l_discount) < 0.0001 else false end agrees
from lineitem""")
def numeric(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.expr("l_partkey % 5")
    made = (
        F.when(text == 0, F.concat(F.lit("Answer: x = "), q, F.lit(" / "), F.col("l_linenumber").cast("string")))
        .when(text == 1, F.concat(F.lit("-"), q, F.lit(" apples")))
        .when(text == 2, F.concat(q, F.lit("%")))
        .when(text == 3, F.concat(q, F.lit("a")))
        .otherwise(F.concat(q, F.lit(" or 7 or 8")))
    )
    df = vw.table(spark, sf, "lineitem").withColumn("t", made)
    value = an.numeric_value(F.col("t"))
    wanted = F.col("l_discount")
    return df.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", rounded(value, 8).alias("number"),
        an.numbers_agree(value, F.col("t"), wanted, wanted.cast("string")).alias("agrees"),
    )


@register("q10_value_sets", """
select l_orderkey, l_linenumber, l_suppkey, l_partkey,
 case when l_partkey % 3 = 2 or q = b then null else least(q, b) || ',' || greatest(q, b) end as values_found
from (select *, l_quantity::int q, l_linenumber + 60 b from lineitem)""")
def value_sets(spark, sf):
    q, b = F.col("l_quantity").cast("int").cast("string"), (F.col("l_linenumber") + 60).cast("string")
    kind = F.col("l_partkey") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("Answer: x = "), q, F.lit(", x = "), b))
        .when(kind == 1, F.concat(b, F.lit(" and f(3) = "), q))
        .otherwise(F.concat(q, F.lit("(x - 1) and "), b))
    )
    df = vw.table(spark, sf, "lineitem")
    made = F.transform(an.value_set(text), lambda x: x.cast("int").cast("string"))
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.array_join(made, ",").alias("values_found"))


@register("q13_heuristic_score", """
select conv_id, turn, round((least(1.0, 0.5 + (case when regexp_matches(text, '[0-9]') then 0.2 else 0 end) + (case when regexp_matches(lower(text), 'therefore|because|thus|so') then 0.1 else 0 end)
 + (case when regexp_matches(text, '(?i)(answer|result|solution)\\s*[:\\-=]') then 0.2 else 0 end)))::decimal(28,10), 4)::double score from conversations""")
def heuristic(spark, sf):
    return vw.table(spark, sf, "conversations").select("conv_id", "turn", rounded(an.heuristic_score(F.col("text")), 4).alias("score"))


@register("q14_root_score", """
with t as (select *, p_size a, p_size + 1 + p_partkey % 7 b from part)
select p_partkey, case p_partkey % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 1.0 else 0.0 end::double score from t""")
def roots(spark, sf):
    a, b = F.col("p_size"), F.col("p_size") + 1 + (F.col("p_partkey") % 7).cast("int")
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat_ws(" ", F.lit("x ="), a.cast("string"), F.lit("or x ="), b.cast("string")))
        .when(kind == 1, F.concat_ws(" ", F.lit("only"), a.cast("string")))
        .when(kind == 2, F.concat_ws(" ", F.lit("from 9999 steps:"), b.cast("string"), a.cast("string"), a.cast("string")))
        .otherwise(F.lit("no idea, 9999"))
    )
    found = F.array(a.cast("double"), b.cast("double"))
    poly = F.array(F.lit(1.0), -(a + b).cast("double"), (a * b).cast("double"))
    return vw.table(spark, sf, "part").select("p_partkey", an.root_score(text, found, poly).alias("score"))


@register("q15_simple_arithmetic", "with " + vw.MATH + " select id, case when id % 8 = 5 then (size + id)::varchar end answer from math_problems")
def arithmetic(spark, sf):
    return vw.math_problems(spark, sf).select("id", an.simple_arithmetic(F.col("problem")).alias("answer"))


@register("q16_output_key", "with " + vw.RESPONSES + NUMBERED + " select problem_id, technique, run_index, ground_truth, elapsed_time, 'num:' || said output_key from r")
def output_key(spark, sf):
    return vw.responses(spark, sf).select("problem_id", "technique", "run_index", "ground_truth", "elapsed_time", an.output_key(F.col("response")).alias("output_key"))


@register("q16_text_key", """
select p_partkey, case p_partkey % 3 when 0 then 'text:' || replace(p_name, ' ', '') when 1 then 'num:' || regexp_replace(regexp_replace(round(p_size / 8, 12)::decimal(38,12)::varchar, '0+$', ''), '\\.$', '')
 else 'text:n(n-1)/' || p_size end output_key from part""")
def text_key(spark, sf):
    kind = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("work\nTherefore, the final answer is: "), F.initcap("p_name"), F.lit("!")))
        .when(kind == 1, F.concat(F.lit("Ans: y = "), size, F.lit("/8.")))
        .otherwise(F.concat(F.lit("So we get n*(n - 1)/"), size, F.lit(".")))
    )
    return vw.table(spark, sf, "part").select("p_partkey", an.output_key(text).alias("output_key"))


@register("q17_quality_flags", r"""
with c as (select conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) t, turn % 3 = 2 cut from conversations),
d as (select *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] last_line from c),
e as (select *, t = '' empty, length(t) < 48 short, regexp_matches(t, '(?i)\b(i am not sure|cannot determine|insufficient information)\b') hedged,
 not (regexp_matches(t, '(?im)^\s*final\s+answer\s*[:=-]') or coalesce(regexp_matches(last_line, '(?i)^\s*answer\s*[:=-]') or regexp_matches(last_line, '(?i)\b([a-z]\s*=\s*)?[-+]?\d+(\.\d+)?(/\d+)?\b'), false)) nofinal from d)
select conv_id, turn, empty, cut truncated, short, hedged, nofinal no_final_answer, empty or cut or short or hedged or nofinal needs_retry from e""")
def quality(spark, sf):
    df = vw.table(spark, sf, "conversations")
    reason = F.when(F.col("turn") % 3 == 2, "length").otherwise("stop")
    return df.select("conv_id", "turn", an.quality_flags(F.col("text"), reason).alias("f")).select("conv_id", "turn", "f.*")


VERDICTS = ["VERDICT: PASS", "pass it", "Verdict: fail", " FAIL", "unclear", ""]
ERRORS = ["model llama not found", "nothing here", "model requires more system memory (5 GiB)", "CUDA error: out", "timeout", "shared object initialization failed"]


@register("q18_q19_verdict_error", f"""
select event_id, case when contains(v, 'verdict: pass') or starts_with(v, 'pass') then true when contains(v, 'verdict: fail') or starts_with(v, 'fail') then false end verdict,
 case when event_id % 2 = 0 and contains(e, 'model') and contains(e, 'not found') then 'model_missing' when event_id % 2 = 0 then 'endpoint' when contains(e, 'requires more system memory') then 'memory'
 when contains(e, 'cuda error') or contains(e, 'shared object') then 'gpu' else 'other' end error_class
from (select event_id, trim(lower({pick(VERDICTS, 'event_id')})) v, lower({pick(ERRORS, '(event_id // 3)')}) e from events)""")
def verdicts(spark, sf):
    df = vw.table(spark, sf, "events").select("event_id", F.expr(pick(VERDICTS, "event_id")).alias("v"), F.expr(pick(ERRORS, "(event_id div 3)")).alias("e"))
    status = F.when(F.col("event_id") % 2 == 0, 404).otherwise(500)
    return df.select("event_id", an.verdict(F.col("v")).alias("verdict"), an.error_class(status, F.col("e")).alias("error_class"))


SCORED = "with " + vw.RESPONSES + NUMBERED + """,
s as (select *, case when success and (said = ground_truth or (not marked and ground_truth in ('3', '4', '12'))) then 1.0 else 0.0 end::double accuracy,
 floor(0.75 * completion_tokens + 0.25 * total_tokens) used, 6 + case when marked then 3 when regexp_matches(response, 'The answer') then 4 when regexp_matches(response, 'Therefore') then 4 else 1 end words from r),
e as (select *, 0.4 * case when elapsed_time = 0 then 0.5 when elapsed_time < 1 then 0.6 when elapsed_time <= 3 then 1 when elapsed_time <= 8 then 0.9 when elapsed_time <= 15 then 0.7 else 0.5 end
 + 0.3 * (case when used <= 100 then 1 when used <= 300 then 0.9 else 0.7 end + case when used / words between 1 and 2 then 1 when used / words between 0.8 and 2.5 then 0.8 else 0.6 end) / 2
 + 0.3 * case when words >= 10 then 0.7 else 0.5 end eff from s)"""


@register("q20_scored_runs", SCORED + """
select problem_id, technique, run_index, elapsed_time, success, accuracy, case when success then round(eff::decimal(28,10), 3)::double else 0.0 end efficiency,
 case when success then 'num:' || said else 'error:run_' || run_index end normalized_output from e""")
def scored(spark, sf):
    return sco.score_runs(vw.responses(spark, sf)).select("problem_id", "technique", "run_index", "elapsed_time", "success", "accuracy", "efficiency", "normalized_output")


@register("b11_benchmark_job", "with " + vw.RESPONSES.replace("cast(cast(l_quantity as int) as varchar) ground_truth", "(l_orderkey % 50 + 1)::varchar ground_truth") + SCORED.removeprefix("with " + vw.RESPONSES) + """,
k as (select problem_id, technique, success, accuracy, case when success then round(eff::decimal(28,10), 3)::double else 0.0 end efficiency, case when success then 'num:' || said else 'error:run_' || run_index end okey from e),
c as (select problem_id, technique, max(n) matching from (select problem_id, technique, okey, count(*) n from k group by all) group by 1, 2),
g as (select problem_id, technique, count(*) n, count(*) filter (success) ok, sum(accuracy::decimal(18,10)) filter (success) a, sum(efficiency::decimal(18,10)) filter (success) ef from k group by 1, 2),
h as (select g.*, a::double / ok aa, ef::double / ok ee, case when n >= 2 then matching::double / n end cc from g join c using (problem_id, technique) where ok > 0),
o as (select problem_id, technique, round(aa::decimal(28,10), 3)::double accuracy, round(cc::decimal(28,10), 3)::double consistency, round(ee::decimal(28,10), 3)::double efficiency,
 round((case when cc is null then (aa + ee) / 2 else (aa + ee + cc) / 3 end)::decimal(28,10), 3)::double overall from h)
select *, row_number() over (partition by problem_id order by overall desc, technique)::bigint place from o""")
def benchmark_job(spark, sf):
    runs = vw.responses(spark, sf).drop("ground_truth")
    orders = vw.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id")).distinct()
    problems = orders.select("problem_id", F.lit(None).cast("string").alias("problem"), (F.col("problem_id") % 50 + 1).cast("string").alias("answer"))
    made = benchmark(runs, problems, vw.WEIGHTS)
    return made["comparison"].select("problem_id", "technique", "accuracy", "consistency", "efficiency", "overall", F.col("place").cast("long").alias("place"))


@register("j1_runs_with_ground_truth", """
select l_orderkey problem_id, l_linenumber run_index, l_partkey technique, l_suppkey, case when o_orderkey is not null then 'order ' || o_orderkey end problem, case when o_orderkey % 3 = 0 then null else floor(o_totalprice)::int::varchar end ground_truth
from lineitem left join orders on l_orderkey = o_orderkey and o_orderstatus <> 'P'""")
def with_truth(spark, sf):
    runs = vw.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("run_index"), F.col("l_partkey").alias("technique"), "l_suppkey")
    orders = vw.table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    answer = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.floor("o_totalprice").cast("int").cast("string"))
    problems = orders.select(F.col("o_orderkey").alias("problem_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("problem"), answer.alias("answer"))
    return sco.with_ground_truth(runs, problems)
