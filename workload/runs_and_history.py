"""Queries over recorded runs and the history built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import metrics as mx
from gaugeline.functions.basics import rounded
from gaugeline.operators import history as hs
from gaugeline.operators import routing as rt
from gaugeline.operators import runs as rn
from gaugeline.operators.scoring import normalise_payloads
from gaugeline.session import durable, scratch_path
from gaugeline.sources import history_store as st
from gaugeline.sources import history_totals as ht
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


def r(expression: str, digits: int) -> str:
    return f"round(({expression})::decimal(28,10), {digits})::double"


# --- scoring arithmetic ---------------------------------------------------------------------

WORDS = "(case when trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' then 0 else len(string_split_regex(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+')) end)"


@register("q1_q5_efficiency", f"""
with d as (select doc_id, {WORDS} words, doc_id % 41 secs, doc_id % 700 prompt_tokens, n_chars // 4 completion_tokens from documents),
b as (select *, floor(0.75 * completion_tokens + 0.25 * (prompt_tokens + completion_tokens))::bigint mixed from d),
u as (select *, case when mixed > 0 then mixed else completion_tokens end used from b),
s as (select *,
  case when secs = 0 then 0.5 when secs < 1 then 0.6 when secs <= 3 then 1 when secs <= 8 then 0.9 when secs <= 15 then 0.7 when secs <= 30 then 0.5 else 0.3 end::double time_score,
  (case when used = 0 then 0.5 else ((case when used <= 100 then 1 when used <= 300 then 0.9 when used <= 500 then 0.7 when used <= 1000 then 0.5 else 0.3 end)
     + (case when words = 0 then 0.5 when used::double / words between 1 and 2 then 1 when used::double / words between 0.8 and 2.5 then 0.8 else 0.6 end)) / 2 end)::double token_score,
  case when words between 30 and 100 then 1 when words between 20 and 150 then 0.9 when words between 10 and 250 then 0.7 else 0.5 end::double conciseness from u)
select doc_id, words::bigint words, used::bigint used, {r('time_score', 4)} time_score, {r('token_score', 4)} token_score, {r('conciseness', 4)} conciseness,
       {r('0.4 * time_score + 0.3 * token_score + 0.3 * conciseness', 3)} efficiency from s""")
def efficiency(spark, sf):
    d = vw.texts(spark, sf).withColumns({
        "secs": F.col("doc_id") % 41, "prompt_tokens": F.col("doc_id") % 700, "completion_tokens": F.floor(F.col("n_chars") / 4),
    }).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    d = d.withColumn("words", mx.word_count(F.col("text")).cast("long"))
    used = mx.blended_tokens(F.col("completion_tokens"), F.col("total_tokens"), F.col("prompt_tokens"))
    return d.select(
        "doc_id", "words", used.alias("used"),
        rounded(mx.time_score(F.col("secs")), 4).alias("time_score"),
        rounded(mx.token_score(used, F.col("words")), 4).alias("token_score"),
        rounded(mx.conciseness_score(F.col("words")), 4).alias("conciseness"),
        mx.efficiency(F.col("text"), F.col("secs"), F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens")).alias("efficiency"),
    )


@register("q21_overall_weights", "with " + vw.RESULTS + f""",
x as (select problem_id, technique, accuracy a, efficiency e, consistency c from results)
select problem_id, technique, {r('case when c is null then (0.75*a + 0*e) / 0.75 else 0.75*a + 0.25*c end', 6)} skewed,
       {r('case when c is null then (a+e)/2 else c end', 6)} consistency_only from x""")
def overall_weights(spark, sf):
    res = vw.results(spark, sf)
    scores = {m: F.col(m) for m in mx.METRICS}
    return res.select(
        "problem_id", "technique",
        rounded(mx.overall(scores, mx.normalise_weights(3, 1, 0)), 6).alias("skewed"),
        rounded(mx.overall(scores, mx.normalise_weights(0, 1, 0)), 6).alias("consistency_only"),
    )


@register("s18_payload_metrics", """
select event_id, greatest(k, 0)::bigint prompt_tokens, greatest(k - 50, 0)::bigint completion_tokens, (greatest(k, 0) + greatest(k - 50, 0))::bigint total_tokens,
 coalesce(value * 1e8, 0) / 1e9 eval_time from (select event_id, cast(json_extract(props, '$.k') as bigint) k, value from events)""")
def payloads(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    df = vw.table(spark, sf, "events").select(
        "event_id", k.alias("prompt_eval_count"), (k - 50).alias("eval_count"),
        F.lit(None).cast("long").alias("load_duration"), F.lit("x").alias("prompt_eval_duration"), (F.col("value") * 1e8).alias("eval_duration"),
    )
    return normalise_payloads(df).drop("load_time", "prompt_eval_time")


# --- aggregates --------------------------------------------------------------------------------

@register("w1_running_consistency", "with " + vw.RUNS + f""",
n as (select *, row_number() over (partition by problem_id, technique, normalized_output order by run_index) seen from runs),
m as (select *, max(seen) over (partition by problem_id, technique order by run_index) best from n),
c as (select *, case when run_index >= 2 then best::double / run_index end cons from m)
select problem_id, technique, run_index::bigint run_index, {r('cons', 3)} consistency, case when run_index >= 2 then best end::bigint matching_runs,
 {r('case when cons is null then (accuracy + efficiency) / 2 else (accuracy + efficiency + cons) / 3 end', 3)} overall, run_index < 2 provisional from c""")
def running(spark, sf):
    return rn.running_scores(vw.runs(spark, sf), vw.WEIGHTS).select(
        "problem_id", "technique", "run_index", "consistency", F.col("consistency_matching_runs").alias("matching_runs"),
        "overall", F.col("overall_is_provisional").alias("provisional"),
    )


@register("a3_output_counts", "with " + vw.RUNS + " select problem_id, technique, normalized_output, count(*)::bigint n, min(run_index)::bigint first_run from runs group by all")
def output_counts(spark, sf):
    return rn.output_counts(vw.runs(spark, sf))


@register("a3_consistency", "with " + vw.RESULTS + f" select problem_id, technique, recorded::bigint runs_used, {r('c', 6)} consistency, case when recorded >= 2 then matching end::bigint matching_runs, canonical_output, recorded < 2 is_provisional from raw_results")
def consistency(spark, sf):
    return rn.consistency(rn.output_counts(vw.runs(spark, sf))).withColumn("consistency", rounded(F.col("consistency"), 6))


@register("a1_a4_technique_results", "with " + vw.RESULTS + " select * replace (consistency_runs_used::bigint as consistency_runs_used) from results")
def technique_results(spark, sf):
    return vw.results(spark, sf)


@register("a5_comparison", "with " + vw.RESULTS + """
select problem_id, row_number() over (partition by problem_id order by overall desc, technique)::bigint place, technique, accuracy, consistency, efficiency, overall,
 elapsed_time latency, total_tokens tokens from results where success""")
def comparison(spark, sf):
    return rn.comparison(vw.results(spark, sf)).drop("consistency_is_provisional", "consistency_runs_used", "consistency_matching_runs")


@register("w3_greedy_winner", "with " + vw.WINNERS + " select problem_id, best_technique, best_overall, true any_success from winners")
def greedy(spark, sf):
    return rn.greedy_winner(vw.results(spark, sf))


@register("w6_p29_display_order", "with " + vw.RESULTS + """
select problem_id, technique, row_number() over (partition by problem_id order by success desc, coalesce(overall,0) desc, technique)::bigint display_rank,
 coalesce(consistency, 0) consistency, overall from results""")
def display(spark, sf):
    return rn.display_order(vw.results(spark, sf)).select("problem_id", "technique", "display_rank", "consistency", "overall")


@register("a19_execution_summary", "with " + vw.RESULTS + " select problem_id, string_agg(technique, ',' order by technique) attempted_techniques, count(*)::bigint attempted_count, count(*) filter (success)::bigint successful_count from results group by 1")
def summary(spark, sf):
    return rn.execution_summary(vw.results(spark, sf))


@register("d6_finalise", "with " + vw.WINNERS + """
select r.problem_id, r.technique, r.overall, s.attempted_count, 'runtime_scores' selection_source, 'ok' status
from results r join winners w on w.problem_id = r.problem_id and w.best_technique = r.technique
join (select problem_id, count(*)::bigint attempted_count from results group by 1) s on s.problem_id = r.problem_id""")
def finalise(spark, sf):
    res = vw.results(spark, sf)
    return rn.finalise(res, rn.greedy_winner(res)).select("problem_id", "technique", "overall", "attempted_count", "selection_source", "status")


@register("b11_benchmark_report", "with " + vw.WINNERS + f"""
select best_technique technique, count(*)::bigint wins, (select count(*) from winners)::bigint problems,
 {r('count(*) * 100.0 / (select count(*) from winners)', 1)} win_percent from winners group by 1""")
def win_table(spark, sf):
    return rn.win_table(rn.greedy_winner(vw.results(spark, sf)))


METRIC_LONG = """
long as (select technique, unnest(['accuracy','consistency','efficiency','overall']) metric, unnest([accuracy, consistency, efficiency, overall]) v from results where success),
st as (select technique, metric, count(v) n, sum(v::decimal(18,10))::double / count(v) m, sum((v*v)::decimal(18,10))::double / count(v) q, min(v) low, max(v) high from long where v is not null group by 1, 2)"""


@register("a12_metric_summary", "with " + vw.RESULTS + "," + METRIC_LONG + f" select technique, metric, n::bigint n, {r('m', 3)} mean, {r('sqrt(greatest(q - m*m, 0))', 3)} std, low, high from st")
def metric_summary(spark, sf):
    return rn.metric_summary(rn.comparison(vw.results(spark, sf)))


@register("a12_metric_rollup", "with " + vw.RESULTS + """,
long as (select problem_id % 3 category, technique, unnest(['accuracy','consistency','efficiency','overall']) metric, unnest([accuracy, consistency, efficiency, overall]) v from results where success)
select category::bigint category, technique, metric, count(v)::bigint n, round((sum(v::decimal(18,10))::double / count(v))::decimal(28,10), 3)::double mean, min(v) low, max(v) high, bit_count(grouping(metric, category, technique))::int "level"
from long where v is not null group by rollup(metric, category, technique)""")
def metric_rollup(spark, sf):
    compared = rn.comparison(vw.results(spark, sf)).withColumn("category", F.col("problem_id") % 3)
    return rn.metric_summary(compared, by=["category"], rollup=True).drop("std")


@register("a12_category_wins", "with " + vw.HISTORY + """ select "domain" category, winner_technique technique, count(*)::bigint wins from h_problems group by 1, 2""")
def category_wins(spark, sf):
    won = rn.greedy_winner(vw.results(spark, sf))
    return rn.category_wins(won, won.select("problem_id", vw.blocks("problem_id")[0].alias("category")))


@register("a13_baseline", "with " + vw.RUNS + f""",
k as (select problem_id, normalized_output, count(*) n from runs where success group by 1, 2),
m as (select problem_id, max(n) matching from k group by 1),
s as (select problem_id, count(*) requested, count(*) filter (success) ok,
  sum(accuracy::decimal(18,10)) filter (success) a, sum(efficiency::decimal(18,10)) filter (success) e, sum(elapsed_time::decimal(28,10)) filter (success) el,
  sum(total_tokens) filter (success) tt, sum(prompt_tokens) filter (success) pt, sum(completion_tokens) filter (success) ct from runs group by 1),
x as (select s.*, a::double / nullif(ok,0) aa, e::double / nullif(ok,0) ee, case when ok >= 2 then matching::double / ok end cc from s left join m using (problem_id))
select problem_id, requested::bigint runs_requested, ok::bigint runs_succeeded, {r('aa', 4)} accuracy, {r('cc', 4)} consistency, {r('ee', 4)} efficiency,
 {r('case when cc is null then (aa + ee) / 2 else (aa + ee + cc) / 3 end', 4)} overall, {r('el::double / ok', 3)} elapsed_time,
 round((tt::double / ok)::decimal(28,10), 0)::bigint total_tokens, round((pt::double / ok)::decimal(28,10), 0)::bigint prompt_tokens, round((ct::double / ok)::decimal(28,10), 0)::bigint completion_tokens,
 case when ok = 0 then 'all_runs_failed' end error from x""")
def baseline(spark, sf):
    return rn.baseline(vw.runs(spark, sf), vw.WEIGHTS)


@register("a14_best_baseline_run", "with " + vw.RUNS + f""",
s as (select problem_id, run_index, {r('accuracy / 3 + efficiency / 3', 6)} score from runs where success)
select problem_id, run_index::bigint best_run_index, score best_score from (select *, row_number() over (partition by problem_id order by score desc, run_index) rk from (select problem_id, min(run_index) run_index, score from s group by 1, 3)) where rk = 1""")
def best_baseline(spark, sf):
    return rn.best_baseline_run(vw.runs(spark, sf), vw.WEIGHTS)


@register("a15_round_totals", f"""
select o_orderkey call_id, sum(l_linenumber)::bigint prompt_tokens, sum(l_quantity)::bigint completion_tokens, sum(l_linenumber + l_quantity)::bigint total_tokens,
 {r('sum(l_discount::decimal(18,10))::double', 6)} eval_time, (count(*) - 1)::bigint continuation_rounds
from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def round_totals(spark, sf):
    orders = vw.table(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"))
    rounds = vw.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").cast("long").alias("prompt_tokens"),
        F.col("l_quantity").cast("long").alias("completion_tokens"), F.col("l_discount").alias("eval_time"),
    )
    return rn.round_totals(rounds.join(orders, "call_id", "left_semi"))


# --- history ----------------------------------------------------------------------------------

LAST = """,
numbered as (select *, row_number() over (partition by problem_id, technique order by run_index desc) back, (accuracy + efficiency) / 2 ov from runs),
entries as (select problem_id, technique, 4 - back - (3 - least(3, max(run_index) over (partition by problem_id, technique))) slot, run_index, accuracy, efficiency, ov from numbered where back <= 3)"""


def _run_scores(spark, sf):
    return vw.runs(spark, sf).select(
        "problem_id", "technique", "run_index", "accuracy", F.lit(None).cast("double").alias("consistency"), "efficiency",
        rounded((F.col("accuracy") + F.col("efficiency")) / 2, 6).alias("overall"),
    )


@register("w2_last_three_runs", "with " + vw.RUNS + LAST + f" select problem_id, technique, slot::bigint slot, run_index::bigint run_index, {r('ov', 6)} overall from entries")
def last_three(spark, sf):
    return hs.last_runs(_run_scores(spark, sf), ["problem_id", "technique"]).select("problem_id", "technique", "slot", "run_index", "overall")


@register("a6_last_three_average", "with " + vw.RUNS + f""",
f as (select problem_id, technique, run_index, accuracy, efficiency, (accuracy + efficiency) / 2 ov, row_number() over (partition by problem_id order by run_index desc, technique desc) back from runs)
select problem_id, {r('sum(accuracy::decimal(18,10))::double / count(*)', 4)} accuracy, {r('sum(efficiency::decimal(18,10))::double / count(*)', 4)} efficiency,
 {r('sum(' + r('ov', 6) + '::decimal(18,10))::double / count(*)', 4)} overall, count(*)::bigint sample_count from f where back <= 3 group by 1""")
def last_average(spark, sf):
    entries = hs.last_runs(_run_scores(spark, sf), ["problem_id"])
    return hs.last_three_average(entries).select("problem_id", "accuracy", "efficiency", "overall", "sample_count")


@register("a7_a8_technique_averages_and_winner", "with " + vw.RUNS + LAST + f""",
av as (select problem_id, technique, {r('sum(' + r('ov', 6) + '::decimal(18,10))::double / count(*)', 4)} overall, min(slot) pos from entries group by 1, 2),
ordered as (select *, row_number() over (partition by problem_id order by overall desc, pos, technique desc) k from av)
select problem_id, technique winner_technique, overall winner_overall from ordered where k = 1""")
def history_winner(spark, sf):
    entries = hs.last_runs(_run_scores(spark, sf), ["problem_id", "technique"]).withColumn("position", F.col("slot"))
    return hs.winners(hs.technique_averages(entries))


@register("s14_s16_run_slots", "with " + vw.WINNERS + """,
mine as (select r.problem_id, r.run_index, (r.accuracy + r.efficiency) / 2 ov, row_number() over (partition by r.problem_id order by run_index desc) back from runs r join winners w on w.problem_id = r.problem_id and w.best_technique = r.technique),
kept as (select *, max(back) over (partition by problem_id) - back + 1 slot from mine where back <= 3),
grid as (select problem_id, s slot from (select distinct problem_id from kept), (select unnest([1, 2, 3]) s))
select g.problem_id, g.slot::bigint slot, coalesce(k.run_index, g.slot)::bigint run_index, round(k.ov::decimal(28,10), 6)::double overall from grid g left join kept k using (problem_id, slot)""")
def run_slots(spark, sf):
    best = rn.greedy_winner(vw.results(spark, sf)).select(
        "problem_id", F.col("best_technique").alias("technique"), F.lit(0.0).alias("accuracy"), F.lit(None).cast("double").alias("consistency"),
        F.lit(0.0).alias("efficiency"), F.col("best_overall").alias("overall"),
    )
    entries = hs.run_entries(_run_scores(spark, sf), best)
    return hs.unpivot_runs(hs.pivot_runs(entries)).select("problem_id", "slot", "run_index", "overall")


RANK = """
select s."domain", s.difficulty, s.technique, s.average_overall, s.samples::bigint samples, coalesce(w.wins, 0)::bigint wins,
 round((coalesce(coalesce(w.wins, 0)::double / t.n, 0))::decimal(28,10), 4)::double win_rate,
 row_number() over (partition by s."domain", s.difficulty order by average_overall desc, samples desc, s.technique)::bigint "rank"
from (select "domain", difficulty, technique, round((sum(overall::decimal(18,10))::double / count(*))::decimal(28,10), 4)::double average_overall, count(*) samples
      from sc group by 1, 2, 3) s
left join (select "domain", difficulty, winner_technique technique, count(*) wins from pr where winner_technique is not null group by 1, 2, 3) w using ("domain", difficulty, technique)
left join (select "domain", difficulty, count(winner_technique) n from pr group by 1, 2) t using ("domain", difficulty)"""

ALL_RANKED = vw.HISTORY + ", sc as (select * from h_scores), pr as (select * from h_problems), d_ranking as (" + RANK + ")"
TRUTH_RANKED = (
    vw.HISTORY
    + """, pr as (select * from h_problems where has_ground_truth),
sc as (select * from h_scores where technique in ('click', 'view', 'purchase') and problem_id in (select problem_id from pr)), d_ranking as (""" + RANK + ")"
)


@register("a9_domain_ranking", "with " + ALL_RANKED + " select * from d_ranking")
def domain_ranking(spark, sf):
    return hs.domain_ranking(*vw.history(spark, sf))


@register("a9_domain_ranking_ground_truth", "with " + TRUTH_RANKED + " select * from d_ranking")
def domain_ranking_truth(spark, sf):
    return hs.domain_ranking(*vw.history(spark, sf), techniques=vw.TECHNIQUES, require_ground_truth=True)


@register("s12_partition_scan", "with " + vw.HISTORY + """ select problem_id, technique, overall from h_scores where "domain" = 'algebra' and difficulty = 'basic'""")
def partition_scan(spark, sf):
    _, scores = stored_history(spark, sf)
    return st.read_history(spark, scores, "algebra", "basic", st.SCORE_KEY).select("problem_id", "technique", "overall")


def stored_history(spark, sf):
    """Paths of the stored problems and scores: two writers, each with a first batch and a repeated second one."""
    problems, scores = vw.history(spark, sf)
    paths = scratch_path(spark, "problems"), scratch_path(spark, "scores")
    for rows, path, key in ((problems, paths[0], st.KEY), (scores, paths[1], st.SCORE_KEY)):
        rows = durable(rows)
        stale = rows.withColumn("winner_technique", F.lit("stale")) if "winner_technique" in rows.columns else rows.withColumn("overall", F.lit(-1.0))
        st.upsert_history(stale.withColumn("updated", F.lit(1)), path, "one", 0, key)
        for _ in range(2):
            st.upsert_history(rows.where("problem_id % 2 = 0").withColumn("updated", F.lit(2)), path, "one", 1, key)
        st.upsert_history(rows.where("problem_id % 2 = 1").withColumn("updated", F.lit(2)), path, "two", 0, key)
    return paths


@register("a9_stored_ranking", "with " + TRUTH_RANKED + " select * from d_ranking")
def stored_ranking(spark, sf):
    problems, scores = stored_history(spark, sf)
    return hs.domain_ranking(
        st.read_history(spark, problems), st.read_history(spark, scores, key=st.SCORE_KEY), techniques=vw.TECHNIQUES, require_ground_truth=True
    )


def stored_totals(spark, sf):
    """Totals advanced after each of three upserts of a third of the rows and one that corrects stale ones."""
    problems, scores = vw.history(spark, sf)
    paths, ledger = (scratch_path(spark, "problems"), scratch_path(spark, "scores")), scratch_path(spark, "totals")
    rows = [(durable(problems), paths[0], st.KEY), (durable(scores), paths[1], st.SCORE_KEY)]
    for batch in range(4):
        for table, path, key in rows:
            part = table.where(F.col("problem_id") % 3 == batch % 3).withColumn("updated", F.lit(batch))
            if batch == 0:  # wrong values first, which the last batch replaces
                part = part.withColumns({"winner_technique": F.lit("stale"), "has_ground_truth": ~F.col("has_ground_truth")} if key == st.KEY else {"overall": F.lit(-1.0)})
            st.upsert_history(part, path, "one", batch, key)
        ht.advance_totals(spark, *paths, ledger)
    return ht.read_totals(spark, ledger)


@register("a9_ranking_from_totals", "with " + TRUTH_RANKED + " select * from d_ranking")
def totals_ranking(spark, sf):
    return hs.ranking_from_totals(stored_totals(spark, sf), techniques=vw.TECHNIQUES, require_ground_truth=True)


@register("j2_allowed_techniques", "with " + vw.RESULTS + " select problem_id, technique, overall from results where technique in ('click', 'view', 'purchase')")
def allowed(spark, sf):
    return vw.results(spark, sf).where(F.col("technique").isin(*vw.TECHNIQUES)).select("problem_id", "technique", "overall")


@register("a11_coverage", "with " + vw.HISTORY + """
select p."domain", p.difficulty, count(*)::bigint problem_count, count(*) filter (has_ground_truth)::bigint ground_truth_count, count(winner_technique)::bigint total_with_winner,
 (select string_agg(distinct technique, ',' order by technique) from h_scores s where s."domain" = p."domain" and s.difficulty = p.difficulty) techniques_tested,
 (select string_agg(w || '=' || n, ',' order by w || '=' || n) from (select winner_technique w, count(*) n from h_problems q where q."domain" = p."domain" and q.difficulty = p.difficulty group by 1)) win_counts
from h_problems p group by 1, 2""")
def coverage(spark, sf):
    return hs.coverage(*vw.history(spark, sf))


@register("a11_coverage_from_totals", ORACLES["a11_coverage"])
def totals_coverage(spark, sf):
    return hs.coverage_from_totals(stored_totals(spark, sf))


@register("w4_a20_headline", "with " + ALL_RANKED + """
select a."domain", a.difficulty, a.technique top_technique, a.win_rate top_win_rate, a.average_overall top_average, a.samples::bigint samples,
 round((a.average_overall - b.average_overall)::decimal(28,10), 4)::double lead
from d_ranking a left join d_ranking b on a."domain" = b."domain" and a.difficulty = b.difficulty and b."rank" = 2 where a."rank" = 1""")
def headline(spark, sf):
    return hs.headline(hs.domain_ranking(*vw.history(spark, sf)), hs.BLOCK)


@register("d1_confidence_gate", "with " + TRUTH_RANKED + """,
t as (select a."domain", a.difficulty, a.samples ts, b.samples ss, round((a.average_overall - coalesce(b.average_overall, 0))::decimal(28,10), 8)::double gap, b.technique is not null two
 from d_ranking a left join d_ranking b on a."domain" = b."domain" and a.difficulty = b.difficulty and b."rank" = 2 where a."rank" = 1),
u as (select *, case when greatest(ts, ss) >= 10 then 0.5 when greatest(ts, ss) >= 5 then 0.75 else 1 end f, case when greatest(ts, ss) >= 10 then 0.008 when greatest(ts, ss) >= 5 then 0.004 else 0.003 end z from t)
select "domain", difficulty, case when ts < 3 then 'insufficient_samples' when not two then 'ok_single_technique' when least(ts, ss) < 3 then 'insufficient_samples'
 when gap < 0.03 * f and gap < z then 'ok_indistinguishable' when gap < 0.03 * f then 'low_confidence_gap' else 'ok' end reason from u""")
def confidence_gate(spark, sf):
    ranking = hs.domain_ranking(*vw.history(spark, sf), techniques=vw.TECHNIQUES, require_ground_truth=True)
    s = hs.ranking_summary(ranking, hs.BLOCK)
    s = s.select(*hs.BLOCK, *[F.col(c).alias("d_" + c) for c in s.columns if c not in hs.BLOCK])
    return s.select(*hs.BLOCK, rt.gate("d_", F.lit(3), F.lit(0.03), top_only=False).alias("reason"))


@register("d4_exploration_draw", "select o_orderkey, round((('0x' || substr(sha256('algebra|' || o_orderkey), 1, 8))::bigint / 4294967295.0)::decimal(28,10), 6)::double draw from orders")
def exploration(spark, sf):
    draw = rt.exploration_draw(F.concat_ws("|", F.lit("algebra"), F.col("o_orderkey").cast("string")))
    return vw.table(spark, sf, "orders").select("o_orderkey", rounded(draw, 6).alias("draw"))
