"""Queries over operators that read and write files, follow streams or are plugged in by the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import text as tx
from gaugeline.functions.basics import rounded
from gaugeline.operators import retrieval as rv
from gaugeline.operators import runs as rn
from gaugeline.operators import scoring as sc
from gaugeline.session import scratch_path
from gaugeline.sources import problems as sp
from gaugeline.streaming import events as ev
from workload import bank as wb
from workload import matching as wm
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


# --- last responses and missing runs ---------------------------------------------------------

def answered(spark, sf):
    """Runs with a response or an error; every fifth problem has failed runs only."""
    index = F.col("run_index").cast("string")
    return vw.runs(spark, sf).withColumn("success", F.col("success") & (F.col("problem_id") % 5 != 0)).withColumns({
        "response": F.when(F.col("success"), F.concat(F.lit("answer "), index)).otherwise(""),
        "error": F.when(~F.col("success") & (F.col("run_index") % 2 == 0), F.concat(F.lit("failed "), index)),
    })


@register("a2_last_response", "with " + vw.RUNS + """,
f as (select problem_id, technique, max(run_index) filter (success and problem_id % 5 <> 0) s, max(run_index) l from runs group by 1, 2)
select problem_id, technique, case when s is not null then 'answer ' || s else '' end response, case when s is null then case when l % 2 = 0 then 'failed ' || l else 'All runs failed' end end error from f""")
def last_response(spark, sf):
    runs = answered(spark, sf)
    return rn.with_last_response(rn.technique_results(runs, vw.WEIGHTS), runs).select("problem_id", "technique", "response", "error")


@register("a4_failed_rows", "with " + vw.RESULTS + """,
e as (select problem_id, technique, success, runs_recorded::bigint runs_recorded, runs_failed::bigint runs_failed, overall from results),
w as (select distinct problem_id, t technique from results, (select unnest(['click', 'view', 'never_run']) t))
select * from e union all select problem_id, technique, false, 0, 3, 0.0 from w anti join e using (problem_id, technique)""")
def failed_rows(spark, sf):
    results = rn.technique_results(vw.runs(spark, sf), vw.WEIGHTS)
    expected = results.select("problem_id", F.explode(F.array(*[F.lit(t) for t in ("click", "view", "never_run")])).alias("technique"))
    made = rn.failed_results(expected, results, 3)
    return made.select("problem_id", "technique", "success", "runs_recorded", "runs_failed", "overall")


# --- files -----------------------------------------------------------------------------------------

@register("s5_appended_problems", wb.JSON_PROBLEMS)
def appended(spark, sf):
    path = scratch_path(spark, "set")
    made = sp.problems_from_json(wb.documents(spark, sf)).drop("pos")
    for part in (0, 1):
        sp.append_problems(made.where(F.col("id") % 2 == part), path)
    return spark.read.parquet(path)


def bank_lines(spark, sf):
    path = scratch_path(spark, "bank")
    wb.bank_documents(spark, sf).select("value").write.text(path)
    return path


BANK_FILE = "with " + wb.BANK_SQL + """ select subject, difficulty, problem, "type", count(*)::bigint n from bank group by all"""


@register("s7_bank_from_files", BANK_FILE)
def bank_files(spark, sf):
    made = sp.read_examples(spark, bank_lines(spark, sf), lines=True)
    return made.groupBy("subject", "difficulty", "problem", "type").agg(F.count("*").alias("n"))


@register("s8_user_bank_from_files", "with " + wb.BANK_SQL + """
select subject, difficulty, count(*)::bigint n, count(expires_at)::bigint expiring from bank group by all""")
def user_files(spark, sf):
    missing = sp.read_user_examples(spark, scratch_path(spark, "nothing"), lines=True)
    made = sp.read_user_examples(spark, bank_lines(spark, sf), lines=True).unionByName(missing)
    return made.groupBy("subject", "difficulty").agg(F.count("*").alias("n"), F.count("expires_at").alias("expiring"))


# --- streams -----------------------------------------------------------------------------------------

def turn_events(spark, sf):
    """A token event per turn and a final event per conversation, ten minutes apart from the next one's."""
    turns = vw.table(spark, sf, "conversations")
    nothing = F.lit(None)
    at = F.timestamp_seconds(F.col("conv_id") * 600 + F.col("seq"))
    tokens = turns.select(
        F.col("conv_id"), F.col("turn").alias("seq"), F.lit("token").alias("type"), F.col("text").alias("content"),
        nothing.cast("long").alias("prompt_eval_count"), nothing.cast("long").alias("eval_count"),
    )
    last = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("seq")).select(
        "conv_id", "seq", F.lit("done").alias("type"), nothing.cast("string").alias("content"), F.col("seq").alias("prompt_eval_count"), F.lit(5).cast("long").alias("eval_count")
    )
    events = tokens.unionByName(last).withColumn("ts", at)
    return events.withColumns({"event_id": F.concat_ws("-", "conv_id", "seq"), "session": F.col("conv_id").cast("string"), "technique": F.lit("t"), "run_index": F.lit(1)}).drop("conv_id")


@register("s19_event_files", """
select conv_id || '-' || turn event_id, conv_id::varchar as session, 'token' "type", md5(text) digest from conversations
union all select conv_id || '-' || (max(turn) + 1), conv_id::varchar, 'done', null from conversations group by conv_id""")
def event_files(spark, sf):
    path = scratch_path(spark, "events")
    ev.write_events(turn_events(spark, sf), path)
    sink, checkpoint = ev.stream_scratch(spark, "s19")
    ev.run_available(ev.read_events_stream(spark, path), sink, checkpoint)
    return spark.read.parquet(sink).select("event_id", "session", "type", F.md5(F.col("content").cast("binary")).alias("digest"))


@register("r2_streamed_responses", """
select conv_id::varchar as session, md5(string_agg(text, '' order by turn)) digest, max(turn)::bigint + 6 total_tokens from conversations
where conv_id < (select max(conv_id) from conversations) group by conv_id""")
def streamed_responses(spark, sf):
    """The last conversation's session is still open when the stream ends."""
    path = scratch_path(spark, "events")
    ev.write_events(turn_events(spark, sf), path)
    events = ev.read_events_stream(spark, path, files_per_trigger=1_000_000)
    sink, checkpoint = ev.stream_scratch(spark, "r2")
    ev.run_available(ev.assemble_responses(events, ["session", "technique", "run_index"], delay="2 minutes"), sink, checkpoint)
    return spark.read.parquet(sink).select("session", F.md5(F.col("response").cast("binary")).alias("digest"), "total_tokens")


@register("r2_token_state", ORACLES["r2_streamed_responses"])
def token_state(spark, sf):
    """As r2_streamed_responses, with the tokens appended to keyed state."""
    path = scratch_path(spark, "events")
    # the first turn is at second 0 of 1970, which Spark's first watermark counts as late
    ev.write_events(turn_events(spark, sf).withColumn("ts", F.col("ts") + F.expr("interval 1 day")), path)
    ev.use_rocksdb(spark)
    sink, checkpoint = ev.stream_scratch(spark, "r2-state")
    made = ev.stream_responses(ev.read_events_stream(spark, path, files_per_trigger=1_000_000), ["session", "technique", "run_index"])
    ev.run_available(made, sink, checkpoint)
    return spark.read.parquet(sink).select("session", F.md5(F.col("response").cast("binary")).alias("digest"), "total_tokens")


# --- plugged in ------------------------------------------------------------------------------------------

@register("x1_custom_scorer", "with " + vw.RESPONSES + """
select problem_id, technique, run_index, round((length(response) / (1 + length(ground_truth)))::decimal(28,10), 4)::double brevity from responses""")
def custom_scorer(spark, sf):
    sc.register_scorer("brevity", lambda response, truth: rounded(F.length(response) / (F.lit(1) + F.length(truth)), 4))
    try:
        scored = sc.score_runs(vw.responses(spark, sf).withColumn("problem", F.lit(None).cast("string")))
    finally:
        sc.unregister_scorer("brevity")
    return scored.select("problem_id", "technique", "run_index", "brevity")


@register("x2_custom_technique", "with " + vw.MATH + """
select id target_id, 'terse' technique, 'Only the number. ' || problem prompt, case when id % 3 = 0 then 'skipped' end error from math_problems
union all select id, 'zero_shot', 'Solve the following math problem. ' || chr(10) || chr(10) || 'Q: ' || problem || chr(10) || 'A:', null from math_problems""")
def custom_technique(spark, sf):
    targets, bank = wm.bank_and_targets(spark, sf)
    rv.register_technique("terse", lambda t: t.select(
        "target_id", F.lit("terse").alias("technique"), F.concat(F.lit("Only the number. "), "problem").alias("prompt"), F.when(F.col("target_id") % 3 == 0, "skipped").alias("error"),
    ))
    try:
        made = rv.all_techniques(targets, bank)
    finally:
        rv.unregister_technique("terse")
    return made.where("technique <> 'few_shot'")


@register("p22_run_level_truth", """
with f as (select o_orderkey, case o_orderkey % 5 when 0 then 'yes' when 1 then 'maybe' when 2 then null else '' end d, case when o_orderkey % 7 = 0 then 'heuristic' end q from orders),
r as (select l_orderkey, l_linenumber n, case l_linenumber % 3 when 1 then 'unknown' when 2 then case when l_orderkey % 2 = 0 then 'true' else 'off' end end rf, case when l_quantity > 45 then 'ground_truth' end rq from lineitem),
k as (select l_orderkey, n, case rf when 'true' then true when 'off' then false else rq = 'ground_truth' end t from r),
g as (select l_orderkey, (list(t order by n) filter (t is not null))[1] t from k group by 1)
select o_orderkey, case when d = 'yes' then true when q = 'heuristic' then false else t end known from f left join g on l_orderkey = o_orderkey""")
def run_level_truth(spark, sf):
    docs = vw.table(spark, sf, "orders").select("o_orderkey", F.expr("case o_orderkey % 5 when 0 then 'yes' when 1 then 'maybe' when 2 then null else '' end").alias("d"), F.expr("case when o_orderkey % 7 = 0 then 'heuristic' end").alias("q"))
    runs = vw.table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct(
            F.col("l_linenumber").alias("n"),
            F.expr("case l_linenumber % 3 when 1 then 'unknown' when 2 then case when l_orderkey % 2 = 0 then 'true' else 'off' end end").alias("has_ground_truth"),
            F.expr("case when l_quantity > 45 then 'ground_truth' end").alias("evaluation_quality"),
        ).alias("r"),
    ).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("runs"))  # the runs of one document
    joined = docs.join(runs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", tx.document_truth_known(F.col("d"), F.col("q"), F.coalesce("runs", F.expr("cast(array() as array<struct<n:int,has_ground_truth:string,evaluation_quality:string>>)"))).alias("known"))
