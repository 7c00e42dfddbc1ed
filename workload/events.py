"""Streaming queries: the given tables are read as streams and run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.sources import history_store as st
from gaugeline.streaming import events as ev
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


def stream(spark, sf, name):
    schema = vw.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@register("r1_decoded_events", """
select event_id::varchar event_id, user_id::varchar as session, case when event_type = 'error' then 'error' else 'token' end "type",
 case when event_type = 'error' then case when event_id % 2 = 0 then 'Unknown error' else 'went wrong' end end error from events""")
def decoded(spark, sf):
    raw = stream(spark, sf, "events")
    body = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session"),
        F.when(F.col("event_type") == "error", "error").otherwise("token").alias("type"), F.when(F.col("event_id") % 2 == 0, "  ").otherwise("went wrong").alias("error"),
    ))
    sink, checkpoint = ev.stream_scratch(spark, "r1")
    ev.run_available(ev.decode_events(raw.select(body.alias("value"))).select("event_id", "session", "type", "error"), sink, checkpoint)
    return spark.read.parquet(sink)


@register("r2_assembled_responses", """
select conv_id, md5(string_agg(text, '' order by turn)) digest, max(turn)::bigint prompt_tokens, max(turn)::bigint + 5 completion_tokens, max(turn)::bigint * 2 + 5 total_tokens from conversations group by 1""")
def assembled(spark, sf):
    turns = vw.table(spark, sf, "conversations")
    nothing = F.lit(None)
    tokens = turns.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("token").alias("type"), F.col("text").alias("content"),
        nothing.cast("string").alias("done_reason"), nothing.cast("long").alias("prompt_eval_count"), nothing.cast("long").alias("eval_count"),
    )
    done = turns.groupBy("conv_id").agg(F.max("turn").alias("seq")).select(
        "conv_id", "seq", F.lit("done").alias("type"), nothing.cast("string").alias("content"), nothing.cast("string").alias("done_reason"),
        F.col("seq").alias("prompt_eval_count"), (F.col("seq") + 5).alias("eval_count"),
    )
    made = ev.assemble_responses(tokens.unionByName(done), ["conv_id"])
    return made.select("conv_id", F.md5(F.col("response").cast("binary")).alias("digest"), "prompt_tokens", "completion_tokens", "total_tokens")


@register("r3_streamed_consistency", "with " + vw.RUNS + """,
n as (select *, row_number() over (partition by problem_id, technique, normalized_output order by run_index) seen from runs),
m as (select *, max(seen) over (partition by problem_id, technique order by run_index) best from n)
select problem_id, technique, run_index::bigint run_index, best::bigint matching_runs, case when run_index >= 2 then round((best::double / run_index)::decimal(28,10), 3)::double end consistency from m""")
def streamed_consistency(spark, sf):
    source, _ = ev.stream_scratch(spark, "r3-source")
    vw.runs(spark, sf).select("problem_id", "technique", "run_index", "normalized_output").write.parquet(source)
    ev.use_rocksdb(spark)
    sink, checkpoint = ev.stream_scratch(spark, "r3")
    runs = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    ev.run_available(ev.running_consistency(runs), sink, checkpoint)
    return spark.read.parquet(sink).select("problem_id", "technique", F.col("run_index").cast("long").alias("run_index"), "matching_runs", "consistency")


@register("r5_live_aggregates", """
with e as (select *, time_bucket(interval '1 day', ts) w, cast(json_extract(props, '$.k') as int) k from events)
select strftime(w, '%Y-%m-%d') "day", event_type technique, count(*)::bigint runs, count(*) filter (k % 10 <> 0)::bigint succeeded, round((sum((value / 10)::decimal(18,10))::double)::decimal(28,10), 4)::double elapsed_time
from e where w + interval '1 day' <= (select max(ts) from events) - interval '10 minutes' group by 1, 2""")
def live(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    runs = stream(spark, sf, "events").select(
        "event_id", vw.utc("ts").alias("ts"), F.col("event_type").alias("technique"),
        (k % 10 != 0).alias("success"), (F.col("value") / 10).alias("elapsed_time"),
    )
    sink, checkpoint = ev.stream_scratch(spark, "r5")
    ev.run_available(ev.live_aggregates(runs, "1 day", "10 minutes"), sink, checkpoint)
    return spark.read.parquet(sink).select(F.expr("cast(date_from_unix_date(cast(unix_seconds(window_start) div 86400 as int)) as string)").alias("day"), "technique", "runs", "succeeded", "elapsed_time")


@register("r4_r7_history_from_stream", """
select ['algebra','pre-calculus','counting-probability'][(o_orderkey % 3) + 1] as "domain", o_orderkey problem_id, o_orderstatus winner_technique from orders where o_orderpriority <> '5-LOW'""")
def history_stream(spark, sf):
    orders = stream(spark, sf, "orders").withColumn("type", F.when(F.col("o_orderpriority") == "5-LOW", "status").otherwise("complete"))
    rows = ev.completed(orders).select(*vw.blocks("o_orderkey"), F.col("o_orderkey").alias("problem_id"), F.col("o_orderstatus").alias("winner_technique"), F.lit(2).alias("updated"))
    path, checkpoint = ev.stream_scratch(spark, "r7")
    # a stream of stale rows first, then the stream itself with a fresh checkpoint, and once more from that checkpoint
    stale = rows.where("problem_id % 3 = 0").withColumns({"winner_technique": F.lit("stale"), "updated": F.lit(1)})
    only_first = rows.where("problem_id % 3 <> 0")
    ev.history_from_stream(stale, path, f"{checkpoint}-stale")
    ev.history_from_stream(only_first, path, f"{checkpoint}-first")
    ev.history_from_stream(rows.where("problem_id % 3 = 0"), path, checkpoint)
    ev.history_from_stream(rows.where("problem_id % 3 = 0"), path, checkpoint)
    return st.read_history(spark, path).select("domain", "problem_id", "winner_technique")


@register("r6_expired_examples", """
select o_orderkey example_id, 'added' "state" from orders union all
select o_orderkey, 'expired' from orders where o_orderdate + interval '3 days' <= (select max(o_orderdate) from orders) - interval '1 minute'""")
def expired(spark, sf):
    rows = stream(spark, sf, "orders").select(F.col("o_orderkey").alias("example_id"), vw.utc("o_orderdate").alias("created_at")).withColumn("expires_at", F.col("created_at") + F.expr("interval 72 hours"))
    ev.use_rocksdb(spark)
    sink, checkpoint = ev.stream_scratch(spark, "r6")
    ev.run_available(ev.expiring_examples(rows), sink, checkpoint)
    return spark.read.parquet(sink).select("example_id", "state")
