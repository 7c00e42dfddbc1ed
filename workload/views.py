"""Views over the given tables that the registered queries start from.

Every view exists twice: as a Spark DataFrame and as a SQL text for the
comparison engine. Both read the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import metrics as mx
from gaugeline.functions.basics import rounded
from gaugeline.operators import history as hs
from gaugeline.operators import runs as rn
from gaugeline.operators.sequences import sequence_numbers
from gaugeline.session import shuffle_width

WEIGHTS = mx.normalise_weights()
TECHNIQUES = ["click", "view", "purchase"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, dealt out over the session's shuffle partitions.

    Each given file has one row group, which Spark can't split, so a row-wise query would run in one task. Tables of
    production size have many row groups and need no such step, which is why it is here and not in the engine. Columns and
    filters are still pushed below it into the scan.
    """
    return spark.read.parquet(f"{sf}/{name}.parquet").repartition(shuffle_width(spark))


def utc(name: str):
    """A zone-less timestamp column read as UTC, whatever the session's zone is."""
    return F.expr(
        f"timestamp_micros(cast(datediff(to_date({name}), date'1970-01-01') as bigint) * 86400000000L + hour({name}) * 3600000000L"
        f" + minute({name}) * 60000000L + cast(extract(second from {name}) * 1000000 as bigint))"
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents."""
    return table(spark, sf, "documents")


# --- runs (events) --------------------------------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded runs: user = problem, event type = technique, order of time = run index."""
    events = table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("problem_id"), F.col("event_type").alias("technique"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    numbered = sequence_numbers(events, ["problem_id", "technique"], ["ts", "event_id"], "run_index")
    k, ok = F.col("k"), F.col("k") % 10 != 0
    made = numbered.select(
        "problem_id", "technique", "run_index",
        (F.col("value") / 10).alias("elapsed_time"),
        F.lit(40).alias("prompt_tokens"), (k * 12).alias("completion_tokens"), (k * 12 + 40).alias("total_tokens"),
        ok.alias("success"),
        F.when(ok, F.concat(F.lit("num:"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("error:run_"), F.col("run_index").cast("string"))).alias("normalized_output"),
        F.when(ok, rounded((k % 4) / 3.0, 3)).otherwise(0.0).alias("accuracy"),
    )
    score = mx.efficiency(F.lit(""), F.col("elapsed_time"), F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens"))
    return made.withColumn("efficiency", F.when(F.col("success"), score).otherwise(0.0))


RUNS = """
raw_runs as (
  select user_id problem_id, event_type technique, value, cast(json_extract(props, '$.k') as int) k,
         row_number() over (partition by user_id, event_type order by ts, event_id) run_index
  from events),
runs as (
  select problem_id, technique, run_index, value / 10 elapsed_time, 40 prompt_tokens, k * 12 completion_tokens,
         k * 12 + 40 total_tokens, k % 10 <> 0 success,
         case when k % 10 <> 0 then 'num:' || (k % 3) else 'error:run_' || run_index end normalized_output,
         case when k % 10 <> 0 then cast([0, 0.333, 0.667, 1][(k % 4) + 1] as double) else 0.0 end accuracy,
         case when k % 10 <> 0 then round(cast(
             0.4 * (case when value = 0 then 0.5 when value < 10 then 0.6 when value <= 30 then 1 when value <= 80 then 0.9
                         when value <= 150 then 0.7 when value <= 300 then 0.5 else 0.3 end)
           + 0.3 * ((case when 12 * k + 10 <= 100 then 1 when 12 * k + 10 <= 300 then 0.9 when 12 * k + 10 <= 500 then 0.7
                          when 12 * k + 10 <= 1000 then 0.5 else 0.3 end + 0.5) / 2)
           + 0.3 * 0.5 as decimal(28,10)), 3)::double else 0.0 end efficiency
  from raw_runs)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    return rn.technique_results(runs(spark, sf), WEIGHTS)


# exact sums like the engine: scores are decimals, the mean is rounded from ten digits
RESULTS = (
    RUNS
    + """,
key_counts as (
  select problem_id, technique, normalized_output, count(*) n, min(run_index) first_run from runs group by all),
modes as (
  select problem_id, technique, n matching, normalized_output canonical_output from (
    select *, row_number() over (partition by problem_id, technique order by n desc, first_run) r from key_counts) where r = 1),
sums as (
  select problem_id, technique, count(*) recorded, count(*) filter (success) ok,
         max(run_index) filter (success) last_success_run, max(run_index) last_run,
         sum(cast(accuracy as decimal(18,10))) filter (success) acc, sum(cast(efficiency as decimal(18,10))) filter (success) eff,
         sum(cast(elapsed_time as decimal(28,10))) filter (success) el, sum(total_tokens) filter (success) tt,
         sum(prompt_tokens) filter (success) pt, sum(completion_tokens) filter (success) ct
  from runs group by 1, 2),
raw_results as (
  select s.*, m.matching, m.canonical_output,
         coalesce(acc::double / nullif(ok, 0), 0) a, coalesce(eff::double / nullif(ok, 0), 0) e,
         case when recorded >= 2 then matching::double / recorded end c
  from sums s join modes m using (problem_id, technique)),
results as (
  select problem_id, technique, ok > 0 success, round(a::decimal(28,10), 3)::double accuracy,
         round(c::decimal(28,10), 3)::double consistency, round(e::decimal(28,10), 3)::double efficiency,
         round((case when c is null then (a + e) / 2 else (a + e + c) / 3 end)::decimal(28,10), 3)::double overall,
         c is null consistency_is_provisional, recorded consistency_runs_used,
         case when recorded >= 2 then matching end consistency_matching_runs, canonical_output,
         round(coalesce(el::double / nullif(ok, 0), 0)::decimal(28,10), 4)::double elapsed_time,
         round(coalesce(tt::double / nullif(ok, 0), 0)::decimal(28,10), 0)::bigint total_tokens,
         round(coalesce(pt::double / nullif(ok, 0), 0)::decimal(28,10), 0)::bigint prompt_tokens,
         round(coalesce(ct::double / nullif(ok, 0), 0)::decimal(28,10), 0)::bigint completion_tokens,
         recorded runs_recorded, ok runs_succeeded, recorded - ok runs_failed, last_success_run, last_run
  from raw_results)"""
)


# --- history ----------------------------------------------------------------------------

DOMAIN_NAMES = ["algebra", "pre-calculus", "counting-probability"]
DIFFICULTY_NAMES = ["basic", "intermediate", "advanced"]


def blocks(id_column: str) -> list:
    name = F.element_at(F.lit(DOMAIN_NAMES), (F.col(id_column) % 3 + 1).cast("int")).alias("domain")
    level = F.element_at(F.lit(DIFFICULTY_NAMES), (F.floor(F.col(id_column) / 3) % 3 + 1).cast("int")).alias("difficulty")
    return [name, level]


def history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(problems, scores): every technique result of every problem as stored history."""
    every = results(spark, sf)
    scores = every.where("success").select(*blocks("problem_id"), "problem_id", "technique", "overall")
    won = rn.greedy_winner(every).select("problem_id", F.col("best_technique").alias("winner_technique"))
    quality = table(spark, sf, "labels").select(F.col("doc_id").alias("problem_id"), (F.col("quality") == 1).alias("has_ground_truth"))
    problems = won.join(quality, "problem_id", "left").select(*blocks("problem_id"), "problem_id", "has_ground_truth", "winner_technique")
    return problems, scores


WINNERS = (
    RESULTS
    + """,
winners as (
  select problem_id, technique best_technique, overall best_overall from (
    select *, row_number() over (partition by problem_id order by overall desc, sha256(problem_id || '|' || technique) desc) r
    from results where success) where r = 1)"""
)

HISTORY = (
    WINNERS
    + """,
h_scores as (
  select ['algebra','pre-calculus','counting-probability'][(problem_id % 3) + 1] as "domain",
         ['basic','intermediate','advanced'][((problem_id // 3) % 3) + 1] as difficulty, problem_id, technique, overall
  from results where success),
h_problems as (
  select ['algebra','pre-calculus','counting-probability'][(w.problem_id % 3) + 1] as "domain",
         ['basic','intermediate','advanced'][((w.problem_id // 3) % 3) + 1] as difficulty, w.problem_id,
         l.quality = 1 has_ground_truth, best_technique winner_technique
  from winners w left join labels l on l.doc_id = w.problem_id)"""
)


# --- problem texts (part) -----------------------------------------------------------------

MATH_SQL = """
select p_partkey id, case p_partkey % 8
 when 0 then concat('Solve for x: ',cast(p_size as string),'x + ',cast(p_partkey%17 as string),' = ',cast(p_size*3+p_partkey%17 as string),'.')
 when 1 then concat('Solve for all real solutions: x^2 - ',cast(p_size+1 as string),'x + ',cast(p_size as string),' = 0.')
 when 2 then concat('A coin is flipped ',cast(p_size as string),' times. What is the probability of exactly ',cast(p_partkey%5 as string),' heads?')
 when 3 then concat('How many ways can ',cast(p_size as string),' books be arranged on a shelf?')
 when 4 then concat('Find the derivative of f(x) = x^3 + ',cast(p_size as string),'x.')
 when 5 then concat('What is ',cast(p_size as string),' + ',cast(p_partkey as string),'?')
 when 6 then concat('Find sin(',cast(p_size as string),' degrees).')
 else concat('A train travels ',cast(p_size as string),' miles in 2 hours. At this rate, how many miles in ',cast(p_partkey%9+1 as string),' hours?') end problem,
 p_brand subject, p_size%3 difficulty, p_size size
from {part}"""

MATH = "math_problems as (" + MATH_SQL.format(part="part").replace("as string", "as varchar") + ")"


def math_problems(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(MATH_SQL.format(part="{part}"), part=table(spark, sf, "part"))


# --- responses (lineitem) -------------------------------------------------------------------

RESPONSES_SQL = """
select l_orderkey problem_id, l_suppkey%5 technique, l_linenumber run_index,
 concat('Step: 3 * 4 = 12.', chr(10),
        case l_linenumber%4 when 0 then 'Final answer: ' when 1 then 'The answer is ' when 2 then 'Therefore x = ' else '' end,
        cast(cast(l_quantity as int) + (case when l_tax>0.06 then 1 else 0 end) as string)) response,
 cast(cast(l_quantity as int) as string) ground_truth,
 l_discount * 100 elapsed_time, cast(l_quantity as int) * 3 completion_tokens, l_linenumber * 10 prompt_tokens,
 cast(l_quantity as int) * 3 + l_linenumber * 10 total_tokens, l_returnflag <> 'A' success
from {lineitem}"""

RESPONSES = "responses as (" + RESPONSES_SQL.format(lineitem="lineitem").replace("as string", "as varchar") + ")"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(RESPONSES_SQL.format(lineitem="{lineitem}"), lineitem=table(spark, sf, "lineitem"))
