"""Following run events as they arrive.

Batch and streaming share the same functions: every one takes a DataFrame
that may be streaming.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeline.functions.basics import exact_sum, non_empty, rounded, strip
from gaugeline.session import scratch_path
from gaugeline.sources.history_store import KEY, upsert_history

#: Groups of examples that share one state. A stream keeps its number for the life of its checkpoint.
BUCKETS = 4096
#: Answers of one (problem, technique) whose counters are read and written together.
FEW = 256

EVENT = (
    "event_id string, session string, seq long, type string, technique string, run_index int, content string, "
    "error string, done_reason string, prompt_eval_count long, eval_count long, ts timestamp"
)


def decode_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed events of JSON lines; unreadable lines drop out, an error always has a text."""
    parsed = lines.select(F.from_json(value, EVENT).alias("e")).select("e.*").where("type is not null")
    text = F.coalesce(non_empty(strip(F.col("error"))), non_empty(strip(F.col("content"))), F.lit("Unknown error"))
    return parsed.withColumn("error", F.when(F.col("type") == "error", text))


def read_events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of event files (one JSON object per line)."""
    return decode_events(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def write_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines."""
    events.write.mode("append").json(path)


def assemble_responses(events: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """R2: the response of each finished run from its token events, with the counters of its last event.

    A run is one model response, so its tokens fit one value. On a stream either use the update output mode, where a run
    appears once its ``done`` event arrived, or give a ``delay``: a run then is a session of event time ``ts`` that ends
    when no event came for that long, its state goes with it, and the append output mode works.
    """
    if delay is not None:
        session = F.session_window("ts", delay).alias("_session")
        whole = assemble_responses(events.withWatermark("ts", delay), [*keys, session])
        return whole.drop("_session")
    tokens = F.sort_array(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "content"))))
    last = F.col("type") == "done"
    made = events.groupBy(*keys).agg(
        tokens.alias("_tokens"),
        F.max(F.when(last, F.lit(1))).alias("_done"),
        F.max(F.when(last, F.coalesce("done_reason", F.lit("stop")))).alias("done_reason"),
        F.max(F.when(last, F.coalesce("prompt_eval_count", F.lit(0)))).alias("prompt_tokens"),
        F.max(F.when(last, F.coalesce("eval_count", F.lit(0)))).alias("completion_tokens"),
    )
    return made.where("_done = 1").select(
        *[k if isinstance(k, str) else "_session" for k in keys], F.array_join(F.col("_tokens.content"), "").alias("response"), "done_reason", "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


class _Responses(StatefulProcessor):
    """Tokens of one run in a list that is only appended to, and a short value: end of waiting and last counters."""

    def __init__(self, keys: list[str], wait_ms: int) -> None:
        self.columns = [*keys, "response", "done_reason", "prompt_tokens", "completion_tokens", "total_tokens"]
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getListState("tokens", "seq long, content string")
        self.end = handle.getValueState("end", "until long, done boolean, done_reason string, prompt_tokens long, completion_tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.end.get() if self.end.exists() else None
        until, done, reason, prompt, completion = known or (None, False, None, None, None)
        before = until
        for frame in rows:
            until = max([int(frame["ms"].max()) + self.wait_ms] + ([until] if until is not None else []))
            tokens = frame[(frame["type"] == "token") & frame["content"].notna()]
            if len(tokens):
                self.tokens.appendList([(int(q), c) for q, c in zip(tokens["seq"], tokens["content"], strict=True)])
            last = frame[frame["type"] == "done"]
            if len(last):
                found = (last["done_reason"].max(), int(last["prompt_eval_count"].max()), int(last["eval_count"].max()))
                reason, prompt, completion = (max(a, b) for a, b in zip(found, (reason, prompt, completion) if done else found, strict=True))
                done = True
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        self.end.update((until, done, reason, prompt, completion))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, done, reason, prompt, completion = self.end.get()
        if done:
            response = "".join(c for _, c in sorted(tuple(t) for t in self.tokens.get()))
            yield pd.DataFrame([(*key, response, reason, prompt, completion, prompt + completion)], columns=self.columns)
        self.tokens.clear()
        self.end.clear()

    def close(self) -> None:
        pass


def stream_responses(events: DataFrame, keys: list[str], delay: str = "2 minutes", wait_ms: int = 120_000) -> DataFrame:
    """R2 on a stream, in the append output mode: the rows of :func:`assemble_responses`, once for each finished run.

    Each batch appends its tokens to the run's state and rewrites nothing but a short value, so the bytes written are linear in
    the tokens. A run ends when the watermark (``delay`` behind the latest ``ts``) is ``wait_ms`` past its last event; tokens may
    come in any order until then, also behind ``done``. Its state goes in any case, and a run without ``done`` gives no row.
    Events without ``ts`` are left out, and so are those at or before the start of 1970, which Spark takes for late.
    Needs the RocksDB state store provider (see :func:`use_rocksdb`).
    """
    kind = dict(events.dtypes)
    timed = events.where(F.col("type").isin("token", "done")).withWatermark("ts", delay).select(
        *keys, "ts", "type", "content", F.unix_millis("ts").alias("ms"), F.coalesce("seq", F.lit(-(2**63))).alias("seq"),
        F.coalesce("done_reason", F.lit("stop")).alias("done_reason"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("prompt_eval_count", "eval_count")],
    ).where("ts is not null")
    schema = ", ".join(f"`{k}` {kind[k]}" for k in keys) + ", response string, done_reason string, prompt_tokens long, completion_tokens long, total_tokens long"
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Responses(keys, wait_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


class _RunningConsistency(StatefulProcessor):
    """Counts per answer key of one (problem, technique), kept in keyed state.

    Runs wait in the state until all runs before them have come, so they count in the order of ``run_index`` whatever the
    order of arrival. A row without a run_index says that no missing run will come: what waits counts. A run that comes
    after a later one has counted is late and counts when it comes.

    The first FEW answers are one value with the totals, so that most keys are read and written once; further ones have a
    counter each.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "runs long, best long, next int, waiting long, counts binary, more boolean")
        self.counts = handle.getMapState("counts", "output string", "n long")
        self.waiting = handle.getMapState("waiting", "run_index int, copy long", "output string")

    def _before(self, output: str | None) -> int:
        if output in self.few or not self.more:
            return self.few.get(output, 0)
        return self.counts.getValue((output,))[0] if self.counts.containsKey((output,)) else 0

    def _counted(self, rows: list[tuple[int, str | None]], late: bool) -> None:
        """Counts runs in their order; a further answer's state is read once and written once."""
        changed: dict[str | None, int] = {}
        for index, output in rows:
            n = changed[output] = (changed[output] if output in changed else self._before(output)) + 1
            self.runs, self.best = self.runs + 1, max(self.best, n)
            self.made.append((index, self.runs, self.best, late))
        for output, n in changed.items():
            if output in self.few or len(self.few) < FEW:
                self.few[output] = n
            else:
                self.counts.updateValue((output,), (n,))
                self.more = True

    def _held(self) -> list[tuple[int, str | None]]:
        rows = [(k[0], v[0]) for k, v in sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0])]
        self.waiting.clear()
        self.n_waiting = 0
        return rows

    def _result(self, key) -> Iterator[pd.DataFrame]:
        if self.made:
            index, used, matching, late = zip(*self.made, strict=True)
            yield pd.DataFrame({"problem_id": key[0], "technique": key[1], "run_index": index, "runs_used": used, "matching_runs": matching, "late": late})
            self.made = []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.totals.get()
        self.runs, self.best, following, self.n_waiting, counts, self.more = tuple(known) if known else (0, 0, 1, 0, None, False)
        self.few = pickle.loads(counts) if counts else {}
        self.made: list[tuple[int, int, int, bool]] = []
        closed = False
        for frame in rows:  # Arrow batches of bounded size
            came = [(i, o if isinstance(o, str) else None) for i, o in zip(frame["run_index"].tolist(), frame["normalized_output"].tolist(), strict=True)]
            numbered = sorted(((int(i), o) for i, o in came if i == i and i is not None), key=lambda x: x[0])
            closed = closed or len(numbered) < len(came)
            self._counted([r for r in numbered if r[0] < following], True)
            ahead = [r for r in numbered if r[0] >= following]
            if ahead and ahead[0][0] > following:
                self._wait(ahead)
            elif ahead:
                if self.n_waiting:
                    ahead = sorted(self._held() + ahead, key=lambda x: x[0])
                # the stretch without a gap from the next run on; a run that comes twice counts twice
                end = next((k for k in range(1, len(ahead)) if ahead[k][0] - ahead[k - 1][0] > 1), len(ahead))
                self._counted(ahead[:end], False)
                following = ahead[end - 1][0] + 1
                self._wait(ahead[end:])
            yield from self._result(key)
        if closed and self.n_waiting:
            held = self._held()
            self._counted(held, False)
            following = held[-1][0] + 1
            yield from self._result(key)
        self.totals.update((self.runs, self.best, following, self.n_waiting, pickle.dumps(self.few), self.more))

    def _wait(self, rows: list[tuple[int, str | None]]) -> None:
        for index, output in rows:
            self.waiting.updateValue((index, self.n_waiting), (output,))
            self.n_waiting += 1

    def close(self) -> None:
        pass


def running_consistency(runs: DataFrame) -> DataFrame:
    """Consistency after each run, in the order of ``run_index`` (from 1), whatever the order of arrival.

    The result equals W1 as long as no run is missing. Runs behind a missing one wait for it until a row of their key without a
    run_index closes the gap; then they count without it. ``late`` marks runs that came after a later one had counted.

    State per key is one counter per distinct answer and the runs that wait, in the state store.
    Needs the RocksDB state store provider (see :func:`use_rocksdb`).
    """
    kind = dict(runs.dtypes)
    schema = f"problem_id {kind['problem_id']}, technique {kind['technique']}, run_index int, runs_used long, matching_runs long, late boolean"
    stepped = runs.select("problem_id", "technique", "run_index", "normalized_output").groupBy("problem_id", "technique").transformWithStateInPandas(
        statefulProcessor=_RunningConsistency(), outputStructType=schema, outputMode="Append", timeMode="None"
    )
    return stepped.withColumn("consistency", F.when(F.col("runs_used") >= 2, rounded(F.col("matching_runs") / F.col("runs_used"), 3)))


class _ExpiringExamples(StatefulProcessor):
    """One row when an example starts and one when its time is over, for the examples of one bucket.

    The state is one value, the end of each example, and one timer at the earliest of them, so a bucket is read and written
    once a batch however many examples it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "ends binary, timer long")

    def _read(self) -> tuple[dict, int | None]:
        known = self.ends.get()
        return (pickle.loads(known[0]), known[1]) if known else ({}, None)

    def _rows(self, ids: list, state: str, ends: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"example_id": ids, "state": state, "expires_ms": ends})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, timer = self._read()
        came: dict = {}
        for frame in rows:
            latest = frame.groupby("example_id", dropna=False)["expires_ms"].max() if key[0] >= 0 else pd.Series([frame["expires_ms"].max()], index=[None], dtype=float)
            for example, until in zip(latest.index.tolist(), latest.tolist(), strict=True):
                came[example] = until if example not in came or not came[example] >= until else came[example]
        came = {example: int(until) for example, until in came.items()}
        added = [example for example in came if example not in ends]
        ends.update({example: until for example, until in came.items() if example not in ends or until > ends[example]})
        earliest = min(ends.values())
        if earliest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
        self.ends.update((pickle.dumps(ends), earliest))
        if added:
            yield self._rows(added, "added", [came[example] for example in added])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, _ = self._read()
        passed, own = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        over = [example for example, until in ends.items() if until < passed or until <= own]
        made = self._rows(over, "expired", [ends.pop(example) for example in over])
        if ends:
            earliest = min(ends.values())
            self.handle.registerTimer(earliest)
            self.ends.update((pickle.dumps(ends), earliest))
        else:
            self.ends.clear()
        if over:
            yield made

    def close(self) -> None:
        pass


def expiring_examples(examples: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Life of user examples by event time. Needs example_id, created_at (timestamp), expires_at (timestamp).

    The examples are dealt to BUCKETS by their id; examples without an id are one.
    """
    kind = dict(examples.dtypes)["example_id"]
    bucket = F.when(F.col("example_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("example_id"), F.lit(BUCKETS)).cast("int")).alias("bucket")
    timed = examples.withWatermark("created_at", delay).withColumn("expires_ms", F.unix_millis("expires_at"))
    return timed.select(bucket, "example_id", "created_at", "expires_ms").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_ExpiringExamples(), outputStructType=f"example_id {kind}, state string, expires_ms long", outputMode="Append", timeMode="EventTime"
    )


def live_aggregates(runs: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Technique totals per event-time window; repeated events and rows later than the delay drop out.

    A window is emitted once the watermark has passed its end; windows that are still open when the stream stops come
    with the next run from the same checkpoint.
    """
    timed = runs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    grouped = timed.groupBy(F.window("ts", window).alias("w"), "technique").agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("succeeded"),
        rounded(exact_sum(F.col("elapsed_time")), 4).alias("elapsed_time"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), "technique", "runs", "succeeded", "elapsed_time")


def completed(events: DataFrame) -> DataFrame:
    """Complete events only."""
    return events.where(F.col("type") == "complete")


def use_rocksdb(spark: SparkSession) -> None:
    """State that does not have to fit the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available now into Parquet, then stop."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro batch to a batch job."""
    return stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_from_stream(rows: DataFrame, path: str, checkpoint: str, key: list[str] = KEY) -> None:
    """Upsert streamed history rows (with ``updated``) as batches of the query.

    The writer is the id of the streaming query. It is kept in the checkpoint, so a restarted query repeats its own
    batches; a query with a fresh checkpoint is another writer and can't replace what the first one stored.
    """

    def store(batch: DataFrame, number: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        upsert_history(batch, path, writer, number, key)

    for_each_batch(rows, store, checkpoint).awaitTermination()


def stream_scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh sink and checkpoint paths in the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/rows", f"{base}/checkpoint"
