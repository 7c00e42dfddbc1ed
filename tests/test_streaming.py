import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import metrics as mx
from gaugeline.operators import runs as rn
from gaugeline.sources import history_store as st
from gaugeline.streaming import events as ev


def test_decode_and_assemble(spark, tmp_path):
    lines = [
        {"session": "s", "seq": 2, "type": "token", "technique": "t", "run_index": 1, "content": "lo"},
        {"session": "s", "seq": 1, "type": "token", "technique": "t", "run_index": 1, "content": "hel"},
        {"session": "s", "seq": 3, "type": "done", "technique": "t", "run_index": 1, "prompt_eval_count": 4, "eval_count": 6},
        {"session": "u", "seq": 1, "type": "token", "technique": "t", "run_index": 1, "content": "open"},
        {"session": "s", "seq": 4, "type": "error", "error": "  "},
    ]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in lines) + "\nbroken\n", encoding="utf-8")
    batch = ev.decode_events(spark.read.text(str(tmp_path)))
    assert batch.count() == 5
    assert batch.where("type = 'error'").first().error == "Unknown error"
    keys = ["session", "technique", "run_index"]
    want = ev.assemble_responses(batch.where("type <> 'error'"), keys).collect()
    assert [(r.session, r.response, r.total_tokens) for r in want] == [("s", "hello", 10)]

    query = ev.assemble_responses(ev.read_events_stream(spark, str(tmp_path)).where("type <> 'error'"), keys).writeStream.format("memory").queryName("assembled").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("assembled").collect() == want


def test_streamed_consistency_equals_batch(spark, tmp_path):
    rows = [("p", "t", i, f"k{i % 3}") for i in range(1, 30)] + [("q", "t", 1, "a"), ("q", "t", 2, "b")]
    df = spark.createDataFrame(rows, "problem_id string, technique string, run_index int, normalized_output string")
    source = str(tmp_path / "runs")
    df.write.parquet(source)
    ev.use_rocksdb(spark)
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "check")
    ev.run_available(ev.running_consistency(spark.readStream.schema(df.schema).parquet(source)), sink, checkpoint)
    scored = df.withColumns({"accuracy": F.lit(1.0), "efficiency": F.lit(1.0)})
    batch = rn.running_scores(scored, mx.normalise_weights()).select("problem_id", "run_index", "consistency").collect()
    stream = spark.read.parquet(sink).select("problem_id", "run_index", "consistency").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_consistency_for_any_arrival(spark, tmp_path, seed):
    """Runs in any order, dealt over many small batches."""
    rng = random.Random(seed)
    rows = [(p, "t", i, None if i % 6 == 0 else f"k{rng.randrange(3)}") for p in ("p", "q") for i in range(1, 40)] + [("r", "u", 1, "a")]
    kind = "problem_id string, technique string, run_index int, normalized_output string"
    df = spark.createDataFrame(rows, kind)
    rng.shuffle(rows)
    source = str(tmp_path / "runs")
    for k in range(0, len(rows), 16):
        spark.createDataFrame(rows[k : k + 16], kind).coalesce(1).write.mode("append").parquet(source)
    ev.use_rocksdb(spark)
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "check")
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ev.run_available(ev.running_consistency(arriving), sink, checkpoint)
    batch = rn.running_scores(df.withColumns({"accuracy": F.lit(1.0), "efficiency": F.lit(1.0)}), mx.normalise_weights())
    order = lambda found: sorted(map(tuple, found.select("problem_id", "run_index", "consistency").collect()), key=repr)
    stream = spark.read.parquet(sink)
    assert order(stream) == order(batch) and stream.where("late").count() == 0 and stream.where("runs_used <> run_index").count() == 0


def test_a_missing_run_holds_others_until_closed(spark, tmp_path):
    kind = "problem_id string, technique string, run_index int, normalized_output string"
    source, sink, checkpoint = (str(tmp_path / x) for x in ("runs", "sink", "check"))
    ev.use_rocksdb(spark)

    def arrive(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        ev.run_available(ev.running_consistency(spark.readStream.schema(kind).parquet(source)), sink, checkpoint)
        return sorted((r.problem_id, r.run_index, r.runs_used, r.matching_runs, r.late) for r in spark.read.parquet(sink).collect())

    assert arrive(("p", "t", 1, "a"), ("p", "t", 3, "a"), ("p", "t", 4, "b")) == [("p", 1, 1, 1, False)]
    assert arrive(("q", "t", 1, "z"), ("p", "t", None, None)) == [("p", 1, 1, 1, False), ("p", 3, 2, 2, False), ("p", 4, 3, 2, False), ("q", 1, 1, 1, False)]
    assert ("p", 2, 4, 2, True) in arrive(("p", "t", 2, "b"))


def test_history_from_stream(spark, tmp_path):
    source = str(tmp_path / "h")
    kind = "domain string, difficulty string, problem_id string, winner_technique string, updated int"
    path = str(tmp_path / "store")
    for number, rows in enumerate(([("a", "b", "p1", "x", 1), ("a", "b", "p2", "x", 1)], [("a", "b", "p3", "y", 2), ("a", "b", "p1", "y", 2)])):
        # each with a checkpoint of its own, so both write a batch 0
        spark.createDataFrame(rows, kind).write.parquet(f"{source}{number}")
        ev.history_from_stream(spark.readStream.schema(kind).parquet(f"{source}{number}"), path, str(tmp_path / f"c{number}"))
    assert {r.problem_id: r.winner_technique for r in st.read_history(spark, path).collect()} == {"p1": "y", "p2": "x", "p3": "y"}


def test_assembled_stream_with_watermark(spark, tmp_path):
    base = "2024-01-01 00:0"
    lines = [{"session": s, "seq": k, "type": t, "technique": "t", "run_index": 1, "content": c, "ts": f"{base}{m}:00", "prompt_eval_count": 1, "eval_count": 2}
             for s, k, t, c, m in (("s", 2, "token", "lo", 1), ("s", 1, "token", "hel", 0), ("s", 3, "done", None, 1), ("z", 1, "token", "late", 9))]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in lines), encoding="utf-8")
    runs = ev.assemble_responses(ev.read_events_stream(spark, str(tmp_path)), ["session", "technique", "run_index"], delay="2 minutes")
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "check")
    ev.run_available(runs, sink, checkpoint)
    assert [(r.session, r.response, r.total_tokens) for r in spark.read.parquet(sink).collect()] == [("s", "hello", 3)]


def test_token_state_for_any_arrival(spark, tmp_path):
    """Tokens in any order over several batches, some behind ``done``, give the rows of the batch form, once each."""
    rng = random.Random(4)
    events = []
    for run in range(6):
        texts = [rng.choice(["a", "b ", "é", "", None]) for _ in range(rng.randrange(1, 9))]
        events += [("s", run, k, "token", c, None, None, None, 10 + rng.randrange(50)) for k, c in enumerate(texts)]
        if run != 2:  # one run never ends
            events.append(("s", run, 99, "done", None, rng.choice([None, "length"]), 3, rng.choice([None, 5]), 10 + rng.randrange(50)))
    rng.shuffle(events)
    schema = "session string, run_index int, seq long, type string, content string, done_reason string, prompt_eval_count long, eval_count long, at int"
    source = str(tmp_path / "events")

    def stored(rows):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(source)
        return df

    parts = [stored(events[:20]), stored(events[20:])]
    stored([("z", 0, 0, "token", "later", None, None, None, 100_000)])
    keys = ["session", "run_index"]
    ev.use_rocksdb(spark)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "check")
    ev.run_available(ev.stream_responses(stream, keys), sink, checkpoint)
    want = ev.assemble_responses(parts[0].unionByName(parts[1]), keys)
    got = spark.read.parquet(sink).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 5


class FakeState:
    """A value, map and timers in one process, which counts the calls that would leave it."""

    def __init__(self):
        self.value, self.rows, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.fired


def test_examples_of_a_bucket_share_one_state():
    """A thousand examples cost a few state calls; each starts once, ends at its latest end, and may start again."""
    state = FakeState()
    bucket = ev._ExpiringExamples()
    bucket.init(state)
    came = pd.DataFrame({"example_id": [i % 1000 for i in range(2000)], "expires_ms": [5000 + i for i in range(2000)]})
    added = pd.concat(bucket.handleInputRows((1,), iter([came[:700], came[700:]]), state))
    assert sorted(added["example_id"]) == list(range(1000)) and set(added["state"]) == {"added"}
    assert state.calls <= 4 and state.timers == {6000}
    assert list(bucket.handleInputRows((1,), iter([pd.DataFrame({"example_id": [0, 1], "expires_ms": [9000, 100]})]), state)) == []
    assert state.timers == {6001}
    state.watermark, state.fired = 6100, 6001
    state.timers.discard(6001)
    over = pd.concat(bucket.handleExpiredTimer((1,), state, state))
    assert list(zip(over["example_id"], over["expires_ms"], strict=True)) == [(i, 6000 + i) for i in range(1, 100)] and set(over["state"]) == {"expired"}
    assert state.timers == {6100}
    again = pd.concat(bucket.handleInputRows((1,), iter([pd.DataFrame({"example_id": [5], "expires_ms": [9500]})]), state))
    assert again["example_id"].tolist() == [5]


def test_few_answers_are_one_state_value():
    """Twenty runs of a key in any order cost two state calls and equal plain counting."""
    state = FakeState()
    step = ev._RunningConsistency()
    step.init(state)
    answers = [f"num:{i % 3}" if i % 4 else None for i in range(20)]
    order = sorted(range(20), key=lambda i: i * 7 % 20)
    frame = pd.DataFrame({"run_index": [i + 1 for i in order], "normalized_output": [answers[i] for i in order]})
    made = pd.concat(step.handleInputRows(("p", "t"), iter([frame]), None))
    best = [max(answers[: i + 1].count(a) for a in set(answers[: i + 1])) for i in range(20)]
    assert made["run_index"].tolist() == list(range(1, 21)) and made["matching_runs"].tolist() == best
    assert state.calls == 2
