import pathlib
import random

from gaugeline.operators import history as hs
from gaugeline.session import scratch_path
from gaugeline.sources import history_store as st
from gaugeline.sources import history_totals as ht

PROBLEM = "domain string, difficulty string, problem_id string, winner_technique string, has_ground_truth boolean, updated int"
SCORE = "domain string, difficulty string, problem_id string, technique string, overall double, updated int"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _agree(spark, problems, scores, ledger):
    """Rankings and coverage from the totals equal the full scan."""
    p, s = st.read_history(spark, problems), st.read_history(spark, scores, key=st.SCORE_KEY)
    totals = ht.read_totals(spark, ledger)
    for settings in ({}, {"techniques": ["a", "b"], "require_ground_truth": True}, {"require_ground_truth": True, "allow_unknown": True}):
        want = hs.domain_ranking(p, s, **settings)
        assert _rows(hs.ranking_from_totals(totals, **settings).select(*want.columns)) == _rows(want), settings
    want = hs.coverage(p, s)
    assert _rows(hs.coverage_from_totals(totals).select(*want.columns)) == _rows(want)


def test_totals_follow_updates(spark):
    rng = random.Random(5)
    problems, scores, ledger = (scratch_path(spark, n) for n in ("p", "s", "ledger"))

    def upsert(writer, batch, size, updated):
        keys = [("d" + rng.choice("xy"), "basic", f"p{rng.randrange(25)}") for _ in range(size)]
        p = [(*k, rng.choice(["a", "b", "c", None]), rng.choice([True, False, None]), updated) for k in keys]
        # scores of other problems too, some without a problem or a value
        s = [(k[0], k[1], f"p{rng.randrange(35)}", t, rng.choice([None, 0.1, 0.25, 0.7]), updated) for k in keys for t in "abc"]
        st.upsert_history(spark.createDataFrame(p, PROBLEM), problems, writer, batch, st.KEY)
        st.upsert_history(spark.createDataFrame(s, SCORE), scores, writer, batch, st.SCORE_KEY)

    assert ht.read_totals(spark, ledger).count() == 0
    upsert("one", 0, 20, 1)
    assert ht.advance_totals(spark, problems, scores, ledger) == 1
    _agree(spark, problems, scores, ledger)
    assert ht.advance_totals(spark, problems, scores, ledger) == 1  # nothing new
    upsert("one", 1, 10, 3)
    upsert("two", 0, 10, 2)  # partly older than what is stored
    assert ht.advance_totals(spark, problems, scores, ledger) == 2
    _agree(spark, problems, scores, ledger)


def test_totals_survive_failed_calls(spark):
    problems, scores, ledger = (scratch_path(spark, n) for n in ("p", "s", "ledger"))
    p = spark.createDataFrame([("d", "b", "p1", "a", True, 1)], PROBLEM)
    s = spark.createDataFrame([("d", "b", "p1", "a", 0.5, 1)], SCORE)
    st.upsert_history(p, problems, "w", 0)
    st.upsert_history(s, scores, "w", 0, st.SCORE_KEY)
    # deltas of a call that died before its list of batches was stored do not count
    lost = spark.createDataFrame([("d", "b", "a", "yes", 9, 9, 9, "1")], "domain string, difficulty string, technique string, truth string, samples long, tested long, problems long, s string")
    lost.selectExpr("domain", "difficulty", "technique", "truth", "cast(s as decimal(38,10)) score_sum", "samples", "tested", "problems").write.parquet(f"{ledger}/deltas/generation=1")
    assert ht.read_totals(spark, ledger).count() == 0
    ht.advance_totals(spark, problems, scores, ledger)
    _agree(spark, problems, scores, ledger)
    # a batch that is still being written is left for the next call
    st.upsert_history(p.replace("a", "b", ["winner_technique"]).replace(1, 2, ["updated"]), problems, "v", 7)
    done = pathlib.Path(problems.removeprefix("file:")) / "writer=by-v" / "batch=7" / "_SUCCESS"
    done.rename(done.with_name("_later"))
    assert ht.advance_totals(spark, problems, scores, ledger) == 1
    done.with_name("_later").rename(done)
    assert ht.advance_totals(spark, problems, scores, ledger) == 2
    _agree(spark, problems, scores, ledger)
