import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of, same

FAST = [
    "w3_greedy_winner", "q21_overall_weights", "t1_history_features", "t9_intent", "a9_domain_ranking", "p12_p16_detection_text", "q8_q12_accuracy",
    "a2_last_response", "a4_failed_rows", "a12_metric_rollup", "b7_j9_added_examples", "d2_preselection", "d3_after_run_selection", "p22_run_level_truth",
    "r2_streamed_responses", "r4_r7_history_from_stream", "s10_two_writers", "s12_partition_scan", "s19_event_files", "s8_user_bank_from_files", "u2_w5_distinct_texts", "x1_custom_scorer",
]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"problem_id", "best_technique", "best_overall", "any_success"}


def test_every_query_has_sql():
    own = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, sf)
    cursor = db.execute(entry.oracle_sql()[name])
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == want_columns and len(rows) == len(want)
    assert all(same(x, y) for a, b in zip(rows, want) for x, y in zip(a, b))
