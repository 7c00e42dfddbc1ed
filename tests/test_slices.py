import json
import os
import random

import pytest

from gaugeline.session import scratch_path
from gaugeline.sources import problems as sp
from gaugeline.sources import slices as sl

WORDS = ["x", "\\frac{1}{2}", 'say "hi"', "[0, 1)", "}{", "\\", "é}", "", "a\nb", "} ] {", "true", '"'] + ["long " * 40]


def _record(rng):
    return {
        "problem": " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))), "answer": rng.choice(WORDS + ["7"]),
        "meta": rng.choice([None, {"deep": [{"a": "}"}, [1.5e3, True, None]]}, {}, [{}]]), "category": rng.choice([None, "c}"]),
    }


def _document(rng):
    some = lambda: [_record(rng) for _ in range(rng.randrange(12))] + rng.choice([[], [5, "x}"]])
    return rng.choice([
        some,
        lambda: {rng.choice(["k", "Group } A", 'q"', "\\"]) + str(i): some() for i in range(3)},
        lambda: {f"o}}{i}": {f"i{{{j}": some() for j in range(2)} for i in range(2)},
        lambda: {"note": "x", "list": some(), "n": 3, "by": {"hard": some(), "z": "}", "no": {"list": some()}}},
        lambda: rng.choice([5, "}", {}, [], None, [[_record(rng)]]]),
    ])()


def _written(spark, texts):
    folder = scratch_path(spark, "json").removeprefix("file:")
    os.makedirs(folder)
    for n, text in enumerate(texts):
        with open(f"{folder}/{n:03d}.json", "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def _wanted(value):
    """(outer, inner, record) of every record, by the plain rule."""
    if isinstance(value, list):
        return [(None, None, r) for r in value if isinstance(r, dict)]
    made = []
    for outer, v in value.items() if isinstance(value, dict) else ():
        for inner, rows in {None: v}.items() if isinstance(v, list) else v.items() if isinstance(v, dict) else ():
            made += [(outer, inner, r) for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return made


@pytest.mark.parametrize("size", [1, 5000])
def test_slices_of_any_size(spark, size):
    rng = random.Random(size)
    values = [_document(rng) for _ in range(12)]
    style = lambda: rng.choice([{}, {"indent": 1}, {"ensure_ascii": False}])
    folder = _written(spark, [rng.choice(["", "\ufeff", " \n"]) + json.dumps(v, **style()) + rng.choice(["", "\n", " "]) for v in values])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    total = sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size + total // 40))  # every split is a task
    try:
        rows = sl.read_items(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for n, value in enumerate(values):
        got = sorted((r for r in rows if r.file.endswith(f"{n:03d}.json")), key=lambda r: r.pos)
        assert [(r.outer_key, r.inner_key, json.loads(r.item)) for r in got] == _wanted(value), value


def test_every_border(spark):
    """The same tasks without Spark: each document is cut at every place where a brace ends."""
    import pandas as pd

    rng = random.Random(1)
    for _ in range(150):
        value = _document(rng)
        text = json.dumps(value, ensure_ascii=False) + rng.choice(["", "\n"])
        pieces = text.split("}")
        if pieces[-1] == "":
            pieces.pop()
        starts, at, start = [], 0, 0
        for p in pieces:
            if rng.random() < 0.5:
                start = at
            starts.append(start)
            at += len(p.encode()) + 1
        frame = pd.DataFrame({"file": "f", "start": starts, "value": pieces})
        batches = [frame.iloc[i : i + 3] for i in range(0, len(frame), 3)]
        states = sl._states(pd.concat(sl._changes(iter(batches))))
        assert states["valid"].all()
        merged = frame.merge(states, on=["file", "start"])
        out = pd.concat(sl._pieces(merged.iloc[i : i + 2] for i in range(0, len(merged), 2)))
        got = [
            (part["outer_key"].iloc[0], part["inner_key"].iloc[0], json.loads("".join(part.sort_values("part")["text"])))
            for _, part in out.groupby("pos")
        ]
        assert [tuple(None if pd.isna(k) else k for k in g[:2]) + g[2:] for g in got] == _wanted(value)


def test_broken_documents_give_no_rows(spark):
    good = '[{"problem": "p", "answer": "1"}]'
    texts = ["", good, good[:-1], good[:-3], '[{"problem": "p", "answer": "1"]}', "{]", '["', "plain } text", '{"a": [{"problem": "p", "answer": "1"}]', '{"k": [{"problem": "q", "answer": "2"}]}\n']
    folder = _written(spark, texts)
    got = sp.read_problems(spark, folder, sliced=True).collect()
    assert sorted((r.file[-8:], r.problem, r.category) for r in got) == [("001.json", "p", "general"), ("008.json", "p", "a"), ("009.json", "q", "k")]
    with_text = sp.read_examples(spark, folder, sliced=True).collect()
    assert sorted((r.subject, r.problem) for r in with_text) == [("a", "p"), ("k", "q")]


def test_one_document_gives_several_tasks(spark):
    records = [{"problem": f"p{i} \\frac{{{i}}}{{2}}", "answer": str(i)} for i in range(4000)]
    folder = _written(spark, [json.dumps({"algebra": {"easy": records}})])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = spark.read.option("lineSep", "}").text(folder)
        assert found.rdd.getNumPartitions() > 5
        sliced, whole = sp.read_problems(spark, folder, sliced=True).collect(), sp.read_problems(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    text = lambda r: (r.problem, r.answer, r.category, r.difficulty)
    assert [text(r) for r in sorted(sliced, key=lambda r: r.pos)] == [text(r) for r in sorted(whole, key=lambda r: r.pos)]
