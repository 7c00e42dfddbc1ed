import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import mixing


def water(sizes: dict, most=3) -> dict:
    """sizes by source, in order of weight: reshare the excess until no target is above its limit."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, weight = total - sum(fixed.values()), sum(weights[s] for s in sizes if s not in fixed)
        targets = fixed | {s: rest * weights[s] / weight for s in sizes if s not in fixed}
        over = [s for s in sizes if s not in fixed and targets[s] > most * sizes[s]]
        if not over:
            return targets
        fixed |= {s: most * sizes[s] for s in over}


def test_points_and_ranks(spark):
    bits, low, width = 9, 100, 177
    rows = spark.range(1 << bits).withColumn("p", mixing.point(F.col("id"), bits)).withColumn("r", mixing.rank(F.col("id"), F.col("p"), F.lit(low), F.lit(width), bits))
    rows = rows.orderBy("id").collect()
    assert [r["p"] for r in rows] == [int(format(i, f"0{bits}b")[::-1], 2) for i in range(1 << bits)]
    seen = 0
    for r in rows:
        if low <= r["p"] < low + width:
            assert r["r"] == seen
            seen += 1


@pytest.mark.parametrize("seed", [0, 5])
def test_mix(docs_of, seed):
    rows = [(i, "w " * (i % 50 * 3), "en", ["a", "bb", "B", "é", None, "tiny"][i % 5 if i % 97 else 5]) for i in range(900)]
    rows += [(2000, "w\x0b" * 9000, "en", "a"), (2001, None, "en", "a"), (2002, "", "en", "zero"), (None, "x y", "en", "a"), (5, rows[5][1], "en", "a")]
    out = mixing.Mix(docs_of(rows, extra=True), seed).taken().collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water({s: sizes[s] for s in order})
    got, taken = {}, defaultdict(int)
    for r in out:
        source = r["src"][1:] if r["src"][0] == "0" else None
        assert r["source_size"] == sizes[source] and 0 <= r["taken"] <= 3 * r["size"]
        got[source] = r["target"]
        taken[source] += r["taken"]
    assert len(out) == len(rows)
    for s, t in want.items():
        assert got[s] == pytest.approx(t) and abs(taken[s] - t) <= 1


def test_pieces_are_whole_and_reruns_agree(docs_of):
    df = docs_of([(i, "a b c " * (i + 1), "en", "ab"[i % 2]) for i in range(40)])
    mix = mixing.Mix(df)
    words = {(r["src"], r["start"]): r["size"] for r in mix.line.collect()}
    pieces = mix.pieces().collect()
    assert all(0 <= p["from_word"] < p["to_word"] <= words[p["src"], p["start"]] for p in pieces)
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, mixing.Mix(df).pieces().collect()))
    # evenly spread: after any number of slots each source has about its share
    order, total = [r["src"] for r in mix.slots.orderBy("slot").collect()], Counter()
    share = {s: n / len(order) for s, n in Counter(order).items()}
    for k, s in enumerate(order, 1):
        total[s] += 1
        assert all(abs(total[x] - k * share[x]) <= 4 for x in share)


def test_empty_and_wordless(docs_of):
    assert mixing.Mix(docs_of([(1, "x")]).limit(0)).taken().count() == 0
    assert [(r["taken"], r["target"]) for r in mixing.Mix(docs_of([(1, None), (2, " ")])).taken().collect()] == [(0, 0.0)] * 2
