import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import lexicon as lx
from gaugeline.operators import retrieval as rv
from gaugeline.operators import similarity as sm
from gaugeline.operators import tagging as tg


def brute_force(spark, targets, docs, rules="history"):
    """Every pair scored on its own, from the pair functions alone."""
    from gaugeline.functions import pairs as pr
    from gaugeline.functions import text as tx

    stop = lx.STOP_WORDS_HISTORY if rules == "history" else lx.STOP_WORDS_BANK

    def made(df, side):
        tagged = tg.with_feature_tags(df, "problem", rules, "tags").withColumn("tokens", tx.tokens(F.col("problem"), stop))
        return tagged.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "tags", "type_key", "tokens")])

    both = made(targets, "a").join(made(docs, "b"))
    keys = [F.col(c) for c in ("a_tags", "b_tags", "a_type_key", "b_type_key")]
    score = pr.hybrid(pr.jaccard(F.col("a_tokens"), F.col("b_tokens")), pr.feature_similarity(*keys), pr.type_mismatch(*keys))
    return {(r.a_id, r.b_id): r.s for r in both.select("a_id", "b_id", score.alias("s")).collect()}


def problems(n, seed):
    rng = random.Random(seed)
    forms = [
        lambda: f"Solve for x: {rng.randint(1, 9)}x + {rng.randint(1, 9)} = {rng.randint(1, 30)}.",
        lambda: f"Solve x^2 - {rng.randint(1, 9)}x = {rng.randint(1, 9)}",
        lambda: f"Tell me about {rng.choice(['red', 'green', 'blue'])} {rng.choice(['ships', 'birds'])}",
        lambda: f"A coin is flipped {rng.randint(1, 5)} times. What is the probability of {rng.randint(1, 3)} heads?",
        lambda: "the of and",
    ]
    return [(i, forms[rng.randrange(len(forms))]()) for i in range(n)]


@pytest.mark.parametrize("parts", [(1024, 2048), (7, 11)])
def test_matching_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(sm, "TARGETS", parts[0])
    monkeypatch.setattr(sm, "DOCUMENTS", parts[1])
    docs = problems(60, 1) + [(100 + i, "Solve for x: 2x + 3 = 7.") for i in range(20)]  # a hot group of copies
    df = spark.createDataFrame(docs, "id int, problem string")
    base = brute_force(spark, df, df)
    overall = {i: (i * 7 % 11) / 10 for i, _ in docs}
    table = df.select(F.col("id").alias("doc_id"), F.lit("d").alias("domain"), F.lit("b").alias("difficulty"), "problem", F.lit("t").alias("winner_technique"))
    scores = spark.createDataFrame([(i, "t", overall[i]) for i, _ in docs], "doc_id int, technique string, overall double")
    targets = table.select(F.col("doc_id").alias("target_id"), "domain", "difficulty", "problem")
    found = sm.match_history(targets, table, scores).persist()
    summary = {r.target_id: r for r in sm.match_summary(found).collect()}
    ranking = {r.target_id: r for r in sm.profile_ranking(found).collect()}
    for t, _ in docs:
        near = {b: s for (a, b), s in base.items() if a == t}
        seen = sum(s >= 0.2 for s in near.values())
        limit = 0.60 if seen > 15 else 0.55
        hits = {b: s for b, s in near.items() if s >= limit}
        got = summary[t]
        assert (got.preliminary_count, got.threshold, got.matched_documents) == (seen, limit, len(hits))
        if hits:
            mean = sum(overall[b] * s for b, s in hits.items()) / sum(hits.values())
            assert ranking[t].average_overall == pytest.approx(mean, abs=1e-4)
            assert ranking[t].samples == len(hits)
    found.unpersist()


def vectored_problems(n, seed):
    rng = random.Random(seed)
    own = [(i, t, None if i % 4 == 0 else [0.0, 0.0, 0.0] if i % 9 == 1 else [rng.uniform(-1, 1) for _ in range(3)]) for i, t in problems(n, seed)]
    return own + [(200 + i, f"Solve for x: 2x + 3 = {i % 3}, case{i % 7} word{i // 2}", None) for i in range(20)]


@pytest.mark.parametrize("rare", [0, 1, 3, 10**6])
@pytest.mark.parametrize("vectors", [False, True])
def test_forms_and_skeletons_equal_brute_force(spark, monkeypatch, rare, vectors):
    """Whatever counts as rare, with and without vectors, in two blocks, with several techniques and single scores."""
    monkeypatch.setattr(sm, "RARE", rare)
    rows = vectored_problems(50, 11)
    df = spark.createDataFrame(rows, "id int, problem string, embedding array<double>")
    docs = df.select(
        F.col("id").alias("doc_id"), F.lit("d").alias("domain"), (F.col("id") % 2).cast("string").alias("difficulty"), "problem",
        F.expr("case when id % 3 = 0 then 't' when id % 3 = 1 then 'u' end").alias("winner_technique"), *(["embedding"] if vectors else []),
    )
    overall = {(i, t): (i * 7 % 11) / 10 for i, _, _ in rows for t in ("t", "u") if (i + (t == "u")) % 5}
    scored = spark.createDataFrame([(i, t, x) for (i, t), x in overall.items()], "doc_id int, technique string, overall double")
    targets = docs.select(F.col("doc_id").alias("target_id"), "domain", "difficulty", "problem", *(["embedding"] if vectors else []))
    whole = sm.prepare(df if vectors else df.drop("embedding"), "problem")
    made = whole.select("id", *sm._hashed(whole)).toPandas()
    score = sm.scores(made, made)
    place = {i: k for k, i in enumerate(made["id"])}
    found = sm.match_history(targets, docs, scored).collect()
    singles = sm.match_history(targets, docs, scored, by_score=True).where("score is not null").collect()
    for t in place:
        near = {d: score[place[t], place[d]] for d in place if d % 2 == t % 2}
        seen = sum(s >= 0.2 for s in near.values())
        hits = {d: s for d, s in near.items() if s >= (0.60 if seen > 15 else 0.55)}
        got = {r.technique: r for r in found if r.target_id == t}
        own = got.get(None)
        assert max((r.preliminary_count for r in got.values()), default=0) == seen
        assert (own.docs if own else 0) == len(hits)
        for technique in ("t", "u"):
            values = [(overall[d, technique], s) for d, s in hits.items() if (d, technique) in overall]
            wins = sum((d % 3 == 0) if technique == "t" else (d % 3 == 1) for d in hits)
            r = got.get(technique)
            assert ((r.n or 0, r.wins or 0) if r else (0, 0)) == (len(values), wins)
            if values:
                assert float(r.weighted_total) == pytest.approx(sum(v * s for v, s in values), abs=1e-6)
                assert float(r.squares) == pytest.approx(sum(v * v for v, _ in values), abs=1e-6)
                counted = {x.score: x.n for x in singles if x.target_id == t and x.technique == technique}
                assert counted == {v: sum(w == v for w, _ in values) for v in {v for v, _ in values}}


def test_match_work_grows_with_the_rows(spark):
    """Ten times the rows from the same templates: pairs of rows grow a hundredfold, what is compared far less."""
    work = []
    for n in (100, 1000):
        df = spark.range(n).selectExpr("cast(id as int) doc_id", "'d' domain", "'b' difficulty", "concat('Solve for x: ', id % 5, 'x + ', id % 7, ' = row', id) problem", "'t' winner_technique")
        scored = spark.createDataFrame([(0, "t", 0.5)], "doc_id int, technique string, overall double")
        work.append(sm.match_work(df.selectExpr("doc_id target_id", "domain", "difficulty", "problem"), df, scored))
    small, large = work
    assert large["pairs_of_rows"] == 100 * small["pairs_of_rows"]
    assert large["pairs_of_skeletons"] + large["met_forms"] <= 20 * (small["pairs_of_skeletons"] + small["met_forms"])


def test_best_asks_for_few_groups(spark, monkeypatch):
    rows = vectored_problems(300, 4)
    made = sm.prepare(spark.createDataFrame(rows, "id int, problem string, embedding array<double>"), "problem")
    for whole in (made, made.drop("embedding")):
        table = whole.select("id", *sm._hashed(whole)).toPandas()
        full, asked = sm.scores, []
        monkeypatch.setattr(sm, "scores", lambda a, b: (asked.append(len(a) * len(b)), full(a, b))[1])
        place, score = sm.best(table, table, 3, lambda x, y: np.equal(x[:, None], y[None]))
        monkeypatch.setattr(sm, "scores", full)
        every = full(table, table)
        np.fill_diagonal(every, -1.0)
        want = np.argsort(-every, axis=1, kind="stable")[:, :3]
        assert (place == want).all() and score == pytest.approx(np.take_along_axis(every, want, 1))
        if "embedding" not in whole.columns:
            assert sum(asked) < 0.5 * len(table) ** 2


def test_array_scores_equal_the_pair_functions(spark):
    """With vectors, without, and with vectors on one side only."""
    from gaugeline.functions import pairs as pr

    rng = random.Random(8)
    texts = problems(25, 9)
    rows = [(i, t, None if i % 4 == 0 else [0.0, 0.0, 0.0] if i % 9 == 1 else [rng.uniform(-1, 1) for _ in range(3)]) for i, t in texts]
    made = sm.prepare(spark.createDataFrame(rows, "id int, problem string, embedding array<double>"), "problem").orderBy("id")
    whole = made.select("id", *sm._hashed(made)).toPandas()
    got = sm.scores(whole, whole)
    tags = lambda c: F.array_remove(F.split(c, ","), "")
    a = made.select(*[F.col(c).alias("a_" + c) for c in ("id", "tag_key", "type_key", "tokens", "embedding")])
    b = made.select(*[F.col(c).alias("b_" + c) for c in ("id", "tag_key", "type_key", "tokens", "embedding")])
    keys = (tags("a_tag_key"), tags("b_tag_key"), F.col("a_type_key"), F.col("b_type_key"))
    cosine = F.when(F.col("a_embedding").isNotNull() & F.col("b_embedding").isNotNull(), pr.cosine(F.col("a_embedding"), F.col("b_embedding")))
    score = pr.hybrid(pr.jaccard(F.col("a_tokens"), F.col("b_tokens")), pr.feature_similarity(*keys), pr.type_mismatch(*keys), cosine)
    place = {i: k for k, i in enumerate(whole["id"])}
    for r in a.join(b).select("a_id", "b_id", score.alias("s")).collect():
        assert got[place[r.a_id], place[r.b_id]] == pytest.approx(r.s, abs=1e-12)


def test_respect_min_similarity(spark):
    df = spark.createDataFrame(problems(30, 3), "id int, problem string")
    table = df.select(F.col("id").alias("doc_id"), F.lit("d").alias("domain"), F.lit("b").alias("difficulty"), "problem", F.lit(None).cast("string").alias("winner_technique"))
    scores = spark.createDataFrame([(0, "t", 0.5)], "doc_id int, technique string, overall double")
    targets = table.select(F.col("doc_id").alias("target_id"), "domain", "difficulty", "problem")
    rows = sm.match_summary(sm.match_history(targets, table, scores, min_similarity=0.9, respect_min=True)).collect()
    assert all(r.threshold == 0.9 for r in rows)


@pytest.mark.parametrize("parts", [(1024, 2048), (7, 11)])
def test_nearest_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(sm, "TARGETS", parts[0])
    monkeypatch.setattr(sm, "DOCUMENTS", parts[1])
    docs = problems(80, 5) + [(200 + i, "Solve for x: 2x + 3 = 7.") for i in range(30)]
    df = spark.createDataFrame(docs, "id int, problem string")
    base = brute_force(spark, df, df, "bank")
    texts = dict(docs)
    bank = sm.prepare(df.select(F.col("id").alias("doc_id"), F.col("id").alias("pos"), F.col("problem").alias("canonical"), "problem", F.lit("").alias("signature"), F.lit("g").alias("b_group")), "problem", "bank")
    goals = sm.prepare(df.select(F.col("id").alias("target_key"), F.col("problem").alias("canonical"), "problem", F.lit("").alias("signature"), F.lit("g").alias("a_group"), F.lit(True).alias("skip_identical"), F.lit(False).alias("match_signature")), "problem", "bank")
    got = {}
    for r in sm.nearest(goals, bank, None, 4).collect():
        got.setdefault(r.target_key, []).append((r.place, r.doc_id, round(r.similarity, 9)))
    for t, text in docs:
        near = sorted((-round(s, 12), b) for (a, b), s in base.items() if a == t and texts[b] != text)
        assert [(d, s) for _, d, s in sorted(got[t])] == [(b, round(-s, 9)) for s, b in near[:4]]


TARGETS = [
    ("Solve for x: 4x + 8 = 20.", "algebra", ["Solve for y: 4y + 8 = 20.", "Solve for y: y^2 - 9 = 0."], "Solve for y: 4y + 8 = 20."),
    ("A coin is flipped 7 times. What is the probability of exactly 3 heads?", "counting-probability",
     ["A coin is flipped 5 times. What is the probability of exactly 2 heads?", "A coin is flipped 5 times. What is the probability of at least 2 heads?"],
     "A coin is flipped 5 times. What is the probability of exactly 2 heads?"),
    ("What is the tens digit of 6! + 7! + 8! + ... + 200!?", "counting-probability",
     ["What is the smallest power of 7 that ends in 1?", "What is the tens digit of 7! + 8! + 9! + ... + 400!?"], "What is the tens digit of 7! + 8! + 9! + ... + 400!?"),
    ("Find the derivative of f(x) = x^3 + x.", "pre-calculus", ["Find the derivative of f(t) = sin(t).", "Find the derivative of f(t) = t^3 + t."], "Find the derivative of f(t) = t^3 + t."),
    ("Solve for x: x+7=18", "algebra", ["Solve for x: x + 7 = 18.", "Solve for y: y + 7 = 18."], "Solve for y: y + 7 = 18."),
    ("Solve for x: x + 7 = 18", "algebra", ["Solve for y: 5^y + 4 = 125^y."], None),
]


@pytest.mark.parametrize("target,subject,bank,chosen", TARGETS)
def test_golden_choices(spark, target, subject, bank, chosen):
    rows = [(i, i, subject, p, "work") for i, p in enumerate(bank)]
    examples = spark.createDataFrame(rows, "example_id int, pos int, subject string, problem string, solution string")
    goals = spark.createDataFrame([(1, target, subject)], "target_id int, problem string, requested string")
    decisions, used = rv.few_shot(goals, examples, min_examples=1, max_examples=1, medium_examples=1, hard_examples=1)
    got = [r.example for r in used.orderBy("rank").collect()]
    assert got == ([chosen] if chosen else [])
    assert (decisions.first().error is None) == (chosen is not None)


def test_types_and_constraints_narrow_the_pool(spark):
    rows = [
        (0, 0, "algebra", "Find all real solutions of x^2 - 5x + 6 = 0", "s", "real_root", ["real solution"]),
        (1, 1, "algebra", "Find all real solutions of x^2 - 7x + 6 = 0 with positive roots", "s", "real_root", ["positive value"]),
        (2, 2, "algebra", "Find all positive real solutions of x^2 - 8x + 7 = 0 please", "s", "real_root", ["positive value"]),
        (3, 3, "algebra", "Expand (x + 1)(x + 2)", "s", "expand", None),
    ]
    bank = spark.createDataFrame(rows, "example_id int, pos int, subject string, problem string, solution string, type string, constraints array<string>")
    goals = spark.createDataFrame([(1, "Find all real solutions of x^2 - 9x + 8 = 0, the positive roots only", "algebra")], "target_id int, problem string, requested string")
    _, used = rv.few_shot(goals, bank)
    # the target asks for real_solutions and positive_values: every typed example overlaps with one of them
    assert {r.example_id for r in used.collect()} <= {0, 1, 2}
    assert used.count() == 2


def family(intent):
    return next((f for f, members in lx.INTENT_FAMILIES.items() if intent in members), intent)


def pool_of(t, bank, least):
    """The cascade for one problem over single examples: (examples, match_signature, priority), or None."""
    members = {n: set(lx.INTENT_FAMILIES[n]) for n in ("equation", "probability", "counting")}
    own = [e for e in bank if e["subject"] == t["subject"]]

    def fits(e):
        kind, typed = t["kind"], e["ex_type"]
        same = any(typed in m and kind in m for m in members.values())
        by_text = not any(typed in m for m in members.values()) and (e["ex_intent"] == kind or (e["ex_intent"] in members["equation"] and kind in members["equation"]))
        return typed != "" and (typed == kind or same or by_text or (kind == "ratio_proportion" and e["ex_rate"]))

    pool = own
    if any(e["ex_type"] for e in own) and t["kind"] != "general" and (any(map(fits, own)) or t["strict"]):
        pool = [e for e in pool if fits(e)]
    if t["strict"]:
        pool = [e for e in pool if family(e["ex_intent"]) == family(t["intent"])]
        if t["intent"] in rv.EQUATIONS and t["family"]:
            pool = [e for e in pool if e["ex_family"] == t["family"]]
    close = [e for e in pool if e["signature"] == t["signature"] and e["canonical"] != t["canonical"]]
    match = t["strict"] and len(close) >= least
    left = close if match else [e for e in pool if e["canonical"] != t["canonical"]] if t["strict"] else pool
    # an example stands for its group of equal labels
    groups = {e["b_group"] for e in left}
    labels = {e["b_group"]: e for e in own}
    met = {g for g in groups if set(filter(None, t["limits"].split(","))) & set(filter(None, labels[g]["ex_constraints"].split(",")))}
    groups = met or groups
    if not groups and not t["strict"]:
        groups = set(labels)
    if not groups:
        return None
    teaching = {g for g in groups if t["conditional"] and labels[g]["ex_conditional"]}
    real = {g for g in groups if t["intent"] == "real_solutions" == labels[g]["ex_intent"]}
    return teaching or real or groups, match, bool(teaching or real)


def test_cascade_equals_brute_force(spark):
    rng = random.Random(6)
    intents = ["solve_equation", "real_solutions", "general", "probability", "counting", "ratio_proportion", "derivative"]
    bank = []
    for _ in range(120):
        e = {
            "subject": rng.choice(["algebra", "other"]), "ex_type": rng.choice(["", "", *intents]), "ex_intent": rng.choice(intents), "ex_family": rng.choice(["", "linear"]), "ex_rate": rng.random() < 0.3,
            "ex_conditional": rng.random() < 0.2, "ex_constraints": rng.choice(["", "a", "a,b"]), "signature": rng.choice("pqr"), "canonical": f"c{rng.randrange(9)}",
        }
        bank.append(e | {"b_group": "\u0001".join(str(e[c]).lower() if isinstance(e[c], bool) else e[c] for c in rv.LABELS)})
    targets = [
        {"subject": rng.choice(["algebra", "other", "none"]), "kind": rng.choice(intents), "intent": rng.choice(intents), "strict": rng.random() < 0.6, "family": rng.choice(["", "linear"]), "limits": rng.choice(["", "a", "b,c"]),
         "conditional": rng.random() < 0.3, "signature": rng.choice("pqrs"), "canonical": f"c{rng.randrange(12)}"}
        for _ in range(200)
    ]
    kinds = lambda row: ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in row.items())
    for size in (120, 8):
        made = spark.createDataFrame([tuple(e.values()) for e in bank[:size]], kinds(bank[0]))
        asked = spark.createDataFrame([tuple(t.values()) for t in targets], kinds(targets[0]))
        links, pools = rv._links(asked, made, 2)
        meets = {}
        for r in pools.collect():
            meets.setdefault(r.a_group, set()).add(r.b_group)
        named = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in rv.FORM])
        keyed = asked.withColumn("link_text", F.md5(F.concat_ws("\u0001", named, "signature", "canonical").cast("binary"))).distinct()
        got = {tuple(str(r[c]) for c in targets[0]): (meets[r.a_group], r.match_signature, r.priority) for r in keyed.join(links, "link_text").collect()}
        want = {tuple(str(v) for v in t.values()): p for t in targets if (p := pool_of(t, bank[:size], 2))}
        assert got == want


def test_diverse_supports(spark):
    rows = [(1, 1, 1.0, ["a"], 3), (1, 2, 0.90, ["b", "c"], 3), (1, 3, 0.89, ["b", "c"], 3), (1, 4, 0.80, ["d"], 3)]
    pool = spark.createDataFrame(rows, "target_key int, place int, similarity double, words array<string>, wanted int")
    got = [r.place for r in rv.diversify(pool).orderBy("rank").collect()]
    assert got == [1, 2, 4]  # 0.89 - 0.15 < 0.80
    few = spark.createDataFrame(rows[:2], pool.schema)
    assert [r.place for r in rv.diversify(few).orderBy("rank").collect()] == [1, 2]


def test_prompts_and_registered_technique(spark):
    bank = spark.createDataFrame([(i, i, "algebra", f"Solve for x: {i}x + 1 = 9.", f"A: {i}") for i in range(2, 6)], "example_id int, pos int, subject string, problem string, solution string")
    goals = spark.createDataFrame([(1, "Solve for x: 7x + 1 = 9.", "algebra"), (2, "What is life", "algebra")], "target_id int, problem string, requested string")
    rv.register_technique("shout", lambda t: t.select("target_id", F.lit("shout").alias("technique"), F.upper("problem").alias("prompt"), F.lit(None).cast("string").alias("error")))
    try:
        made = {(r.target_id, r.technique): r for r in rv.all_techniques(goals, bank).collect()}
    finally:
        rv.unregister_technique("shout")
    assert made[(1, "few_shot")].prompt.startswith("Solve math problems like the examples below.\n\nQ: Solve for x: ")
    assert made[(1, "few_shot")].prompt.endswith("\n\nQ: Solve for x: 7x + 1 = 9.\nA:")
    assert made[(1, "few_shot")].prompt.count("Q: ") == 3
    assert made[(1, "shout")].prompt == "SOLVE FOR X: 7X + 1 = 9."
    assert made[(2, "zero_shot")].prompt == "Solve the following math problem. \n\nQ: What is life\nA:"


def near_rows(n, seed):
    """Problems with rare words, signatures, copies and texts that differ in spaces only; some with a vector."""
    rng = random.Random(seed)
    rows = []
    for i, (_, text) in enumerate(problems(n, seed)):
        text = f"{text} word{rng.randrange(n)}" if i % 3 == 0 else text
        vector = [rng.uniform(-1, 1) for _ in range(3)] if i % 4 == 0 else None
        rows.append((i, text, text.replace(" ", ""), str(i % 2), vector))
    return rows


@pytest.mark.parametrize("rare,vectors", [(0, False), (2, True), (10**6, False)])
def test_nearest_of_forms_equals_all_pairs(spark, monkeypatch, rare, vectors):
    monkeypatch.setattr(sm, "RARE", rare)
    rows = near_rows(70, 21)
    df = spark.createDataFrame(rows, "id int, problem string, canonical string, signature string, embedding array<float>")
    df = df if vectors else df.drop("embedding")
    made = sm.prepare(df, "problem", "bank").withColumns({"doc_id": F.col("id"), "pos": F.col("id"), "b_group": F.when(F.col("id") % 5 == 0, "g").otherwise("h")})
    goals = sm.prepare(df, "problem", "bank").withColumns({
        "target_key": F.col("id"), "a_group": F.when(F.col("id") % 2 == 0, "both").otherwise("one"), "skip_identical": F.col("id") % 3 != 1, "match_signature": F.col("id") % 7 == 0,
    })
    links = spark.createDataFrame([("both", "g"), ("both", "h"), ("one", "h")], "a_group string, b_group string")
    table = made.select("id", *sm._hashed(made)).toPandas().sort_values("id")
    score, place, whole = sm.scores(table, table), {i: k for k, i in enumerate(table["id"])}, {r[0]: r for r in rows}
    got = {}
    for r in sm.nearest(goals, made, links, 3).collect():
        got.setdefault(r.target_key, []).append((r.place, r.doc_id, round(r.similarity, 9)))
    for t in place:
        met = [
            d for d in place if (t % 2 == 0 or d % 5 != 0) and not (t % 3 != 1 and whole[d][2] == whole[t][2]) and not (t % 7 == 0 and whole[d][3] != whole[t][3])
        ]
        near = sorted((-round(score[place[t], place[d]], 12), d) for d in met)[:3]
        assert [(d, s) for _, d, s in sorted(got.get(t, []))] == [(d, round(-s, 9)) for s, d in near]


def test_nearest_compares_far_fewer_than_all_pairs(spark, monkeypatch):
    """Ten times the rows from one template with a word of their own: what is compared grows far less than a hundredfold."""
    parts, work = sm._parts, []
    monkeypatch.setattr(sm, "_parts", lambda a, b, *ids: (work.append(a.count() * b.count()), parts(a, b, *ids))[1])
    for n in (60, 600):
        df = spark.range(n).selectExpr("id", "concat('Solve for x: ', id % 5, 'x = row', id) problem")
        made = sm.prepare(df, "problem", "bank").withColumns({"doc_id": F.col("id"), "pos": F.col("id"), "canonical": F.col("id").cast("string"), "signature": F.lit(""), "b_group": F.lit("g")})
        goals = made.withColumns({"target_key": F.col("id"), "a_group": F.lit("g"), "skip_identical": F.lit(True), "match_signature": F.lit(False)})
        assert sm.nearest(goals, made, None, 2).count() == 2 * n
    assert work[1] <= 20 * work[0]


def test_long_texts_need_no_index_of_tokens(spark, monkeypatch):
    rows = problems(40, 31)
    df = spark.createDataFrame(rows, "id int, problem string")
    table = df.select(F.col("id").alias("doc_id"), F.lit("d").alias("domain"), F.lit("b").alias("difficulty"), "problem", F.lit("t").alias("winner_technique"))
    scored = spark.createDataFrame([(i, "t", (i * 7 % 11) / 10) for i, _ in rows], "doc_id int, technique string, overall double")
    targets = table.selectExpr("doc_id target_id", "domain", "difficulty", "problem")
    monkeypatch.setattr(sm, "LONG", 10**6)
    want = sorted(sm.match_summary(sm.match_history(targets, table, scored)).collect())
    monkeypatch.setattr(sm, "LONG", 0)
    monkeypatch.setattr(sm, "PAIRS", 50)  # several steps in a task
    assert sorted(sm.match_summary(sm.match_history(targets, table, scored)).collect()) == want
    assert sm.match_work(targets, table, scored)["met_forms"] == 0


def test_cosines_of_odd_vectors(spark, monkeypatch):
    """All parts, with vectors that are null, hold a null, are zero or shorter."""
    from gaugeline.functions import pairs as pr

    monkeypatch.setattr(sm, "QUERIES", 3)
    monkeypatch.setattr(sm, "VECTORS", 4)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(12)] + [(12, None), (13, [1.0, None, 1.0, 0.0]), (14, [0.0] * 4), (15, [1.0, 2.0]), (16, [2.0, 1.0]), (17, [])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = df.withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.vec_id): r.cosine for r in sm.cosines(asked, df).collect()}
    both = asked.withColumnRenamed("embedding", "a").crossJoin(df).where("query_id <> vec_id")
    want = {(r.query_id, r.vec_id): r.c for r in both.select("query_id", "vec_id", pr.cosine(F.col("a"), F.col("embedding")).alias("c")).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (c is None) and (c is None or got[k] == pytest.approx(c, abs=1e-12)) for k, c in want.items())


def test_intents_are_dealt_out_and_scored_by_label(spark, sf):
    from workload import matching as wm

    made = wm.intents(spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    join = plan[: plan.index("Relation")]
    assert "part#" in join and "array_intersect" not in plan
    assert made.where("id = other_id or id % 100 <> 0").count() == 0


@pytest.mark.parametrize("parts", [(3, 4), (1024, 2048)])
def test_pair_layers_equal_the_pair_functions(spark, monkeypatch, parts):
    """All pairs of a group, part by part, with odd vectors, null texts, keys that repeat or are null."""
    from gaugeline.functions import pairs as pr
    from gaugeline.functions import text as tx
    from gaugeline.functions.basics import rounded

    monkeypatch.setattr(sm, "QUERIES", parts[0])
    monkeypatch.setattr(sm, "VECTORS", parts[1])
    rng = random.Random(5)
    odd = [None, [1.0, None, 1.0, 0.0], [0.0] * 4, [1.0, 2.0], [2.0, 1.0], [], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]
    texts = problems(40, 5) + [(40, None), (41, ""), (None, "Solve for x: 2x = 4."), (42, "Solve for x: 2x = 4."), (42, "Solve for x: 2x = 4.")]
    vector = lambda k: [rng.uniform(-1, 1) for _ in range(4)] if k % 3 else odd[k // 3 % len(odd)]
    rows = [(i, ["a", "b", None][k % 7 // 3], text, vector(k)) for k, (i, text) in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, group string, problem string, embedding array<float>")
    df = tg.with_feature_tags(df, "problem", "history", "tags").withColumn("tokens", tx.tokens(F.col("problem"), lx.STOP_WORDS_HISTORY)).drop("problem")
    asked, others = df.where("id % 2 = 0"), df.withColumnRenamed("id", "other_id")
    made = sm.pair_layers(asked, others)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "array_intersect" not in plan and "i#" in plan

    side = lambda d, name: d.select(*[F.col(c).alias(f"{name}_{c}") for c in d.columns])
    both = side(asked, "a").join(side(others, "b"), F.expr("a_group = b_group and a_id <> b_other_id"))
    keys = [F.col(c) for c in ("a_tags", "b_tags", "a_type_key", "b_type_key")]
    cosine = F.when(F.expr("a_embedding is not null and b_embedding is not null"), pr.cosine(F.col("a_embedding"), F.col("b_embedding")))
    lexical, feature, mismatch = pr.jaccard(F.col("a_tokens"), F.col("b_tokens")), pr.feature_similarity(*keys), pr.type_mismatch(*keys)
    both = both.withColumns({"lexical": lexical, "feature": feature, "type_mismatch": mismatch, "cosine": cosine})
    want = both.select("a_id", "b_other_id", rounded(F.col("lexical"), 6), rounded(F.col("feature"), 6), "type_mismatch", rounded(pr.hybrid(F.col("lexical"), F.col("feature"), F.col("type_mismatch"), F.col("cosine")), 6))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


def test_array_rounding_equals_rounded(spark):
    from gaugeline.functions.basics import rounded

    rng = random.Random(6)
    values = [-1.0, 0.0, 1.0, 1 / 128, 3 / 128, 0.12345649995, 0.123456499949, 0.1234565] + [rng.randint(0, 10**6) / 10**6 + rng.choice([-1, 0, 1]) * 10.0 ** rng.randint(-12, -9) + 5e-7 for _ in range(500)] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    want = [r.r for r in df.orderBy("k").select(rounded(F.col("v"), 6).alias("r")).collect()]
    assert sm._rounded(np.array(values)).tolist() == want


def test_pair_scores_are_taken_part_by_part(spark, sf):
    from workload import matching as wm

    made = wm.pair_scores(spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "aggregate(" not in plan
    assert made.where("id = other_id or id % 100 <> 0").count() == 0


def test_routing_labels_each_problem_once(spark, sf, monkeypatch):
    from workload import matching as wm

    seen = []
    tagged = sm.with_feature_tags
    monkeypatch.setattr(sm, "with_feature_tags", lambda *args: seen.append(args) or tagged(*args))
    _, ranked = wm.rankings(spark, sf)
    assert len(seen) == 1 and ranked.count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_labelled_sides_match_as_texts_do(spark):
    texts = [*problems(30, 9), (30, None), (31, " ")]
    docs = spark.createDataFrame([(i, "d", "e", p, "few_shot" if i % 2 else None, i % 3 > 0) for i, p in texts], "doc_id int, domain string, difficulty string, problem string, winner_technique string, has_ground_truth boolean")
    targets = docs.select(F.col("doc_id").alias("target_id"), "domain", "difficulty", "problem")
    scored = docs.select("doc_id", F.lit("few_shot").alias("technique"), (F.col("doc_id") / 40).alias("overall"))
    rows = lambda *sides: sorted(map(repr, sm.match_history(*sides, scored, require_ground_truth=True).collect()))
    assert rows(sm.labelled(targets, "problem"), sm.labelled(docs, "problem")) == rows(targets, docs)
