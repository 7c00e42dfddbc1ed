import random
import time

from brute import base_digest, base_spans
from pyspark.sql import functions as F

from gaugeline.llm import pii
from gaugeline.llm.queries import op4_personal_data

TEXTS = [
    None, "", "a@b.c_d@e.f", "x a.b+c@mail-1.example.org. 10.0.0.1 1.2.3.4.5.6.7.8 300.1.1.1 0010.000255.1.1",
    "4539 1488 0343 6467 and 4539-1488-0343-6467, 4539148803436468", "+1 (743) 555-3824 / +44 20 7946 0958- +1 ..  +123",
    "é😀 a@b.co 😀 +1 (743) 555-3824", "1" * 30_000, "a" * 30_000 + "@", "1." * 5_000, "+1" + " " * 20_000, "a@b.c " * 2_000,
    "pay to iban DE89 3704 0044 0532 0130 00 now, GB00 WEST 1234 5698 7654 32", "my ssn is 123-45-6789; part 123-45-6789x",
]


def test_base_spans_equal_the_plain_patterns(spark, docs_of):
    rng = random.Random(1)
    made = ["".join(rng.choice("a1.@+- ()%_é\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts = TEXTS + made
    out = pii.find_personal_data(docs_of(list(enumerate(texts)), extra=True)).select("doc_id", "pii").collect()
    assert len(out) == len(texts)
    for row in out:
        got = [(s["start"], s["end"], s["kind"]) for s in row["pii"] if s["kind"] in pii.BASE]
        assert got == base_spans(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_further_kinds_need_their_check(docs_of):
    rows = [(1, TEXTS[-2]), (2, TEXTS[-1]), (3, "number 123-45-6789"), (3, "number 123-45-6789"), (None, "ssn 123-45-6789")]
    out = pii.find_personal_data(docs_of(rows)).select("doc_id", F.transform("pii", lambda s: s["kind"]).alias("k")).collect()
    kinds = sorted((r["doc_id"] or 0, [k for k in r["k"] if k not in pii.BASE]) for r in out)
    assert kinds == [(0, ["ssn"]), (1, ["iban"]), (2, ["ssn"]), (3, []), (3, [])]


def test_redact(docs_of):
    rows = [(1, "write a@b.co or +1 (743) 555-3824."), (2, None), (3, ""), (4, "clean")]
    docs = docs_of(rows).withColumn("pii", F.lit("own"))
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("pii = 'own'").collect()}
    assert out == {1: "write [removed] or [removed].", 2: None, 3: "", 4: "clean"}


def test_time_is_linear_in_the_matches(docs_of):
    """10 MB of addresses in one text; the positions stay right, also behind wider characters and for redaction."""
    n = 1_100_000
    docs = docs_of([(1, "é" + "10.0.0.1 " * n)])
    start = time.time()
    row = pii.find_personal_data(docs).select(F.size("pii").alias("n"), F.element_at("pii", -1).alias("last")).first()
    assert (row["n"], row["last"]["start"], row["last"]["end"]) == (n, 9 * n - 8, 9 * n) and time.time() - start < 90
    small = docs_of([(1, "é😀" + "10.0.0.1 a@b.co😀x " * 3000)])
    assert pii.redact(small).first()["text"] == "é😀" + "[removed] [removed]😀x " * 3000


def test_redact_merges_overlapping_spans(docs_of):
    rows = [(1, "a+4539148803436467@b.co1.2.3.4 +1 (743) 555-3824"), (2, "x 1.2.3.4@b.co y")]
    found = {r["doc_id"]: r["pii"] for r in pii.find_personal_data(docs_of(rows)).collect()}
    for r in pii.redact(docs_of(rows)).collect():
        text, at, out = dict(rows)[r["doc_id"]], 0, ""
        for s in found[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[removed]"
            at = max(at, s["end"])
        assert r["text"] == out + text[at:]


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r["base_sha256"] == base_digest(texts[r["doc_id"]]) for r in rows)
    assert sum(r["n_email"] + r["n_card"] + r["n_phone"] for r in rows) > 0
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_need_a_hint_letters_digits_and_entropy(spark, docs_of):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [
        f'é token = "{key}" end', f"commit {key}", "token " + "ab" * 20, "token " + "a1" * 20, "secret: wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY==",
        "token " + key * 6, "token " + key[:19], None, "", "x" * 300_000 + " token 1" + "y" * 300_000, f"password {key} and {key}",
    ]
    rows = pii.find_personal_data(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    found = [[(s.start, s.end) for s in r.pii if s.kind == "secret"] for r in rows]
    assert found[0] == [(11, 51)] and found[4] == [(8, 50)] and found[10] == [(9, 49)]
    assert not any(found[k] for k in (1, 2, 3, 5, 6, 7, 8, 9))
    cleaned = pii.redact(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert cleaned[0].text == 'é token = "[removed]" end' and cleaned[1].text == texts[1]


def test_query_counts_every_kind(spark, tmp_path, docs_of):
    docs_of([(1, "a@b.c and 10.0.0.1, token 04dbebab91ab85687d33eeaaf9ac699e1188f962"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    one, none = op4_personal_data(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.n_iban, one.n_ssn, one.n_secret, one.n_spans) == (1, 1, 0, 0, 0, 0, 1, 3)
    assert (none.n_spans, none.spans) == (0, "")
