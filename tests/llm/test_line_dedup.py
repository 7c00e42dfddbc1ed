from collections import defaultdict

from gaugeline.llm import line_dedup

LONG = "A line of well over forty characters, that comes again"


def brute(rows, least=40, docs=5):
    held = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for doc_id, text in rows:
        for x in (text or "").split("\n"):
            if doc_id is not None and len(key(x)) >= least:
                held[key(x)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or len(held[key(x)]) < docs or doc_id == max(held[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_equals_brute_force(docs_of):
    rows = [(i, f"{LONG if i % 2 else LONG.upper()}\t\nown {i}\n{LONG}\n{'é' * 39}") for i in range(9)]
    rows += [(i, f"short\n{'É' * 40}x") for i in range(20, 24)] + [(24, f" {'É' * 40}X "), (25, f"{'é' * 40}X")]
    rows += [(40, None), (41, ""), (42, "\n\n"), (None, LONG), (None, LONG), (3, rows[3][1]), (50, "w " * 50_000), (51, LONG + "\n" + "z\n" * 3_000)]
    out = line_dedup.drop_repeated_lines(docs_of(rows, extra=True))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "pos", "size", "start", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=repr)
    assert got == brute(rows)


def test_repeated_rows_are_one_document(docs_of):
    rows = [(1, LONG)] * 6 + [(2, LONG)]
    assert all(r["n_dropped"] == 0 for r in line_dedup.drop_repeated_lines(docs_of(rows)).collect())
    assert line_dedup.drop_repeated_lines(docs_of(rows).limit(0)).count() == 0
    assert [r["text"] for r in line_dedup.drop_repeated_lines(docs_of([(None, "a\nb")])).collect()] == ["a\nb"]


def test_runs_keep_counts_and_the_first_holder(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for batch in ([("a", 9), ("a", 8), ("b", 8)], [("a", 7), ("c", 7)], [("c", 5), ("d", 5), ("d", 5)]):
        runs.add(spark.createDataFrame([(bytearray(x.encode()), d) for x, d in batch], "line binary, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 1]
    got = {bytes(r["line"]).decode(): (r["n_docs"], r["holder"]) for r in runs.totals().collect()}
    runs.forget()
    assert got == {"a": (3, 9), "b": (1, 8), "c": (2, 7), "d": (1, 5)}
