import hashlib
import zlib

import pytest

from gaugeline.llm import merkle
from gaugeline.llm.queries import op12_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """Root, and per node the siblings left and right, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place - place % 8
            ways[k].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8])))
        nodes, at = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], ways


def fold(node, way):
    for a, b in way:
        node = H(a, node, b)
    return node


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = (own, *climb([leaf(*r) for r in own]))
    root, tops = climb([trees[g][1] for g in names])
    for g, top in zip(names, tops, strict=True):
        own, subroot, ways = trees[g]
        for r, way in zip(own, ways, strict=True):
            way = way + top
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            shown = leaf(*r[:4], lower(r[4])) if touched else leaf(*r)
            made = fold(shown, way)
            out.append((r[0], leaf(*r), subroot, root, H(*[a + b for a, b in way]), made, made == root))
    return sorted(out, key=repr)


def rows_of(n, langs=("en", "de", None, "é", "Z", "")):
    heavy = [(i, f"s{i % 3}" if i % 11 else None, langs[0] if i % 3 else langs[i % len(langs)], len(f"Text {i}") if i % 13 else None, f"Text {i} É" if i % 7 else None) for i in range(n)]
    return heavy + [(5_000 + i, "s", f"lone{i}", 1, "A") for i in range(9)]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65, 700])
def test_query_equals_brute_force(spark, tmp_path, n):
    rows = rows_of(n)[: n or None] if n < 10 else rows_of(n)
    rows = [] if n == 0 else rows
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("text", "doc_id", "n_chars", "lang", "source", "'x' as grp", "1 as place", "2 as n")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted([tuple(r) for r in op12_merkle_manifest(spark, str(tmp_path)).collect()], key=repr) == brute(rows)


def test_several_rounds_of_blocks(spark, monkeypatch):
    """With blocks of one level, 700 leaves take four rounds; the tree stays the same."""
    rows = rows_of(700)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    whole = merkle.verified(merkle.manifest(docs)).select("doc_id", "root", "proof", "verified").collect()
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    small = merkle.verified(merkle.manifest(docs)).select("doc_id", "root", "proof", "verified").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, whole)) and all(r["verified"] for r in small)


def test_repeated_and_unnamed_rows(spark):
    rows = [(1, "s", "en", 1, "A")] * 3 + [(None, None, None, None, None)] * 2 + [(None, "s", None, 0, ""), (2, "s", "en", 3, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    tree = merkle.verified(merkle.manifest(docs)).collect()
    want = brute(rows)
    assert len(tree) == 7 and all(r["verified"] for r in tree)
    assert sorted((r["leaf"], r["subroot"], r["root"]) for r in tree) == sorted(r[1:4] for r in want)


def test_a_changed_leaf_does_not_verify(spark):
    docs = spark.createDataFrame(rows_of(80), "doc_id long, source string, lang string, n_chars long, text string")
    from pyspark.sql import functions as F

    tree = merkle.verified(merkle.manifest(docs, tampered=F.when(F.col("doc_id") == 3, F.lit("other"))))
    assert [r["doc_id"] for r in tree.where("not verified").collect()] == [3]
