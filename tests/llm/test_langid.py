import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from gaugeline.llm import langid
from gaugeline.llm.common import crc_mod
from gaugeline.llm.queries import op3_language_id

TRAIN = [(k, t, lang) for k in range(6) for lang, t in (("en", "the cat and the dog with thing"), ("de", "der hund und die katze nicht schön"), ("fr", "le chat et le chien été"))]


def test_known_words_then_grams(docs_of):
    model = langid.fit(docs_of(TRAIN), F.lit(True))
    assert model.langs == ["de", "en", "fr"]
    rows = [(1, "the dog"), (2, "katzen schönes"), (3, "étés"), (4, None), (5, "12 -- ."), (6, ""), (None, "the the"), (6, "der"), (7, "the " * 50_000 + "der"), (8, "ЖЖЖ")]
    out = {(r["doc_id"], r["text"] if r["text"] is None or len(r["text"]) < 20 else "long"): (r["lang_pred"], r["lang_score"]) for r in langid.predict(docs_of(rows, extra=True), model).collect()}
    assert {k[0]: v[0] for k, v in out.items() if k[0] in (1, 2, 3, 4, 5, 7, None)} == {1: "en", 2: "de", 3: "fr", 4: "und", 5: "und", 7: "en", None: "en"}
    assert out[6, ""][0] == "und" and out[6, "der"][0] == "de" and len(out) == len(rows)
    assert out[8, "ЖЖЖ"] == ("de", 1 / 3)  # nothing known: a tie, the first language
    assert all(0 <= s <= 1 for _, s in out.values())


def test_long_runs_are_judged_whole(docs_of):
    model = langid.fit(docs_of(TRAIN), F.lit(True))
    start = "the" * 22  # more letters than a word that is remembered
    rows = [(1, start), (2, start + "schön" * 2000), (3, start + "été" * 3000), (4, "der " + start + "schön" * 2000), (5, "ø" * 200_000 + "schön" * 200)]
    out = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(docs_of(rows), model).collect()}
    assert {k: v[0] for k, v in out.items()} == {1: "en", 2: "de", 3: "fr", 4: "de", 5: "de"}
    assert all(out[k][1] > 0.9 for k in (2, 3, 4))


def test_fit_counts_ngrams_of_whole_words(docs_of):
    model = langid.fit(docs_of([(1, "a" * 100 + "xyzzy", "en"), (2, "b𐐨𐐩c", "de")]), F.lit(True))
    assert {"xyzzy", "zzy\x03", "a" * 5, "b𐐨𐐩c", "\x02b𐐨", "𐐩"} <= set(model.grams)


def test_no_labels_and_empty(docs_of):
    model = langid.fit(docs_of(TRAIN), F.lit(False))
    assert [r["lang_pred"] for r in langid.predict(docs_of([(1, "the")]), model).collect()] == ["und"]
    assert langid.predict(docs_of(TRAIN).limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op3_language_id(spark, folder).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98


def test_folds(spark):
    import zlib

    got = spark.range(-20, 200).select("id", crc_mod(F.col("id"), 5).alias("k")).collect()
    assert all(r["k"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_numerals_are_no_letters(docs_of):
    """Whatever Unicode calls a number gives ``und``, whatever it calls a letter does not."""
    import unicodedata

    docs = docs_of([(i, t, lang) for i, (t, lang) in enumerate([("the house of the rising sun", "en"), ("das Haus der Sonne", "de")] * 3)])
    model = langid.fit(docs, F.lit(True))
    every = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nd", "Nl", "No")]
    rows = [(1, "½ ² ① Ⅷ 123"), (2, "".join(every)), (3, "½a"), (4, "Ⅷ 一"), (5, "_ 12 _")]
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(docs_of(rows), model).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[3][0] != "und" and got[4][0] != "und"


def _plain_model(rows, words, grams):
    """Log probabilities by plain counting: {kind: {item: {lang: log p}}}, kind 0 words, otherwise the n-gram's length."""
    langs = sorted({lang for _, lang in rows})
    counts = {lang: Counter() for lang in langs}
    for text, lang in rows:
        counts[lang].update(regex.findall(r"\p{L}+", text.lower()))
    top = lambda c, most: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most])
    known = {0: {lang: top(counts[lang], words) for lang in langs}}
    for n in langid.LENGTHS:
        known[n] = {}
        for lang in langs:
            found = Counter()
            for word, times in known[0][lang].items():
                marked = f"\x02{word}\x03"
                for at in range(len(marked) - n + 1):
                    found[marked[at : at + n]] += times
            known[n][lang] = top(found, grams)
    out = {}
    for kind, by_lang in known.items():
        items = set().union(*by_lang.values())
        sums = {lang: sum(by_lang[lang].values()) + 0.5 * (len(items) + 1) for lang in langs}
        out[kind] = {x: {lang: math.log((by_lang[lang].get(x, 0) + 0.5) / sums[lang]) for lang in langs} for x in items}
    return langs, out


def _plain_word(word, langs, model):
    if word in model[0]:
        return model[0][word]
    marked, total, found = f"\x02{word}\x03", dict.fromkeys(langs, 0.0), 0
    for at in range(len(marked)):
        for step, n in enumerate(langid.LENGTHS, 1):
            gram = marked[at : at + n]
            if len(gram) == n and gram in model[n] and gram not in ("\x02", "\x03", "\x02\x03"):
                total = {lang: total[lang] + model[n][gram][lang] - langid.STEP * step for lang in langs}
                found += 1
                break
    return {lang: total[lang] / max(1, found) * max(1.0, len(word) / langid.LONGEST) for lang in langs}


def _plain_prediction(text, langs, model):
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words or not langs:
        return "und", 0.0
    each = {w: _plain_word(w, langs, model) for w in set(words)}
    total = {lang: sum(each[w][lang] for w in words) for lang in langs}
    most = max(total.values())
    odds = {lang: math.exp(total[lang] - most) for lang in langs}
    best = max(langs, key=lambda lang: odds[lang])
    return best, odds[best] / sum(odds.values())


@pytest.mark.parametrize("limits", [None, (40, 60)])
def test_scores_equal_plain_counting(docs_of, monkeypatch, limits):
    """Fit and scores against a version that counts in plain Python, also where the limits on words and n-grams bind."""
    if limits:
        monkeypatch.setattr(langid, "WORDS", limits[0])
        monkeypatch.setattr(langid, "GRAMS", limits[1])
    rng = random.Random(11)
    letters = {"en": "etaoinshr th", "de": "enisratdhuü sch", "fr": "esaitnrulé ou"}
    prose = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    train = [(k, prose(lang, rng.randrange(200)), lang) for k, lang in enumerate(sorted(letters) * 25)] + [(900, "", "en"), (901, None, "de"), (902, "x", None)]
    asked = [(k, rng.choice(["", " ", "1 "]).join(prose(lang, rng.randrange(30)) for lang in rng.choices(sorted(letters), k=3))) for k in range(150)]
    asked += [(500, None), (501, "½ 12"), (502, "Ж"), (503, prose("de", 300).replace(" ", "")), (504, "É" * 200), (505, "the the")]
    langs, model = _plain_model([(t, lang) for _, t, lang in train if t is not None and lang], langid.WORDS, langid.GRAMS)
    rows = langid.predict(docs_of(asked), langid.fit(docs_of(train), F.lit(True))).collect()
    assert len(rows) == len(asked)
    for r in rows:
        want, share = _plain_prediction(r["text"], langs, model)
        assert abs(r["lang_score"] - share) < 1e-9, r
        assert r["lang_pred"] == want or share < 0.5 + 1e-9, r
