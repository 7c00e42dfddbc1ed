"""Language identification, word first: a known word scores by its log frequency in each language, an unseen word by the
longest of its character n-grams that are known, at every position.

The model is fitted on at most ``SAMPLE`` labelled documents per language, chosen by a hash of the doc_id, and keeps at
most ``WORDS`` words and ``GRAMS`` n-grams of each length per language, so it has a bounded size. Its counts are
aggregated by Spark; every document is then scored in one pass, without a shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import held, letter_runs

#: Bounds of the fit.
SAMPLE, WORDS, GRAMS = 4000, 20_000, 5_000
#: Length of character n-grams, longest first; words carry a mark at both ends. Log penalty per step down from words.
LENGTHS, STEP = (5, 4, 3, 2, 1), 0.5
#: Words and their scores that a task remembers, letters of the longest of them and of one word's weight, texts scored at a time.
REMEMBERED, LONGEST, DOCS = 200_000, 64, 200
#: Positions of a word whose n-grams are added up at a time.
STRETCH = 1 << 16
UNKNOWN = "und"


class Model:
    """Languages, and a row of log probabilities per language for every known word and n-gram."""

    def __init__(self, rows):
        """rows: (lang, kind, item, n); kind 0 is a word, otherwise the length of the n-gram."""
        self.langs = sorted({r[0] for r in rows})
        column = {x: k for k, x in enumerate(self.langs)}
        tables: dict[int, dict[str, np.ndarray]] = {}
        for kind in (0, *LENGTHS):
            items: dict[str, np.ndarray] = {}
            for lang, k, item, n in rows:
                if k == kind:
                    items.setdefault(item, np.zeros(len(self.langs)))[column[lang]] += n
            total = sum(items.values()) + 0.5 * (len(items) + 1) if items else 1.0
            tables[kind] = {x: np.log((v + 0.5) / total) for x, v in items.items()}
        # tables of numbers, and the row of each word and n-gram
        self.words = {x: k for k, x in enumerate(tables[0])}
        self.word_rows = np.array(list(tables[0].values())).reshape(len(tables[0]), len(self.langs))
        # all n-grams in one table, the penalty of their length included
        self.grams: dict[str, int] = {}
        rows = []
        for step, n in enumerate(LENGTHS, 1):
            for x, v in tables[n].items():
                if x not in "\x02\x03":  # a word's end alone says nothing
                    self.grams[x] = len(rows)
                    rows.append(v - STEP * step)
        self.gram_rows = np.array(rows).reshape(len(rows), len(self.langs))

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.word_rows[known]
        marked, grams, total, n_found = f"\x02{word}\x03", self.grams, np.zeros(len(self.langs)), 0
        for begin in range(0, len(marked), STRETCH):
            found = []
            for at in range(begin, min(begin + STRETCH, len(marked))):
                for n in LENGTHS:
                    row = grams.get(marked[at : at + n])
                    if row is not None:
                        found.append(row)
                        break
            total += self.gram_rows[found].sum(0) if found else 0.0
            n_found += len(found)
        # the mean over positions, so that an unseen word weighs like one word, and a longer run like the words it may hold
        return total / max(1, n_found) * max(1.0, len(word) / LONGEST)


class Scorer:
    """A model with the scores of the words it has met."""

    def __init__(self, model: Model, most: int = REMEMBERED):
        self.model, self.langs, self.most = model, model.langs, most
        self.place: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        """Make sure that the scores of all the words are at hand."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place, self.rows, new = {}, self.rows[:0], list(words)
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, [self.model.word(w) for w in new]])

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its share of the likelihoods."""
        words = [letter_runs(t.lower())[0] for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        met = set().union(*words)
        runs = {w: self.model.word(w) for w in met if len(w) > LONGEST}  # not remembered
        self.learn(met - runs.keys())
        out = []
        for own in words:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.zeros(len(self.langs))
            if runs:
                total += sum(runs[w] for w in own if w in runs)
                own = [w for w in own if w not in runs]
            total += self.rows[np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))].sum(0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((self.langs[best], float(odds[best] / odds.sum())))
        return out


def _top(rows: DataFrame, item: str, most: int, kind: int) -> DataFrame:
    """The most frequent items of each language; ties to the smaller item."""
    counted = rows.groupBy("lang", item).agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), item)
    kept = counted.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    return kept.select("lang", F.lit(kind).alias("kind"), F.col(item).alias("item"), "n")


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model of the rows where ``learn`` holds and text and lang are given. Without such rows it knows no language."""
    known = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 48)) / (1 << 48)
    part = F.lit(False)
    for lang, n in sorted(sizes.items()):
        part = part | ((F.col("lang") == lang) & (place < sample / n))
    words = (
        known.where(part)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    top = _top(words, "word", WORDS, 0).persist()
    marked = F.concat(F.lit("\x02"), "item", F.lit("\x03"))
    parts = [top]
    for n in LENGTHS:
        # overlapping, in one walk over the word
        grams = top.select("lang", "n", F.explode(F.regexp_extract_all(marked, F.lit(f"(?=(.{{{n}}}))."), F.lit(1))).alias("gram"))
        parts.append(_top(grams, "gram", GRAMS, n))
    rows = parts[0]
    for part_rows in parts[1:]:
        rows = rows.unionByName(part_rows)
    found = [tuple(r) for r in rows.collect()]  # at most (WORDS + 5 GRAMS) rows per language
    top.unpersist()
    return Model(found)


def predict(docs: DataFrame, model: Model, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1: the share of the language among the model's likelihoods).

    Whole texts are scored. Null text and text without a letter give ``und`` with score 0, as does a model without
    languages; ties go to the language that sorts first. ``remembered`` words are kept by each worker, which trades memory
    for time. Rows are judged one by one. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the limits of the fit
    owner = f"langid {uuid.uuid4().hex}"

    @F.arrow_udf("lang_pred string, lang_score double")
    def judge(texts: pa.Array) -> pa.Array:
        scorer, rows = held(owner, lambda: Scorer(shared.value, remembered)), []
        for k in range(0, len(texts), DOCS):
            rows += scorer.score([x or "" for x in texts.slice(k, DOCS).to_pylist()])
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "lang_score"])

    return docs.withColumn("_judged", judge("text")).withColumns(
        {"lang_pred": F.col("_judged.lang_pred"), "lang_score": F.col("_judged.lang_score")}
    ).drop("_judged")
