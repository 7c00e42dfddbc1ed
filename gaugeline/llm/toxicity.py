"""Toxic spans with a linear-chain conditional random field.

Documents carry labels, their words don't: in labelled documents a word counts as toxic where the word or one of its
beginnings stands in toxic documents far oftener than chance allows. A two-state chain (clean, toxic) is fitted to these
tagged words by gradient ascent on the exact likelihood. Forward-backward marginals give every word of a text its
probability; the document's score is the chance that at least one of the suspicious words is toxic, and stretches of
words above ``SPAN`` are returned with their offsets.

The chain is fitted on at most ``SAMPLE`` documents per class, chosen by a hash of the doc_id; of a longer one it sees a
stretch of ``CHARS`` code points at a place that the hash names. Every document is then scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import held, letter_runs

#: Bounds of the fit, its rounds, and the least documents and largest chance for a feature to mark a word as toxic.
SAMPLE, CHARS, ROUNDS = 1000, 10_000, 20
LEAST, CHANCE, SHARE = 3, 1e-7, 0.9
#: Beginnings of words that are features, marginals that count for a score and make a span, words remembered by a task.
BEGINNINGS, COUNTED, SPAN, REMEMBERED = (4, 5, 6), 0.1, 0.5, 300_000
#: Words that are judged at a time, and words of one column of the chain's matrices.
TOKENS, ROW = 1 << 20, 128


def features(word: str) -> list[tuple[str, str]]:
    """The word in lower case and its beginnings; each with the feature that stands for it where it is unknown."""
    w = word.lower()
    return [(w, "?"), *[(f"{w[:n]}*", f"?{n}") for n in BEGINNINGS if len(w) > n]]


def _running(m: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Vectors v[t] = m[t] v[t-1], scaled to sum 1; m has shape (2, 2, n). Products of ROW matrices are made side by side."""
    n = m.shape[2]
    columns = -(-n // ROW)
    padded = np.zeros((2, 2, columns * ROW))
    padded[0, 0] = padded[1, 1] = 1.0
    padded[:, :, :n] = m
    steps = padded.reshape(2, 2, columns, ROW)
    whole = np.zeros((2, 2, columns))
    whole[0, 0] = whole[1, 1] = 1.0
    for k in range(ROW):
        whole = np.einsum("ijc,jkc->ikc", steps[..., k], whole)
        whole /= whole.sum((0, 1))
    v = np.empty((2, columns))
    at = start.astype(float)
    for c in range(columns):
        v[:, c] = at
        at = whole[:, :, c] @ at
        at = at / at.sum()
    out = np.empty((2, columns, ROW))
    for k in range(ROW):
        v = np.einsum("ijc,jc->ic", steps[..., k], v)
        v /= v.sum(0)
        out[..., k] = v
    return out.reshape(2, -1)[:, :n]


class Chain:
    """log odds of the toxic state by feature; log potentials of the start and of the steps between states."""

    def __init__(self, weights: dict[str, float], bias: float, start: float, steps: np.ndarray):
        self.weights, self.bias, self.start, self.steps = weights, bias, start, steps

    def emissions(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        """Log odds of each word; ``known`` remembers those of words that were met."""
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.bias + sum(self.weights.get(f, self.weights.get(other, 0.0)) for f, other in features(w))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def marginals(self, emissions: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """P(toxic) of each word; ``firsts`` marks the first word of each text."""
        return _forward_backward(emissions, firsts, self.start, self.steps)[0]


def _forward_backward(e: np.ndarray, firsts: np.ndarray, start: float, steps: np.ndarray):
    """Marginals of the toxic state, and the expected counts of all four steps."""
    n = len(e)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    psi, a = np.exp(np.clip(e, -30, 30)), np.exp(steps)
    m = np.empty((2, 2, n))
    m[0, 0], m[0, 1], m[1, 0], m[1, 1] = a[0, 0], a[1, 0], psi * a[0, 1], psi * a[1, 1]
    m[0][:, firsts] = 1.0
    m[1][:, firsts] = psi[firsts] * np.exp(start)
    ahead = _running(m, np.array([0.5, 0.5]))
    lasts = np.append(firsts[1:], True)
    follow = np.append(psi[1:], 1.0)
    m[0, 0], m[0, 1], m[1, 0], m[1, 1] = a[0, 0], a[0, 1] * follow, a[1, 0], a[1, 1] * follow
    m[:, :, lasts] = 1.0
    behind = _running(np.ascontiguousarray(m[:, :, ::-1]), np.array([0.5, 0.5]))[:, ::-1]
    both = ahead * behind
    p = both[1] / both.sum(0)
    inner = np.flatnonzero(~firsts)
    pairs = np.empty((2, 2, len(inner)))
    for i in range(2):
        for j in range(2):
            pairs[i, j] = ahead[i, inner - 1] * a[i, j] * (psi[inner] if j else 1.0) * behind[j, inner]
    return p, (pairs / pairs.sum((0, 1))).sum(2)


def _marks(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that stand in toxic documents far oftener than chance allows; copies count once.

    Whole words come first, then their beginnings, the longest first, each seen only in words that nothing marks yet and
    only if at least LEAST different words have it: a word that is toxic by itself says nothing about its beginning.
    """
    seen, kept, sizes = set(), [], [0, 0]
    for words, toxic in docs:
        key = hash(tuple(words))
        if key not in seen:
            seen.add(key)
            sizes[toxic] += 1
            kept.append(({w.lower() for w in words}, toxic))
    share, found = sizes[1] / max(1, sum(sizes)), set()
    open_words: dict[str, bool] = {w: True for words, _ in kept for w in words}
    for n in (0, *sorted(BEGINNINGS, reverse=True)):
        named = {w: w if not n else f"{w[:n]}*" for w, free in open_words.items() if free and (not n or len(w) > n)}
        variety = Counter(named.values())
        counts = (Counter(), Counter())
        for words, toxic in kept:
            counts[toxic].update({named[w] for w in words if w in named})
        fresh = set()
        for f, k in counts[1].items():
            total = k + counts[0][f]
            q = k / total
            if k >= LEAST and q >= SHARE and q > share > 0 and (not n or variety[f] >= LEAST):
                # Chernoff bound of so many toxic documents among all that have it, were they drawn by chance
                away = q * math.log(q / share) + (0.0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - share)))
                if -total * away < math.log(CHANCE):
                    fresh.add(f)
        found |= fresh
        for w, f in named.items():
            if f in fresh:
                open_words[w] = False
    return found


def train(rows: list[tuple[str, int]]) -> Chain:
    """A chain of (text, toxic) rows. Toxic documents without a toxic word say nothing about words and are left out."""
    docs = [(letter_runs(text or "")[0], int(toxic)) for text, toxic in rows]
    marks = _marks(docs)
    tagged = []
    for words, toxic in docs:
        of = {w: bool(toxic) and any(f in marks for f, _ in features(w)) for w in set(words)}
        if words and (not toxic or any(of.values())):
            tagged.append((words, [of[w] for w in words]))
    often = Counter(f for words, _ in tagged for w in set(words) for f, _ in features(w))
    variety = Counter(f for w in {w.lower() for words, _ in tagged for w in words} for f, _ in features(w))
    common = sorted(f for f, n in often.items() if n >= LEAST and (f[-1] != "*" or variety[f] >= LEAST))
    index = {f: k for k, f in enumerate(["?", *[f"?{n}" for n in BEGINNINGS], *common])}
    words = [w for ws, _ in tagged for w in ws]
    y = np.array([t for _, ts in tagged for t in ts], bool)
    if not y.any():
        return Chain({}, -20.0, 0.0, np.zeros((2, 2)))
    firsts = np.zeros(len(words), bool)
    firsts[np.cumsum([0] + [len(ws) for ws, _ in tagged[:-1]])] = True
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    word_at = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    pairs = np.array([(k, index.get(f, index[other])) for w, k in distinct.items() for f, other in features(w)], np.int64).reshape(-1, 2)
    # potentials: feature weights, bias, start, two steps into and out of the toxic state
    w, bias, start, steps = np.zeros(len(index)), -4.0, 0.0, np.array([[0.0, -1.0], [-1.0, 0.0]])
    inner = np.flatnonzero(~firsts)
    told = np.zeros((2, 2))
    np.add.at(told, (y[inner - 1].astype(int), y[inner].astype(int)), 1.0)
    size = len(index)
    moment, square = np.zeros(size + 6), np.zeros(size + 6)
    for t in range(1, ROUNDS + 1):
        score = bias + np.bincount(pairs[:, 0], w[pairs[:, 1]], len(distinct))
        p, expected = _forward_backward(score[word_at], firsts, start, steps)
        miss = y - p
        by_word = np.bincount(word_at, miss, len(distinct))
        slope = np.concatenate([
            np.bincount(pairs[:, 1], by_word[pairs[:, 0]], size) - 0.01 * w, [miss.sum(), miss[firsts].sum()], (told - expected).ravel() - 0.1 * steps.ravel(),
        ])
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.3 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        w, bias, start, steps = w + move[:size], bias + move[size], start + move[size + 1], steps + move[size + 2 :].reshape(2, 2)
    return Chain({f: float(w[k]) for f, k in index.items()}, float(bias), float(start), steps)


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled documents per class where ``learn`` holds.

    Those with the smallest hashes of doc_id and text are taken, repeated rows count once; of a text a stretch of CHARS code
    points, placed by a hash. A document is toxic if any of its labels is 1.
    """
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    known = docs.where(learn & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    keys = known.select("doc_id", "mark").join(judged, "doc_id").distinct()
    order = [F.xxhash64("doc_id", "mark"), F.col("doc_id"), F.col("mark")]
    first = [keys.where(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * sample rows
    start = F.pmod(F.xxhash64(F.lit("stretch"), "doc_id"), F.greatest(F.length("text") - CHARS + 1, F.lit(1))) + 1
    stretch = F.substr(F.col("text"), start.cast("int"), F.lit(CHARS)).alias("text")
    return known.join(chosen, ["doc_id", "mark"]).select("doc_id", stretch, "toxic").distinct()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Chain:
    """A chain of the labelled documents where ``learn`` holds, from the bounded sample of them."""
    rows = sampled(docs, labels, learn, sample).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])


SCHEMA = "score double, spans array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, chain: Chain, key: str = "doc_id") -> DataFrame:
    """(key, score, spans) for every row: the chance that a suspicious word is toxic, and the toxic stretches.

    Whole texts are scored; offsets are in code points, the end exclusive. Null, empty and wordless texts score 0 and have
    no spans. Rows are judged one by one, so repeated rows, null keys and ties need no rule. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the sample of the fit
    kind, owner = docs.schema[key].dataType.simpleString(), f"toxicity {uuid.uuid4().hex}"

    def judge(texts: list[str]):
        found = [letter_runs(t) for t in texts]
        words = [ws for ws, _ in found]
        flat = [w for ws in words for w in ws]
        firsts = np.zeros(len(flat), bool)
        ends = np.cumsum([len(ws) for ws in words])
        for ws, end in zip(words, ends, strict=True):
            if ws:
                firsts[end - len(ws)] = True
        p = shared.value.marginals(shared.value.emissions(flat, held(owner, dict)), firsts)
        for text, (ws, pattern), end in zip(texts, found, ends, strict=True):
            own = p[end - len(ws) : end]
            counted = own[own >= COUNTED]
            total = float(1.0 - np.prod(1.0 - counted)) if len(counted) else float(own.max(initial=0.0))
            spans = []
            if len(counted) and counted.max() >= SPAN:
                for k, m in enumerate(pattern.finditer(text)):
                    if own[k] >= SPAN:
                        if spans and spans[-1]["k"] == k - 1:
                            spans[-1] |= {"end": m.end(), "k": k, "p": max(spans[-1]["p"], float(own[k]))}
                        else:
                            spans.append({"start": m.start(), "end": m.end(), "p": float(own[k]), "k": k})
            yield min(1.0, max(0.0, total)), [{x: s[x] for x in ("start", "end", "p")} for s in spans]

    def task(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4 * TOKENS):  # about four characters a word at least
                    size += len(texts[end])
                    end += 1
                rows = list(judge(texts[at:end]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(at, end - at), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], span)],
                    names=[key, "score", "spans"],
                )
                at = end

    return docs.select(key, "text").mapInArrow(task, f"{key} {kind}, {SCHEMA}")
