"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents of its partition, buffer by buffer, so nothing is shuffled. A document's full windows of
the longest context are sequences of their own. What is left of it goes to the tier of the smallest context that holds
it. Tiers are packed from the longest: the longest piece of a tier opens a window of the tier's size, the gap is filled
with the largest pieces of shorter tiers that fit, and the last bit of the gap with the head of a piece that is cut
there; what the cut leaves goes back to the tier of its new length. So every window is full. Pieces of the last, unfilled
window wait for the next buffer; at the end of the partition they are cut into windows of powers of two. The sequences of
a buffer are dealt to step groups of about equal tokens and, among equal ones, equal attention cost.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from gaugeline.llm.common import held

#: Context sizes; the longest is the limit of a sequence.
TIERS = (2048, 1024, 512, 256)
#: Tokens that a task packs at a time, tokens of a step group, words whose ids a worker remembers,
#: the longest of them, and documents whose words are looked up at a time.
BUFFER, STEP_TOKENS, REMEMBERED, LONGEST, DOCS = 1 << 21, 1 << 16, 800_000, 64, 500
#: Words of these letters only have one lower case and one spelling, and are one piece to the tokenizer.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
)


class Memory(dict):
    """Values by word, made when asked for; at ``most`` words, those not asked for since the last time go."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def hold(self, words: list[str]) -> None:
        """Make sure that all the words, which are distinct, are held until the next call."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.old = {w: x for w, x in self.items() if len(w) <= LONGEST}
            self.clear()
            new = words
        known = self.old
        self.update((w, known[w]) for w in new if w in known)
        new = [w for w in new if w not in known]
        self.update(zip(new, self.make(new), strict=True))


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer lowers case, drops white space and never joins what stands on both sides of it, so the ids of a text are
    those of its words in order. Nor does it join letters with the full stops and commas behind them, so a word of Latin
    letters is looked up in lower case without them, and any other word as it stands. Distinct words are found by Arrow;
    only those that the worker hasn't met go through the tokenizer.
    """

    def __init__(self, tokenizer, most: int = REMEMBERED):
        self.encode = tokenizer.encode_batch
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Memory(self._ids, most)

    def _ids(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if LATIN.fullmatch(w)]
        out = dict(zip(plain, self._letters(plain), strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._each(rest), strict=True))
        return [out[w] for w in words]

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.encode(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters are encoded as one text and cut after each id that ends a word."""
        if not words:
            return []
        ids = np.array(self.encode([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._each(words)
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def of(self, texts) -> list[bytes]:
        """Ids of an Arrow array of texts without nulls, as bytes of unsigned 32-bit numbers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        core = pc.utf8_rtrim(words, characters=".,")
        plain = pc.match_substring_regex(core, f"^{LATIN.pattern}$")
        part = pc.if_else(plain, pc.utf8_lower(core), words)
        tail = pc.if_else(plain, pc.replace_substring_regex(words, r"^.*?([.,]*)$", r"\1"), "")
        parts = pa.concat_arrays([part, tail]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        self.known.hold(names)
        ids = [self.known[x] for x in names]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), "<u4")
        # every word is its part, then its tail
        of_word = parts.indices.to_numpy().reshape(2, -1).T
        chosen = of_word[at].ravel()
        length = sizes[chosen]
        ends = np.cumsum(length)
        place = np.repeat((starts[chosen] - (ends - length)).astype(np.int32), length)
        place += np.arange(len(place), dtype=np.int32)
        out = flat[place]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() * 2 - split.offsets[0].as_py() * 2]
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def learned(model: str, most: int) -> WordIds:
    """What this Python worker knows of the tokenizer; it serves all its tasks."""
    from tokenizers import Tokenizer

    return held(f"packing {hash(model)} {most}", lambda: WordIds(Tokenizer.from_str(model), most))


class Pool:
    """Pieces (document, start, length) by length; the lengths present are the bits of one number."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.present = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.by_length.setdefault(length, []).append((doc, start))
            self.present |= 1 << length

    def take(self, most: int):
        """The largest piece of at most ``most`` tokens."""
        length = (self.present & ((1 << (most + 1)) - 1)).bit_length() - 1
        if length <= 0:
            return None
        doc, start = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length]
            self.present ^= 1 << length
        return doc, start, length


def fill(pool: Pool, tiers=TIERS) -> tuple[list[tuple[int, list]], list]:
    """Full windows (size, pieces) of all tiers, and the pieces of the last window if that isn't full."""
    windows = []
    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while (pool.present >> (shorter + 1)) if shorter else pool.present:
            window = [pool.take(tier)]
            gap = tier - window[0][2]
            while gap and pool.present:
                piece = pool.take(gap)
                if piece is None:
                    # nothing is as short as the gap: cut the head off a piece, of a shorter tier if there is one
                    doc, start, length = pool.take(shorter) or pool.take(tier)
                    pool.put(doc, start + gap, length - gap)
                    piece = (doc, start, gap)
                window.append(piece)
                gap -= piece[2]
            if gap:
                return windows, window
            windows.append((tier, window))
    return windows, []


def binary(pieces: list) -> list[tuple[int, list]]:
    """Windows of powers of two, no two of a size, that hold the pieces in order."""
    left, windows = list(pieces), []
    total = sum(p[2] for p in left)
    while total:
        size = gap = 1 << (total.bit_length() - 1)
        window = []
        while gap:
            doc, start, length = left.pop(0)
            window.append((doc, start, min(gap, length)))
            if length > gap:
                left.insert(0, (doc, start + gap, length - gap))
            gap -= window[-1][2]
        windows.append((size, window))
        total -= size
    return windows


def groups(windows: list[tuple[int, list]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: the longest first, always to the group with the fewest tokens, then the least cost."""
    n = max(1, round(sum(size for size, _ in windows) / step_tokens))
    heap = [(0, 0, g) for g in range(n)]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -windows[k][0]):
        tokens, cost, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (tokens + windows[k][0], cost + sum(p[2] ** 2 for p in windows[k][1]), g))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers=TIERS, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents and the sequences that hold them.

    ``tokenizer``: path of a tokenizer file, read by the driver; ``remembered``: words whose ids each worker keeps, which
    trades memory for time. A document is its ids, then ``end_id``; null text is empty,
    so every row has at least one id. Returns a row per piece: doc_id, start (ids of the document before it), length, ids
    (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (there, without gaps), tier (the sequence's
    size; all sequences are full), step_group. Rows are packed one by one: repeated rows and null ids are documents of
    their own. Sequence ids carry the number of the partition; a lost task packs its partition to the same pieces again as
    long as it reads the same rows in the same order, so ``docs`` should be a table that was read. An empty table gives no
    piece.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: of fixed size
    longest = tiers[0]

    def task(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from pyspark import TaskContext

        ids_of = learned(model.value, remembered)
        partition = TaskContext.get().partitionId() << 33
        last = array("I", [end_id]).tobytes()
        held, waiting, tokens, made, stepped = {}, [], 0, 0, 0  # held: (doc_id, ids) by the number of the document
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
        ])

        def flush(final: bool):
            nonlocal held, waiting, tokens, made, stepped
            pool, windows = Pool(), []
            for piece in waiting:
                pool.put(*piece)
            old = {p[0] for p in waiting}
            for number, (_, ids) in held.items():
                if number not in old:
                    n = len(ids) // 4
                    full = n - n % longest
                    windows += [(longest, [(number, k, longest)]) for k in range(0, full, longest)]
                    pool.put(number, full, n - full)
            packed, rest = fill(pool, tiers)
            windows += packed
            if final:
                windows, rest = windows + binary(rest), []
            dealt = groups(windows)
            rows = []
            for k, (size, pieces) in enumerate(windows):
                offset = 0
                for number, start, length in pieces:
                    doc_id, ids = held[number]
                    rows.append((doc_id, start, length, ids[start * 4 : (start + length) * 4], len(ids) // 4, partition + made + k, offset, size, partition + stepped + dealt[k]))
                    offset += length
            made, stepped = made + len(windows), stepped + max(dealt, default=-1) + 1
            waiting = rest
            held = {p[0]: held[p[0]] for p in rest}
            tokens = sum(p[2] for p in rest)
            for k in range(0, len(rows), 8192):
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows[k : k + 8192], strict=True), schema, strict=True)], schema=schema)

        number = 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            for k in range(0, len(texts), DOCS):
                for doc_id, ids in zip(doc_ids[k : k + DOCS], ids_of.of(texts.slice(k, DOCS)), strict=True):
                    held[number] = (doc_id, ids + last)
                    tokens += len(ids) // 4 + 1
                    number += 1
                if tokens >= BUFFER:
                    yield from flush(False)
        yield from flush(True)

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)
