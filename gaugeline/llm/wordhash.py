"""64-bit hashes of the words of many texts at once, with numpy.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z in lower case. Its hash is a polynomial over a table of
random values for its bytes, mixed at the end; a shingle's hash mixes the hashes of its words in order. Work arrays are
bounded by ``BLOCK`` bytes of text (or one word, where that is longer), whatever the length of the texts.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTES = stream(256, 1)
_BASE = int(stream(1, 2)[0])
#: What each byte counts: capitals as small letters, white space nothing.
_VALUES = _BYTES[[c + 32 if 65 <= c <= 90 else c for c in range(256)]]
_VALUES[[9, 10, 11, 12, 13, 32]] = 0


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


#: The base is odd and has an inverse, so that a word's sum is brought from its place in a block to the block's begin.
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS, _INVERSES = _powers(BLOCK + 1), _powers(BLOCK + 1, _INVERSE)


def _block(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one stretch of text."""
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts = edges[::2]
    if not len(starts):
        return np.empty(0, _U), starts
    long = len(b) > len(_POWERS)
    powers, inverses = (_powers(len(b)), _powers(len(b), _INVERSE)) if long else (_POWERS, _INVERSES)
    with np.errstate(over="ignore"):
        values = _VALUES.take(b)
        values *= powers[: len(b)]
        # white space adds nothing, so a word's sum is what is new since the last word's end
        sums = np.diff(np.cumsum(values)[edges[1::2] - 1], prepend=_U(0)) * inverses[starts]
        return mix(sums + (edges[1::2] - starts).astype(_U)), starts


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin and end (len(texts) + 1 bounds)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    k = 0
    while k < len(texts):
        if len(texts[k]) > BLOCK:
            for part in _parts(texts[k]):
                h, _ = _block(part)
                hashes.append(h)
                counts[k] += len(h)
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and size + len(texts[end]) + 1 <= BLOCK + 1:
            size += len(texts[end]) + 1
            end += 1
        h, starts = _block(b" ".join(texts[k:end]))
        limits = np.cumsum([len(t) + 1 for t in texts[k:end]])
        counts[k:end] = np.diff(np.searchsorted(starts, limits), prepend=0)
        hashes.append(h)
        k = end
    return (np.concatenate(hashes) if hashes else np.empty(0, _U)), np.concatenate([[0], np.cumsum(counts)])


def _parts(text: bytes):
    """Stretches of about BLOCK bytes that end before white space."""
    at, view = 0, memoryview(text)
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield view[at:end]
        at = end


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; fewer words make one run of their own."""
    if not len(words):
        return np.empty(0, _U)
    width = min(width, len(words))
    factors = stream(width, 100 + width)
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = words[:n] * factors[0]
        for k in range(1, width):
            total = total + words[k : k + n] * factors[k]
    return mix(total)


def sets_of_words(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word runs of each text, from :func:`hash_words`; fewer words make one run."""
    runs, out = shingles(words, width) if len(words) >= width else words[:0], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        # the runs that begin in a text and end in it
        own = np.sort(runs[a : b - width + 1] if b - a >= width else shingles(words[a:b], width))
        out.append(own if len(own) < 2 else own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def utf8(column) -> list[bytes]:
    """An Arrow string column as a list of bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
