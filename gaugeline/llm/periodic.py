"""Periodic run detection: stretches of words that repeat with a period.

A run is a stretch with smallest period q (words q apart are equal) that no neighbouring word extends, of at least LEAST words
and two periods. Two places that hold the same word, q apart, lie on the diagonal q; a run of length n is a stretch of n - q
matches on its diagonal. The words are read in order: earlier occurrences open diagonals or lengthen the matches of open ones,
and a diagonal that the next word doesn't lengthen ends and, if long enough, gives its run at once.

What keeps the diagonals sparse, and the work near linear for any text:

* A run of period q needs max(q, LEAST - q) matches in a row. So at distances from ``size`` to twice ``size`` not single words
  but groups of ``size`` words are looked up, for sizes of 6, 12, 24 and so on.
* Inside a stretch of a small period p a group occurs every p words; occurrences at most half a size apart form a cluster.
  Pairs inside a cluster are multiples of p, so no smallest periods. Of two clusters a run crosses, either both end p-periodic
  where the run goes on (pairs of last occurrences show it), or they touch and the run begins within the first p words of the
  second one (pairs of its first occurrence with all of the cluster it touches). This makes O(n) pairs per size.
* A diagonal is lengthened by the largest groups that are equal, not word by word.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from gaugeline.llm.wordhash import utf8

#: Words of a run at least, beside two periods.
LEAST = 12
#: Bytes of text that are split into words at a time.
BLOCK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_ids(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of a text (equal ones for equal words), and the words by number."""
    ids, known, at = [], {}, 0
    while at < len(text):
        cut = _SPACE.search(text, min(len(text), at + BLOCK))
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        for w in words:
            if w not in known:
                known[w] = len(known)
        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return (np.concatenate(ids) if ids else np.empty(0, np.int64)), list(known)


def _ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _repeated(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places, and their names, whose name occurs more than once."""
    again = np.bincount(names)[names] > 1 if len(names) else np.zeros(0, bool)
    return names[again], places[again]


def _groups(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a group of ``size`` words begins that occurs more than once, and the groups' numbers.

    Equal sums of scrambled words sift out most of the places; what is left is compared word by word.
    """
    n = len(ids) - size + 1
    with np.errstate(over="ignore"):
        scrambled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        scrambled ^= scrambled >> np.uint64(29)
        total = scrambled[:n].copy()
        for k in range(1, size):
            total = total * np.uint64(0xBF58476D1CE4E5B9) + scrambled[k : k + n]
    order = np.sort(total)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spot = np.searchsorted(twice, total)
    places = np.flatnonzero(twice[np.minimum(spot, len(twice) - 1)] == total)
    names, width = _ranked(ids[places]), int(ids.max()) + 1
    for k in range(1, size):
        names = _ranked(names * width + ids[places + k])
    return _repeated(names, places)


def _between(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (which range, which key) of sorted keys in the ranges [low, high]."""
    first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
    sizes = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    begin = np.cumsum(sizes) - sizes
    return owner, np.arange(len(owner)) - np.repeat(begin, sizes) + np.repeat(first, sizes)


def _pairs(names: np.ndarray, places: np.ndarray, size: int, n: int, lowest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (to an earlier place) at which a group's diagonal may begin."""
    span = np.int64(n + 2 * size)
    keys = names * span + places
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    near = np.diff(keys) <= size // 2
    first, last = np.concatenate([[True], ~near]), np.concatenate([~near, [True]])
    at, lag = [], []

    def add(of: np.ndarray, among: np.ndarray, least: int) -> None:
        # places of one name are less than n apart, those of two names more than 2 * size
        owner, found = _between(among, of - (2 * size - 1), of - least)
        at.append(of[owner] % span)
        lag.append(of[owner] - among[found])

    if lowest:
        # all pairs of different clusters; inside a cluster the neighbours, whose distance is the small period
        cluster = np.cumsum(first)
        owner, found = _between(keys, keys - (2 * size - 1), keys - 1)
        use = (cluster[owner] != cluster[found]) | (found == owner - 1)
        at.append(keys[owner[use]] % span)
        lag.append(keys[owner[use]] - keys[found[use]])
    else:
        add(keys[first], keys[first], size)
        add(keys[last], keys[last], size)
        # clusters that touch: the first place of one with all places of the one before it
        begins = np.flatnonzero(first)
        after, before = begins[1:], begins[:-1]
        several = after - before > 1
        after, before = after[several], before[several]
        touch = keys[after] - keys[after - 1] <= size + (keys[after - 1] - keys[after - 2]) - 1
        after, before = after[touch], before[touch]
        owner, found = _between(keys, np.maximum(keys[after] - (2 * size - 1), keys[before]), keys[after] - size)
        at.append(keys[after][owner] % span)
        lag.append(keys[after][owner] - keys[found])
    return np.concatenate(at), np.concatenate(lag)


def _beginnings(ids: np.ndarray, least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, memoryview]]]:
    """(place of the last word, distance, words) of the groups with which a diagonal may begin, by place; and per size, the
    largest first, the number of the group at each place, -1 where it occurs once only."""
    size, n = least // 2, len(ids)
    names, places = _groups(ids, size)
    found, groups, lowest = [], [], True
    while len(places):
        whole = np.full(n, -1, np.int32)
        whole[places] = names
        groups.insert(0, (size, memoryview(whole)))
        at, lag = _pairs(names, places, size, n, lowest)
        # of a diagonal's pairs in a row the first one is enough
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(lag) != 0) | (np.diff(at) > 1)
        found.append(np.stack([at[fresh] + size - 1, lag[fresh], np.full(fresh.sum(), size)]))
        # groups of twice the size
        places = places[places + size < n]
        places = places[whole[places + size] >= 0]
        names, places = _repeated(_ranked(whole[places].astype(np.int64) * n + whole[places + size]), places)
        size, lowest = 2 * size, False
    if not found:
        return [], []
    every = np.concatenate(found, axis=1)
    return every[:, np.lexsort((every[1], every[0]))].T.tolist(), groups


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``least`` is even."""
    n = len(ids)
    if n < least:
        return []
    words = memoryview(np.ascontiguousarray(ids))
    beginnings, groups = _beginnings(ids, least)

    def lengthened(place: int, lag: int) -> int:
        """The place after the matches of the diagonal from ``place`` on."""
        for size, names in groups:
            while place < n and names[place] >= 0 and names[place] == names[place - lag]:
                place += size
        while place < n and words[place] == words[place - lag]:
            place += 1
        return place

    def begun(place: int, lag: int) -> int:
        """The first of the matches of the diagonal that lead up to ``place``."""
        for size, names in groups:
            while place - size >= lag and names[place - size] >= 0 and names[place - size] == names[place - size - lag]:
                place -= size
        while place > lag and words[place - 1] == words[place - 1 - lag]:
            place -= 1
        return place

    active: dict[int, int] = {}  # distance: place of the first match
    ends: list[tuple[int, int]] = []  # heap of (place after the last match, distance)
    found: dict[tuple[int, int], int] = {}

    def ended(place: int, lag: int) -> None:
        """A diagonal has matched up to before ``place``. A stretch's smallest period is the least of its periods."""
        first = active.pop(lag)
        if place - first >= max(lag, least - lag):
            key = (first - lag, place - first + lag)
            found[key] = min(found.get(key, lag), lag)

    for place, lag, size in beginnings:
        while ends and ends[0][0] <= place:
            ended(*heapq.heappop(ends))
        if lag not in active:
            active[lag] = begun(place - size + 1, lag)
            heapq.heappush(ends, (lengthened(place + 1, lag), lag))
    while ends:
        ended(*heapq.heappop(ends))
    return sorted((start, length, q) for (start, length), q in found.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay, where every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period by start, then period) and ``collapsed`` (the words
    that stay, joined by one space).

    Words are runs of characters other than space and \\x09-\\x0D, counted from 0. Null text has no words and no runs; columns
    of these names are replaced; rows are documents of their own; an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    source = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def find(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, listed, left = [], [], []
            for data in utf8(batch.column(text)):
                ids, words = word_ids(data)
                made = runs(ids)
                counts.append(len(ids))
                listed.append([{"start": s, "length": n, "period": q} for s, n, q in made])
                left.append(b" ".join([words[k] for k in ids[kept_words(len(ids), made)].tolist()]))
            added = [pa.array(counts, pa.int64()), pa.array(listed, kind), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    return source.mapInArrow(find, f"{schema}, n_words bigint, runs array<{RUN}>, collapsed string")
