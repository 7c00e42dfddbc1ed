"""Large JSON documents read in slices.

A document that holds all records of a file (a list, lists by key, lists by two keys) is cut by Spark's text source at every
``}``, so that the splits of one file go to different tasks. Two passes find the records:

1. Every split says how it changes the place in the document: the brackets that it closes and leaves open, once for a start
   outside of a string and once for a start inside of one. A start that the text rules out (letters outside of strings,
   brackets that do not match) says so and nothing else. One task per file, with two short rows per split, follows these
   changes from the file's start and knows where every split begins.
2. Every split cuts its records. Only records that cross a border are put together by a shuffle key of their own.

Order is kept: ``pos`` rises with the place in the file and has gaps (split start + number of the record in the split).
Strings are in double quotes, as JSON has it. A file whose brackets do not match, or that ends inside of a string or list,
is no document and gives no rows; a missing last ``}`` is forgiven. Entries of lists that are no objects are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A string, a bracket, a quote without an end, or a character that valid JSON has in strings only.
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{}]|"|[^\s\ufeff,:0-9.+\-eEaflnrstuNIiy]', re.S)
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
OPENER = {"}": "{", "]": "["}
#: Kinds of the brackets around a record.
AROUND = {("[",), ("{", "["), ("{", "{", "[")}

CHANGE = "file string, start long, quoted boolean, valid boolean, ends_quoted boolean, closed string, opened string, tail string, unclosed boolean"
STATE = "file string, start long, valid boolean, quoted boolean, stack string, tail string, end long, home_end long"
PIECE = "file string, pos long, part long, outer_key string, inner_key string, text string"


class _Change:
    """What a split does to the place in the document, for one of the two ways to begin."""

    def __init__(self, quoted: bool) -> None:
        self.began, self.quoted, self.valid, self.unclosed = quoted, quoted, True, quoted
        self.closed: list[str] = []
        self.opened: list[tuple[str, str | None, bool]] = []  # kind, key before it, whether the key began in an earlier split
        self.tail: list[str] = []
        self.key: tuple[str | None, bool] = (None, False)

    def feed(self, text: str) -> None:
        if not self.valid:
            return
        at = 0
        if self.quoted:
            end = STRING_END.match(text)
            if end is None:
                self.tail.append(text)
                return
            self.key = ("".join([*self.tail, end.group()[:-1]]), self.unclosed)
            self.tail, self.quoted, self.unclosed, at = [], False, False, end.end()
        for token in TOKEN.finditer(text, at):
            t = token.group()
            if t in "[{":
                self.opened.append((t, *self.key))
            elif t in "]}":
                if not self.opened:
                    self.closed.append(t)
                elif self.opened.pop()[0] != OPENER[t]:
                    break
            elif len(t) > 1:
                self.key = (t[1:-1], False)
            elif t == '"':
                self.quoted, self.tail = True, [text[token.end():]]
                return
            else:
                break
        else:
            return
        self.valid, self.opened, self.closed, self.tail = False, [], [], []

    def row(self, file: str, start: int) -> tuple:
        return (
            file, start, self.began, self.valid, self.quoted, "".join(self.closed), json.dumps(self.opened),
            "".join(self.tail) if self.quoted and self.valid else "", self.unclosed,
        )


def _runs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch, split by split, in their order."""
    number = ((frame["file"] != frame["file"].shift()) | (frame["start"] != frame["start"].shift())).cumsum()
    for _, part in frame.groupby(number, sort=False):
        yield part


def _changes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place, open_now = None, []

    def done() -> pd.DataFrame:
        return pd.DataFrame([c.row(*place) for c in open_now], columns=[f.split()[0] for f in CHANGE.split(", ")])

    for frame in frames:
        for part in _runs(frame):
            here = (part["file"].iloc[0], int(part["start"].iloc[0]))
            if here != place:
                if place is not None:
                    yield done()
                place, open_now = here, [_Change(False)] + ([_Change(True)] if here[1] else [])
            text = "}".join(part["value"]) + "}"
            for change in open_now:
                change.feed(text)
    if place is not None:
        yield done()


def _states(frame: pd.DataFrame) -> pd.DataFrame:
    """Where every split of one file begins, from the changes of the splits before it."""
    changes = {(int(r.start), bool(r.quoted)): r for r in frame.itertuples()}
    starts = sorted({s for s, _ in changes})
    ends = dict(zip(starts, [s - 1 for s in starts[1:]] + [2**62], strict=True))
    stack: list[tuple[str, str | None, int]] = []  # kind, key, split that opened it
    quoted, tail, valid, states = False, "", True, []
    for start in starts:
        change = changes.get((start, quoted))
        if change is None or not change.valid:
            valid = False
            break
        level = _record_level([k for k, _, _ in stack])
        home_end = ends[stack[level][2]] if level is not None else None
        # an open string outside of records may be a key
        states.append((quoted, json.dumps([(k, key) for k, key, _ in stack]), tail if level is None else "", ends[start], home_end))
        for number, closer in enumerate(change.closed):
            if stack and stack[-1][0] == OPENER[closer]:
                stack.pop()
            else:  # only the brace that stands for the end of the file may be one too many
                valid = valid and not stack and start == starts[-1] and number == len(change.closed) - 1
        for kind, key, partial in json.loads(change.opened):
            stack.append((kind, (tail if partial else "") + (key or ""), start))
        tail = (tail if change.unclosed else "") + change.tail
        quoted = bool(change.ends_quoted)
    valid = valid and not stack and not quoted
    file = frame["file"].iloc[0]
    if not valid:
        states = [(False, "[]", "", 0, None)] * len(starts)
    made = [(file, s, valid, *state) for s, state in zip(starts, states, strict=True)]
    return pd.DataFrame(made, columns=[f.split()[0] for f in STATE.split(", ")]).astype({"home_end": "Int64"})


def _record_level(kinds: list[str]) -> int | None:
    """Place of the record's own bracket in a stack, where there is one."""
    for level in (1, 2, 3):
        if len(kinds) > level and kinds[level] == "{" and tuple(kinds[:level]) in AROUND:
            return level
    return None


class _Cutter:
    """Cuts the records of one split, given where it begins."""

    def __init__(self, first) -> None:
        self.file, self.start, self.end, self.quoted = first.file, int(first.start), int(first.end), bool(first.quoted)
        self.stack = [tuple(x) for x in json.loads(first.stack)]
        level = _record_level([k for k, _ in self.stack])
        self.inside = 0 if level is None else len(self.stack) - level  # brackets open in the record
        if level is not None:
            self.stack = self.stack[:level]
        self.pos = int(first.home_end) if level is not None else None
        self.count, self.key = 0, first.tail
        self.parts: list[str] = []

    def _keys(self) -> tuple[str | None, str | None]:
        # the key of a bracket in an object; two levels of keys at most
        keys = [json.loads(f'"{key}"') for (kind, _), (_, key) in zip(self.stack, self.stack[1:], strict=False) if kind == "{"]
        return (keys + [None, None])[0], (keys + [None, None])[1]

    def feed(self, text: str) -> list[tuple]:
        made, at = [], 0
        begin = 0 if self.inside else None
        if self.quoted:
            end = STRING_END.match(text)
            if end is None:
                if self.inside:
                    self.parts.append(text)
                else:
                    self.key += text
                return made
            self.quoted, at = False, end.end()
            self.key += end.group()[:-1]
        for token in TOKEN.finditer(text, at):
            t = token.group()
            if self.inside:
                if t in "[{":
                    self.inside += 1
                elif t in "]}":
                    self.inside -= 1
                    if not self.inside:
                        self.parts.append(text[begin:token.end()])
                        pos = self.start + self.count if self.pos is None else self.pos
                        self.count += self.pos is None
                        made.append(self._piece(pos))
                        self.pos, begin = None, None
                elif t == '"':
                    self.quoted, self.key = True, ""
            elif t == "{" and tuple(k for k, _ in self.stack) in AROUND:
                self.inside, begin = 1, token.start()
            elif t in "[{":
                self.stack.append((t, self.key))
            elif t in "]}":
                if self.stack:
                    self.stack.pop()
            elif t == '"':
                self.quoted, self.key = True, text[token.end():]
            else:
                self.key = t[1:-1]
            if self.quoted:
                break
        if self.inside:
            self.parts.append(text[begin:])
        return made

    def _piece(self, pos: int) -> tuple:
        piece = (self.file, pos, self.start, *self._keys(), "".join(self.parts))
        self.parts = []
        return piece

    def rest(self) -> list[tuple]:
        """The beginning of a record that ends in a later split."""
        return [self._piece(self.end if self.pos is None else self.pos)] if self.inside else []


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [f.split()[0] for f in PIECE.split(", ")]
    cutter = None
    for frame in frames:
        made = []
        for part in _runs(frame):
            first = next(part.head(1).itertuples())
            if cutter is None or (cutter.file, cutter.start) != (first.file, first.start):
                made += cutter.rest() if cutter else []
                cutter = _Cutter(first)
            made += cutter.feed("}".join(part["value"]) + "}")
        yield pd.DataFrame(made, columns=columns)
    if cutter:
        yield pd.DataFrame(cutter.rest(), columns=columns)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the JSON documents below ``path``: file, pos, outer_key, inner_key, item (JSON text)."""
    found = spark.read.option("lineSep", "}").text(path)
    braces = found.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("number"), "value",
    )
    changes = braces.select("file", "start", "value").mapInPandas(_changes, CHANGE)
    states = changes.groupBy("file").applyInPandas(_states, STATE)
    moved = F.raise_error(F.lit("the files were split in another way in the second pass; read them again"))
    # the join may shuffle the rows, but a split stays in one partition
    placed = braces.join(states, ["file", "start"], "left").where(F.coalesce(F.col("valid"), moved.cast("boolean")))
    cut = placed.sortWithinPartitions("file", "start", "number").select("file", "start", "value", "quoted", "stack", "tail", "end", "home_end")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    return cut.mapInPandas(_pieces, PIECE).groupBy("file", "pos").agg(
        F.min_by("outer_key", "part").alias("outer_key"), F.min_by("inner_key", "part").alias("inner_key"), F.array_join(parts, "").alias("item")
    )
